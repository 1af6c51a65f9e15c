"""Queries over extension plans, refinement, summaries and the genome join."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import views
from helixframe.operators import extensions as ex
from helixframe.operators import ladders as ld
from helixframe.operators.cohorts import with_settings
from helixframe.operators.comparison import compared, matches
from helixframe.operators.sampling import CHUNK, region_sequences
from helixframe.plans.materialise import broadcast_if_small, checkpointed
from helixframe.queries import plan_queries as pq
from helixframe.queries.statistic_queries import _DRAW, _matches
from helixframe.views import SQL as V
from helixframe.views import table

WIDTHS = [8, 10, 12, 14, 16]
FROZEN = {"features": ["share", "size"], "mean": [0.02, 7.0], "scale": [0.05, 1.2], "coefficients": [-1.5, 0.25], "intercept": 0.4}


def _plan(spark, sf_dir):
    return ld.grid(spark, table(spark, sf_dir, "supplier").count(), 2, pq.LEVELS, ["oops", "zoops"], pq.SEEDS)


def plan_widths(spark, sf_dir):
    return ex.with_widths(ex.restricted(_plan(spark, sf_dir), levels=[100, 75, 50]), WIDTHS).select("run_id", "sample", "signal_percent", "model", "width")


def plan_difference(spark, sf_dir):
    """The expected grid against the cells that events give: which are missing and which are not asked for."""
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample")).withColumn("signal", F.explode(F.array(*map(F.lit, ("click", "view", "buy")))))
    actual = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("signal")).distinct()
    return ex.grid_difference(expected, actual, ["sample", "signal"])


def ladder_midpoints(spark, sf_dir):
    levels = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("sample"), (F.col("p_size") * 2.0).alias("level"))
    return ex.midpoints(levels, ["sample"])


def ladder_refined(spark, sf_dir):
    ladder = ld.nested(pq._slots(spark, sf_dir), ["sample"], pq.LEVELS, pq.SIZE, 20260916)
    return ex.refined(ladder, ["sample"], [90.0, 65.0, 35.0, 5.0], pq.SIZE)


def descriptive_hits(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("value"))
    found = ex.descriptive(runs, _matches(spark, sf_dir), ["model"], 0.05, 20)
    return found.select("model", "n", F.round("mean_value", 4).alias("mean_value"), "hits")


def pair_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") - 10).alias("oops_neg_log10_evalue"), (F.col("l_extendedprice") / 1000 - 5).alias("zoops_neg_log10_evalue"), F.col("l_discount").alias("oops_resampling"), F.col("l_tax").alias("zoops_resampling"), (1 - F.col("l_discount")).alias("oops_ap"), (1 - F.col("l_tax")).alias("zoops_ap"))
    made = ex.pair_features(rows)
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 9).alias(c) for c in ("weakest_log_confidence", "resampling_instability", "minimum_ap")])


def block_bootstrap(spark, sf_dir):
    rows = views.scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("double").alias("other")), "doc_id")
    found = ex.block_bootstrap(rows.select("label", (F.col("doc_id") % 10).alias("block"), "score", "other"), "block", "other", "score", 200, 20260918)
    return found.agg(F.round(F.percentile("delta", F.lit(0.025)), 6).alias("lower"), F.round(F.percentile("delta", F.lit(0.975)), 6).alias("upper"), F.count("delta").alias("usable"))


def frozen_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.regexp_count("text", F.lit("[#*$%&|<>!]")) / F.col("n_chars")).alias("share"), F.log("n_chars").alias("size"))
    return docs.select("doc_id", F.round(ex.sigmoid_scores(docs, FROZEN), 9).alias("score"))


def genome_extract(spark, sf_dir):
    """The letters of every mask region, its start taken modulo the length of its chromosome less the longest region."""
    genome = checkpointed(views.genome(spark, sf_dir))
    sizes = broadcast_if_small(genome.groupBy("chrom").agg(((F.max("piece") + 1) * CHUNK - 80).alias("last")), 10_000)
    regions = views.mask(spark, sf_dir).join(sizes, "chrom").select("chrom", (F.col("start") % F.col("last")).alias("start"), (F.col("start") % F.col("last") + F.col("end") - F.col("start")).alias("end"))
    return region_sequences(regions.distinct(), genome).select("chrom", "start", "end", "seq")


def _label_means(spark, sf_dir):
    """The mean matrix of each label: target_id, pwm."""
    flat = views.matrices(spark, sf_dir).select(F.col("label").cast("bigint").alias("target_id"), F.posexplode(F.flatten("pwm")).alias("at", "p"))
    means = flat.groupBy("target_id", "at").agg(F.avg("p").alias("p")).groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("v"))  # 64 numbers a label
    return means.select("target_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("v", k * 4 + 1, 4)).alias("pwm"))


def motif_compare(spark, sf_dir):
    """Every matrix against the mean matrix of each label."""
    rows = views.matrices(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "pwm")
    found = compared(rows, _label_means(spark, sf_dir), 13)
    return found.select("query_id", "target_id", F.round("score", 6).alias("score"), "overlap")


def motif_matches(spark, sf_dir):
    """The mean matrix of each label against all matrices as a catalogue, with p-, E- and q-values."""
    catalogue = views.matrices(spark, sf_dir).select(F.col("vec_id").alias("target_id"), "pwm")
    found = matches(_label_means(spark, sf_dir).withColumnRenamed("target_id", "query_id"), catalogue, 13)
    return found.select("query_id", "target_id", F.round("p", 9).alias("p"), F.round("e", 6).alias("e"), F.round("q", 9).alias("q"), "shift", "strand", "overlap")


def cohort_settings(spark, sf_dir):
    """A two-step lookup: nation to region to its settings, on every customer."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    factors = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("cohort"), F.col("r_name").alias("factor"))
    targets = region.select(F.col("r_name").alias("factor"), (F.col("r_regionkey") * 3 + 10).alias("width"))
    found = with_settings(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "cohort"), factors, targets)
    return found.groupBy("factor", "width").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean_value"))


QUERIES = {f.__name__: f for f in (plan_widths, plan_difference, ladder_midpoints, ladder_refined, descriptive_hits, pair_features, block_bootstrap, frozen_scores, genome_extract, motif_compare, motif_matches, cohort_settings)}

_Z = " + ".join(f"({x} - {m}) / CAST({s} AS DOUBLE) * {w}" for x, m, s, w in zip(("share", "size"), FROZEN["mean"], FROZEN["scale"], FROZEN["coefficients"], strict=True))
_CORRELATION = "CASE WHEN xx * yy > 0 THEN xy / sqrt(xx * yy) ELSE 0 END"
_COMPARE = f"""WITH {V['matrices']}, t AS (SELECT CAST(label AS BIGINT) AS target_id, k, avg(a) AS a, avg(c) AS c, avg(g) AS g, avg(t) AS t FROM v_pwm GROUP BY ALL),
 s AS (SELECT *, 1 AS plus FROM t UNION ALL SELECT target_id, 15 - k, t, g, c, a, 0 FROM t),
 p AS (SELECT q.vec_id AS query_id, target_id, plus, shift, {" + ".join(f"(q.{b} - 0.25) * (s.{b} - 0.25)" for b in "acgt")} AS xy, {" + ".join(f"(q.{b} - 0.25) * (q.{b} - 0.25)" for b in "acgt")} AS xx, {" + ".join(f"(s.{b} - 0.25) * (s.{b} - 0.25)" for b in "acgt")} AS yy
  FROM v_pwm q, s, (SELECT unnest(range(-3, 4)) AS shift) WHERE q.k = s.k + shift),
 m AS (SELECT query_id, target_id, plus, shift, count(*) AS overlap, sum({_CORRELATION}) / count(*) AS score FROM p GROUP BY ALL)
SELECT query_id, target_id, round(score, 6) AS score, CAST(overlap AS INT) AS overlap FROM m QUALIFY row_number() OVER (PARTITION BY query_id, target_id ORDER BY score DESC, plus DESC, shift) = 1"""

#: Significance the plain way: bins of all pairs of columns, sums of columns by recursion, all alignments.
def matches_sql(width: int, overlap: int) -> str:
    """Matches of the first width columns of the label means with those of all matrices."""
    d = width - overlap
    return f"""WITH RECURSIVE {V['matrices']}, x AS (SELECT CAST(label AS BIGINT) AS query_id, k AS i, avg(a) AS a, avg(c) AS c, avg(g) AS g, avg(t) AS t FROM v_pwm WHERE k < {width} GROUP BY ALL),
 y AS (SELECT vec_id AS target_id, 1 AS plus, k AS j, a, c, g, t FROM v_pwm WHERE k < {width} UNION ALL SELECT vec_id, 0, {width - 1} - k, t, g, c, a FROM v_pwm WHERE k < {width}),
 pairs AS (SELECT query_id, i, target_id, plus, j, {" + ".join(f"(x.{b} - 0.25) * (y.{b} - 0.25)" for b in "acgt")} AS xy, {" + ".join(f"(x.{b} - 0.25) * (x.{b} - 0.25)" for b in "acgt")} AS xx, {" + ".join(f"(y.{b} - 0.25) * (y.{b} - 0.25)" for b in "acgt")} AS yy FROM x, y),
 bins AS (SELECT query_id, i, target_id, plus, j, CAST(floor(round({_CORRELATION}, 9) * 25 + 25.5) AS BIGINT) AS b FROM pairs),
 shares AS (SELECT query_id, i, b, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM y) AS h FROM bins GROUP BY ALL),
 sums(query_id, lo, hi, s, pr) AS (SELECT query_id, i, i + 1, b, h FROM shares WHERE i <= {d}
  UNION ALL SELECT d.query_id, lo, hi + 1, s + b, sum(pr * h) FROM sums d JOIN shares n ON n.query_id = d.query_id AND n.i = d.hi GROUP BY d.query_id, lo, hi, s + b),
 above AS (SELECT query_id, lo, hi, s, least(1.0, sum(pr) OVER (PARTITION BY query_id, lo, hi ORDER BY s DESC)) AS p FROM sums WHERE hi - lo >= {overlap}),
 aligned AS (SELECT query_id, target_id, plus, i - j AS shift, min(i) AS lo, max(i) + 1 AS hi, sum(b) AS s, count(*) AS overlap FROM bins WHERE abs(i - j) <= {d} GROUP BY ALL),
 best AS (SELECT a.*, p FROM aligned a JOIN above o USING (query_id, lo, hi, s) QUALIFY row_number() OVER (PARTITION BY query_id, target_id ORDER BY round(ln(p), 6), plus DESC, shift) = 1),
 whole AS (SELECT *, 1 - power(1 - p, {4 * d + 2}) AS pp, count(*) OVER (PARTITION BY query_id) AS m FROM best),
 placed AS (SELECT *, pp * m / row_number() OVER (PARTITION BY query_id ORDER BY pp, target_id) AS v FROM whole)
SELECT query_id, target_id, round(pp, 9) AS p, round(pp * (SELECT count(*) FROM embeddings), 6) AS e, round(least(1.0, min(v) OVER (PARTITION BY query_id ORDER BY pp DESC, target_id DESC ROWS UNBOUNDED PRECEDING)), 9) AS q,
 CAST(shift AS INT) AS shift, CASE WHEN plus = 1 THEN '+' ELSE '-' END AS strand, CAST(overlap AS INT) AS overlap FROM placed"""


def _ap(score: str, name: str) -> str:
    return f"""{name}_c AS (SELECT replicate, {score} AS score, sum(label * weight) AS p, sum((1 - label) * weight) AS n FROM rows JOIN w USING (block) GROUP BY ALL),
 {name}_r AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS fp FROM {name}_c WINDOW o AS (PARTITION BY replicate ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 {name} AS (SELECT replicate, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * tp / (tp + fp)) / sum(p) END AS ap FROM {name}_r GROUP BY replicate)"""


_BLOCK_DRAW = _DRAW.format(text="'20260918|' || replicate || '|' || draw", n="(SELECT count(*) FROM names)")
_BLOCKS = f"""WITH {V['scored']}, rows AS (SELECT s.doc_id % 10 AS block, label, score, CAST(CAST('0x' || substr(md5(text), 1, 8) AS UBIGINT) AS DOUBLE) AS other FROM v_scored s JOIN documents USING (doc_id)),
 names AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS k FROM (SELECT DISTINCT block FROM rows)),
 w AS (SELECT replicate, block, count(*) AS weight FROM (SELECT replicate, {_BLOCK_DRAW} AS k FROM (SELECT unnest(range(200)) AS replicate), (SELECT unnest(range((SELECT count(*) FROM names))) AS draw)) JOIN names USING (k) GROUP BY ALL),
 {_ap("other", "one")}, {_ap("score", "two")}
SELECT round(quantile_cont(d, 0.025), 6) AS lower, round(quantile_cont(d, 0.975), 6) AS upper, count(d) AS usable FROM (SELECT two.ap - one.ap AS d FROM one JOIN two USING (replicate))"""
SQL = {
    "plan_widths": f"WITH {pq._GRID} SELECT run_id || printf('_w%02d', width) AS run_id, sample, signal_percent, model, width FROM plan, (SELECT CAST(unnest({WIDTHS}) AS INT) AS width) WHERE signal_percent IN (100, 75, 50)",
    "plan_difference": """WITH e AS (SELECT * FROM (SELECT c_custkey AS sample FROM customer), (SELECT unnest(['click', 'view', 'buy']) AS signal)),
 a AS (SELECT DISTINCT user_id AS sample, event_type AS signal FROM events)
SELECT *, true AS missing FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, false FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)""",
    "ladder_midpoints": """SELECT sample, (level + below) / 2 AS level FROM (SELECT sample, level, lag(level) OVER (PARTITION BY sample ORDER BY level) AS below FROM (SELECT DISTINCT p_partkey % 20 AS sample, CAST(p_size * 2.0 AS DOUBLE) AS level FROM part)) WHERE below IS NOT NULL""",
    "ladder_refined": f"""WITH {pq._SLOTS} SELECT sample, CAST(l.level AS DOUBLE) AS level, slot, replacement_rank, CASE WHEN replacement_rank < 20 - k THEN 'negative' ELSE 'positive' END AS source
FROM ranked, (VALUES (90.0, 18), (65.0, 13), (35.0, 7), (5.0, 1)) l(level, k)""",
    "descriptive_hits": """WITH m AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount + l_tax <= 0.05 AND p_size >= 20)
SELECT o_orderpriority AS model, count(*) AS n, round(avg(o_totalprice), 4) AS mean_value, count(m.run_id) AS hits FROM orders LEFT JOIN m ON m.run_id = o_orderkey GROUP BY o_orderpriority""",
    "pair_features": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(ln(1 + greatest(0.0, l_quantity - 10)), ln(1 + greatest(0.0, l_extendedprice / 1000 - 5))), 9) AS weakest_log_confidence,
 round(greatest(l_discount, l_tax), 9) AS resampling_instability, round(least(1 - l_discount, 1 - l_tax), 9) AS minimum_ap FROM lineitem""",
    "frozen_scores": f"""WITH d AS (SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g')) AS DOUBLE) / n_chars AS share, ln(n_chars) AS size FROM documents)
SELECT doc_id, round(1 / (1 + exp(-({FROZEN['intercept']} + {_Z}))), 9) AS score FROM d""",
    "genome_extract": f"""WITH {V['mask']}, {V['sequences']}, g AS (SELECT chrom, string_agg(rpad(whole, CAST((length(whole) + {CHUNK - 1}) // {CHUNK} * {CHUNK} AS INT), 'N'), '' ORDER BY doc_id) AS whole FROM (SELECT *, (['AF','AO','NF','NO','RF','RO'])[CAST(doc_id % 6 AS INT) + 1] AS chrom FROM v_letters) GROUP BY chrom),
 r AS (SELECT DISTINCT chrom, start % (length(whole) - 80) AS start, start % (length(whole) - 80) + "end" - start AS "end" FROM v_mask JOIN g USING (chrom))
SELECT chrom, start, "end", substr(whole, start + 1, "end" - start) AS seq FROM r JOIN g USING (chrom) WHERE "end" <= length(whole)""",
    "motif_compare": _COMPARE,
    "motif_matches": matches_sql(16, 13),
    "block_bootstrap": _BLOCKS,
    "cohort_settings": """SELECT r_name AS factor, r_regionkey * 3 + 10 AS width, count(*) AS n, round(avg(c_acctbal), 6) AS mean_value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}
