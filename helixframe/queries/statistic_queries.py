"""Queries over ranking metrics, regression and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import views
from helixframe.operators import diagnostics as dg
from helixframe.operators import ranking as rk
from helixframe.operators import regression as rg
from helixframe.plans.running import running
from helixframe.views import SQL as V
from helixframe.views import table

COLUMNS, CONTROLS = ["y", "d", "c1", "c2"], ["c1", "c2"]
TARGET = "Brand#11"
LOGISTIC = {"one": ["size"], "two": ["size", "share"], "three": ["size", "share", "marks"]}


def _rounded(df, *names, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def ap_by_lang(spark, sf_dir):
    return _rounded(rk.average_precision(views.scored(spark, sf_dir), ["lang"]), "ap")


def auroc_by_lang(spark, sf_dir):
    return _rounded(rk.auroc(views.scored(spark, sf_dir), ["lang"]), "auroc")


def ranking_overall(spark, sf_dir):
    whole = views.scored(spark, sf_dir).withColumn("part", F.lit("all"))
    both = rk.average_precision(whole, ["part"]).join(rk.auroc(whole, ["part"]), "part")
    return _rounded(both, "ap", "auroc")


def trapezoid_auc(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(F.col("event_type"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    return _rounded(rk.trapezoid(points, ["event_type"]), "area", digits=4)


def _differences(spark, sf_dir):
    parts = table(spark, sf_dir, "customer").groupBy("c_mktsegment", (F.col("c_nationkey") % 9).alias("k"))
    halves = parts.agg(F.avg(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal"))).alias("even"), F.avg(F.when(F.col("c_custkey") % 2 == 1, F.col("c_acctbal"))).alias("odd"))
    return halves.where("even is not null and odd is not null").select("c_mktsegment", "k", F.round(F.col("even") - F.col("odd"), 6).alias("d"))


def _numbered_differences(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("k")) - 1  # nine values of k at most
    return _differences(spark, sf_dir).withColumn("k", place.cast("bigint"))


def sign_flip(spark, sf_dir):
    return _rounded(rk.sign_flip(_differences(spark, sf_dir), ["c_mktsegment"], 9), "mean", "p", digits=6)


def bootstrap_mean(spark, sf_dir):
    found = rk.bootstrap_mean(_numbered_differences(spark, sf_dir), ["c_mktsegment"], seed=20260918)
    return _rounded(found, "mean", "lower", "upper", digits=6)


def bootstrap_mean_tiled(spark, sf_dir):
    """Price less fifty times quantity of lineitem, over all rows of a flag: groups as large as the table."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") - 50 * F.col("l_quantity")).alias("d"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string")).alias("id"))
    keyed = rows.withColumn("tile", F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int"))
    pairs = running(keyed, ["flag"], "tile", [F.col("id"), F.col("d")], sums={"k": F.lit(1)}).select("flag", "d", F.col("k").cast("bigint").alias("k"))
    found = rk.tiled_bootstrap_mean(pairs, ["flag"], seed=20260918, replicates=500)
    return found.select("flag", "n_pairs", *[F.round(c, 4).alias(c) for c in ("mean", "lower", "upper")])


def quantiles(spark, sf_dir):
    shares = {f"q{int(1000 * p):03d}": p for p in (0.025, 0.25, 0.5, 0.975)}
    found = rk.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", shares)
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in shares])


def cell_center(spark, sf_dir):
    rows = rg.centred(views.cells(spark, sf_dir), ["cell"], ["y", "d"])
    grid = F.col("cell").alias("cell")
    return rows.groupBy(grid, "trajectory").agg(F.round(F.sum("y"), 5).alias("y"), F.round(F.sum("d"), 5).alias("d"), F.count("*").alias("n"))


def _parts(spark, sf_dir):
    return rg.moments(views.cells(spark, sf_dir), ["cell"], "trajectory", COLUMNS)


def _statistics(gram):
    return rg.partial_statistics(gram, "y", "d", CONTROLS, COLUMNS)


def partial_r(spark, sf_dir):
    found = _statistics(rg.pooled(_parts(spark, sf_dir), ["cell"], [], COLUMNS))
    return _rounded(found.select("n", "within_r", "partial_r"), "within_r", "partial_r", digits=6)


def r2_delta(spark, sf_dir):
    found = _statistics(rg.pooled(_parts(spark, sf_dir), ["cell"], [], COLUMNS))
    return _rounded(found.select("baseline_r2", "full_r2", "delta_r2"), "baseline_r2", "full_r2", "delta_r2", digits=6)


def loo_partial_r(spark, sf_dir):
    found = _statistics(rg.leave_one_out(_parts(spark, sf_dir), ["cell"], "trajectory", COLUMNS))
    return _rounded(found.select("omitted", "n", "partial_r"), "partial_r", digits=6)


def loo_bounds(spark, sf_dir):
    found = _statistics(rg.leave_one_out(_parts(spark, sf_dir), ["cell"], "trajectory", COLUMNS))
    return _rounded(rg.quantile_bounds(found, [], "partial_r"), "minimum", "median", "maximum", digits=6)


def cluster_bootstrap(spark, sf_dir):
    found = rg.cluster_bootstrap(_parts(spark, sf_dir), ["cell"], "trajectory", COLUMNS, "y", "d", CONTROLS, replicates=1000, seed=20260925)
    return _rounded(found, "lower", "upper", digits=6)


def transfer_rmse(spark, sf_dir):
    """How well a fit on half of the trajectories tells y on the other half, without and with d."""
    rows = views.cells(spark, sf_dir)
    found = rg.frozen_transfer(rows.where("trajectory < 5"), rows.where("trajectory >= 5"), ["c1", "c2"], "d", "y")
    return _rounded(found, *found.columns, digits=4)


def _scored(spark, sf_dir):
    return views.scored(spark, sf_dir)


def threshold_fpr(spark, sf_dir):
    return dg.thresholds(_scored(spark, sf_dir), ["lang"], 0.1)


def report_grouping_sets(spark, sf_dir):
    return _rounded(dg.report(_scored(spark, sf_dir), 1500.0, "lang"), "sensitivity", "false_positive_rate", "alert_precision")


def logistic_diag(spark, sf_dir):
    """Three nested logistic diagnostics on document counts, fitted on one half of the ids and applied to all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[#*$%&|<>!]")).cast("double").alias("marks"), F.col("n_chars").cast("double").alias("n_chars"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    rows = rows.select("doc_id", "label", (F.col("marks") / F.greatest("n_chars", F.lit(1.0))).alias("share"), F.log1p("n_chars").alias("size"), F.log1p("marks").alias("marks"))
    frozen = dg.fit_models(rows.where("doc_id % 2 = 0"), LOGISTIC)
    return dg.predictions(rows, frozen).select("doc_id", *[F.round(f"risk_{name}", 6).alias(f"risk_{name}") for name in LOGISTIC])


def _matches(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return parts.select(F.col("l_orderkey").alias("run_id"), F.col("p_brand").alias("target"), F.col("p_size").alias("match_overlap"), (F.col("l_discount") + F.col("l_tax")).alias("p"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("place"))


def reference_best(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    return _rounded(dg.reference_results(runs, _matches(spark, sf_dir), TARGET, 10, 0.05), "p")


def reference_weak(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    return dg.reference_results(runs, _matches(spark, sf_dir), TARGET, 10, 0.05).groupBy("weak").agg(F.count("*").alias("n"))


def pair_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cells = e.groupBy((F.col("user_id") % 40).alias("sample"), F.col("event_type").alias("signal"), F.when(F.col("event_id") % 2 == 0, "oops").otherwise("zoops").alias("model"), F.floor(F.col("event_id") / 2 % 2).cast("int").alias("repeat"))
    wide = dg.complete_pairs(cells.agg(F.max("value").alias("value")), ["sample", "signal"])
    return wide


QUERIES = {
    f.__name__: f
    for f in (ap_by_lang, auroc_by_lang, ranking_overall, trapezoid_auc, sign_flip, bootstrap_mean, bootstrap_mean_tiled, quantiles, cell_center, partial_r, r2_delta, loo_partial_r, loo_bounds, cluster_bootstrap, transfer_rmse, threshold_fpr, report_grouping_sets, logistic_diag, reference_best, reference_weak, pair_pivot)
}

_WHOLE = V["scored"].replace("(SELECT", "(SELECT 'all' AS part,")
_S = f"WITH {V['scored']}"
_AP = """counts AS (SELECT {k}, score, sum(label) AS p, sum(1 - label) AS n FROM v_scored GROUP BY ALL),
 run AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM counts WINDOW w AS (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 ap AS (SELECT {k}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p * tp / (tp + fp)) / sum(p), 9) END AS ap FROM run GROUP BY {k}),
 up AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY score ROWS UNBOUNDED PRECEDING) - n AS below FROM counts),
 auc AS (SELECT {k}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 9) END AS auroc FROM up GROUP BY {k})"""
_DIFF = """d AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY k) - 1 AS k, round(even - odd, 6) AS d FROM (SELECT c_mktsegment, c_nationkey % 9 AS k, avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END) AS even,
  avg(CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END) AS odd FROM customer GROUP BY ALL) WHERE even IS NOT NULL AND odd IS NOT NULL)"""


def _gram(source: str, by: str) -> str:
    """Centred sums of products of source's y, d, c1, c2 by the columns by, and the statistics after two controls, in SQL."""
    keys = f"{by}," if by else ""
    over = f"PARTITION BY {keys} cell"
    names = COLUMNS
    centre = ", ".join(f"{c} - avg({c}) OVER ({over}) AS {c}" for c in names)
    products = ", ".join(f"sum({a} * {b}) AS {a}_{b}" for i, a in enumerate(names) for b in names[i:])
    c1 = {"y": "y_c1", "d": "d_c1", "c2": "c1_c2"}
    step = ", ".join(f"{a}_{b} - {c1[a]} * {c1[b]} / c1_c1 AS e_{a}_{b}" for a, b in (("y", "y"), ("y", "d"), ("d", "d"), ("y", "c2"), ("d", "c2"), ("c2", "c2")))
    second = ", ".join(f"e_{a}_{b} - e_{a}_c2 * e_{b}_c2 / e_c2_c2 AS f_{a}_{b}" for a, b in (("y", "y"), ("y", "d"), ("d", "d")))
    group = f"GROUP BY {by}" if by else ""
    return f"""centred AS (SELECT {keys} cell, {centre} FROM {source}),
 gram AS (SELECT {keys} count(*) AS n, {products} FROM centred {group}),
 one AS (SELECT *, {step} FROM gram), two AS (SELECT *, {second} FROM one),
 stats AS (SELECT {keys} n, round(y_d / sqrt(y_y * d_d), 6) AS within_r, round(f_y_d / sqrt(f_y_y * f_d_d), 6) AS partial_r, round(1 - f_y_y / y_y, 6) AS baseline_r2,
  round(1 - (f_y_y - f_y_d * f_y_d / f_d_d) / y_y, 6) AS full_r2, round(f_y_d * f_y_d / f_d_d / y_y, 6) AS delta_r2 FROM two)"""


_E = {"y": "y_c1", "d": "d_c1", "c2": "c1_c2"}
_STEPS = (
    "one AS (SELECT *, " + ", ".join(f"{a}_{b} - {_E[a]} * {_E[b]} / c1_c1 AS e_{a}_{b}" for a, b in (("y", "y"), ("y", "d"), ("d", "d"), ("y", "c2"), ("d", "c2"), ("c2", "c2"))) + " FROM gram),"
    " two AS (SELECT *, " + ", ".join(f"e_{a}_{b} - e_{a}_c2 * e_{b}_c2 / e_c2_c2 AS f_{a}_{b}" for a, b in (("y", "y"), ("y", "d"), ("d", "d"))) + " FROM one)"
)
_LOO = f"""WITH {V['cells']}, names AS (SELECT DISTINCT trajectory AS omitted FROM v_cells), kept AS (SELECT omitted, c.* FROM names JOIN v_cells c ON c.trajectory <> omitted), {_gram('kept', 'omitted')}"""
_RATES = """count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, count(*) FILTER (WHERE score >= 1500 AND label = 1) AS true_alerts, count(*) FILTER (WHERE score >= 1500 AND label = 0) AS false_alerts,
 round(count(*) FILTER (WHERE score >= 1500 AND label = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 9) AS sensitivity,
 round(count(*) FILTER (WHERE score >= 1500 AND label = 0) / nullif(count(*) FILTER (WHERE label = 0), 0), 9) AS false_positive_rate,
 round(count(*) FILTER (WHERE score >= 1500 AND label = 1) / nullif(count(*) FILTER (WHERE score >= 1500), 0), 9) AS alert_precision"""
_REF = f"""WITH m AS (SELECT l_orderkey AS run_id, p_brand AS target, p_size AS match_overlap, l_discount + l_tax AS p, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem JOIN part ON l_partkey = p_partkey),
 best AS (SELECT * FROM m WHERE target = '{TARGET}' AND match_overlap >= 10 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY p, place) = 1),
 r AS (SELECT g.run_id, coalesce(p, 1.0) AS p, coalesce(match_overlap, 0) AS overlap, CASE WHEN coalesce(p, 1.0) > 0.05 THEN 1 ELSE 0 END AS weak FROM (SELECT o_orderkey AS run_id FROM orders) g LEFT JOIN best USING (run_id))"""
#: Draws as the library makes them: the leading 32 bits of a digest modulo the size.
_DRAW = "CAST(CAST('0x' || substr(sha256({text}), 1, 8) AS UBIGINT) % {n} AS BIGINT)"
_CLUSTER_DRAW = _DRAW.format(text="'20260925|' || replicate || '|' || draw", n="(SELECT count(*) FROM names)")
_SUMS = ", ".join(f"sum(p_{a}_{b} * weight) AS {a}_{b}" for i, a in enumerate(COLUMNS) for b in COLUMNS[i:])
_CLUSTER = f"""WITH {V['cells']}, names AS (SELECT trajectory, row_number() OVER (ORDER BY trajectory) - 1 AS k FROM (SELECT DISTINCT trajectory FROM v_cells)),
 w AS (SELECT replicate, trajectory, count(*) AS weight FROM (SELECT replicate, {_CLUSTER_DRAW} AS k FROM (SELECT unnest(range(1000)) AS replicate), (SELECT unnest(range((SELECT count(*) FROM names))) AS draw)) JOIN names USING (k) GROUP BY ALL),
 parts AS (SELECT cell, trajectory, count(*) AS n, {", ".join(f"sum({c}) AS s_{c}" for c in COLUMNS)}, {", ".join(f"sum({a} * {b}) AS p_{a}_{b}" for i, a in enumerate(COLUMNS) for b in COLUMNS[i:])} FROM v_cells GROUP BY ALL),
 pooled AS (SELECT replicate, cell, sum(n * weight) AS n, {", ".join(f"sum(s_{c} * weight) AS s_{c}" for c in COLUMNS)}, {_SUMS} FROM parts JOIN w USING (trajectory) GROUP BY ALL),
 gram AS (SELECT replicate, {", ".join(f"sum({a}_{b} - s_{a} * s_{b} / n) AS {a}_{b}" for i, a in enumerate(COLUMNS) for b in COLUMNS[i:])} FROM pooled GROUP BY replicate),
 {_STEPS}
SELECT round(quantile_cont(r, 0.025), 6) AS lower, round(quantile_cont(r, 0.975), 6) AS upper, count(*) AS usable FROM (SELECT f_y_d / sqrt(f_y_y * f_d_d) AS r FROM two)"""
_MEAN_DRAW = _DRAW.format(text="'20260918|' || c_mktsegment || '|' || replicate || '|' || draw", n="n")
_BOOTSTRAP = f"""WITH {_DIFF}, s AS (SELECT c_mktsegment, count(*) AS n, avg(d) AS mean FROM d GROUP BY ALL),
 t AS (SELECT c_mktsegment, n, replicate, unnest(range(n)) AS draw FROM s, (SELECT unnest(range(2000)) AS replicate)),
 m AS (SELECT c_mktsegment, replicate, avg(d) AS mean FROM (SELECT c_mktsegment, replicate, {_MEAN_DRAW} AS k FROM t) JOIN d USING (c_mktsegment, k) GROUP BY ALL)
SELECT c_mktsegment, n AS n_pairs, round(s.mean, 6) AS mean, round(quantile_cont(m.mean, 0.025), 6) AS lower, round(quantile_cont(m.mean, 0.975), 6) AS upper FROM m JOIN s USING (c_mktsegment) GROUP BY c_mktsegment, n, s.mean"""
_M = ", ".join(f"avg({c}) AS m_{c}" for c in COLUMNS)
_TRANSFER = f"""WITH {V['cells']}, tr AS (SELECT * FROM v_cells WHERE trajectory < 5), te AS (SELECT * FROM v_cells WHERE trajectory >= 5), m AS (SELECT {_M} FROM tr),
 gram AS (SELECT {", ".join(f"sum(({a} - m_{a}) * ({b} - m_{b})) AS {a}_{b}" for i, a in enumerate(COLUMNS) for b in COLUMNS[i:])} FROM tr, m), {_STEPS},
 full_d AS (SELECT *, f_y_d / f_d_d AS bd FROM two), full_2 AS (SELECT *, (e_y_c2 - bd * e_d_c2) / e_c2_c2 AS b2, e_y_c2 / e_c2_c2 AS a2 FROM full_d),
 coef AS (SELECT bd, b2, (y_c1 - bd * d_c1 - b2 * c1_c2) / c1_c1 AS b1, a2, (y_c1 - a2 * c1_c2) / c1_c1 AS a1 FROM full_2),
 p AS (SELECT y, m_y + a1 * (c1 - m_c1) + a2 * (c2 - m_c2) AS base, m_y + b1 * (c1 - m_c1) + b2 * (c2 - m_c2) + bd * (d - m_d) AS more FROM te, m, coef),
 r AS (SELECT sqrt(avg((base - y) * (base - y))) AS b, corr(base, y) AS br, sqrt(avg((more - y) * (more - y))) AS a, corr(more, y) AS ar FROM p)
SELECT round(b, 4) AS baseline_rmse, round(br, 4) AS baseline_r, round(a, 4) AS augmented_rmse, round(ar, 4) AS augmented_r, round(a - b, 4) AS delta_rmse FROM r"""
SQL = {
    "transfer_rmse": _TRANSFER,
    "cluster_bootstrap": _CLUSTER,
    "bootstrap_mean": _BOOTSTRAP,
    "ap_by_lang": f"{_S}, {_AP.format(k='lang')} SELECT * FROM ap",
    "auroc_by_lang": f"{_S}, {_AP.format(k='lang')} SELECT * FROM auc",
    "ranking_overall": f"WITH {_WHOLE}, {_AP.format(k='part')} SELECT part, ap, auroc FROM ap JOIN auc USING (part)",
    "trapezoid_auc": """SELECT event_type, round(sum((x - px) * (y + py) / 2), 4) AS area FROM (SELECT event_type, CAST(event_id AS DOUBLE) AS x, value AS y, lag(CAST(event_id AS DOUBLE)) OVER w AS px, lag(value) OVER w AS py
 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) GROUP BY event_type""",
    "sign_flip": f"""WITH {_DIFF}, s AS (SELECT c_mktsegment, CAST(count(*) AS INT) AS n_pairs, avg(d) AS mean FROM d GROUP BY ALL),
 flips AS (SELECT c_mktsegment, bits, sum(CASE WHEN (bits >> k) & 1 = 1 THEN -d ELSE d END) / count(*) AS other FROM d, (SELECT unnest(range(512)) AS bits) GROUP BY ALL)
SELECT c_mktsegment, n_pairs, round(any_value(mean), 6) AS mean, count(*) FILTER (WHERE abs(other) + 1e-9 >= abs(mean)) AS extreme, count(*) AS total, round(count(*) FILTER (WHERE abs(other) + 1e-9 >= abs(mean)) / count(*), 6) AS p
FROM flips JOIN s USING (c_mktsegment) WHERE bits < (1 << n_pairs) GROUP BY c_mktsegment, n_pairs""",
    "quantiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS q{int(1000 * p):03d}" for p in (0.025, 0.25, 0.5, 0.975)) + " FROM lineitem GROUP BY l_returnflag",
    "cell_center": f"WITH {V['cells']}, c AS (SELECT cell, trajectory, y - avg(y) OVER (PARTITION BY cell) AS y, d - avg(d) OVER (PARTITION BY cell) AS d FROM v_cells) SELECT cell, trajectory, round(sum(y), 5) AS y, round(sum(d), 5) AS d, count(*) AS n FROM c GROUP BY ALL",
    "partial_r": f"WITH {V['cells']}, {_gram('v_cells', '')} SELECT n, within_r, partial_r FROM stats",
    "r2_delta": f"WITH {V['cells']}, {_gram('v_cells', '')} SELECT baseline_r2, full_r2, delta_r2 FROM stats",
    "loo_partial_r": f"{_LOO} SELECT omitted, n, partial_r FROM stats",
    "loo_bounds": f"{_LOO} SELECT round(min(partial_r), 6) AS minimum, round(median(partial_r), 6) AS median, round(max(partial_r), 6) AS maximum FROM stats",
    "threshold_fpr": f"""{_S}, counts AS (SELECT lang, score, sum(1 - label) AS n FROM v_scored GROUP BY ALL),
 run AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS higher, sum(n) OVER (PARTITION BY lang) AS total FROM counts)
SELECT lang, coalesce(min(CASE WHEN higher <= 0.1 * total THEN score END), nextafter(max(score), CAST('infinity' AS DOUBLE))) AS threshold FROM run GROUP BY lang""",
    "report_grouping_sets": f"{_S} SELECT lang, {_RATES} FROM v_scored GROUP BY GROUPING SETS ((), (lang))",
    "reference_best": f"{_REF} SELECT run_id, round(p, 9) AS p, overlap, weak FROM r",
    "reference_weak": f"{_REF} SELECT weak, count(*) AS n FROM r GROUP BY weak",
    "pair_pivot": """WITH c AS (SELECT user_id % 40 AS sample, event_type AS signal, CASE WHEN event_id % 2 = 0 THEN 'oops' ELSE 'zoops' END AS model, event_id // 2 % 2 AS repeat, max(value) AS value FROM events GROUP BY ALL),
 w AS (SELECT sample, signal, max(value) FILTER (WHERE model = 'oops' AND repeat = 0) AS value_oops_0, max(value) FILTER (WHERE model = 'oops' AND repeat = 1) AS value_oops_1,
  max(value) FILTER (WHERE model = 'zoops' AND repeat = 0) AS value_zoops_0, max(value) FILTER (WHERE model = 'zoops' AND repeat = 1) AS value_zoops_1 FROM c GROUP BY ALL)
SELECT * FROM w WHERE value_oops_0 IS NOT NULL AND value_oops_1 IS NOT NULL AND value_zoops_0 IS NOT NULL AND value_zoops_1 IS NOT NULL""",
}
