"""Queries over ladders, task plans, matched sampling and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import views
from helixframe.operators import ladders as ld
from helixframe.plans.materialise import broadcast_if_small, checkpointed
from helixframe.views import table

LEVELS, SIZE = [100.0, 75.0, 50.0, 25.0, 10.0, 0.0], 20
SEEDS = {"sample": 20260915, "order": 20260916, "meme": 20260917}
WINDOW = 201


def _slots(spark, sf_dir):
    """Orders as slots of ladders of 20, by runs of order keys; what is left of a run that is not full has no ladder."""
    orders = table(spark, sf_dir, "orders").select((F.floor(F.col("o_orderkey") / SIZE)).alias("sample"), (F.col("o_orderkey") % SIZE).cast("int").alias("slot"), "o_orderkey")
    full = orders.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") == SIZE)
    return orders.join(full, "sample", "left_semi").select("sample", "slot", F.col("o_orderkey").alias("positive_id"), (-F.col("o_orderkey")).alias("negative_id"))


def ladder_records(spark, sf_dir):
    return ld.nested(_slots(spark, sf_dir), ["sample"], LEVELS, SIZE, 20260916)


def ladder_counts(spark, sf_dir):
    rows = ld.nested(_slots(spark, sf_dir), ["sample"], LEVELS, SIZE, 20260916)
    return rows.groupBy("level", "source").agg(F.count("*").alias("n"))


def plan_grid(spark, sf_dir):
    """A task plan with as many samples as the table has suppliers, up to a thousand times ten."""
    n = table(spark, sf_dir, "supplier").count()
    return ld.grid(spark, n, 2, LEVELS, ["oops", "zoops"], SEEDS)


def plan_pending(spark, sf_dir):
    plan = ld.grid(spark, table(spark, sf_dir, "supplier").count(), 2, LEVELS, ["oops", "zoops"], SEEDS)
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") + 0).cast("int").alias("sample"))
    done = plan.join(suppliers, "sample", "left_semi").where("model = 'oops'").select("run_id", "meme_seed", F.lit("complete").alias("status"))
    return ld.pending(plan, done).select("run_id", "sample", "model")


def means_by_level(spark, sf_dir):
    """Events as runs: means by model, level and width, as the extension summary gives them."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", (F.col("user_id") % 5).alias("width")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def _positives(spark, sf_dir):
    """Customers as regions of the genome: record_id, split (a fifth test), chrom, start, end, seq."""
    from helixframe.operators.sampling import CHUNK, region_sequences

    genome = checkpointed(views.genome(spark, sf_dir))
    sizes = broadcast_if_small(genome.groupBy("chrom").agg(((F.max("piece") + 1) * CHUNK - WINDOW).alias("last")), 10_000)
    split = F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split")
    rows = table(spark, sf_dir, "customer").select(F.format_string("cust%08d", "c_custkey").alias("record_id"), split, views.chromosome(F.col("c_custkey")).alias("chrom"), "c_custkey")
    placed = rows.join(sizes, "chrom").select("record_id", "split", "chrom", ((F.col("c_custkey") * 104729) % F.col("last")).alias("start"))
    return genome, checkpointed(region_sequences(placed.withColumn("end", F.col("start") + WINDOW), genome))


def _controls(spark, sf_dir, strict=False):
    from helixframe.operators.sampling import matched_controls

    genome, positives = _positives(spark, sf_dir)
    forbidden = views.mask(spark, sf_dir).unionByName(positives.select("chrom", "start", "end"))
    return positives, matched_controls(positives, genome, forbidden, strict=strict)


def matched_sampling(spark, sf_dir):
    """One control for each train region and ten for each test region; keys that no round serves have no place."""
    positives, controls = _controls(spark, sf_dir)
    return controls.select("split", "record_id", "negative_index", "chrom", "start", "attempt")


def em_discovery(spark, sf_dir):
    from helixframe.operators.discovery import discovered

    tasks = views.sequences(spark, sf_dir).select(F.col("lang").alias("task"), F.col("window_id").alias("doc_id"), "seq")
    found = discovered(tasks, width=8)
    return found.select("task", F.posexplode("pwm").alias("k", "r"), "sites", "log10_evalue").select("task", "k", *[F.round(F.element_at("r", j + 1), 6).alias(b) for j, b in enumerate("acgt")], "sites", F.round("log10_evalue", 3).alias("log10_evalue"))


QUERIES = {f.__name__: f for f in (ladder_records, ladder_counts, plan_grid, plan_pending, means_by_level, matched_sampling, em_discovery)}

_SLOTS = """slots AS (SELECT o_orderkey // 20 AS sample, CAST(o_orderkey % 20 AS INT) AS slot, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_orderkey // 20) = 20),
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample ORDER BY sha256('20260916|' || sample || '|' || slot), slot) - 1 AS INT) AS replacement_rank FROM slots),
 rungs AS (SELECT * FROM ranked, (VALUES (100.0, 20), (75.0, 15), (50.0, 10), (25.0, 5), (10.0, 2), (0.0, 0)) l(level, keep)),
 ladder AS (SELECT sample, CAST(level AS DOUBLE) AS level, slot, replacement_rank, CASE WHEN replacement_rank < 20 - keep THEN 'negative' ELSE 'positive' END AS source,
  CASE WHEN replacement_rank < 20 - keep THEN -o_orderkey ELSE o_orderkey END AS source_id FROM rungs)"""


def _seed(base: int, stream: str, repeat: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256('{base}:{stream}:' || sample || ':' || {repeat}), 1, 8) AS UBIGINT) % 2147483647 AS BIGINT)"


_GRID = f"""plan AS (SELECT sample, input_repeat, signal_percent, model, {_seed(SEEDS['sample'], 'sample', 'input_repeat')} AS sample_seed, {_seed(SEEDS['order'], 'replacement', 'input_repeat')} AS order_seed,
  {_seed(SEEDS['meme'], 'meme', "'0'")} AS meme_seed, printf('s%02d_r%02d_p%06.2f_%s', sample, input_repeat, signal_percent, model) AS run_id
 FROM (SELECT CAST(unnest(range(1, (SELECT count(*) FROM supplier) + 1)) AS INT) AS sample), (SELECT CAST(unnest([0, 1]) AS INT) AS input_repeat),
  (SELECT CAST(unnest([100.0, 75.0, 50.0, 25.0, 10.0, 0.0]) AS DOUBLE) AS signal_percent), (SELECT unnest(['oops', 'zoops']) AS model))"""
SQL = {
    "ladder_records": f"WITH {_SLOTS} SELECT * FROM ladder",
    "ladder_counts": f"WITH {_SLOTS} SELECT level, source, count(*) AS n FROM ladder GROUP BY ALL",
    "plan_grid": f"WITH {_GRID} SELECT * FROM plan",
    "plan_pending": f"WITH {_GRID} SELECT run_id, sample, model FROM plan WHERE NOT (model = 'oops' AND sample IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))",
    "means_by_level": "SELECT event_type, user_id % 5 AS width, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
}
