"""Contamination ladders, task grids and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.keyed import stage_seed


def ladder_counts(levels: list[float], size: int) -> list[tuple[float, int]]:
    """(level, how many slots keep their positive); fails where a level is no whole number of slots."""
    out = []
    for level in levels:
        exact = size * level / 100
        if abs(round(exact) - exact) > 1e-8:
            raise ValueError(f"level {level} is no whole number of {size} slots")
        out.append((float(level), round(exact)))
    return out


def nested(pairs: DataFrame, by: list[str], levels: list[float], size: int, seed: int) -> DataFrame:
    """by, level, slot, replacement_rank, source and source_id for pairs (slot, positive_id, negative_id).

    Slots are replaced by their rank in a keyed digest, so what a level replaces, a lower level
    replaces too."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), *by, F.col("slot").cast("string")), 256)
    ranked = pairs.withColumn("replacement_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "slot")) - 1)
    steps = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(keep).alias("keep")) for level, keep in ladder_counts(levels, size)]))
    rungs = ranked.withColumn("s", steps)
    out = F.col("replacement_rank") < size - F.col("s.keep")
    return rungs.select(*by, "s.level", "slot", "replacement_rank", F.when(out, "negative").otherwise("positive").alias("source"), F.when(out, F.col("negative_id")).otherwise(F.col("positive_id")).alias("source_id"))


def grid(spark, samples: int, repeats: int, levels: list[float], models: list[str], seeds: dict[str, int]) -> DataFrame:
    """The task plan: one row for each sample, input repeat, level and model, with its seeds and run_id."""
    rows = spark.range(1, samples + 1).select(F.col("id").cast("int").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("input_repeat"))
    rows = rows.withColumn("signal_percent", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    plan = rows.withColumns(
        {
            "sample_seed": stage_seed(seeds["sample"], "sample", F.col("sample"), F.col("input_repeat")),
            "order_seed": stage_seed(seeds["order"], "replacement", F.col("sample"), F.col("input_repeat")),
            "meme_seed": stage_seed(seeds["meme"], "meme", F.col("sample"), F.lit(0)),
        }
    )
    return plan.withColumn("run_id", F.format_string("s%02d_r%02d_p%06.2f_%s", "sample", "input_repeat", "signal_percent", "model"))


def pending(plan: DataFrame, done: DataFrame) -> DataFrame:
    """The tasks of plan without a result in done (run_id, status complete).

    Fails where a result of a planned run differs in any column that plan and done have in
    common (seed, trajectory, motif and so on), or where there are two results of a run."""
    finished = done.where("status = 'complete'")
    twice = finished.groupBy("run_id").count().where("count > 1").take(1)
    if twice:
        raise RuntimeError(f"two results of {twice[0]['run_id']}")
    shared = [c for c in done.columns if c in plan.columns and c != "run_id"]
    if shared:
        both = plan.alias("p").join(finished.alias("d"), F.col("p.run_id") == F.col("d.run_id"))
        differs = F.lit(False)
        for c in shared:
            differs = differs | ~F.col(f"p.{c}").eqNullSafe(F.col(f"d.{c}"))
        other = both.where(differs).select("p.run_id").take(1)
        if other:
            raise RuntimeError(f"a result of another protocol: {other[0]['run_id']}")
    return plan.join(finished.select("run_id"), "run_id", "left_anti").select(plan.columns)


def primary(runs: DataFrame) -> DataFrame:
    """The runs that are primary observations: neither repeats of the order nor of the optimiser."""
    return runs.where("order_repeat = 0 and meme_repeat = 0")


def subset(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """The runs of a list of ids, all of which must be there."""
    kept = runs.where(F.col("run_id").isin(run_ids))
    lost = sorted(set(run_ids) - {r[0] for r in kept.select("run_id").distinct().collect()})  # a list that the caller wrote
    if lost:
        raise ValueError(f"no such runs: {', '.join(lost[:5])}")
    return kept


def fine_grid(spark, samples: int, levels: list[float], models: list[str], seeds: dict[str, int], repeats: int = 2) -> DataFrame:
    """A plan at other levels, which need no ends, on the streams of the original one; its tasks have the role fine_signal_grid."""
    if len(set(levels)) != len(levels) or not all(0 <= x <= 100 for x in levels):
        raise ValueError("levels must differ and lie within 0 and 100")
    return grid(spark, samples, repeats, levels, models, seeds).withColumn("role", F.lit("fine_signal_grid"))


def with_seeds(plan: DataFrame, repeats: int, base: int) -> DataFrame:
    """Every task of plan once for each repeat of the optimiser, with a seed of its own; repeat 0 keeps the run_id and the seed."""
    each = plan.withColumn("meme_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    again = F.col("meme_repeat") > 0
    own = stage_seed(base, "meme", F.col("sample"), F.col("meme_repeat"))
    return each.withColumns({"meme_seed": F.when(again, own).otherwise(F.col("meme_seed")), "run_id": F.when(again, F.concat("run_id", F.format_string("_m%02d", "meme_repeat"))).otherwise(F.col("run_id"))})


def concatenated(cohorts: list[DataFrame]) -> DataFrame:
    """The rows of several cohorts as one table; fails where two share a cohort's name."""
    out = None
    for rows in cohorts:
        out = rows if out is None else out.unionByName(rows)
    total = sum(rows.select("cohort").distinct().count() for rows in cohorts)
    if out.select("cohort").distinct().count() != total:
        raise ValueError("two tables of one cohort")
    return out
