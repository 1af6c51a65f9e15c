"""Extension plans, refinement of ladders, descriptive summaries and paired features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ladders import ladder_counts
from helixframe.operators.ranking import drawn_weights, numbered, replicate_precision
from helixframe.plans.materialise import broadcast_if_small

#: Weights of blocks in replicates that go along with the tasks of a pass; 64 MB.
WEIGHTS = 1 << 23


def with_widths(plan: DataFrame, widths: list[int]) -> DataFrame:
    """Every task of plan at every width, of four columns at least; the width is part of run_id."""
    if any(w < 4 for w in widths):
        raise ValueError("a motif has at least four columns")
    wide = plan.withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    return wide.withColumn("run_id", F.concat("run_id", F.format_string("_w%02d", "width")))


def restricted(plan: DataFrame, samples: list[int] | None = None, levels: list[float] | None = None) -> DataFrame:
    """The tasks of some samples and levels."""
    kept = plan if samples is None else plan.where(F.col("sample").isin(samples))
    return kept if levels is None else kept.where(F.col("signal_percent").isin([float(x) for x in levels]))


def grid_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys with missing: true for cells that are expected and not there, false for cells that are there unasked."""
    lost = expected.select(*keys).exceptAll(actual.select(*keys)).withColumn("missing", F.lit(True))
    return lost.unionByName(actual.select(*keys).exceptAll(expected.select(*keys)).withColumn("missing", F.lit(False)))


def midpoints(levels: DataFrame, by: list[str]) -> DataFrame:
    """by and level: the middle of each pair of neighbouring levels of a group."""
    below = F.lag("level").over(Window.partitionBy(*by).orderBy("level"))
    return levels.select(*by, "level").distinct().withColumn("below_", below).where("below_ is not null").select(*by, ((F.col("level") + F.col("below_")) / 2).alias("level"))


def refined(ladder: DataFrame, by: list[str], levels: list[float], size: int) -> DataFrame:
    """More levels of a ladder on its frozen ranks: by, level, slot, replacement_rank and source."""
    ranks = ladder.select(*by, "slot", "replacement_rank").distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.lit(keep).alias("keep")) for x, keep in ladder_counts(levels, size)]))
    rungs = ranks.withColumn("s", steps)
    return rungs.select(*by, "s.level", "slot", "replacement_rank", F.when(F.col("replacement_rank") < size - F.col("s.keep"), "negative").otherwise("positive").alias("source"))


def descriptive(runs: DataFrame, matches: DataFrame, by: list[str], limit: float, overlap: int) -> DataFrame:
    """by with n, mean_value and hits: runs (run_id, value) of which any match, to whatever target, has p up to limit and enough overlap."""
    hit = matches.where((F.col("p") <= limit) & (F.col("match_overlap") >= overlap)).select("run_id").distinct().withColumn("hit_", F.lit(1))
    return runs.join(hit, "run_id", "left").groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.sum(F.coalesce("hit_", F.lit(0)).cast("bigint")).alias("hits"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """pairs with weakest_log_confidence, resampling_instability and minimum_ap from columns of both models."""
    log = lambda c: F.log1p(F.greatest(F.lit(0.0), F.col(c)))
    return pairs.withColumns(
        {
            "weakest_log_confidence": F.least(log("oops_neg_log10_evalue"), log("zoops_neg_log10_evalue")),
            "resampling_instability": F.greatest("oops_resampling", "zoops_resampling"),
            "minimum_ap": F.least("oops_ap", "zoops_ap"),
        }
    )


def key_text(*columns: str) -> Column:
    """A tuple of columns as text, texts in quotes: the order of summaries is that of these texts, so 100.0 comes before 25.0."""
    shown = [F.concat(F.lit("'"), c, F.lit("'")) if quoted else F.col(c).cast("string") for c, quoted in ((c.removeprefix("'"), c.startswith("'")) for c in columns)]
    return F.concat(F.lit("("), F.concat_ws(", ", *shown), F.lit(",)" if len(columns) == 1 else ")"))


def block_bootstrap(scored: DataFrame, block: str, one: str, two: str, replicates: int, seed: int) -> DataFrame:
    """replicate and delta: average precision by score two less that by score one, over drawn blocks (label, block, one, two).

    A replicate takes as many draws as there are blocks. Rows are counted by block, score and
    label and read once for all replicates, or once for so many that their weights are at most
    WEIGHTS numbers. Replicates of one class have no delta. Blocks are at most WEIGHTS."""
    names = broadcast_if_small(numbered(scored, block))
    rows = scored.join(names, block)
    blocks = names.count()
    if blocks > WEIGHTS:
        raise ValueError(f"more than {WEIGHTS} blocks")
    at_once, out = max(1, WEIGHTS // max(1, blocks)), None
    for first in range(0, replicates, at_once):
        last = min(replicates, first + at_once)
        drawn = drawn_weights(names.agg(F.count("*").alias("n")), [], last, seed, first).select("replicate", "k", "weight").toArrow()
        weights = np.zeros((blocks, last - first))
        weights[drawn["k"].to_numpy(), drawn["replicate"].to_numpy() - first] = drawn["weight"].to_numpy()
        a, b = (replicate_precision(rows.select("label", F.col(c).alias("score"), "k"), weights).withColumnRenamed("ap", c_) for c, c_ in ((one, "a"), (two, "b")))
        part = a.join(b, "replicate").select((F.col("replicate") + first).alias("replicate"), (F.col("b") - F.col("a")).alias("delta"))
        out = part if out is None else out.unionByName(part)
    return out


def sigmoid_scores(rows: DataFrame, model: dict) -> Column:
    """The frozen logistic score of rows: model has features, mean, scale, coefficients and intercept."""
    z = F.lit(float(model["intercept"]))
    for name, mean, scale, weight in zip(model["features"], model["mean"], model["scale"], model["coefficients"], strict=True):
        z = z + (F.col(name) - mean) / scale * weight
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))
