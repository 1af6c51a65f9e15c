"""New cohorts: inputs of sequences at every level of contamination with their plan, and refinement of frozen ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.keyed import stage_seed
from helixframe.operators.extensions import refined
from helixframe.operators.ladders import ladder_counts
from helixframe.plans.materialise import broadcast_if_small, checkpointed


def with_settings(rows: DataFrame, factors: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (cohort and others) with factor and the settings of its target: factors has cohort and factor, targets factor and the settings.

    Settings are declared, never inferred: fails on a cohort without a factor, a factor without a target, and one that is declared twice."""
    for table, key in ((factors, "cohort"), (targets, "factor")):
        twice = table.groupBy(key).count().where("count > 1").take(1)
        if twice:
            raise ValueError(f"{key} {twice[0][key]} is declared twice")
    both = broadcast_if_small(factors.join(targets.withColumn("known_", F.lit(True)), "factor", "left").withColumn("declared_", F.lit(True)))
    met = rows.join(both, "cohort", "left")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    lost = F.when(F.col("declared_").isNull(), F.concat(F.lit("no factor is declared for cohort "), shown("cohort"))).otherwise(F.concat(F.lit("no target is declared for factor "), shown("factor")))
    return met.where(F.assert_true(F.col("declared_").isNotNull() & F.col("known_").isNotNull(), lost).isNull()).drop("known_", "declared_")


def training_pairs(pairs: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """positive_id and negative_id of the first train pair of each positive (pairs has split and negative_index); fails on a second one or an id without a sequence (id, seq)."""
    own = checkpointed(pairs.where("split = 'train' and negative_index = 1").select("positive_id", "negative_id"))
    if own.groupBy("positive_id").count().where("count > 1").take(1):
        raise ValueError("a positive with two first pairs")
    for side, rows in (("positive_id", positives), ("negative_id", negatives)):
        if own.join(rows.select(F.col("id").alias(side)), side, "left_anti").take(1):
            raise ValueError(f"a pair whose {side} has no sequence")
    return own


def sampled(pairs: DataFrame, samples: int, repeats: int, size: int, seed: int) -> DataFrame:
    """sample, input_repeat, slot, positive_id and negative_id: size pairs for each sample and repeat, the first by keyed digest; slots are in that order.

    Every stream draws from the whole of pairs; ranks beyond size go before the shuffle."""
    streams = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(r).alias("input_repeat")) for s in range(1, samples + 1) for r in range(repeats)]))
    each = pairs.withColumn("stream_", streams).select("positive_id", "negative_id", "stream_.*")
    own = stage_seed(seed, "sample", F.col("sample"), F.col("input_repeat"))
    order = F.sha2(F.concat_ws("|", own.cast("string"), F.col("positive_id").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("sample", "input_repeat").orderBy("order_", "positive_id"))
    # the place itself is held against size: so every task drops its own ranks beyond size, before rows move
    drawn = each.withColumn("order_", order).withColumn("place_", place).where(F.col("place_") <= size).withColumn("slot", F.col("place_") - 1)
    if pairs.limit(size).count() < size:
        raise ValueError(f"fewer than {size} pairs")
    return drawn.drop("order_", "place_")


def cohort_records(pairs: DataFrame, samples: int, repeats: int, size: int, levels: list[float], seeds: dict[str, int], partial: bool = False) -> DataFrame:
    """sample, input_repeat, level, slot, replacement_rank, positive_id, negative_id, source and source_id: every input of a new cohort.

    Fails on levels that repeat, lie outside of 0 to 100, lack an end (unless partial) or are no whole number of slots."""
    if len(set(levels)) != len(levels) or not all(0 <= x <= 100 for x in levels):
        raise ValueError("levels must differ and lie within 0 and 100")
    if not partial and not {0.0, 100.0} <= set(map(float, levels)):
        raise ValueError("both ends are needed")
    if repeats not in (1, 2):
        raise ValueError("one input, or one and its companion")
    by = ["sample", "input_repeat"]
    rows = sampled(pairs, samples, repeats, size, seeds["sample"])
    own = stage_seed(seeds["order"], "replacement", F.col("sample"), F.col("input_repeat"))
    order = F.sha2(F.concat_ws("|", own.cast("string"), F.col("slot").cast("string")), 256)
    ranked = rows.withColumn("replacement_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "slot")) - 1)
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.lit(keep).alias("keep")) for x, keep in ladder_counts(levels, size)]))
    out = F.col("replacement_rank") < size - F.col("s_.keep")
    return ranked.withColumn("s_", steps).select(*by, "s_.level", "slot", "replacement_rank", "positive_id", "negative_id", F.when(out, "negative").otherwise("positive").alias("source"), F.when(out, F.col("negative_id")).otherwise(F.col("positive_id")).alias("source_id"))


def cohort_sequences(records: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """records with id, as their header has it, and seq."""
    both = positives.select(F.lit("positive").alias("source"), F.col("id").alias("source_id"), "seq").unionByName(negatives.select(F.lit("negative").alias("source"), F.col("id").alias("source_id"), "seq"))
    named = records.withColumn("id", F.concat(F.format_string("slot_%04d|", "slot"), "source", F.lit("|"), F.col("source_id").cast("string")))
    return named.join(both, ["source", "source_id"])


def checked_slots(ladder: DataFrame, by: list[str]) -> DataFrame:
    """ladder (by, slot, replacement_rank, one row a slot), if slots and ranks are each 0 to n - 1 in every group; else this fails."""
    of = lambda c: (F.countDistinct(c) == F.count("*")) & (F.min(c) == 0) & (F.max(c) == F.count("*") - 1)
    bad = ladder.groupBy(*by).agg((of("slot") & of("replacement_rank")).alias("ok")).where("not ok").take(1)
    if bad:
        raise ValueError(f"slots and ranks must each be a permutation: {bad[0].asDict()}")
    return ladder


def refinement(ladder: DataFrame, by: list[str], levels: list[float], size: int, endpoints: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """refined() on frozen ranks, if the frozen inputs (by, level 0 or 100, slot, seq) still have the sequences of their slots; else this fails."""
    slots = checked_slots(ladder.select(*by, "slot", "replacement_rank", "positive_id", "negative_id").distinct(), by)
    sides = F.explode(F.array(F.struct(F.lit(100.0).alias("level"), F.lit("positive").alias("source"), F.col("positive_id").alias("source_id")), F.struct(F.lit(0.0).alias("level"), F.lit("negative").alias("source"), F.col("negative_id").alias("source_id"))))
    wanted = cohort_sequences(slots.select(*by, "slot", sides.alias("s_")).select(*by, "slot", "s_.*"), positives, negatives)
    keys = [*by, "level", "slot"]
    one, two = wanted.select(*keys, "seq"), endpoints.select(*keys, "seq")
    if one.exceptAll(two).take(1) or two.exceptAll(one).take(1):
        raise ValueError("sequences differ from the frozen endpoints")
    return refined(slots, by, levels, size)
