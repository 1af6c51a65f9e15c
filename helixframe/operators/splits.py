"""Train and test splits of overlap groups: stratified, exact in size, and reproducible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.intervals import TILE, group_table, overlap_groups, overlapping
from helixframe.plans.materialise import broadcast_if_small, checkpointed
from helixframe.plans.running import ranked, running
from helixframe.sources.sinks import twelve_digits, write_json, write_tsv


def score_bins(groups: DataFrame, bins: int) -> DataFrame:
    """groups (group_id, score) with bin: rank * bins div n over all groups by score, then id."""
    kept = checkpointed(groups)
    total = kept.count()
    placed = ranked(kept, "score", ["group_id"], "rank_")
    return placed.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("rank_") * bins / F.lit(max(1, total)))).cast("int")).drop("rank_")


def allocation(binned: DataFrame, fraction: float) -> DataFrame:
    """(chrom, bin, members, quota): the test groups of each stratum by largest remainders; a table of strata."""
    strata = binned.groupBy("chrom", "bin").agg(F.count("*").alias("members"))
    everything = Window.partitionBy()
    exact = F.col("members") * F.lit(fraction)
    sized = strata.withColumns({"floor_": F.floor(exact), "rest_": exact - F.floor(exact), "n_": F.sum("members").over(everything)})
    target = F.least(F.col("n_") - 1, F.greatest(F.lit(1), F.floor(F.col("n_") * F.lit(fraction) + 0.5)))
    left = sized.withColumn("left_", target - F.sum("floor_").over(everything))
    place = F.row_number().over(Window.orderBy(F.desc("rest_"), "chrom", "bin"))
    return left.withColumn("place_", place).select("chrom", "bin", "members", (F.col("floor_") + (F.col("place_") <= F.col("left_")).cast("bigint")).alias("quota"))


def assigned(groups: DataFrame, fraction: float, seed: int, bins: int) -> DataFrame:
    """groups (group_id, chrom, score) with bin and split: in each stratum the first quota groups by keyed digest test."""
    binned = checkpointed(score_bins(groups, bins))
    order = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col("group_id")), 256)
    place = F.row_number().over(Window.partitionBy("chrom", "bin").orderBy(order, "group_id"))
    joined = binned.withColumn("place_", place).join(broadcast_if_small(allocation(binned, fraction)), ["chrom", "bin"])
    return joined.withColumn("split", F.when(F.col("place_") <= F.col("quota"), "test").otherwise("train")).drop("place_", "quota", "members")


def leaks(manifest: DataFrame) -> DataFrame:
    """The train intervals of a manifest (split, chrom, start, end) that overlap a test interval; there should be none."""
    return overlapping(manifest.where("split = 'train'"), manifest.where("split = 'test'"))


def _may_leak(spans: DataFrame) -> bool:
    """Whether a group (chrom, start, end, split) begins before the furthest end of groups of the other split that begin before it or with it; if none does, none of their members overlap."""
    tiles = spans.withColumn("tile_", F.floor(F.col("start") / TILE))
    ends = {f"{s}_": F.when(F.col("split") == s, F.col("end")) for s in ("train", "test")}
    before = running(tiles, ["chrom"], "tile_", [F.col("start"), F.col("split")], maxima=ends)
    reached = F.col("start") < F.when(F.col("split") == "train", F.col("test_")).otherwise(F.col("train_"))
    return bool(before.agg(F.bool_or(reached)).first()[0])


def manifest(intervals: DataFrame, fraction: float, seed: int, bins: int) -> DataFrame:
    """intervals (chrom, start, end, record_id, score and others) with split and group_id, in order of split, chromosome, start and end.

    Fails where a train interval overlaps a test interval."""
    grouped = overlap_groups(intervals)
    spans = checkpointed(assigned(group_table(grouped), fraction, seed, bins).select("chrom", "group_id", "start", "end", "split"))
    rows = grouped.join(broadcast_if_small(spans.select("chrom", "group_id", "split")), ["chrom", "group_id"])
    first = leaks(rows).select("record_id").take(1) if _may_leak(spans) else []
    if first:
        raise ValueError(f"cross-split overlap: {first[0]['record_id']}")
    return rows.orderBy("split", "chrom", "start", "end", "record_id")


def split_report(rows: DataFrame) -> DataFrame:
    """split, groups and intervals of a manifest."""
    return rows.groupBy("split").agg(F.countDistinct("chrom", "group_id").alias("groups"), F.count("*").alias("intervals"))


def write_split(intervals: DataFrame, path: str, fraction: float, seed: int, bins: int) -> dict:
    """Write a manifest and its counts to new folders PATH/manifest and PATH/summary; the counts."""
    rows = checkpointed(manifest(intervals, fraction, seed, bins))
    counts = {r["split"]: r for r in split_report(rows).collect()}
    of = lambda what: {s: counts[s][what] if s in counts else 0 for s in ("train", "test")}
    record = {"seed": seed, "test_fraction_requested": fraction, "score_bins": bins, "group_counts": of("groups"), "interval_counts": of("intervals"), "cross_split_overlaps": 0}
    write_tsv(rows.withColumn("score", twelve_digits("score")), f"{path}/manifest")
    write_json(intervals.sparkSession, record, f"{path}/summary")
    return record
