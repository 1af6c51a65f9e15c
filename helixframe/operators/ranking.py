"""Ranking metrics with ties, paired tests and bootstraps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.keyed import unsigned_head
from helixframe.plans.materialise import broadcast_if_small, checkpointed
from helixframe.plans.running import running, tiled

#: Draws that one row lists, pairs of a tile of a bootstrap, and numbers that a task of replicates holds at once.
DRAWS, TILE, NUMBERS = 4096, 4096, 1 << 22


def _by_score(scored: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """One row a group and score: p and n count labels 1 and 0, each row weight times; fails on other labels or scores that are not finite."""
    fine = F.col("label").isin(0, 1) & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    checked = scored.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("labels must be 0 or 1 and scores finite")).isNull())
    w = F.lit(1) if weight is None else weight
    return checked.groupBy(*by, "score").agg(F.sum(F.col("label") * w).alias("p"), F.sum((1 - F.col("label")) * w).alias("n"))


def average_precision(scored: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by and ap: the area under the precision-recall staircase, rows of equal score entering together; null for one class.

    With weight a row counts so many times. The running counts go over distinct scores in
    tiles, so one large group spreads over tasks."""
    counts = tiled(_by_score(scored, by, weight), by, "score", descending=True)
    before = running(counts, by, "tile", [F.desc("score")], sums={"tp": F.col("p"), "fp": F.col("n")})
    tp, fp = F.col("tp") + F.col("p"), F.col("fp") + F.col("n")
    totals = F.sum("p"), F.sum("n")
    area = F.sum(F.when(F.col("p") > 0, F.col("p") * tp / (tp + fp)).otherwise(0.0))
    return before.groupBy(*by).agg(F.when((totals[0] > 0) & (totals[1] > 0), area / totals[0]).alias("ap"))


def auroc(scored: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by and auroc: the chance that a positive outranks a negative, ties counting half; null for one class. With weight a row counts so many times."""
    counts = tiled(_by_score(scored, by, weight), by, "score")
    before = running(counts, by, "tile", [F.col("score")], sums={"below": F.col("n")})
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    pairs = F.sum("p") * F.sum("n")
    return before.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each share: the exact quantile of value, between neighbours in proportion; null for a group without values.

    Values are counted first, and the running counts go over tiles, so no group goes through one task."""
    counts = tiled(checkpointed(rows.groupBy(*by, F.col(value).cast("double").alias("value_")).agg(F.count(value).alias("n_"))), by, "value_")
    before = running(counts, by, "tile", [F.col("value_")], sums={"below_": F.col("n_")})
    totals = broadcast_if_small(counts.groupBy(*by).agg(F.sum("n_").alias("total_")))
    at = lambda place: F.max(F.when((F.col("below_") <= place) & (place < F.col("below_") + F.col("n_")), F.col("value_")))
    told = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("total_") - 1)
        low, high, rest = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        told.append(F.when(low == high, low).otherwise((1 - rest) * low + rest * high).alias(name))
    return before.join(totals, by).groupBy(*by).agg(*told)


def trapezoid(points: DataFrame, by: list[str]) -> DataFrame:
    """by and area under the points (x, y) by trapezoids; fails on equal x and on a group of one point.

    A point meets the one before it through the running maximum over tiles of x."""
    before = running(tiled(points, by, "x"), by, "tile", [F.col("x")], maxima={"last_": F.struct("x", "y")})
    px, py = F.col("last_.x"), F.col("last_.y")
    steps = before.where(F.assert_true(px.isNull() | (F.col("x") > px), F.lit("x coordinates must be unique")).isNull())
    areas = steps.groupBy(*by).agg(F.sum((F.col("x") - px) * (F.col("y") + py) / 2).alias("area"), F.count("*").alias("n_"))
    return areas.where(F.assert_true(F.col("n_") > 1, F.lit("an area needs two points")).isNull()).drop("n_")


def sign_flip(differences: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """by, n_pairs, mean, extreme, total and p: the exact two-sided test over all sign assignments of at most most differences (d, k from 0)."""
    spark = differences.sparkSession
    groups = differences.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("pairs"))
    fine = F.assert_true(F.size("pairs") <= most, F.lit("too many differences for an exact test"))
    sized = groups.where(fine.isNull()).withColumns({"d": F.transform("pairs", lambda p: p["d"]), "n_pairs": F.size("pairs")})
    signs = spark.range(1 << most).withColumnRenamed("id", "bits")
    flips = sized.join(signs, F.col("bits") < F.pow(F.lit(2.0), F.col("n_pairs")))
    total = lambda flipped: F.aggregate(flipped, F.lit(0.0), lambda s, x: s + x)
    signed = F.transform("d", lambda d, k: F.when(F.floor(F.col("bits") / F.pow(F.lit(2.0), k)) % 2 == 1, -d).otherwise(d))
    tested = flips.withColumns({"mean": total(F.col("d")) / F.col("n_pairs"), "other": F.abs(total(signed) / F.col("n_pairs"))})
    extreme = F.sum((F.col("other") + 1e-15 >= F.abs("mean")).cast("bigint"))
    return tested.groupBy(*by, "n_pairs", "mean").agg(extreme.alias("extreme"), F.count("*").alias("total"), (extreme / F.count("*")).alias("p"))


def drawn_weights(sizes: DataFrame, by: list[str], replicates: int, seed: int, first: int = 0) -> DataFrame:
    """by, replicate, k and weight: how often each member k (from 0) of a group of size n is drawn, with replacement, in each replicate from first up to replicates.

    sizes has by and n. A draw is the leading 32 bits of a digest of seed, group, replicate and
    number, modulo n, so any task, and any engine, can tell any draw. Draws are made DRAWS at a time."""
    parts = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / DRAWS))).alias("part_"))
    each = parts.select(*by, "n", F.explode(F.sequence(F.col("part_") * DRAWS, F.least(F.col("n"), (F.col("part_") + 1) * DRAWS) - 1)).alias("draw"))
    drawn = each.withColumn("replicate", F.explode(F.sequence(F.lit(first), F.lit(replicates - 1))))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("replicate").cast("string"), F.col("draw").cast("string"))
    picked = drawn.withColumn("k", (unsigned_head(text, 8) % F.col("n").cast("decimal(20,0)")).cast("bigint"))
    return picked.groupBy(*by, F.col("replicate").cast("bigint").alias("replicate"), "k").agg(F.count("*").alias("weight"))


def bootstrap_mean(differences: DataFrame, by: list[str], seed: int, replicates: int = 2000, confidence: float = 0.95) -> DataFrame:
    """by, n_pairs, mean, lower and upper: a percentile interval for the mean of paired differences (d, k from 0).

    Draws are counted before they meet the differences, so a replicate reads a pair at most once."""
    plain = differences.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean"))
    weights = drawn_weights(plain.select(*by, F.col("n_pairs").alias("n")), by, replicates, seed)
    means = weights.join(differences, [*by, "k"]).groupBy(*by, "replicate").agg((F.sum(F.col("weight") * F.col("d")) / F.sum("weight")).alias("mean_"))
    tail = (1 - confidence) / 2
    ends = means.groupBy(*by).agg(F.percentile("mean_", F.lit(tail)).alias("lower"), F.percentile("mean_", F.lit(1 - tail)).alias("upper"))
    return plain.join(broadcast_if_small(ends), by)


def _in_tile(n: int, tiles: int, tile: int, key: list[int], replicates: int) -> np.ndarray:
    """How many of n draws fall into a tile, for each replicate; tiles hold TILE members but for the last.

    The draws are split in halves from the whole down to the tile by binomials whose generators are
    keyed by the place in the tree, so every task that asks gets the same counts, which add up to n."""
    lo, hi, left = 0, tiles, np.full(replicates, n, np.int64)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        below, whole = TILE * (middle - lo), min(n, TILE * hi) - TILE * lo
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([*key, lo, hi])))
        first = rng.binomial(left, below / whole)
        if tile < middle:
            hi, left = middle, first
        else:
            lo, left = middle, left - first
    return left


def _drawn_sums(d: np.ndarray, times: np.ndarray, key: list[int]) -> np.ndarray:
    """For each replicate the sum of times members of d drawn with replacement, as Generator.integers draws them.

    In a tile whose size is a power of two a draw is the leading bits of a 32-bit word, so words are taken as they come."""
    philox = np.random.Philox(np.random.SeedSequence(key))
    if len(d) < 2 or len(d) & (len(d) - 1):
        rng = np.random.Generator(philox)
        return np.array([d[rng.integers(0, len(d), t)].sum() for t in times])
    shift, left, sums = 33 - len(d).bit_length(), np.zeros(0, "<u4"), []
    step = max(1, NUMBERS // len(d))
    for lo in range(0, len(times), step):
        ends = np.cumsum(times[lo : lo + step]).tolist()
        words = philox.random_raw(max(0, ends[-1] - len(left) + 1) // 2).astype("<u8", copy=False).view("<u4")
        at = np.concatenate([left, words])
        left, at = at[ends[-1] :], at >> shift
        sums += [d.take(at[first:end]).sum() for first, end in zip([0, *ends], ends)]  # noqa: B905
    return np.array(sums)


def tiled_bootstrap_mean(differences: DataFrame, by: list[str], seed: int, replicates: int = 2000, confidence: float = 0.95) -> DataFrame:
    """by, n_pairs, mean, lower and upper as bootstrap_mean has them, for groups of any size; its draws are others.

    A group is cut into tiles of TILE pairs by k, its number from 0. The pairs are read once and kept as a row a
    tile. A task tells how many of a replicate's draws fall into its tile and draws that many pairs there; it passes
    on one sum a replicate and group, not the pairs. Draws depend on seed, group and tile only. k must be 0 to n - 1 in each group."""
    kinds = "".join(f"{c} {differences.schema[c].dataType.simpleString()}, " for c in by)

    def pack(pairs: pa.Table) -> pa.Table:
        k, d = pairs["k"].to_numpy(), pairs["d"].to_numpy()
        told = pairs["d"].drop_null().to_numpy()
        one = pairs.select([*by, "tile_"]).slice(0, 1)
        for name, value in (("n", len(k)), ("last_", int(k.max())), ("told", len(told)), ("total", float(told.sum())), ("members", d[np.argsort(k, kind="stable")].astype(float).tobytes())):
            one = one.append_column(name, pa.array([value]))
        return one

    pairs = differences.select(*by, F.col("k").cast("bigint").alias("k"), F.col("d").cast("double").alias("d"), F.floor(F.col("k") / TILE).alias("tile_"))
    tiles = checkpointed(pairs.groupBy(*by, "tile_").applyInArrow(pack, f"{kinds}tile_ bigint, n bigint, last_ bigint, told bigint, total double, members binary"))
    plain = broadcast_if_small(tiles.groupBy(*by).agg(F.sum("n").alias("n_pairs"), F.try_divide(F.sum("total"), F.sum("told")).alias("mean"), F.max("last_").alias("last_")))
    fine = plain.where(F.assert_true(F.col("last_") == F.col("n_pairs") - 1, F.lit("pairs must be numbered from 0")).isNull())
    sized = tiles.join(fine.select(*by, "n_pairs"), by).withColumn("key_", F.xxhash64(*by) if by else F.lit(0).cast("bigint"))
    most = max(1, NUMBERS // replicates)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def passed() -> pa.RecordBatch:
            first = pa.concat_batches([one for one, _ in sums.values()]).take(pa.array(np.repeat(np.arange(len(sums)), replicates)))
            more = [pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(sums))), pa.array(np.concatenate([made for _, made in sums.values()]))]
            sums.clear()
            return pa.RecordBatch.from_arrays([*first.columns[: len(by)], *more], names=[*by, "replicate", "sum"])

        for batch in batches:
            n, tile, group, members = (batch.column(c).to_pylist() for c in ("n_pairs", "tile_", "key_", "members"))
            for row, name in enumerate(zip(*(batch.column(c).to_pylist() for c in [*by, "key_"]), strict=True)):
                key = [seed, group[row] % (1 << 64)]
                times = _in_tile(n[row], -(-n[row] // TILE), tile[row], key, replicates)
                made = _drawn_sums(np.frombuffer(members[row], float), times, [*key, tile[row]])
                if name in sums:
                    sums[name] = sums[name][0], sums[name][1] + made
                    continue
                if len(sums) == most:
                    yield passed()
                sums[name] = batch.select([*by, "key_"]).slice(row, 1), made
        if sums:
            yield passed()

    sums = sized.select(*by, "n_pairs", "tile_", "key_", "members").mapInArrow(draw, f"{kinds}replicate int, sum double")
    means = sums.groupBy(*by, "replicate").agg(F.sum("sum").alias("sum")).join(fine.select(*by, "n_pairs"), by).withColumn("mean_", F.col("sum") / F.col("n_pairs"))
    tail = (1 - confidence) / 2
    ends = means.groupBy(*by).agg(F.percentile("mean_", F.lit(tail)).alias("lower"), F.percentile("mean_", F.lit(1 - tail)).alias("upper"))
    return fine.drop("last_").join(broadcast_if_small(ends), by)


def replicate_precision(scored: DataFrame, weights: np.ndarray) -> DataFrame:
    """replicate and ap: average precision of rows (label, score, k) under each column of weights [members k, replicates], rows of equal score entering together; null for one class.

    Rows are counted by score, label and member, cut into tiles along score, and read once: a task goes down its
    tiles with the running counts of all replicates side by side, which start from the tiles
    above it. No row is repeated for a replicate; a task passes on a number a replicate."""
    spark = scored.sparkSession
    fine = F.col("label").isin(0, 1) & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    checked = scored.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("labels must be 0 or 1 and scores finite")).isNull())
    counts = checkpointed(checked.groupBy("score", "label", "k").agg(F.count("*").alias("rows")).withColumn("whole_", F.lit(0)))
    tiles = tiled(counts, ["whole_"], "score", descending=True).drop("whole_")
    members, replicates = weights.shape
    totals = tiles.groupBy("tile", "label", "k").agg(F.sum("rows").alias("rows")).toArrow()  # tiles times members, twice
    at, where = np.unique(totals["tile"].to_numpy(), return_inverse=True)
    sums = np.zeros((2, len(at), members))
    np.add.at(sums, (totals["label"].to_numpy().astype(int), where, totals["k"].to_numpy()), totals["rows"].to_numpy())
    whole = sums.sum(1) @ weights  # [label, replicates]
    above = {int(t): sums[:, :k].sum(1) for k, t in enumerate(at)}
    held = spark.sparkContext.broadcast((weights, above))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, above = held.value
        area = np.zeros(replicates)
        tile = score = None
        passed, group = np.zeros((2, replicates)), np.zeros((2, replicates))  # n and p of higher scores, and of the score at hand

        def enter() -> None:
            nonlocal area, passed, group
            passed = passed + group
            seen = passed.sum(0)
            area += np.divide(group[1] * passed[1], seen, out=np.zeros(replicates), where=seen > 0)
            group = np.zeros((2, replicates))

        some = max(1, NUMBERS // replicates)
        for batch in batches:
            for lo in range(0, batch.num_rows, some):
                t, s, label, k, rows = (c.to_numpy(zero_copy_only=False) for c in batch.slice(lo, some).columns)
                cuts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])))
                each = weights[k] * rows[:, None]
                sides = [np.add.reduceat(each * (label == y)[:, None], cuts) for y in (0, 1)]
                for g, first in enumerate(cuts.tolist()):
                    if (t[first], s[first]) != (tile, score):
                        enter()
                        if t[first] != tile:
                            tile, passed = t[first], above[int(t[first])] @ weights
                        score = s[first]
                    group = group + np.stack([sides[0][g], sides[1][g]])
        enter()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(area)], names=["replicate", "area"])

    sorted_ = tiles.select("tile", "score", F.col("label").cast("int").alias("label"), "k", "rows").repartition("tile").sortWithinPartitions("tile", F.desc("score"))
    areas = sorted_.mapInArrow(go, "replicate bigint, area double").groupBy("replicate").agg(F.sum("area").alias("area"))
    ends = spark.createDataFrame([(r, float(p), float(n)) for r, (n, p) in enumerate(whole.T)], "replicate bigint, p double, n double")
    return ends.join(areas, "replicate").select("replicate", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / F.col("p")).alias("ap"))


def numbered(names: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column with k, their place in order from 0; names of clusters or blocks, a short list."""
    return names.select(column).distinct().withColumn("k", (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint"))
