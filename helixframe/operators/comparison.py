"""Motifs against a catalogue of motifs: best alignments by column correlation, and their significance.

Every query meets every target, so both are dealt into blocks by their ids and each pair of
blocks is one group of a co-group: no side is broadcast or held by the driver, and a group has
about QUERIES queries and TARGETS targets whatever the sizes.

The significance of an alignment is the chance that as many columns, drawn each by itself from
all columns of the catalogue and their complements, score as high against the same columns of
the query. Column scores are correlations in bins. The chance comes from one histogram for
each query column and from adding up columns by convolution; so it is exact for the bins. A
pair's p-value is that of its best alignment, corrected for the number of alignments tried;
E is p times the size of the catalogue, and q the least share of false matches at which the
match would be taken (Benjamini and Hochberg's, over the matches of the query)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.plans.materialise import checkpointed

QUERIES, TARGETS = 500, 1000
#: Correlations are put into so many bins above the lowest one.
BINS = 50
#: Logarithms of p-values that agree to so many digits tie.
DIGITS = 6


def unit_rows(pwm) -> np.ndarray:
    """Rows less their mean of 1/4, of length 1; a flat row is all zero."""
    rows = np.array([list(r) for r in pwm], float) - 0.25
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def blockwise(queries: DataFrame, targets: DataFrame, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What meet gives for each pair of a block of queries (query_id and others) and a block of targets (target_id and others)."""
    sizes = [-(-df.count() // most) or 1 for df, most in ((queries, QUERIES), (targets, TARGETS))]
    block = lambda name, size: F.pmod(F.xxhash64(name), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    one = queries.withColumns({"q_": block("query_id", sizes[0]), "t_": every(sizes[1])})
    apart = targets.select(*[F.col(c).alias(c) for c in targets.columns])  # both may come of one table
    two = apart.withColumns({"t_": block("target_id", sizes[1]), "q_": every(sizes[0])})
    return one.groupBy("q_", "t_").cogroup(two.groupBy("q_", "t_")).applyInPandas(meet, schema)


def _kinds(queries: DataFrame, targets: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, target_id {targets.schema['target_id'].dataType.simpleString()}"


def best_alignment(x: np.ndarray, m: np.ndarray, overlap: int):
    """(score, shift, strand, overlap) of the best mean column correlation; ties go to the plus strand, then to the smallest shift."""
    best = None
    for strand, y in (("+", m), ("-", m[::-1, ::-1])):
        columns = x @ y.T
        for shift in range(overlap - len(y), len(x) - overlap + 1):
            along = np.diagonal(columns, -shift)
            score = along.sum() / len(along)
            if best is None or score > best[0] + 1e-12:
                best = (score, shift, strand, len(along))
    return best


def compared(queries: DataFrame, targets: DataFrame, overlap: int) -> DataFrame:
    """query_id, target_id, score, shift, strand and overlap: the best mean column correlation of each query (query_id, pwm) with each target (target_id, pwm).

    Pairs that cannot overlap so far are left out."""

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        units = [(k, unit_rows(pwm)) for k, pwm in zip(two["target_id"], two["pwm"], strict=True)]
        rows = []
        for query, pwm in zip(one["query_id"], one["pwm"], strict=True):
            x = unit_rows(pwm)
            rows += [(query, k, *found) for k, m in units if (found := best_alignment(x, m, overlap)) is not None]
        return pd.DataFrame(rows, columns=["query_id", "target_id", "score", "shift", "strand", "overlap"])

    return blockwise(queries.select("query_id", "pwm"), targets.select("target_id", "pwm"), meet, f"{_kinds(queries, targets)}, score double, shift int, strand string, overlap int")


def _binned(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """[columns of the query, columns] bins of correlations, rounded so that sums in another order fall alike."""
    return np.floor(np.round(x @ columns.T, 9) * (BINS / 2) + BINS / 2 + 0.5).astype(np.int64)


def _both_strands(matrices: list[np.ndarray]) -> np.ndarray:
    """[matrices, 2, width, 4] of matrices of one width: as they are, and reversed and complemented."""
    plus = np.stack(matrices)
    return np.stack([plus, plus[:, ::-1, ::-1]], 1)


def histograms(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, counts): for each column of a query how many columns of the catalogue, of both strands, fall into each bin, one column after another."""

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(two):
            pool = np.concatenate([unit_rows(pwm) for pwm in two["pwm"]])
            pool = np.concatenate([pool, pool[:, ::-1]])
            for query, pwm in zip(one["query_id"], one["pwm"], strict=True):
                bins = _binned(unit_rows(pwm), pool)
                rows.append((query, np.concatenate([np.bincount(b, minlength=BINS + 1) for b in bins])))
        return pd.DataFrame(rows, columns=["query_id", "counts"])

    kind = queries.schema["query_id"].dataType.simpleString()
    parts = blockwise(queries.select("query_id", "pwm"), targets.select("target_id", "pwm"), meet, f"query_id {kind}, counts array<bigint>")

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"query_id": rows["query_id"].iloc[:1].to_numpy(), "counts": [np.sum(np.stack(rows["counts"].to_numpy()), 0)]})

    return parts.groupBy("query_id").applyInPandas(add, f"query_id {kind}, counts array<bigint>")  # a row for each block of targets


def tails(counts: np.ndarray, overlap: int) -> dict[tuple[int, int], np.ndarray]:
    """For each range of at least overlap columns the chance of each sum of bins or a higher one; counts is [columns, bins]."""
    share = counts / counts.sum(1, keepdims=True)
    out = {}
    for lo in range(len(share) - overlap + 1):
        sums = np.ones(1)
        for hi in range(lo, len(share)):
            sums = np.convolve(sums, share[hi])
            if hi + 1 - lo >= overlap:
                out[lo, hi + 1] = np.minimum(1.0, np.cumsum(sums[::-1])[::-1])
    return out


def _alignments(x: np.ndarray, ys: np.ndarray, above: dict, overlap: int) -> tuple[np.ndarray, ...]:
    """p, shift, minus strand and overlap of the best alignment of a query with each of ys [targets, 2, width, 4]."""
    n, _, width, _ = ys.shape
    bins = _binned(x, ys.reshape(-1, 4)).reshape(len(x), n, 2, width)
    shifts = range(overlap - width, len(x) - overlap + 1)
    made, keys = [], []
    for strand in (0, 1):
        for shift in shifts:
            lo, hi = max(0, shift), min(len(x), shift + width)
            sums = sum(bins[k, :, strand, k - shift] for k in range(lo, hi))
            made.append(above[lo, hi][sums])
            keys.append((shift, strand, hi - lo))
    p = np.stack(made)
    first = np.argmin(np.round(np.log(p), DIGITS), 0)  # of ties the first: plus strand, smallest shift
    least = p[first, np.arange(n)]
    shift, strand, common = np.array(keys).T[:, first]
    return -np.expm1(len(p) * np.log1p(-np.minimum(least, 1 - 1e-16))), shift, strand, common


def matches(queries: DataFrame, targets: DataFrame, overlap: int) -> DataFrame:
    """query_id, target_id, p, e, q, shift, strand and overlap: how each query (query_id, pwm) matches each target (target_id, pwm) of a catalogue.

    Of a pair's alignments of overlap columns or more, on either strand, the one with the least
    chance counts; ties go to the plus strand, then to the smallest shift. Pairs that cannot overlap so far are
    left out, and count in the catalogue's size. Ids are taken to be unique. An empty
    catalogue gives no rows. The q-values of a query are ranked in one task: as many rows as the
    catalogue has motifs."""
    queries, targets = checkpointed(queries.select("query_id", "pwm")), checkpointed(targets.select("target_id", "pwm"))
    size = targets.count()
    known = checkpointed(queries.join(histograms(queries, targets), "query_id"))

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        by_width: dict[int, list] = {}
        for k, pwm in zip(two["target_id"], two["pwm"], strict=True):
            by_width.setdefault(len(pwm), []).append((k, unit_rows(pwm)))
        out = []
        for query, pwm, counts in zip(one["query_id"], one["pwm"], one["counts"], strict=True):
            above = tails(np.array(counts, float).reshape(len(pwm), BINS + 1), overlap)
            for width, some in by_width.items():
                if min(width, len(pwm)) >= overlap:
                    p, shift, minus, common = _alignments(unit_rows(pwm), _both_strands([m for _, m in some]), above, overlap)
                    out.append(pd.DataFrame({"query_id": query, "target_id": [k for k, _ in some], "p": p, "shift": shift, "strand": np.where(minus == 1, "-", "+"), "overlap": common}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "target_id", "p", "shift", "strand", "overlap"])

    found = blockwise(known, targets, meet, f"{_kinds(queries, targets)}, p double, shift int, strand string, overlap int")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("p", "target_id"))
    scaled = found.withColumn("at_", F.col("p") * F.count("*").over(Window.partitionBy("query_id")) / at)
    later = Window.partitionBy("query_id").orderBy(F.desc("p"), F.desc("target_id")).rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn("q", F.least(F.lit(1.0), F.min("at_").over(later))).select("query_id", "target_id", "p", (F.col("p") * size).alias("e"), "q", "shift", "strand", "overlap")
