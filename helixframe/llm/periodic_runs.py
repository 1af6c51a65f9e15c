"""Runs of repeated words in texts, by recompression.

A run is a stretch of consecutive words with smallest period q that is at least 3 * q and
least words long and that no neighbouring word extends. For each period a grid of places is
laid over a text, as wide as a run of that period must be after its first period; every run
holds a place of its period's grid with the place one period on. Places around which too few words
agree for any run are put aside; for all others the exact extensions to both sides come from
the grammar of the texts (recompression.py). Nothing is sorted by suffixes.

A text is handled within its row; texts share a grammar in groups of about GROUP_WORDS words,
and a longer text has one of its own. Places are laid PLACES at a time, so memory follows the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import binary_values, free_names, small_batches
from helixframe.llm.recompression import Grammar
from helixframe.llm.wordhash import mixed

GROUP_WORDS, PLACES = 1 << 18, 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class _Numbers(dict):
    """A number for each word, from 0, as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _grid(sizes: np.ndarray, least: int, most_places: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) for texts of so many words, in blocks of about most_places."""
    periods = np.where(sizes >= least, sizes // 3, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least - period, 2 * period)
    count = -(-(sizes[text] - period) // step)
    cuts = np.flatnonzero(np.diff(np.cumsum(count) // most_places, prepend=-1)).tolist() + [len(text)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = count[lo:hi]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[lo:hi], n), at * np.repeat(step[lo:hi], n), np.repeat(period[lo:hi], n)


def _agreeing(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (text, place, period) of the grid at which some width words ahead or behind agree, as they do in any run: its extensions make up max(least, 3 * period) - period words or more."""
    width = 1
    digest = mixed(words.astype(np.uint64))
    while 4 * width <= least - least // 3:
        digest = mixed(digest + np.uint64(1)) ^ np.append(digest[width:], np.arange(width, dtype=np.uint64))
        width *= 2
    behind = np.append(np.arange(width, dtype=np.uint64), digest)  # of the words before a place
    found = []
    for text, place, period in _grid(sizes, least, PLACES):
        at = first[text] + place
        # a window may reach over the end of a text; the separators there are all different
        some = (digest[at] == digest[at + period]) | (behind[at] == behind[at + period])
        found.append((text[some], place[some], period[some]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def find_runs(texts: list[np.ndarray], least: int = 24) -> list[np.ndarray]:
    """For each sequence of word numbers its runs (start, length, period), by start and then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros((0, 3), np.int64)
    if not (sizes >= least).any():
        return [none] * len(texts)

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts in a row, each with a separator of its own behind it, and their first places."""
        top = 1 + max(int(texts[k].max(initial=0)) for k in which)
        parts = [p for n, k in enumerate(which) for p in (texts[k], [top + n])]
        ends = np.cumsum(sizes[which] + 1)
        return np.concatenate(parts).astype(np.int64), ends - sizes[which] - 1

    long = np.flatnonzero(sizes >= least)
    words, first = joined(long)
    text, place, period = _agreeing(words, first, sizes[long], least)
    some, text = np.unique(text, return_inverse=True)
    if not len(some):
        return [none] * len(texts)
    words, first = joined(long[some])
    grammar = Grammar(words)
    at = first[text] + place
    ahead, behind = grammar.extensions(at, at + period), grammar.extensions(at, at + period, back=True)
    start, length = place - behind, behind + period + ahead
    is_run = length >= np.maximum(least, 3 * period)
    rows = np.unique(np.stack([text, start, length, period], 1)[is_run], axis=0)
    # a stretch also comes with multiples of its smallest period, which stand behind it here
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))[: len(rows)]]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    out = [none] * len(texts)
    cuts = np.searchsorted(rows[:, 0], np.arange(len(some) + 1))
    for k, number in enumerate(long[some].tolist()):
        out[number] = rows[cuts[k] : cuts[k + 1], 1:]
    return out


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: it is in no run after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _grouped(words: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    group: list[list[bytes]] = []
    size = 0
    for one in words:
        if group and size + len(one) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(one)
        size += len(one)
    if group:
        yield group


def with_runs(docs: DataFrame, least: int = 24) -> DataFrame:
    """docs with the array runs (start, length, period; by start, then period), and text collapsed: its words that no run holds after its first period, parted by one space.

    Words are parted by white space (0x20, 0x09 to 0x0D); periods are in words. Null, empty and wordless texts
    have no runs and come out empty. Every row is handled by itself, so repeated rows come out as often as they went in; no rows,
    no rows. Other columns are passed on; one named runs keeps its name, and the new one takes the next
    free name with an underscore."""
    small_batches(docs.sparkSession)
    (runs_name,) = free_names(docs.columns, "runs")
    rest = [c for c in docs.columns if c != "text"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for group in _grouped([t.split() for t in binary_values(batch.column(len(rest)))]):
                numbers = _Numbers()
                found = find_runs([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in group], least)
                texts = [b" ".join([w for w, k in zip(words, _kept(len(words), runs).tolist(), strict=True) if k] if len(runs) else words) for words, runs in zip(group, found, strict=True)]
                every = np.concatenate(found)
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], names=["start", "length", "period"])
                part = batch.slice(row, len(group))
                row += len(group)
                columns = [*part.columns[: len(rest)], pa.array(texts, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(offsets), fields)]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, "text", runs_name])

    schema = ", ".join([*kinds, "text string", f"`{runs_name}` array<{RUN}>"])
    return docs.select(*[F.col(f"`{c}`") for c in rest], "text").mapInArrow(search, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null if there is none."""
    stronger = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast(RUN), stronger)
