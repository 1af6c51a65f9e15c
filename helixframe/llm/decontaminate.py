"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items (13 consecutive words; a shorter item
is one window). Words are the alphabet: for each window length there is a table of shifts
by block of consecutive words, read at the end of the current position. A block that no
window holds lets the search skip almost a whole window; a block that ends some window
leads to a bucket of windows, which are compared with the text word by word.

The patterns reach the tasks as broadcast blocks of at most PATTERN_BYTES of item text.
A larger benchmark is searched in several passes over the documents, one a block, so what
is broadcast at once has a fixed bound.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import binary_values, checkpointed, free_names, other_columns, small_batches

WINDOW_WORDS = 13
BLOCK_WORDS = 3
PATTERN_BYTES = 16 << 20
#: What has been found is written down after so many passes, so that no plan grows with the benchmark.
PASSES = 8

#: Bytes of UTF-8 to what stands for them: letters in lower case, digits and all bytes
#: beyond ASCII stay; all else separates words.
_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowSearch:
    """Shift tables and buckets for the windows of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW_WORDS, block: int = BLOCK_WORDS):
        owners: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            found = words(text)
            size = min(window, len(found))
            for at in range(len(found) - size + 1 if size else 0):
                owners[size][tuple(found[at : at + size])].add(item)
        self.tables = []
        for size, patterns in sorted(owners.items()):
            width = min(block, size)
            shifts: dict[tuple, int] = {}
            buckets: dict[tuple, list] = defaultdict(list)
            for pattern, ids in patterns.items():
                for end in range(width, size + 1):
                    key = pattern[end - width : end]
                    shifts[key] = min(shifts.get(key, size), size - end)
                buckets[pattern[size - width :]].append((list(pattern), tuple(sorted(ids))))
            self.tables.append((size, width, size - width + 1, shifts, dict(buckets)))

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(word ranges of occurring windows, ids of their items)."""
        spans, ids = [], set()
        n = len(found)
        for size, width, skip, shifts, buckets in self.tables:
            end, get = size, shifts.get
            while end <= n:
                key = tuple(found[end - width : end])
                shift = get(key, skip)
                if shift:
                    end += shift
                    continue
                for pattern, owners in buckets[key]:
                    if found[end - size : end] == pattern:
                        spans.append((end - size, end))
                        ids.update(owners)
                end += 1
        return spans, ids


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word ranges, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def item_blocks(benchmark: DataFrame, limit: int = PATTERN_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items in lists of at most limit bytes of text (or a single item), fetched one partition at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        text = row.text.encode()
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    if held:
        yield held


_KINDS = ("bigint", "array<struct<lo: bigint, hi: bigint>>", "array<bigint>")


def _searched(docs: DataFrame, benchmark: DataFrame, names: list[str]) -> DataFrame:
    """docs with three more columns of free names: count of words, disjoint word ranges that are hit, and sorted ids of items."""
    found = docs.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in zip(names, _KINDS, strict=True)])
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *found.schema.fields[-3:]])
    context = docs.sparkSession.sparkContext
    text_at = [c.lower() for c in docs.columns].index("text")
    width = len(docs.columns)

    def search(held):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = WindowSearch(held.value)
            for batch in batches:
                counts, spans, ids = [], [], []
                before = zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True)
                for text, (old_spans, old_ids) in zip(binary_values(batch.column(text_at)), before, strict=True):
                    seen = words(text)
                    new_spans, new_ids = finder.hits(seen)
                    counts.append(len(seen))
                    spans.append(covered([*new_spans, *((s["lo"], s["hi"]) for s in old_spans or ())]))
                    ids.append(sorted({*new_ids, *(old_ids or ())}))
                pair = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
                made = [
                    pa.array(counts, pa.int64()),
                    pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], pa.list_(pair)),
                    pa.array(ids, pa.list_(pa.int64())),
                ]
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=names)

        return scan

    passes = 0
    for block in item_blocks(benchmark):
        if passes and passes % PASSES == 0:
            found = checkpointed(found)
        found = found.mapInArrow(search(context.broadcast(block)), schema)
        passes += 1
    return found if passes else found.mapInArrow(search(context.broadcast([])), schema)


def find_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with hit_n_words, hit_spans (disjoint word ranges) and hit_items (sorted ids).

    Every row of docs is kept as it is, repeated rows included; columns with these names are
    replaced. A null or wordless text has no words and no hits; so has every document when
    the benchmark is empty. Items with null id or text or without words have no windows; an
    id that occurs twice owns the windows of both texts.
    """
    names = ["hit_n_words", "hit_spans", "hit_items"]
    return _searched(docs.select(other_columns(docs, *names)), benchmark, names)


def _judged(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, list[str], Column]:
    """docs with three columns of free names, these names, and whether a document is contaminated."""
    names = free_names(docs.columns, "hit_n_words", "hit_spans", "hit_items")
    n_hit = F.aggregate(names[1], F.lit(0).cast("bigint"), lambda total, s: total + s["hi"] - s["lo"])
    return _searched(docs, benchmark, names), [*names, n_hit], (n_hit > 0) & (20 * n_hit >= F.col(names[0]))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted as strings) and contaminated, by their hits.

    A document is contaminated when it has hit words and they are at least a twentieth of
    its words. Columns of docs with these names are replaced, others are kept, whatever
    they are called."""
    own = other_columns(docs, "n_words", "n_hit", "n_items", "items", "contaminated")
    found, (n_words, _, ids, n_hit), contaminated = _judged(docs.select(own), benchmark)
    items = F.array_sort(F.transform(ids, lambda x: x.cast("string")))
    return found.select(*own, F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), items.alias("items"), contaminated.alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs as they were."""
    found, _, contaminated = _judged(docs, benchmark)
    return found.where(~contaminated).select(docs.columns)
