"""Phrases that occur together more often than their parts would: counted by multikey quicksort, scored by their weakest cut.

Words are numbered by a digest of language and word, 64 bits wide; a first pass counts them
and sees to it that no frequent number stands for two words. Suffixes of the texts, five words
at most, are then routed by their leading words: a second pass sums the sizes of partitions by
two and by three leading words over all the corpus, and a partition with too few suffixes for a
frequent phrase is abandoned before anything moves. The words and partitions left are told to tasks
as bit sets of bounded size; where those are too small for a corpus, more suffixes move, in vain.
A third pass sends the suffixes up to the first word or partition that is abandoned; equal ones of
a task travel as one with their number. Where they meet, multikey three-way quicksort passes over
pointers to them, a word deeper with each equal part; the sizes of the equal parts are the counts,
and parts that are not frequent are abandoned.

Suffixes with the same two leading words meet in one task; those of a partition that is more than
a bounded share of all are parted by three leading words, and if that is not enough by all, and
the counts of what they have in common are added up by Spark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import binary_values, checkpointed, small_batches
from helixframe.llm.wordhash import mixed
from helixframe.plans.materialise import broadcast_if_small

LONGEST = 5
#: A task sends on what it has counted when it knows so many words of a language or holds so many of its words, and numbers texts in segments of so many bytes.
WORDS_A_TASK, HELD, SEGMENT = 300_000, 1 << 21, 1 << 22
#: A partition of more suffixes than this, or than a share of all, is parted by more words.
ROUTE_ROWS, HOT = 1 << 20, 20_000
#: Suffixes of so many words of the corpus are sorted in one task at most, of several routes.
WORDS_A_SORT, ROUTES = 1 << 22, 4
#: The filter of frequent words has 2 to these powers of bits, 16 a word.
FILTER_BITS = (20, 28)
#: Suffixes are routed into 2 to these powers of partitions by two and as many by three leading words, for so many words of the corpus one; sizes are summed in blocks of BLOCK.
PARTITION_BITS, WORDS_A_PARTITION, BLOCK = (16, 28), 8, 1 << 16
#: Candidates of a language are ranked in so many parts first.
PARTS = 64

_BREAK = 0xFF  # no byte of UTF-8
_FOLD = bytes(_BREAK if b in b".,;:!?\n\x0b\x0c\r" else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = re.compile(rb"[ \t]")


def _word_id(lang: str, word: bytes, seed: int) -> int:
    made = hashlib.blake2b(word, digest_size=8, key=hashlib.blake2b(lang.encode(), digest_size=16).digest(), salt=seed.to_bytes(8, "little"))
    return int.from_bytes(made.digest(), "little", signed=True) or 1


class _Words(dict):
    """A language's words of a task, numbered from 1; 0 is a break between pieces."""

    def __init__(self, lang: str, seed: int):
        super().__init__({bytes([_BREAK]): 0})
        self.lang, self.seed = lang, seed
        self.words: list[bytes] = [b""]
        self.ids = np.zeros(1, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def take(self, text: bytes) -> None:
        """Hold the numbers of a text's words, with a break behind it."""
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            end = cut.start() if cut else len(text)
            tokens = text[at:end].translate(_FOLD).replace(bytes([_BREAK]), bytes([0x20, _BREAK, 0x20])).split()
            self.held.append(np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens)))
            self.size += len(tokens)
            at = end
        self.held.append(np.zeros(1, np.int32))

    def emptied(self) -> tuple[np.ndarray, np.ndarray]:
        """All numbers held, and the id of each number."""
        fresh = [_word_id(self.lang, w, self.seed) for w in self.words[len(self.ids) :]]
        self.ids = np.concatenate([self.ids, np.array(fresh, np.int64)])
        numbers = np.concatenate([*self.held, np.zeros(LONGEST, np.int32)])
        self.held, self.size = [], 0
        return numbers, self.ids


def _over_words(docs: DataFrame, seed: int, count, schema: str) -> DataFrame:
    """What count(words) gives, in arrays, for the words of docs (lang, text) that a task holds of a language at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                if lang not in known:
                    known[lang] = _Words(lang, seed)
                words = known[lang]
                words.take(text)
                if words.size >= HELD or len(words.words) >= WORDS_A_TASK:
                    yield count(words)
                    if len(words.words) >= WORDS_A_TASK:
                        del known[lang]
            if sum(len(w.words) for w in known.values()) >= 2 * WORDS_A_TASK:  # many languages
                yield from (count(w) for w in known.values() if w.held)
                known = {}
        yield from (count(w) for w in known.values() if w.held)

    return docs.mapInArrow(run, schema)


def _counted_words(docs: DataFrame, seed: int, minimum: int) -> DataFrame:
    """(id, n, lang, word, other): the frequent words; the empty word stands for all of its language. other: the id has another word too."""

    def count(words: _Words) -> pa.RecordBatch:
        numbers, ids = words.emptied()
        times = np.bincount(numbers, minlength=len(ids))
        some = np.flatnonzero(times[1:]) + 1
        found = [b"", *[words.words[k] for k in some.tolist()]]
        all_ids = np.append(_word_id(words.lang, b"", seed), ids[some])
        n = np.append(times[some].sum(), times[some])
        return pa.RecordBatch.from_arrays([pa.array(all_ids), pa.array([words.lang] * len(found)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["id", "lang", "word", "n"])

    rows = _over_words(docs, seed, count, "id bigint, lang string, word string, n bigint")
    own = F.struct("lang", "word")
    grouped = rows.groupBy("id").agg(F.sum("n").alias("n"), F.min(own).alias("own"), F.max(own).alias("last"))
    return grouped.where((F.col("n") >= minimum) | (F.col("own.word") == "")).select("id", "n", "own.lang", "own.word", (F.col("own") != F.col("last")).alias("other"))


def _filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bit set of the column key by its leading bits; its words, not the rows, come to the driver, 32 MB at most."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * keys.count()).bit_length()))
    spot = F.shiftrightunsigned("key", 64 - bits)
    one = F.expr("shiftleft(1L, cast(spot % 64 as int))")
    words = keys.select(spot.alias("spot")).select(F.floor(F.col("spot") / 64).alias("word"), one.alias("bit"))
    made = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    held = np.zeros((1 << bits) // 64, np.int64)
    held[made["word"].to_numpy()] = made["bit"].to_numpy()
    return held, bits


def _frequent_only(numbers: np.ndarray, ids: np.ndarray, frequent: tuple[np.ndarray, int]) -> np.ndarray:
    """The numbers of frequent words, 0 for others."""
    held, bits = frequent
    spot = (ids.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    known = (held[spot >> 6] >> (spot & 63)) & 1 == 1
    known[0] = False
    return np.where(known[numbers], numbers, 0)


def _turned(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(17)) | (x >> np.uint64(47))


def _leading(numbers: np.ndarray, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of the two and of the three words from each place on, and whether no break comes before."""
    known = ids[numbers].view(np.uint64)
    two = mixed(known[:-1] ^ _turned(known[1:]))
    three = mixed(two[:-1] ^ _turned(known[2:]))
    pair = (numbers[:-1] > 0) & (numbers[1:] > 0)
    return [two, three], [pair, pair[:-1] & pair[1:]]


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The sizes of the partitions of one block from parts of it."""
    total = np.zeros(BLOCK, np.int64)
    for at, sizes in zip(rows["at"], rows["sizes"], strict=True):
        total[np.frombuffer(at, "<u2")] += np.frombuffer(sizes, "<u4")
    some = np.flatnonzero(total)
    made = rows.head(1).copy()
    made["at"], made["sizes"] = [some.astype("<u2").tobytes()], [np.minimum(total[some], (1 << 32) - 1).astype("<u4").tobytes()]
    return made


def _partitions(docs: DataFrame, seed: int, frequent, bits: int, least: tuple[int, int]) -> np.ndarray:
    """[2, 2, 2 ** bits / 8]: for each number of least the bits of the partitions by two and by three leading words that hold so many suffixes in all the corpus."""

    def count(words: _Words) -> pa.RecordBatch:
        numbers, ids = words.emptied()
        keys, whole = _leading(_frequent_only(numbers, ids, frequent.value), ids)
        parts = [(k[w] >> np.uint64(64 - bits)).astype(np.int64) + (kind << bits) for kind, (k, w) in enumerate(zip(keys, whole, strict=True))]
        found, sizes = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.flatnonzero(np.diff(found // BLOCK, prepend=-1)).tolist() + [len(found)]
        at, sizes = (found % BLOCK).astype("<u2"), sizes.astype("<u4")
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(found[cuts[:-1]] // BLOCK, pa.int32()), pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([sizes[a:b].tobytes() for a, b in spans], pa.binary())], names=["block", "at", "sizes"])

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, sizes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                bit = np.zeros((2, BLOCK), np.uint8)
                for k in (0, 1):
                    bit[k, np.frombuffer(at, "<u2")] = np.frombuffer(sizes, "<u4") >= least[k]
                out.append(np.packbits(bit).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    salted = _over_words(docs, seed, count, "block int, at binary, sizes binary").withColumn("salt", F.spark_partition_id() % 16)
    schema = "block int, at binary, sizes binary, salt int"
    whole = salted.groupBy("block", "salt").applyInPandas(_summed, schema).groupBy("block").applyInPandas(_summed, schema)
    made = whole.select("block", "at", "sizes").mapInArrow(large, "block int, bits binary").toArrow()
    held = np.zeros((2, (2 << bits) // BLOCK, BLOCK // 8), np.uint8)
    for block, packed in zip(made["block"].to_pylist(), made["bits"].to_pylist(), strict=True):
        held[:, block] = np.frombuffer(packed, np.uint8).reshape(2, -1)
    return held.reshape(2, 2, -1)


def _routed(docs: DataFrame, seed: int, frequent, partitions, bits: int, routes: int) -> DataFrame:
    """(route, suffixes): the suffixes of two words or more, up to the first word, pair or three words that are abandoned.

    A row holds those of one task and route that differ, in order: words (0 is none), how often, and by how
    many leading words they are routed. Two, where their partition is not hot, or three, or all."""

    def count(words: _Words) -> pa.RecordBatch:
        numbers, ids = words.emptied()
        numbers = _frequent_only(numbers, ids, frequent.value)
        keys, whole = _leading(numbers, ids)
        large, hot = partitions.value

        def told(kind: int, bit: np.ndarray) -> np.ndarray:
            at = (keys[kind] >> np.uint64(64 - bits)).astype(np.int64)
            return whole[kind] & ((bit[kind][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

        two, three = told(0, large), told(1, large)
        at = np.flatnonzero(two[: -LONGEST + 1])
        columns, going = [numbers[at], numbers[at + 1]], np.ones(len(at), bool)
        for k in range(2, LONGEST):
            going = going & three[at + k - 2] & two[at + k - 1]
            columns.append(np.where(going, numbers[at + k], 0))
        by = np.where(told(0, hot)[at], np.where(told(1, hot)[at], LONGEST, 3), 2)
        taken = [np.where(c > 0, ids[c], 0) for c in columns]
        every = keys[1][at]
        for c in taken[3:]:
            every = mixed(every ^ _turned(c.view(np.uint64)))
        route = (np.where(by == 2, keys[0][at], np.where(by == 3, mixed(keys[0][at] ^ _turned(taken[2].view(np.uint64))), every)) % np.uint64(routes)).astype(np.int64)
        order = np.lexsort([*columns[::-1], route])
        rows = np.stack([route, *taken, by])[:, order]
        new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))[: len(at)]
        n = np.diff(np.append(np.flatnonzero(new), len(at)))
        rows = np.concatenate([rows[:, new], n[None]]).astype("<i8")
        cuts = np.flatnonzero(np.diff(rows[0], prepend=-1)).tolist() + [rows.shape[1]]
        packed = [np.ascontiguousarray(rows[1:, a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(rows[0, cuts[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["route", "suffixes"])

    return _over_words(docs, seed, count, "route int, suffixes binary")


def quicksorted(columns: list[np.ndarray], weights: np.ndarray, minimum: int, by: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(depth, a row, count) of each equal part of at least minimum, by multikey three-way quicksort over row pointers; a 0 ends a row.

    by: how many first columns of a row are alike in this sort only in all; parts of fewer columns are parts
    of a whole that others sort too, so they are told whatever their size."""
    by = np.ones(len(weights), np.int64) if by is None else by
    parts = [(np.arange(len(weights)), 0)]
    while parts:
        rows, depth = parts.pop()
        if not len(rows) or (weights[rows].sum() < minimum and by[rows].max() <= depth + 1):
            continue  # abandoned
        keys = columns[depth][rows]
        pivot = np.sort(keys[[0, len(keys) // 2, -1]])[1]
        parts += [(rows[keys < pivot], depth), (rows[keys > pivot], depth)]
        equal = rows[keys == pivot]
        count = int(weights[equal].sum())
        if pivot:
            if count >= minimum or by[equal].max() > depth + 1:
                yield depth + 1, int(equal[0]), count
            if depth + 1 < len(columns):
                parts.append((equal, depth + 1))


def _counted_phrases(routed: DataFrame, minimum: int, tasks: int) -> DataFrame:
    """(words, n): the frequent phrases of two words or more."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [np.frombuffer(x, "<i8").reshape(LONGEST + 2, -1) for b in batches for x in b.column(1).to_pylist()]
        if not blocks:
            return
        *columns, by, weights = np.concatenate(blocks, 1)
        words, counts = [], []
        for depth, row, count in quicksorted(columns, weights, minimum, by):
            if depth > 1:
                words.append([int(c[row]) for c in columns[:depth]])
                counts.append(count)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=["words", "n"])

    made = routed.repartition(tasks, "route").mapInArrow(sort, "words array<bigint>, n bigint")
    return made.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= minimum)


def _scored(counts: DataFrame, totals: Column) -> DataFrame:
    """(words, a, l, r, n, score): each phrase of counts (words, n, all) by its lowest cut; exact in decimals while 1000 * a * n stays under 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    phrases = counts.where(F.size("words") > 1).select("words", F.col("n").alias("a"), totals.alias("n"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    part = lambda key, n: counts.select(F.col("words").alias(key), F.col("n").alias(n))
    both = cuts.join(part("first", "l"), "first").join(part("rest", "r"), "rest")
    both = both.withColumns({"top": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "below": wide("l") * wide("r")})
    least = F.min(F.struct(F.expr("top div below").alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("words", "a", "n").agg(least).select("words", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, minimum: int = 100, limit: int = 2000, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the limit phrases of 2 to 5 words that hold together most.

    A text is cut into pieces at . , ; : ! ? and line ends, and those into words at blanks and tabs; A-Z count as
    a-z. n: the words of the language; a: how often the phrase is, at least minimum; l and r: how
    often its first part and its rest are, at the cut with the lowest score floor(1000 * a * n / (l * r)), of
    equal ones the first. A phrase inside a longer one that is at least percent / 100 times as
    frequent goes. Rank goes by score, then a, then phrase in the order of its bytes. A null lang
    counts as und, a null text as empty; repeated rows count as often as they stand. No frequent phrase, no row. Other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    for seed in range(16):
        known = checkpointed(_counted_words(texts, seed, minimum))
        if known.where("other").isEmpty():
            break
    else:
        raise ValueError("no seed tells the words apart")
    totals = broadcast_if_small(known.where("word = ''").select("lang", F.col("n").alias("all")))
    words = known.where("word <> ''").select("id", "n", "lang", "word")
    context = spark.sparkContext
    frequent = context.broadcast(_filter(words.select(F.col("id").alias("key"))))
    everything = known.where("word = ''").agg(F.sum("n")).first()[0] or 0
    bits = min(PARTITION_BITS[1], max(PARTITION_BITS[0], (everything // WORDS_A_PARTITION).bit_length()))
    partitions = context.broadcast(_partitions(texts, seed, frequent, bits, (minimum, max(ROUTE_ROWS, everything // HOT))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-everything // WORDS_A_SORT))
    phrases = _counted_phrases(_routed(texts, seed, frequent, partitions, bits, ROUTES * tasks), minimum, tasks)
    plain = words.select(F.array("id").alias("words"), "n").unionAll(phrases)
    language = words.join(totals, "lang").select(F.col("id").alias("id_"), "all")
    counts = checkpointed(plain.join(language, F.element_at("words", 1) == F.col("id_")).select("words", "n", "all"))

    size = F.size("words")
    inner = F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1)))
    above = counts.where(size > 2).select(inner.alias("words"), "n").groupBy("words").agg(F.max("n").alias("above"))
    left = _scored(counts, F.col("all")).join(above, "words", "left").where(F.col("above").isNull() | (100 * F.col("above") < percent * F.col("a"))).drop("above")

    each = left.select("*", F.posexplode("words").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = each.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(told.alias("phrase"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", max(limit, int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))))  # so that tasks pass on so many rows only
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = named.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
