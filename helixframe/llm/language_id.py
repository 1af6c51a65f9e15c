"""Language identification by cross-parsing.

For each language the suffix automaton of a sample of its labelled text accepts exactly the
substrings of the sample. A text is parsed from left to right into longest phrases that the
sample holds; the language that needs the fewest phrases, normalised by how many its own
held-back text needs, wins. The count of phrases a symbol, times the logarithm of the sample's
length, estimates the cross entropy, so samples of different lengths can be compared.

Texts are read as letters in lower case with single spaces for all else, and these as the bytes
of UTF-8, so that an alphabet is small in any script and no letter has to be left out of one.
For speed a text is parsed in blocks of BLOCK bytes that advance side by side through the
transition table; a block end closes a phrase in every language alike.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import other_columns, small_batches, text_values

#: A sample is at most so many documents and symbols a language; half as many more documents are held back to normalise.
SAMPLE_DOCUMENTS = 96
SAMPLE_SYMBOLS = 60_000
#: All samples together, which bounds the automata at some 300 MB.
ALL_SYMBOLS = 480_000
#: So many languages are learnt at most, and so many characters of all of them reach the driver.
MOST_LANGUAGES, ALL_CHARACTERS = 1000, 48_000_000
#: Lengths in characters of the documents that a sample takes first; others follow where a language has too few, the longer ones with their first part.
SAMPLE_LENGTHS = (200, 10_000)
BLOCK = 256
#: No byte of UTF-8: what fills up the last block of a text.
PADDING = 255
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, bool)


def letter_table() -> np.ndarray:
    """True at the code points of letters."""
    if not _LETTER.any():
        _LETTER[:] = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> np.ndarray:
    """The bytes of letters in lower case, with one space (0x20) for each run of others, none at the ends."""
    points = code_points(text)
    letter = letter_table()[points]
    points = np.where(letter, points, 0x20)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]
    points = points[:-1] if len(points) and points[-1] == 0x20 else points
    return np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton: [state * alphabet + symbol] is the next state, or -1."""
    following, link, length = [dict()], [-1], [0]
    last = 0
    for c in symbols:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.full((len(following), alphabet), -1, np.int32)
    for state, moves in enumerate(following):
        for c, to in moves.items():
            table[state, c] = to
    return table.ravel()


#: Automata by the digest of what they were built from; a Python worker builds them once.
_BUILT: dict[str, list[np.ndarray]] = {}


class CrossParser:
    """Suffix automata of all languages, each over the bytes of its own sample.

    What travels to the tasks is the samples; the automata, a hundred times as large, are
    built where they are used."""

    def __init__(self, samples: dict[str, list[np.ndarray]], held: dict[str, list[np.ndarray]]):
        self.languages = sorted(samples)
        joined = [np.concatenate([x for s in samples[k] for x in (s, np.array([0x20], np.uint8))]) for k in self.languages]
        size, room = SAMPLE_SYMBOLS, ALL_SYMBOLS
        for k, n in enumerate(sorted(map(len, joined))):  # what short samples leave is for the others
            size = min(SAMPLE_SYMBOLS, room // (len(joined) - k))
            room -= min(n, size)
        self.codes, self.widths, self.texts = [], [], []
        for text in joined:
            alphabet = np.unique(text[:size])
            codes = np.zeros(256, np.uint8)  # 0 is a byte that the sample does not have
            codes[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint8)
            self.codes.append(codes)
            self.widths.append(len(alphabet) + 1)
            self.texts.append(codes[text[:size]])
        sizes = np.array([len(text) for text in self.texts], np.int64)
        self.bits = np.log2(np.maximum(2, sizes))
        self.base = np.ones(len(self.languages))
        own = [np.mean([r[0][0] for r in self.rates(held.get(name) or samples[name][-8:], [k])] or [1.0]) for k, name in enumerate(self.languages)]
        needs = np.array(own) * self.bits
        # A small sample needs many bits for its own text too; to divide by them would hide how badly it fits others.
        if len(sizes):
            self.base = np.minimum(needs, needs[2 * sizes >= sizes.max()].max()) / self.bits

    def steps(self) -> list[np.ndarray]:
        """For each language [state * width + code]: twice the next state, plus 1 where a phrase ends before the symbol."""
        digest = hashlib.sha256(b"|".join(t.tobytes() for t in self.texts)).hexdigest()
        if digest not in _BUILT:
            _BUILT.clear()
            made = []
            for text, width in zip(self.texts, self.widths, strict=True):
                table = suffix_automaton(text.tolist(), width)
                fails = table < 0
                table = np.where(fails, np.tile(np.maximum(table[:width], 0), len(table) // width), table)
                made.append((table * 2 + fails).astype(np.int32))
            _BUILT[digest] = made
        return _BUILT[digest]

    def phrases(self, blocks: np.ndarray, which: list[int]) -> np.ndarray:
        """Phrases for each of which languages (row) and block (column); blocks is [BLOCK, n], filled up with PADDING."""
        counts = np.zeros((len(which), blocks.shape[1]), np.int64)
        live = blocks != PADDING
        full = live.all(axis=1)
        steps = self.steps()
        for k, at in enumerate(which):
            step, width = steps[at], self.widths[at]
            state = np.zeros(blocks.shape[1], np.int64)
            for row, here, whole in zip(self.codes[at][blocks], live, full.tolist(), strict=True):
                value = step[state * width + row]
                counts[k] += value & 1 if whole else (value & 1) * here
                state = value >> 1
        return counts + 1

    def rates(self, texts: list[np.ndarray], which: list[int] | None = None) -> Iterator[tuple[np.ndarray, int]]:
        """(phrases a symbol for each of which languages, all if none are named, divided by the language's own rate; symbols) of folded texts."""
        which = list(range(len(self.languages))) if which is None else which
        sizes = np.array([len(t) for t in texts], np.int64)
        tall = -(-sizes // BLOCK)
        ends = np.cumsum(tall)
        flat = np.full(int(ends[-1]) * BLOCK if len(ends) else 0, PADDING, np.uint8)
        for text, end, n in zip(texts, ends.tolist(), tall.tolist(), strict=True):
            flat[(end - n) * BLOCK : (end - n) * BLOCK + len(text)] = text
        counts = self.phrases(np.ascontiguousarray(flat.reshape(-1, BLOCK).T), which) if len(flat) else np.zeros((len(which), 0))
        sums = np.concatenate([np.zeros((len(which), 1)), np.cumsum(counts, axis=1)], axis=1)
        for end, n, size in zip(ends.tolist(), tall.tolist(), sizes.tolist(), strict=True):
            yield (sums[:, end] - sums[:, end - n]) / max(1, size) / self.base[which], size

    def judged(self, texts: list[np.ndarray]) -> Iterator[tuple[str, float]]:
        """(language, score): the score is the winner's share when each language weighs 2 ** -(excess bits of 40 symbols)."""
        for rate, size in self.rates(texts):
            if not size or not self.languages:
                yield UNKNOWN, 0.0
                continue
            best = int(np.argmin(rate))
            weights = np.exp2(-(rate - rate[best]) * self.base[best] * self.bits[best] * min(size, 40))
            yield self.languages[best], float(1 / weights.sum())


def learned(docs: DataFrame, training: Column) -> CrossParser:
    """The parser learnt from labelled documents where training holds.

    At most 1.5 * SAMPLE_DOCUMENTS rows a language and ALL_CHARACTERS in all reach the driver: each language has an
    equal share of them. More than MOST_LANGUAGES labels fail, as a column of something else would have. Copies
    count once: Spark ranks the distinct hashes of a language's texts, and only the texts of the
    first ones are fetched. A language with a single text holds back its end."""
    rank = Window.partitionBy("lang").orderBy("odd_", "hash_")
    keep = SAMPLE_DOCUMENTS + SAMPLE_DOCUMENTS // 2
    known = docs.where(training).where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("hash_"))
    languages = known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    most = F.least(F.length("text"), F.lit(SAMPLE_LENGTHS[1]))
    odd = (~F.length("text").between(*SAMPLE_LENGTHS)).cast("int").alias("odd_")
    keys = known.select("lang", "hash_", odd, most.alias("most_")).distinct().withColumn("rank_", F.row_number().over(rank)).where(F.col("rank_") <= keep)
    share = ALL_CHARACTERS // max(1, languages)
    keys = keys.withColumn("before_", F.sum("most_").over(rank.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most_")).where(F.col("before_") < share)
    picked = known.join(F.broadcast(keys), ["lang", "hash_"])  # at most MOST_LANGUAGES * keep rows
    cut = F.substring("text", F.lit(1), F.least(F.lit(SAMPLE_LENGTHS[1]), share - F.col("before_")).cast("int"))
    rows = picked.groupBy("lang", "rank_").agg(F.min(cut).alias("text")).collect()
    samples: dict[str, list] = {}
    held: dict[str, list] = {}
    for at, row in enumerate(sorted(rows, key=lambda r: (r["lang"], r["rank_"])), 1):
        text = folded(row["text"])
        if len(text):
            part = samples if len(samples.get(row["lang"], [])) < SAMPLE_DOCUMENTS and (at % 3 or row["lang"] not in samples) else held
            part.setdefault(row["lang"], []).append(text)
    for name, parts in samples.items():
        if name not in held and len(parts) > 1:
            held[name] = [parts.pop()]
        elif name not in held and len(parts[0]) > 2:
            end = len(parts[0]) * 2 // 3
            parts[0], held[name] = parts[0][:end], [parts[0][end:]]
    return CrossParser(samples, held)


def identified(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1), from text alone.

    A null text, one without a letter, and any text when nothing was learnt, is "und" with
    score 0; equal counts go to the language first by name. Other columns and repeated rows
    are kept as they are; columns named lang_pred and lang_score are replaced."""
    small_batches(docs.sparkSession)
    own = [docs.schema[c] for c in other_columns(docs, "lang_pred", "lang_score")]
    at = [f.name for f in own].index("text")
    held = docs.sparkSession.sparkContext.broadcast(parser)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, group, size = [], [], 0
            for text in text_values(batch.column(at)):
                group.append(folded(text))
                size += len(group[-1])
                if size >= 1 << 20:
                    made += held.value.judged(group)
                    group, size = [], 0
            made += held.value.judged(group)
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "lang_score"])

    added = T._parse_datatype_string("lang_pred string, lang_score double").fields
    return docs.select([f.name for f in own]).mapInArrow(scan, T.StructType([*own, *added]))
