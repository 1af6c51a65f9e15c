"""Background models and scanning of sequences with position weight matrices."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.functions.dna import flipped_matrix, log_or_minus_infinity

BASES = "ACGT"
#: A set of motifs is broadcast to the scanner up to so many matrix rows.
BROADCAST_ROWS = 200_000
#: Sequences are read so many letters at a time; scores are looked up by words of WORD letters.
PIECE, WORD = 1 << 20, 5
#: Words of at most so many letters are scored in a table, at most 65,536 rows.
LISTED = 8
_CODE = np.full(256, 4, np.int8)
_CODE[list(b"ACGT")] = _CODE[list(b"acgt")] = range(4)


def _letters_of(values: list[bytes]) -> np.ndarray:
    """Base codes of sequences in a row, 4 for other letters and behind each sequence."""
    return _CODE[np.frombuffer(b"\n".join([*values, b""]), np.uint8)]


def _pieces(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each sequence, first places, codes) of the sequences of a column, about PIECE letters at a time; a longer sequence comes in parts that share overlap letters."""
    rows, held, size = [], [], 0

    def flush():
        ends = np.cumsum([len(v) + 1 for v in held])
        return np.array(rows), ends - [len(v) + 1 for v in held], _letters_of(held)

    for row, value in enumerate(pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()):
        at = 0
        while at == 0 or at + overlap < len(value):
            part = value[at : at + PIECE + overlap]
            if held and size + len(part) > PIECE + overlap:
                yield flush()
                rows, held, size = [], [], 0
            rows.append(row)
            held.append(part)
            size += len(part) + 1
            at += PIECE
    if held:
        yield flush()


def _words(codes: np.ndarray, k: int) -> np.ndarray:
    """The number of the word of k letters at each place, other letters read as A. Words are made from words of half their letters."""
    last, n = max(0, len(codes) - k + 1), 0
    word = np.zeros(last, np.int32)
    part, held = np.where(codes < 4, codes, 0).astype(np.int32), 1
    while n < k:
        if k & held:
            more = part[n : n + last]
            word = word * 4**held + more if n else more
            n += held
        if n < k:
            part, held = part[:-held] * 4**held + part[held:], 2 * held
    return word


def _known(codes: np.ndarray, k: int) -> np.ndarray:
    """Whether each window of k letters has base letters only."""
    known, held = codes < 4, 1
    while held < k and len(known):
        step = min(held, k - held)
        known, held = known[:-step] & known[step:], held + step
    return known


def word_counts(sequences: DataFrame, longest: int, both_strands: bool = False) -> DataFrame:
    """(k, at, n): how often each unambiguous word of 1 to longest letters stands in the sequences (seq), in one pass; at is its number in base 4, words that do not occur are left out.

    A task counts in arrays of 4 ** k numbers and passes on only those."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(4**k, np.int64) for k in range(1, longest + 1)}
        for batch in batches:
            for k in sums:
                for _, _, codes in _pieces(batch.column(0), k - 1):
                    sums[k] += np.bincount(_words(codes, k)[_known(codes, k)], minlength=4**k)
        for k, n in sums.items():
            if both_strands:
                n = n + n.reshape((4,) * k)[(slice(None, None, -1),) * k].transpose().ravel()
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["k", "at", "n"])

    parts = sequences.select("seq").mapInArrow(count, "k int, at int, n bigint")
    return parts.groupBy("k", "at").agg(F.sum("n").alias("n"))


def _word(k: int) -> Column:
    """The word of k letters whose number is at."""
    return F.concat(*[F.substring(F.lit(BASES), (F.floor(F.col("at") / 4**j) % 4 + 1).cast("int"), F.lit(1)) for j in reversed(range(k))])


def kmer_counts(sequences: DataFrame, k: int, both_strands: bool = False) -> DataFrame:
    """(word, n): unambiguous words of k letters over all sequences (seq)."""
    return word_counts(sequences, k, both_strands).where(F.col("k") == k).select(_word(k).alias("word"), "n")


def markov_table(sequences: DataFrame, order: int, pseudocount: float = 0.1, both_strands: bool = False) -> DataFrame:
    """(word, k, freq): the frequency of every word of 1 to order + 1 letters, none of them zero.

    Each possible word's count gets pseudocount / 4 ** k; frequencies of one length sum to 1."""
    spark = sequences.sparkSession
    every = [spark.range(4**k).select(F.lit(k).alias("k"), F.col("id").cast("int").alias("at")).withColumn("word", _word(k)) for k in range(1, order + 2)]
    counted = functools.reduce(DataFrame.unionByName, every).join(word_counts(sequences, order + 1, both_strands), ["k", "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("k"))  # at most 4 ** k rows
    return counted.select("word", "k", ((F.col("n") + F.lit(pseudocount) / F.pow(F.lit(4.0), F.col("k"))) / (total + pseudocount)).alias("freq"))


def scan_sql(sequences: DataFrame, pwm: list[list[float]], background: dict[str, float]) -> DataFrame:
    """(doc_id, max_log_odds) in DataFrame functions: the best window of either strand against single-letter frequencies.

    Windows with other letters than ACGT are passed over; a sequence without a window left has none."""
    width = len(pwm)
    both = []
    for matrix in (pwm, [row[::-1] for row in pwm[::-1]]):
        steps = []
        for j, row in enumerate(matrix):
            odds = F.lit(None).cast("double")
            for base, p in zip(BASES, row, strict=True):
                odds = F.when(F.substring("word", j + 1, 1) == base, log_or_minus_infinity(F.lit(float(p))) - F.log(F.lit(background[base]))).otherwise(odds)
            steps.append(odds)
        both.append(sum(steps[1:], steps[0]))
    last = F.length("seq") - (width - 1)
    places = sequences.where(last >= 1).select("doc_id", "seq", F.explode(F.sequence(F.lit(1), last)).alias("i_"))
    words = places.select("doc_id", F.col("seq").substr(F.col("i_"), F.lit(width)).alias("word"))
    if width <= LISTED:  # every word is scored once, and a window looks its word up
        every = sequences.sparkSession.range(4**width).select(F.col("id").alias("at")).select(_word(width).alias("word")).select("word", F.greatest(*both).alias("odds_"))
        scored = words.join(F.broadcast(every), "word")
    else:  # a word with another letter has no odds
        scored = words.select("doc_id", F.greatest(*both).alias("odds_")).where("odds_ is not null")
    return scored.groupBy("doc_id").agg(F.max("odds_").alias("max_log_odds"))


class Scanner:
    """Log odds of motifs at all places of sequences. What the motifs share, the numbers of words and the background of windows, is made once for all; a motif adds the scores of its pieces of WORD columns, looked up by word."""

    def __init__(self, motifs: list[tuple], background: dict[str, float], order: int):
        self.order = order
        name = lambda k, at: "".join(BASES[at // 4**j % 4] for j in reversed(range(k)))
        self.below = [np.zeros(1), *(np.log([background[name(k, at)] for at in range(4**k)]) for k in range(1, order + 2))]
        self.motifs = []
        for motif_id, pwm in motifs:
            plus = np.array([list(r) for r in pwm], float)
            with np.errstate(divide="ignore"):
                strands = [self._tables(np.log(m)) for m in (plus, plus[::-1, ::-1])]
            if len(plus) <= LISTED:  # one table tells a whole word's better strand
                strands = [[(0, len(plus), functools.reduce(np.maximum, [functools.reduce(lambda x, y: (x[:, None] + y[None, :]).ravel(), [made for _, _, made in pieces]) for pieces in strands]))]]
            self.motifs.append((motif_id, len(plus), strands))

    @staticmethod
    def _tables(odds: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(first column, columns, score of each word) for the pieces of a matrix."""
        out = []
        for lo in range(0, len(odds), WORD):
            made = np.zeros(1)
            for row in odds[lo : lo + WORD]:
                made = (made[:, None] + row[None, :]).ravel()
            out.append((lo, min(WORD, len(odds) - lo), made))
        return out

    def _background(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Of each window: its first word's frequency, then each letter given the ones before it; infinite where a letter is unknown."""
        head = min(self.order + 1, width)
        last = max(0, len(codes) - width + 1)
        below = self.below[head][_words(codes, head)[:last]]
        if width > head:
            step = self.below[self.order + 1][_words(codes, self.order + 1)] - self.below[self.order][_words(codes, self.order)[: len(codes) - self.order]]
            for j in range(head - self.order, width - self.order):  # in one order, so that a word weighs alike wherever it stands
                below = below + step[j : j + last]
        return np.where(_known(codes, width), below, np.inf)

    def best(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
        """For each motif the best window of either strand of each sequence that begins at first; minus infinity without one."""
        words: dict[int, np.ndarray] = {}
        below: dict[int, np.ndarray] = {}
        for motif_id, width, strands in self.motifs:
            last = len(codes) - width + 1
            if last < 1:
                yield motif_id, np.full(len(first), -np.inf)
                continue
            if width not in below:
                below[width] = self._background(codes, width)
            best = None
            for tables in strands:
                total = None
                for lo, k, table in tables:
                    if k not in words:
                        words[k] = _words(codes, k)
                    part = table[words[k][lo : lo + last]]
                    total = part if total is None else total + part
                best = total if best is None else np.maximum(best, total)
            scores = np.full(len(codes), -np.inf)
            scores[:last] = best - below[width]
            yield motif_id, np.maximum.reduceat(scores, first)


def scan(sequences: DataFrame, motifs: DataFrame, background: dict[str, float], order: int, best_only: bool = False) -> DataFrame:
    """(doc_id, motif_id, max_log_odds) for every sequence and motif, by an Arrow kernel; with best_only for the best motif of each sequence, on ties the one of the greatest id.

    Sequences may be of any length: what is longer than PIECE is scanned in parts that overlap by
    the widest motif less a letter, so no site is lost. motifs (motif_id, pwm) are broadcast up to
    BROADCAST_ROWS matrix rows, else they take turns in blocks of that size. Fails on a sequence
    without a finite score, as one that is shorter than a motif or has no unambiguous window."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    columns = f"doc_id {kind(sequences, 'doc_id')}, motif_id {kind(motifs, 'motif_id')}, max_log_odds double"
    kinds = to_arrow_type(motifs.schema["motif_id"].dataType)
    out, block, rows = None, [], 0

    def over(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(held.value, background, order)
            widest = max(width for _, width, _ in scanner.motifs)
            ids = pa.array([k for k, _ in held.value], kinds)
            falling = np.array(sorted(range(len(held.value)), key=lambda k: held.value[k][0], reverse=True)) if best_only else None
            for batch in batches:
                best = np.full((len(held.value), batch.num_rows), -np.inf)
                for row, first, codes in _pieces(batch.column(1), widest - 1):
                    for k, (_, scores) in enumerate(scanner.best(codes, first)):
                        np.maximum.at(best[k], row, scores)
                if not np.isfinite(best).all():
                    raise ValueError("sequence without a finite score, or shorter than the matrix")
                if best_only:
                    top = falling[np.argmax(best[falling], 0)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), ids.take(pa.array(top)), pa.array(best[top, np.arange(batch.num_rows)])], names=["doc_id", "motif_id", "max_log_odds"])
                    continue
                for k in range(len(best) if batch.num_rows else 0):
                    yield pa.RecordBatch.from_arrays([batch.column(0), ids.take(pa.array([k] * batch.num_rows, pa.int64())), pa.array(best[k])], names=["doc_id", "motif_id", "max_log_odds"])

        return sequences.select("doc_id", "seq").mapInArrow(run, columns)

    def join(done, held):
        made = over(sequences.sparkSession.sparkContext.broadcast(held))
        return made if done is None else done.unionByName(made)

    for motif in motifs.select("motif_id", "pwm").toLocalIterator():
        if block and rows + len(motif["pwm"]) > BROADCAST_ROWS:
            out, block, rows = join(out, block), [], 0
        block.append((motif["motif_id"], [list(r) for r in motif["pwm"]]))
        rows += len(motif["pwm"])
    several = out is not None
    out = join(out, block) if block or out is None else out
    if best_only and several:  # the best of each block
        out = out.groupBy("doc_id").agg(F.max(F.struct("max_log_odds", "motif_id")).alias("b_")).select("doc_id", "b_.motif_id", "b_.max_log_odds")
    return out


def motif_distances(pairs: DataFrame, metric: str = "jsd", fraction: float = 0.8, clamp: bool = True) -> DataFrame:
    """pairs (a and b are matrices) with distance, shift, strand and overlap: the best alignment of either strand.

    An alignment's distance is the sum over overlapping columns of their distance (Jensen-Shannon
    in bits, total variation, or Hellinger), plus 1 for each column without partner, over the
    number of columns of the union. Shifts run so that fraction of the longer matrix could
    overlap. Ties go to the plus strand, then the smallest shift. Without an alignment all are
    null. With clamp the distance is kept within 0 and 1, else it is the score as it comes out.
    All alignments of a pair are tried within its row, so nothing is shuffled."""
    names = ["x_", "y_", "z_", "need_", "best_"]
    need = F.ceil(F.greatest(F.size("a"), F.size("b")) * F.lit(fraction)).cast("int")
    scaled = lambda m: F.transform(m, lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda s, y: s + y)))
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, v: s + v)

    def column(r, q):
        if metric == "tv":
            return total(F.zip_with(r, q, lambda u, v: F.abs(u - v))) / 2
        if metric == "hellinger":
            return F.sqrt(total(F.zip_with(r, q, lambda u, v: (F.sqrt(u) - F.sqrt(v)) * (F.sqrt(u) - F.sqrt(v)))) / 2)
        part = lambda u, v: F.when(u > 0, u * F.log2(u / ((u + v) / 2))).otherwise(0.0)
        return total(F.zip_with(r, q, lambda u, v: part(u, v) + part(v, u))) / 2

    x, y, z = (F.col(c) for c in names[:3])
    low, high = F.col(names[3]) - F.size(y), F.size(x) - F.col(names[3])

    def placed(strand, m):
        def at(shift):
            start = F.greatest(F.lit(0), shift)
            overlap = F.least(F.size(x), shift + F.size(m)) - start
            columns = total(F.zip_with(F.slice(x, start + 1, overlap), F.slice(m, start - shift + 1, overlap), column))
            unmatched = F.size(x) + F.size(m) - 2 * overlap
            return F.struct(((columns + unmatched) / (overlap + unmatched)).alias("score"), F.lit(strand).alias("strand"), shift.cast("int").alias("shift"), overlap.cast("int").alias("overlap"))

        return F.transform(F.filter(F.sequence(low, high), lambda k: F.least(F.size(x), k + F.size(m)) > F.greatest(F.lit(0), k)), at)

    names_of = pairs.withColumns({names[0]: scaled(F.col("a")), names[1]: scaled(F.col("b")), names[3]: need}).withColumn(names[2], flipped_matrix(y))
    best = names_of.withColumn(names[4], F.when(low <= high, F.array_min(F.concat(placed("+", y), placed("-", z)))))
    score = F.col(f"{names[4]}.score")
    distance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) if clamp else score
    return best.select(*pairs.columns, F.when(score.isNotNull(), distance).alias("distance"), *[F.col(f"{names[4]}.{c}").alias(c) for c in ("shift", "strand", "overlap")])
