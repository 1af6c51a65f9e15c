"""Motif discovery by expectation-maximisation in Spark rounds over whole sequence sets, with significance.

This is the published mixture model in its two forms, one motif a sequence or at most one. The
starts are words: Spark counts all words of a set in one pass, the words that stand there most
beyond what single letters explain are grown into matrices on these counts alone, a table of at
most 4 ** WORD numbers a set, and only the likeliest goes on into rounds over the sequences.

Significance asks how surely the motif is more than chance. The scores of its windows under the
background have a distribution that follows column by column, by convolution; it turns the best
window of each sequence into a chance. The number of sequences below a level is then held against
a binomial, at the best of LEVELS levels. The E-value multiplies by the levels and by the words that
could have started a motif."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.operators.sequences import PIECE, _known, _letters_of, _words
from helixframe.plans.materialise import checkpointed, small_batches

#: Words that start matrices, rounds on word counts, rounds over sequences at most, and how many sets there may be.
STARTS, SCREEN, ROUNDS, MOST_SETS = 8, 30, 8, 1000
#: A round that adds less than this share of the log likelihood ratio is the last.
GAIN = 1e-4
#: Words of at most so many letters are looked up at once.
WORD = 8
#: Sequences are kept in blocks of about so many letters.
BLOCK = 1 << 17
#: A task keeps the tables of so many sets.
READY = 64
#: Window scores are put into bins of this width for their distribution; levels of chance that are tried.
STEP, LEVELS = 0.02, 40


def expectation_maximisation(codes: np.ndarray, starts: list[np.ndarray], model: str, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[np.ndarray, float, float]:
    """(matrix, sites, log likelihood ratio) of the likeliest end, in memory; codes is [n, length] with 4 for unknown letters, starts are matrices."""
    width = len(starts[0])
    n, size = codes.shape
    last = size - width + 1
    windows = np.stack([codes[:, j : j + last] for j in range(width)], 2)  # [n, last, width]
    usable = (windows < 4).all(2)
    safe = np.where(windows < 4, windows, 0)
    known = codes[codes < 4]
    back = (np.bincount(known, minlength=4) + 1) / (len(known) + 4)
    best = (starts[0], 0.0, -np.inf)
    for pwm in starts:
        share, ratio = 0.5, -np.inf
        for _ in range(rounds):
            odds = np.log(pwm) - np.log(back)
            score = np.where(usable, sum(odds[j][safe[:, :, j]] for j in range(width)), -np.inf)
            weight = np.exp(score)
            mass = weight.sum(1) / last
            if model == "zoops":
                has = share * mass / (share * mass + (1 - share))
                now = float(np.log(share * mass + (1 - share)).sum())
                share = float(np.clip(has.mean(), 1e-3, 1 - 1e-3))
            else:
                has = (mass > 0).astype(float)
                now = float(np.log(np.maximum(mass, 1e-300)).sum())
            place = weight / np.maximum(weight.sum(1, keepdims=True), 1e-300) * has[:, None]
            counts = np.stack([[float(place[safe[:, :, j] == b].sum()) for b in range(4)] for j in range(width)])
            pwm = _smoothed(counts)
            if now - ratio < gain * max(1.0, abs(now)):
                break
            ratio = now
        if ratio > best[2]:
            best = (pwm, float(place.sum()), ratio)
    return best


def _smoothed(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.25) / (counts.sum(1, keepdims=True) + 1)


def _tables(ratio: np.ndarray) -> list[np.ndarray]:
    """For each piece of at most WORD columns the product of the columns' ratios by word, and 0 for a word with an unknown letter."""
    tables = []
    for lo in range(0, len(ratio), WORD):
        made = np.ones(1)
        for row in ratio[lo : lo + WORD]:
            made = (made[:, None] * row[None, :]).ravel()
        tables.append(np.append(made, 0.0))
    return tables


def _numbers(codes: np.ndarray, width: int) -> list[np.ndarray]:
    """For each piece of at most WORD columns of the windows the number of its word; 4 ** columns where a letter of the window is unknown."""
    usable, pieces = _known(codes, width), []
    for lo in range(0, width, WORD):
        n = min(WORD, width - lo)
        pieces.append(np.where(usable, _words(codes, n)[lo : lo + len(usable)], np.intp(4**n)))
    return pieces


def _letters(sums: np.ndarray, columns: int) -> np.ndarray:
    """Counts [columns, 4] from the sums by word."""
    cube = sums.reshape((4,) * columns)
    return np.stack([cube.sum(tuple(x for x in range(columns) if x != j)) for j in range(columns)])


def _by_sequence(values: np.ndarray, first: np.ndarray, size: int, how) -> np.ndarray:
    """how (a ufunc) over the windows that begin in each sequence; values has none for the last places of the codes."""
    return how.reduceat(np.concatenate([values, np.zeros(size - len(values), values.dtype)]), first)


def _expected(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, model: str, ratio: list[np.ndarray], share: float) -> np.ndarray:
    """Log likelihood ratio, sequences with a site, sites and, by word of each piece of the motif, the expected counts of the sequences that begin at first; ratio has the pieces' tables."""
    words = _numbers(codes, width)
    weight = ratio[0][words[0]]
    for word, by_word in zip(words[1:], ratio[1:], strict=True):
        weight *= by_word[word]
    total = _by_sequence(weight, first, len(codes), np.add)
    mass = total / np.maximum(sizes - width + 1, 1)
    if model == "zoops":
        has, now = share * mass / (share * mass + (1 - share)), np.log(share * mass + (1 - share))
    else:
        has, now = (mass > 0).astype(float), np.log(np.maximum(mass, 1e-300))
    factor = np.repeat(has / np.maximum(total, 1e-300), np.diff(np.append(first, len(codes))))
    place = weight * factor[: len(weight)]
    counts = [np.bincount(word, place, len(by_word))[:-1] for word, by_word in zip(words, ratio, strict=True)]
    long = sizes >= width
    return np.concatenate([[now[long].sum(), has[long].sum(), place.sum()], *counts])


def _by_letter(sums: np.ndarray, width: int) -> np.ndarray:
    """The sums of _expected with counts by column and letter instead of by word."""
    head, at, counts = sums[:3], 3, []
    for lo in range(0, width, WORD):
        n = min(WORD, width - lo)
        counts.append(_letters(sums[at : at + 4**n], n).ravel())
        at += 4**n
    return np.concatenate([head, *counts])


def _packed(rows: DataFrame) -> DataFrame:
    """(task, doc_id, n, size, codes, sizes): the sequences of each set in blocks of about BLOCK letters, doc_id that of a block's first one.

    A block has base codes, 4 for other letters and behind each sequence, the sequences' lengths, their number and
    the greatest length. So a round reads arrays and takes no sequence apart; a longer sequence is a block of its own."""
    kinds = [rows.schema[c].dataType for c in ("task", "doc_id")]
    arrow = [*map(to_arrow_type, kinds), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["task", "doc_id", "n", "size", "codes", "sizes"]

    def run(batches):
        held: dict = {}
        done: list[tuple] = []

        def close(task):
            first, longest, _, values = held.pop(task)
            done.append((task, first, len(values), longest, _letters_of(values).tobytes(), np.array([*map(len, values)], np.int64).tobytes()))

        def told():
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), arrow, strict=True)], names=names)
            done.clear()
            return made

        for batch in batches:
            text = batch.column(2)
            for task, doc, value, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text.cast(pa.large_binary()).to_pylist(), pc.utf8_length(text).to_pylist(), strict=True):
                if task in held and held[task][2] + len(value) > BLOCK:
                    close(task)
                block = held.setdefault(task, [doc, 0, 0, []])
                block[1] = max(block[1], size)
                block[2] += len(value) + 1
                block[3].append(value)
            if done:
                yield told()
        for task in list(held):
            close(task)
        if done:
            yield told()

    simple = [k.simpleString() for k in kinds]
    return rows.select("task", "doc_id", "seq").mapInArrow(run, f"task {simple[0]}, doc_id {simple[1]}, n int, size int, codes binary, sizes binary")


def _pieces(codes: np.ndarray, sizes: np.ndarray, overlap: int):
    """(first places, lengths, codes) of a block's sequences; one of more than a piece comes in parts that share overlap letters."""
    if len(sizes) > 1 or sizes[0] <= PIECE + overlap:
        yield np.cumsum(sizes + 1) - sizes - 1, sizes, codes
        return
    for at in range(0, int(sizes[0]) - overlap, PIECE):
        part = codes[at : min(at + PIECE + overlap, int(sizes[0]))]
        yield np.zeros(1, np.int64), np.array([len(part)]), np.append(part, np.int8(4))


def _over_sets(rows: DataFrame, sent: dict, make, overlap: int, schema: str, ready=None, end=None) -> DataFrame:
    """(task, k, value): the sums of the arrays that make(ready(sent), codes, first, sizes) gives, by set, and what end makes of them in each task; only numbers that are not 0 move. rows are blocks."""
    kind = to_arrow_type(rows.schema["task"].dataType)

    def run(batches):
        sums, held = {}, {}
        for batch in batches:
            for task, codes, sizes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if task in sent:
                    if task not in held:
                        if len(held) == READY:
                            held.clear()
                        held[task] = ready(sent[task]) if ready else sent[task]
                    for first, long, part in _pieces(np.frombuffer(codes.as_buffer(), np.int8), np.frombuffer(sizes.as_buffer(), np.int64), overlap):
                        made = make(held[task], part, first, long)
                        sums[task] = sums[task] + made if task in sums else made
        for task, made in sums.items():
            made = end(made) if end else made
            at = np.flatnonzero(made)
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(at), kind), pa.array(at.astype(np.int32)), pa.array(made[at].astype(float))], names=["task", "k", "value"])

    return rows.select("task", "codes", "sizes").mapInArrow(run, schema).groupBy("task", "k").agg(F.sum("value").alias("value"))


def _gathered(summed: DataFrame, size: int) -> dict:
    """The sums of each set as an array of size numbers."""
    found: dict = {}
    table = summed.toArrow()  # at most sets times size numbers
    for task, k, value in zip(table["task"].to_pylist(), table["k"].to_pylist(), table["value"].to_pylist(), strict=True):
        found.setdefault(task, np.zeros(size))[k] = value
    return found


def start_words(counts: np.ndarray, letters: int, back: np.ndarray, starts: int) -> list[int]:
    """The words (numbers in base 4) that occur most beyond what single letters explain; of words that share all but a letter at an end with a better one none."""
    chance = np.ones(1)
    for _ in range(letters):
        chance = (chance[:, None] * back[None, :]).ravel()
    wanted = counts.sum() * chance
    excess = (counts - wanted) / np.sqrt(np.maximum(wanted, 1e-9))
    taken: list[int] = []
    size = 4 ** (letters - 1)
    for at in np.argsort(-excess, kind="stable").tolist():
        if all(at % size != t // 4 and at // 4 != t % size for t in taken):
            taken.append(at)
            if len(taken) == starts:
                break
    return taken


def _grown(counts: np.ndarray, letters: int, back: np.ndarray, word: int) -> tuple[float, np.ndarray]:
    """(log likelihood ratio, matrix) of a start by the mixture of motif and background on counts of words."""
    digits = [word // 4**j % 4 for j in reversed(range(letters))]
    pwm, share = 0.6 * np.eye(4)[digits] + 0.4 * back, 0.01
    now = -math.inf
    for _ in range(SCREEN):
        weight = _tables(pwm / back)[0][:-1]
        mixed = share * weight / (share * weight + (1 - share))
        now = float((counts * np.log(share * weight + (1 - share))).sum())
        place = counts * mixed
        pwm, share = _smoothed(_letters(place, letters)), float(np.clip(place.sum() / max(1.0, counts.sum()), 1e-6, 0.5))
    return now, pwm


def score_tail(pwm: np.ndarray, back: np.ndarray) -> tuple[float, np.ndarray]:
    """(lowest score, chances): the chance of a window score (log odds, in steps of STEP above the lowest) or a higher one under the background, by convolution over the columns."""
    steps = np.round(np.log(pwm / back) / STEP).astype(int)
    low = steps.min(1)
    sums = np.ones(1)
    for row, least in zip(steps, low, strict=True):
        column = np.zeros(int(row.max() - least) + 1)
        np.add.at(column, row - least, back)
        sums = np.convolve(sums, column)
    return float(low.sum()), np.minimum(1.0, np.cumsum(sums[::-1])[::-1])


def _with_scores(state: dict) -> dict:
    """state with the score of each word by piece of the motif."""
    tables = []
    for lo in range(0, len(state["steps"]), WORD):
        table = np.zeros(1, np.int64)
        for row in state["steps"][lo : lo + WORD]:
            table = (table[:, None] + row[None, :]).ravel()
        tables.append(np.append(table, -(10**9)))
    return state | {"tables": tables}


def _chances(state: dict, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many sequences have a best window of at most each level of chance, and how many there are."""
    low, above, width = state["low"], state["above"], len(state["steps"])
    score = 0
    for word, table in zip(_numbers(codes, width), state["tables"], strict=True):
        score = score + table[word]
    best = _by_sequence(np.maximum(score - int(low), -1), first, len(codes), np.maximum)[sizes >= width]
    windows = (sizes - width + 1)[sizes >= width]
    p = np.where(best >= 0, above[np.clip(best, 0, len(above) - 1)], 1.0)
    whole = -np.expm1(windows * np.log1p(-np.minimum(p, 1 - 1e-16)))
    return np.append([(whole <= level).sum() for level in state["levels"]], len(whole)).astype(float)


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """The natural logarithm of the chance of k or more of n."""
    if k <= n * p:
        return 0.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, ratio, at = 1.0, 1.0, k
    while at < n and ratio > 1e-17:
        ratio *= (n - at) / (at + 1) * p / (1 - p)
        total += ratio
        at += 1
    return min(0.0, term + math.log(total))


def discovered(tasks: DataFrame, width: int, model: str = "zoops") -> DataFrame:
    """task, pwm, sites, score, n and log10_evalue for the sequence sets (task, doc_id, seq).

    All sequences take part, those shorter than the motif as ones without a site: one pass counts words, at most
    ROUNDS passes sum the expected counts under the matrix so far, one pass tells how many
    sequences match how well. The driver holds a table of words and a matrix for each set, so
    there may be MOST_SETS sets; more fail. log10_evalue is that of the number of motifs as
    marked as this to be expected by chance. A sequence of more than a million letters counts as several. Fails on a
    set without a sequence as long as the motif."""
    spark = tasks.sparkSession
    small_batches(spark)
    # several rounds read the sequences: they are packed once, and the blocks dealt evenly over as many tasks as their size asks for
    rows = checkpointed(_packed(tasks.select("task", "doc_id", F.upper("seq").alias("seq")).where("seq is not null")).repartition("doc_id"))
    kind = rows.schema["task"].dataType.simpleString()
    schema = f"task {kind}, k int, value double"
    facts = rows.groupBy("task").agg(F.sum("n").alias("n"), F.max("size").alias("size")).limit(MOST_SETS + 1).collect()
    if len(facts) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets")
    sets = {r["task"]: r for r in facts}
    for task, row in sets.items():
        if row["size"] < width:
            raise ValueError(f"no sequence of set {task} is as long as the motif")
    letters = min(WORD, width)

    def count(_, codes, first, sizes):
        words = np.bincount(_words(codes, letters)[_known(codes, letters)], minlength=4**letters)
        return np.concatenate([np.bincount(codes, minlength=5)[:4], words])

    counted = _gathered(_over_sets(rows, dict.fromkeys(sets, True), count, letters - 1, schema), 4 + 4**letters)
    state: dict = {}
    for task in sets:
        made = counted.get(task, np.zeros(4 + 4**letters))
        back = (made[:4] + 1) / (made[:4].sum() + 4)
        _, core = max((_grown(made[4:], letters, back, word) for word in start_words(made[4:], letters, back, STARTS)), key=lambda x: x[0])
        side = (width - letters) // 2
        pwm = np.concatenate([np.tile(back, (side, 1)), core, np.tile(back, (width - letters - side, 1))])
        state[task] = {"back": back, "pwm": pwm, "start": pwm, "share": 0.5, "ratio": -np.inf, "sites": 0.0, "live": True}
    for _ in range(ROUNDS):
        sent = {task: (x["pwm"] / x["back"], x["share"]) for task, x in state.items() if x["live"]}
        if not sent:
            break
        make = lambda held, codes, first, sizes: _expected(codes, first, sizes, width, model, *held)
        for task, made in _gathered(_over_sets(rows, sent, make, width - 1, schema, lambda held: (_tables(held[0]), held[1]), lambda made: _by_letter(made, width)), 3 + 4 * width).items():
            x = state[task]
            if model == "zoops":
                x["share"] = float(np.clip(made[1] / sets[task]["n"], 1e-3, 1 - 1e-3))
            x["pwm"], x["sites"] = _smoothed(made[3:].reshape(width, 4)), float(made[2])
            x["live"] = made[0] - x["ratio"] >= GAIN * max(1.0, abs(made[0]))
            x["ratio"] = float(made[0]) if x["live"] else x["ratio"]
    levels = [0.5 * 0.7**k for k in range(LEVELS)]
    sent = {}
    for task, x in state.items():
        low, above = score_tail(x["pwm"], x["back"])
        sent[task] = {"low": low, "above": above, "steps": np.round(np.log(x["pwm"] / x["back"]) / STEP).astype(int), "levels": levels}
    marked = _gathered(_over_sets(rows, sent, _chances, width - 1, schema, _with_scores), LEVELS + 1)
    out = []
    for task, row in sets.items():
        x, hits = state[task], marked.get(task, np.zeros(LEVELS + 1))
        surest = min(log_binomial_tail(int(k), int(hits[-1]), level) for k, level in zip(hits, levels, strict=False))
        tried = math.log10(LEVELS) + letters * math.log10(4)
        out.append((task, x["pwm"].tolist(), x["sites"], x["ratio"], row["n"], surest / math.log(10) + tried))
    return spark.createDataFrame(out, f"task {kind}, pwm array<array<double>>, sites double, score double, n bigint, log10_evalue double")
