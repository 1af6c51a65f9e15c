"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a document's counts and votes 1 (good), 0 (bad) or abstains (null).
Expectation-maximisation over the table of vote patterns (at most 3 ** rules rows, however
many documents) estimates each rule's accuracy in both classes and the share of good
documents, freely and from several starts, of which the likeliest end is taken; the class
whose documents the rules more often call good is the good one. The posterior probability of
being good then decides, in place of a demand that a document pass every rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import checkpointed

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = """the of and to in is that it for with as was on be by this are from
de la le et les des en un une du que qui est pour dans au sur par
der die das und den von zu mit sich auf ist im dem nicht ein eine
el los las y del se con por su para al lo es""".split()

#: A power of two: windows are hashed by doubling.
WINDOW_WORDS = 8
#: Where expectation-maximisation begins: the share of good documents, and the chance of a good vote on good and on bad ones.
STARTS = ((0.5, 0.97, 0.6), (0.9, 0.9, 0.4), (0.1, 0.9, 0.4), (0.5, 0.8, 0.2))
SYMBOLS = "[#*$%&|<>]"
#: A word of letters with one usual mark after it at most.
CLEAN_WORD = r"(?<![^\x20\x09-\x0D])[\p{L}'’-]++[.,;:?!]?(?![^\x20\x09-\x0D])"
SPACE = r"[\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once though body may name it often, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(characters))


def _doubled(span: int):
    """Hashes of runs of 2 * span words from those of span words; the last ones run past the end."""
    return lambda codes: F.transform(codes, lambda h, i: F.xxhash64(h, F.get(codes, i + span)))


def _repeated_words(words: Column, size: int) -> Column:
    """How many words lie in windows of size words that the text holds twice or more.

    Windows stand for themselves by a 64-bit hash. A text whose window hashes are all
    distinct, as most are, needs no sorting."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(order: Column) -> Column:
            same = lambda x, k: F.coalesce(x["h"] == F.get(order, k)["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(size), at + size - acc["end"])).alias("n"), (at + size).alias("end"))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(_let(pairs, positions), start, step, lambda acc: acc["n"].cast("bigint"))

    def judged(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered(hashes))

    many = F.transform(words, lambda w: F.xxhash64(w))
    span = 1
    while span < size:
        many = _let(many, _doubled(span))
        span *= 2
    many = F.slice(many, F.lit(1), F.size(words) - (size - 1))
    return F.when(F.size(words) <= size, F.lit(0).cast("bigint")).otherwise(_let(many, judged))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the counts that the rules read; a null text counts as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    with_words = docs.withColumns(
        {
            "words_": F.array_remove(F.split(text, SPACE + "+", -1), ""),
            "lines_": lines,
            "n_upper_": _count(text, r"\p{Lu}").cast("double"),
            "n_bang_": _count(text, "!").cast("double"),
            "n_stop_": _count(text, "[.!?]").cast("double"),
            "n_clean_": _count(text, CLEAN_WORD).cast("double"),
            "n_symbols": _count(text, SYMBOLS).cast("bigint"),
            "word_chars": (F.length(text) - _count(text, SPACE)).cast("bigint"),
        }
    )
    known = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return with_words.withColumns(
        {
            "n_words": F.size("words_").cast("bigint"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("bigint"),
            "n_lines_": F.size("lines_").cast("double"),
            "n_known_": F.size(F.array_intersect("words_", known)).cast("double"),
            "n_repeat_words": _repeated_words(F.col("words_"), WINDOW_WORDS),
        }
    ).drop("words_", "lines_")


def rules() -> dict[str, Column]:
    """Each rule's vote over the columns of measured()."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    vote = lambda good, bad: F.when(bad, 0).when(good, 1)
    symbols, length = F.col("n_symbols") / n, F.col("word_chars") / n
    clean = F.col("n_clean_") / n
    upper, bangs, stops = F.col("n_upper_") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_bang_") / n, F.col("n_stop_") / n
    repeated, copied = F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines_"), F.lit(1.0))
    return {
        "symbols": vote(symbols <= 0.05, symbols > 0.3),
        "symbol_share": vote(F.col("n_symbols") <= 0.01 * F.col("word_chars"), F.col("n_symbols") > 0.05 * F.col("word_chars")),
        "clean_words": vote(clean >= 0.9, clean < 0.6),
        "word_length": vote((length >= 3) & (length <= 9), (length < 2.5) | (length > 14)),
        "capitals": vote(upper <= 0.1, upper > 0.3),
        "exclamations": vote(bangs <= 0.05, bangs > 0.25),
        "sentences": vote((stops >= 0.01) & (stops <= 0.35), (F.col("n_words") >= 40) & (stops < 0.002)),
        # without any of these words the text is in another language, or none: no vote
        "function_words": vote(F.col("n_known_") >= 3, (F.col("n_words") >= 60) & F.col("n_known_").between(1, 2)),
        "repetition": vote((repeated <= 0.05) & (F.col("n_words") >= 20), repeated > 0.3),
        "copied_lines": vote((copied == 0) & (F.col("n_lines_") >= 2), copied > 0.4),
    }


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_odds(votes: dict[str, Column], model: dict) -> Column:
    """The log of the odds of being good, given the votes and a fitted model."""
    total = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, vote in votes.items():
        good, bad = model["rules"][name]
        total = total + F.when(vote == 1, math.log(good / bad)).when(vote == 0, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return total


def _array(rows: list[list[float]]) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in rows) + ")"


def _log_chance(models: list, side: int) -> str:
    """SQL for the log of the chance of the votes v and of the class (1 good, 2 bad), under model s."""
    shares = _array([[math.log(m[0] if side == 1 else 1 - m[0])] for m in models])
    up, down = _array([list(map(math.log, m[side])) for m in models]), _array([[math.log1p(-x) for x in m[side]] for m in models])
    votes = f"transform(v, (x, i) -> case when x = 1 then {up}[s][i] when x = 0 then {down}[s][i] else 0.0D end)"
    return f"aggregate({votes}, {shares}[s][0], (total, x) -> total + x)"


def fitted(patterns: DataFrame, names: list[str], rounds: int = 60, tolerance: float = 1e-7, starts=STARTS) -> dict:
    """Expectation-maximisation over a table of vote patterns with their counts n.

    model["rules"][name] is (chance that the rule, when it votes on a good document, votes
    good; the same on a bad one); model["log_likelihood"] is that of the table. All starts
    run side by side, one Spark job a round, until none gains more than tolerance of its
    likelihood; half a document of each vote keeps the chances away from 0 and 1. Without
    documents the model is the first start."""
    count = len(names)
    models = [(prior, [good] * count, [bad] * count) for prior, good, bad in starts]
    # at most 3 ** rules rows: one partition, so that a round needs no shuffle
    rows = patterns.coalesce(1).select(F.array(*names).alias("v"), "n", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))).alias("s"))
    likelihood = [-math.inf] * len(models)
    for _ in range(rounds):
        told = rows.selectExpr("v", "n", "s", f"{_log_chance(models, 1)} as g", f"{_log_chance(models, 2)} as b")
        told = told.selectExpr("v", "n", "s", "n / (1 + exp(b - g)) as p", "greatest(g, b) + log1p(exp(-abs(g - b))) as l").selectExpr("*", "n - p as q")
        each = [f"sum(if(v[{k}] {what}, {side}, 0)) as {side}{name}_{k}" for k in range(count) for side in "pq" for name, what in (("1", "= 1"), ("n", "is not null"))]
        sums = [F.expr(x) for x in ["sum(p) as p", "sum(n * l) as l", "sum(n) as n", *each]]
        found = {r["s"]: r for r in told.groupBy("s").agg(*sums).collect()}  # one row a start
        if not found or not found[0]["n"]:
            break
        chance = lambda r, side: [(r[f"{side}1_{k}"] + 0.5) / (r[f"{side}n_{k}"] + 1) for k in range(count)]
        models = [((found[s]["p"] + 0.5) / (found[s]["n"] + 1), chance(found[s], "p"), chance(found[s], "q")) for s in range(len(models))]
        gained = max(found[s]["l"] - likelihood[s] - tolerance * abs(found[s]["l"]) for s in range(len(models)))
        likelihood = [found[s]["l"] for s in range(len(models))]
        if gained <= 0:
            break
    best = max(range(len(models)), key=lambda s: likelihood[s])
    prior, good, bad = models[best]
    if sum(good) < sum(bad):
        prior, good, bad = 1 - prior, bad, good
    return {"prior": prior, "rules": dict(zip(names, zip(good, bad, strict=True), strict=True)), "log_likelihood": likelihood[best]}


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, each rule's vote, quality and kept.

    A null or empty text has no words and fails the base rules. Repeated rows are judged one
    by one. A document is kept when it passes the base rules and its posterior quality
    reaches threshold. Columns of docs besides doc_id and text are not read."""
    found = measured(docs.select("doc_id", "text"))
    votes = {f"vote_{k}": v for k, v in rules().items()}
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    voted = checkpointed(found.select(*base, *[v.cast("int").alias(k) for k, v in votes.items()]))
    names = list(votes)
    patterns = checkpointed(voted.groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1))
    quality = _sigmoid(log_odds({c: F.col(c) for c in names}, fitted(patterns, names)))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return voted.withColumns({"base_failed": failed, "quality": quality}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
