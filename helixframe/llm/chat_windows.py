"""Chat formatting in budgeted windows.

A conversation is cut between turns into windows: a window's own turns are those whose prefix
sums of tokens, with the tokens of its context, stay within a budget that counts all that the
window holds, marks included. The context repeats the system turn in force and the last few
turns before the window; where it does not fit, the oldest of these go first and then the
system turn, so only a single turn that is longer than the budget itself makes a window longer
than that, and stands there alone. The texts of a window's own assistant turns are its
training targets; repeated turns are masked, so over all windows each target counts once.

Turns are written as `### role: text </turn>` and a newline. Control strings inside a text
(### and </turn>) and backslashes get a backslash before them, in roles also colons, which
is undone by taking one backslash off; so formatting loses nothing. White space ends a token,
so a window has as many tokens as its turns together.

A text moves once: to the task of its conversation, sorted by turn, where windows are made as
the turns stream by. A conversation of more than LONG_TURNS turns is cut into parts by ranges
of turn numbers, which go to tasks of their own; to each part go copies of the turns that its
first window repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import small_batches
from helixframe.llm.packing import WordTokens
from helixframe.llm.tokenizers import tokenizer_path

BUDGET = 1024
HISTORY = 2
#: Conversations of more turns than this are cut into parts of so many turn numbers.
LONG_TURNS, PART = 4096, 1024
#: Ids of long conversations are broadcast up to so many, else joined.
BROADCAST_LONG = 100_000
#: A batch of output holds about so many characters.
BATCH_CHARS = 1 << 20
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_ROLE = re.compile(r"### ((?:[^\\:]|\\.)*+): ", re.DOTALL)

WINDOW_SCHEMA = "conv_id bigint, part bigint, window bigint, text string, n_tokens bigint, n_context bigint, loss_spans array<struct<start: bigint, end: bigint>>"
DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _SPANS]
_DIGEST_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Turn:
    """A turn as it is written: head, body, tail; the tokens of all that; whether it is a target or a system turn."""

    __slots__ = ("head", "body", "tokens", "target", "system")

    def __init__(self, role: str, text: str, count: Callable[[str], int]):
        self.head, self.body = HEAD + _ROLE_CONTROL.sub(r"\\\g<0>", role) + MIDDLE, escaped(text)
        self.tokens = count(self.head + self.body + TAIL)
        self.target, self.system = role == "assistant", role == "system"


def _window(context: list[Turn], own: list[Turn]) -> tuple[str, int, int, list[dict]]:
    """(text, tokens, turns of context, spans of targets) of one window."""
    pieces, spans, at = [], [], 0
    for k, turn in enumerate(context + own):
        pieces += [turn.head, turn.body, TAIL]
        start = at + len(turn.head)
        at = start + len(turn.body) + len(TAIL)
        if turn.target and k >= len(context):
            spans.append({"start": start, "end": start + len(turn.body)})
    return "".join(pieces), sum(t.tokens for t in context + own), len(context), spans


class Windows:
    """Windows of the turns of one part, which arrive in order."""

    def __init__(self, budget: int, history: int):
        self.budget, self.system = budget, None
        self.before: deque[Turn] = deque(maxlen=history)
        self.context, self.own = [], []
        self.sums = [0]  # prefix sums of the tokens of the context and of the own turns, one after another

    def repeat(self, turn: Turn) -> None:
        """A turn of an earlier part that may be repeated."""
        if turn.system:
            self.system = turn
        else:
            self.before.append(turn)

    def add(self, turn: Turn) -> Iterator[tuple]:
        if self.own and self.sums[-1] + turn.tokens > self.budget:
            yield self.made()
        if not self.own:
            self.context = [x for x in self.before if x is not self.system]
            if self.system is not None and not turn.system:
                self.context.insert(0, self.system)
            while self.context and sum(x.tokens for x in self.context) + turn.tokens > self.budget:
                self.context.pop(1 if len(self.context) > 1 and self.context[0] is self.system else 0)
            self.sums = [sum(x.tokens for x in self.context)]
        self.own.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)
        if turn.system:
            self.system = turn
        self.before.append(turn)

    def made(self) -> tuple:
        found = _window(self.context, self.own)
        self.own = []
        return found


def _formatted(batches: Iterator[pa.RecordBatch], budget: int, history: int, tokenizer_file: str) -> Iterator[tuple]:
    """(conv_id, part, window, text, tokens, turns of context, spans) of sorted rows of _sorted."""
    tokens = WordTokens(tokenizer_file)
    count = lambda text: len(tokens.ids([text.encode("utf-8", "surrogatepass")])[0]) // 4
    at, made, number = None, Windows(budget, history), 0

    def flushed():
        return [(*at, number, *made.made())] if made.own else []

    for batch in batches:
        for conv, part, own, role, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if at != (conv, part):
                yield from flushed()
                at, made, number = (conv, part), Windows(budget, history), 0
            turn = Turn(role, text, count)
            if not own:
                made.repeat(turn)
                continue
            for window in made.add(turn):
                yield (*at, number, *window)
                number += 1
    yield from flushed()


def _batches(rows: Iterator[tuple], kinds: list, schema: str, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in re.sub(r"<.*>", "", schema).split(",")]
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def read_back(text: str, n_context: int, spans: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
    """(the own (role, text) of a window, the texts under its loss mask), read from its text."""
    turns = []
    for line in text.split(TAIL)[n_context:-1]:
        role = _ROLE.match(line)
        turns.append((unescaped(role.group(1)), unescaped(line[role.end() :])))
    return turns, [unescaped(text[s["start"] : s["end"]]) for s in spans]


def _digested(windows: Iterator[tuple]) -> Iterator[tuple]:
    """One row a conversation from its windows (conv_id, text, turns of context, spans), which arrive in order."""
    held = None
    shown = lambda h: (h[0], h[1], h[2].hexdigest(), h[3], h[4].hexdigest(), h[5])
    for conv, text, n_context, spans in windows:
        if held is None or held[0] != conv:
            if held is not None:
                yield shown(held)
            held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        turns, targets = read_back(text, n_context, spans)
        held[1] += len(turns)
        for role, said in turns:
            held[2].update(f"{role}\n{said}\n".encode())
        for said in targets:
            held[3] += len(said)
            held[4].update(said.encode())
        held[5] += len(text)
    if held is not None:
        yield shown(held)


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _flagged(conversations: DataFrame, long_turns: int) -> DataFrame:
    """conv_id, turn, role, text, and part: null for all turns of a short conversation, else by turn number."""
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = conversations.groupBy("conv_id").count().where(F.col("count") > long_turns).select("conv_id", F.lit(True).alias("long"))
    few = long.limit(BROADCAST_LONG + 1).count() <= BROADCAST_LONG
    joined = clean.alias("c").join((F.broadcast(long) if few else long).alias("l"), _same("c", "l", ["conv_id"]), "left")
    part = F.when(F.col("l.long"), F.coalesce(F.floor(F.col("c.turn") / PART), F.lit(-(1 << 62))))
    return joined.select("c.*", part.cast("bigint").alias("part"))


def _repeated(long: DataFrame, history: int) -> DataFrame:
    """Copies of the turns that the first window of each part repeats: the last system turn before it and the last turns of the part before it.

    The keys are found on rows without texts; a part is one row of the running step."""
    keys = ["turn", "role", "hash_"]
    narrow = long.select("conv_id", "part", "turn", "role", F.xxhash64("text").alias("hash_"))
    last = Window.partitionBy("conv_id", "part").orderBy(*[F.desc(k) for k in keys])
    tails = narrow.where("role <> 'system'").withColumn("k_", F.row_number().over(last)).where(F.col("k_") <= history)
    systems = F.max(F.when(F.col("role") == "system", F.struct(*keys))).alias("own_")
    parts = narrow.groupBy("conv_id", "part").agg(systems)
    order = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.select("conv_id", "part", F.lead("part").over(order).alias("next_"), F.last("own_", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("system_"))
    wanted = tails.alias("t").join(parts.alias("p"), _same("t", "p", ["conv_id", "part"])).where("p.next_ is not null").select("t.conv_id", *[F.col(f"t.{k}").alias(k) for k in keys], F.col("p.next_").alias("to_"))
    wanted = wanted.union(parts.where("system_ is not null").select("conv_id", *[F.col(f"system_.{k}").alias(k) for k in keys], "part")).distinct()
    texts = long.withColumn("hash_", F.xxhash64("text"))
    return texts.alias("x").join(wanted.alias("w"), _same("x", "w", ["conv_id", *keys])).select("x.conv_id", "x.turn", "x.role", "x.text", F.col("w.to_").alias("part"))


def _sorted(rows: DataFrame) -> DataFrame:
    """conv_id, part, own, role, text: parts together, repeated turns first, then in order."""
    placed = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "own", "turn", "role", F.xxhash64("text"))
    return placed.select("conv_id", "part", "own", "role", "text")


def _short(flagged: DataFrame) -> DataFrame:
    return _sorted(flagged.where("part is null").withColumn("own", F.lit(True)))


def _long(flagged: DataFrame, history: int) -> DataFrame:
    rows = flagged.where("part is not null")
    return _sorted(rows.withColumn("own", F.lit(True)).unionByName(_repeated(rows, history).withColumn("own", F.lit(False))))


def _as_windows(rows: DataFrame, budget: int, history: int, tokenizer_file: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_formatted(batches, budget, history, tokenizer_file), _WINDOW_KINDS, WINDOW_SCHEMA, lambda row: len(row[3]))

    return rows.mapInArrow(run, WINDOW_SCHEMA)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer_file: str | None = None, long_turns: int = LONG_TURNS) -> DataFrame:
    """One row a window: conv_id, part, window, text, n_tokens, n_context and loss_spans.

    conversations has conv_id, turn, role and text; other columns are not read. text is the
    formatted window; its first n_context turns are context; loss_spans are the code points
    [start, end) of the targets. Windows stand in order of part (null but for long
    conversations) and window. n_tokens is at most budget, but for a turn that alone has more:
    it is a window of its own, without context.

    Turns stand by turn, then role, then a hash of the text; a null turn comes first, a null
    text or role is an empty one, and a null conv_id is a conversation like any other.
    Repeated rows are turns of their own. The system turn in force is the last one before a
    window; where a part of a long conversation begins, history reaches back to the part
    before it. No rows, no windows."""
    small_batches(conversations.sparkSession)
    file = tokenizer_file or tokenizer_path("word_bpe_49k.json")
    flagged = _flagged(conversations, long_turns)
    return _as_windows(_short(flagged), budget, history, file).union(_as_windows(_long(flagged, history), budget, history, file))


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from its windows read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a conversation takes its windows in order, so they are sorted within the
    partition of their conversation and hashed as they stream by; no conversation is held."""
    ordered = formatted.select("conv_id", "part", "window", "text", "n_context", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True))
        yield from _batches(_digested(rows), _DIGEST_KINDS, DIGEST_SCHEMA, lambda row: 200)

    return ordered.mapInArrow(run, DIGEST_SCHEMA)


def conversation_digests(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer_file: str | None = None, long_turns: int = LONG_TURNS) -> DataFrame:
    """digests(windows(conversations)) without moving a short conversation's text twice: its windows are read back in the task that made them."""
    small_batches(conversations.sparkSession)
    file = tokenizer_file or tokenizer_path("word_bpe_49k.json")
    flagged = _flagged(conversations, long_turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((row[0], row[3], row[5], row[6]) for row in _formatted(batches, budget, history, file))
        yield from _batches(_digested(made), _DIGEST_KINDS, DIGEST_SCHEMA, lambda row: 200)

    long = digests(_as_windows(_long(flagged, history), budget, history, file))
    return _short(flagged).mapInArrow(run, DIGEST_SCHEMA).union(long)
