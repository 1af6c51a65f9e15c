"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents become token ids (one end mark after each); those longer than a sequence are cut
into full pieces and a rest. Full pieces are sequences of their own. The rests are dealt
evenly over shards of about SHARD_PIECES pieces, and each shard packs its own: a piece goes
to the residual gap (or a new sequence) where the sum over gaps of the squared count of
open sequences becomes smallest. Only ids, lengths and checksums travel, never texts. What
a shard leaves open at its end is at most a few hundred sequences whatever the input, so
the waste of dealing out stays below a few per cent.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Collection, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import checkpointed, small_batches

SEQUENCE_TOKENS = 4096
END_ID = 1
SHARD_PIECES = 40_000
#: The memo of token ids by word holds about this many words, to bound a task's memory: those met last.
MEMO_WORDS = 400_000
#: Texts are split into words in slices of about this many bytes.
SLICE_BYTES = 1 << 22

PIECES = "doc_row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Bytes of UTF-8 as the tokenizer sees them: A-Z in lower case. bytes.split() then cuts at
#: ASCII white space.
_LOWER = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_MARKS = ".,;:!?&%$*#|"
#: Latin letters that are letters in lower case too (the dotted I falls apart there).
_LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha())
_PLAIN = re.compile(f"[{_LATIN}]+").fullmatch
_MARKED = f"^(?P<stem>[{_LATIN}]+)(?P<tail>[{_MARKS}]+)$"

#: What the tokenizer's control strings begin with; they are told by case, so texts with them are not put in lower case.
_CONTROL = "<|"


class WordTokens:
    """Token ids of whole texts through a memo by word.

    It serves tokenizers that work in lower case, mark word ends, drop white space and never
    join across it nor between a letter and the marks in _MARKS; then the ids of a text are
    those of its words, one after another. Control strings in a text are what the tokenizer
    makes of them. Words of other letters than Latin ones are encoded one by one."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text in UTF-8 as little-endian unsigned 32-bit numbers."""
        control = _CONTROL.encode()
        parts = [(text if control in text else text.translate(_LOWER)).split() for text in texts]
        known = self._known(set(chain.from_iterable(parts)))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def column_ids(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts of a column, one text after another, and the bounds of each in bytes.

        Each word is looked up once, and so are its letters and the marks behind them."""
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, _CONTROL), texts, pc.ascii_lower(texts)))
        coded = words.values.dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, _MARKED)
        stems = pc.coalesce(pc.struct_field(parts, "stem"), coded.dictionary)
        tails = pc.fill_null(pc.struct_field(parts, "tail"), "")
        names = pa.concat_arrays([stems, tails]).dictionary_encode()
        spelled = names.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = self._known(spelled)
        ids = pa.array(map(known.__getitem__, spelled), pa.large_binary()).take(names.indices)
        ids = pc.binary_join_element_wise(ids[: len(stems)], ids[len(stems) :], pa.scalar(b"", pa.large_binary())).take(coded.indices)
        _, starts, data = ids.buffers()
        bounds = np.frombuffer(starts, np.int64)[words.offsets.to_numpy()] if len(ids) else np.zeros(len(texts) + 1, np.int64)
        return memoryview(data or b""), bounds

    def _known(self, names: Collection[bytes]) -> dict[bytes, bytes]:
        """The memo, with all of names in it. Whenever half of MEMO_WORDS are in it, a new one begins and the one before the last goes."""
        if len(self.memo) > MEMO_WORDS // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = [n for n in names if n not in memo]
        if new:
            memo.update((n, older[n]) for n in new if n in older)
            self._learn([n for n in new if n not in memo])
        return memo

    def _learn(self, new: list[bytes]) -> None:
        memo, plain, marked, odd = self.memo, set(), [], set()
        for word in new:
            text = word.decode()
            letters = text.rstrip(_MARKS)
            if not _PLAIN(letters):
                odd.add(word)
                continue
            stem = letters.encode()
            if len(letters) < len(text):
                tail = word[len(stem) :]
                marked.append((word, stem, tail))
                if tail not in memo:
                    odd.add(tail)
            if stem not in memo:
                plain.add(stem)
        self._encode(list(plain))
        self._encode_each(list(odd))
        for word, stem, tail in marked:
            memo[word] = memo[stem] + memo[tail]

    def _encode_each(self, names: list[bytes]) -> None:
        made = self.tokenizer.encode_batch_fast([n.decode() for n in names], add_special_tokens=False)
        self.memo.update((n, np.array(m.ids, "<u4").tobytes()) for n, m in zip(names, made, strict=True))

    def _encode(self, names: list[bytes]) -> None:
        """Learn words of letters in one call: each is one pre-token, so its tokens run to a word end."""
        if not names:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(names).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(names):
            return self._encode_each(names)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        self.memo.update((n, data[lo:hi]) for n, lo, hi in zip(names, cuts[:-1], cuts[1:], strict=True))


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive rows of about size bytes together; a long text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        until = (ends[row - 1] if row else 0) + size
        end = max(row + 1, int(np.searchsorted(ends, until, "right")))
        yield row, texts[row:end]
        row = end


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_row (a number of the input row), doc_id, piece, start, length, ids_crc32.

    A null or empty text is the end mark alone. Repeated rows and repeated ids are documents
    of their own; other columns are not read. No document, no piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(tokenizer_file)
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows, numbers, doc_ids = [], batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for first, texts in _slices(batch.column(2), SLICE_BYTES):
                ids, bounds = tokens.column_ids(texts)
                for row, (lo, hi) in enumerate(pairwise(bounds.tolist()), first):
                    data, number, doc_id = bytes(ids[lo:hi]) + end, numbers[row], doc_ids[row]
                    for k, at in enumerate(range(0, len(data), width)):
                        part = data[at : at + width]
                        rows.append((number, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_row", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("doc_row"), "text")
    return numbered.mapInArrow(cut, PIECES)


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each length, placed in the order given.

    The change of the sum of squares when a sequence moves from gap g to gap g - s is
    2 * (count[g - s] - count[g]) + 2; a full sequence is closed and counts nothing. Of equal
    changes the smallest gap wins."""
    counts = np.zeros(capacity + 1, np.int64)
    closed = np.iinfo(np.int64).max
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    placed, offsets = [], []
    for s in lengths:
        after, now = counts[: capacity - s + 1].copy(), counts[s:]
        change = 2 * (after - now) + 2
        change[0] = 1 - 2 * now[0]
        change = np.where(now > 0, change, closed)
        gap = s + int(np.argmin(change))
        fresh = 2 * counts[capacity - s] + 1 if s < capacity else 0
        if change[gap - s] <= fresh and counts[gap]:
            where = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, where = capacity, len(filled)
            filled.append(0)
        placed.append(where)
        offsets.append(filled[where])
        filled[where] += s
        if gap > s:
            open_at[gap - s].append(where)
            counts[gap - s] += 1
    return placed, offsets


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces with sequence_id and offset; every piece is placed once and no sequence exceeds capacity.

    Within a shard long pieces are placed first, and pieces of one length by document and
    piece, so the result is the same however rows arrive."""
    pieces = checkpointed(pieces)
    shards = max(1, -(-pieces.where(F.col("length") < capacity).count() // shard_pieces))
    shard = F.when(F.col("length") < capacity, F.pmod(F.xxhash64("doc_id", "doc_row", "piece"), F.lit(shards)))
    dealt = pieces.withColumn("shard", shard)
    schema = f"{PIECES}, shard bigint, slot bigint, offset bigint"

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "doc_row", "piece"], ascending=[False, True, True, True], kind="stable")
        part["slot"], part["offset"] = sum_of_squares(part["length"].tolist(), capacity)
        return part

    whole = dealt.where("shard is null").withColumns({"slot": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    whole = whole.withColumn("sequence_id", -1 - F.col("slot"))
    packed = dealt.where("shard is not null").groupBy("shard").applyInPandas(place, schema)
    packed = packed.withColumn("sequence_id", F.col("shard") * F.lit(1 << 32) + F.col("slot"))
    return whole.unionByName(packed).drop("shard", "slot")
