"""Exact removal of lines that many documents share, behind two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. One pass over the
texts marks the keys of each document in two filters: bits that some document has set, and
bits that a second one has set too. The filters of tasks are merged in blocks: what either
has seen twice, or both have seen once, is seen twice. A second pass asks the second filter:
a key with a bit that is not set there stands in one document only and is dropped from
sight; the others are suspected. Only suspects move, as 16 bytes of digest a key and document;
they are counted exactly, and of a key found often enough the largest doc_id is chosen.

The filters never miss a repeated key, so their size decides only how many keys are
suspected in vain. They hold BITS_A_KEY bits a key up to 2 ** MOST_BITS; beyond, more and at last
all keys are suspects, and the count is an ordinary grouping of all keys by Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import binary_values, checkpointed, free_names, small_batches
from helixframe.plans.materialise import broadcast_if_small

#: The filters: bits a key, positions a key, and the size they never pass (128 MB) or fall below.
BITS_A_KEY, POSITIONS, MOST_BITS, LEAST_BITS = 16, 3, 30, 20
#: Filters are merged in blocks of so many bits; a task passes on its marks after so many keys.
BLOCK_BITS, KEYS_A_FLUSH = 1 << 16, 1 << 20
#: A key with more suspects than this is met by them in several tasks; there are at most HOT_KEYS of these, as the bound grows with all suspects.
BUCKET, HOT_KEYS = 2048, 100_000
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def line_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """The digest of each key of min_chars code points or more, with the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(_SPACE)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            found.setdefault(hashlib.blake2b(key.translate(_LOWER), digest_size=16).digest(), []).append(at)
    return found


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """[keys, POSITIONS] places in a filter of 2 ** bits."""
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    steps = np.arange(POSITIONS, dtype=np.uint64)
    return ((halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def _keys_of(text: Column) -> Column:
    """More keys than a text has, roughly: its lines."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _marks(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(block, once, twice): the bits that a task's documents have set, as sorted offsets within a block, and those set by two documents or more."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kept = 0

        def flush() -> pa.RecordBatch:
            places, times = np.unique(np.concatenate(held), return_counts=True)
            block = places // BLOCK_BITS
            cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist() + [len(places)]
            offset = (places % BLOCK_BITS).astype("<u2")
            parts = [(offset[a:b], offset[a:b][times[a:b] > 1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            once, twice = ([p[k].tobytes() for p in parts] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])

        for batch in batches:
            for text in binary_values(batch.column(0)):
                if digests := list(line_keys(text, min_chars)):
                    held.append(np.unique(_positions(digests, bits)))  # a document sets a bit once
                    kept += len(digests)
                if kept >= KEYS_A_FLUSH:
                    yield flush()
                    held, kept = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(mark, "block int, once binary, twice binary")


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The filters of one block from parts of it: seen twice is what a part has seen twice and what two parts have seen."""
    once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    for one, two in zip(rows["once"], rows["twice"], strict=True):
        one = np.frombuffer(one, "<u2")
        twice[one] |= once[one]
        once[one] = True
        twice[np.frombuffer(two, "<u2")] = True
    made = rows.head(1).copy()
    made["once"], made["twice"] = ([np.flatnonzero(f).astype("<u2").tobytes()] for f in (once, twice))
    return made


def twice_seen(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The filter of keys that two documents or more hold, 2 ** bits wide; it alone comes to the driver, at most 128 MB."""
    salted = _marks(docs, min_chars, bits).withColumn("salt", F.spark_partition_id() % 16)
    schema = "block int, once binary, twice binary, salt int"
    partly = salted.groupBy("block", "salt").applyInPandas(_merged, schema)
    whole = partly.groupBy("block").applyInPandas(_merged, schema).where("length(twice) > 0")
    held = np.zeros(((1 << bits) // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for offsets in batch.column(1).to_pylist():
                bit = np.zeros(BLOCK_BITS, np.uint8)
                bit[np.frombuffer(offsets, "<u2")] = 1
                out.append(np.packbits(bit).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    made = whole.select("block", "twice").mapInArrow(packed, "block int, bits binary").toArrow()
    for block, word in zip(made["block"].to_pylist(), made["bits"].to_pylist(), strict=True):
        held[block] = np.frombuffer(word, np.uint8)
    return held.ravel()


def _suspects(docs: DataFrame, seen: np.ndarray, min_chars: int, bits: int) -> DataFrame:
    """(doc_id, row, key, lines): the keys of each row of docs (doc_id, row, text) that the filter has twice."""
    held = docs.sparkSession.sparkContext.broadcast(seen)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, lines = [], [], []
            for k, text in enumerate(binary_values(batch.column(2))):
                if not (found := line_keys(text, min_chars)):
                    continue
                places = _positions(list(found), bits)
                some = ((held.value[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1).tolist()
                for suspected, (key, where) in zip(some, found.items(), strict=True):
                    if suspected:
                        at.append(k)
                        keys.append(key)
                        lines.append(where)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], names=["doc_id", "row", "key", "lines"])

    return docs.select("doc_id", "row", "text").mapInArrow(ask, f"doc_id {id_type}, row bigint, key binary, lines array<int>")


def _losing(suspects: DataFrame, min_documents: int) -> DataFrame:
    """(doc_id, row, lost): the numbers of the lines that each row loses.

    Suspects meet the verdict on their key; a key of many suspects is dealt over salts."""
    known = suspects.groupBy("key").agg(F.count_distinct("doc_id").alias("documents"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).where(F.col("documents") >= min_documents)
    known = checkpointed(known)
    total = known.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    bucket = max(BUCKET, -(-total // HOT_KEYS))
    salts = F.ceil(F.col("rows") / bucket).cast("int")
    hot = F.broadcast(known.where(F.col("rows") > bucket).select("key", salts.alias("salts")))  # at most HOT_KEYS rows
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "row"), F.col("salts"))).cast("int")
    dealt = suspects.join(hot, "key", "left").withColumn("salt", salt).drop("salts")
    verdict = known.select("key", "last", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    lost = dealt.join(verdict, ["key", "salt"]).where("doc_id is null or doc_id < last")
    return lost.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lost"))  # the lines of one text


def deduplicated(docs: DataFrame, min_chars: int = 20, min_documents: int = 3) -> DataFrame:
    """docs without the lines whose key at least min_documents documents hold (2 or more), except in the largest doc_id holding it; n_lines and n_dropped are added (under free names if docs has such).

    Lines are parted by \\n; a null or empty text is one empty line and comes out empty. Keys of
    fewer than min_chars code points stay. Rows of one doc_id are one document: each row that
    holds the key keeps or loses its lines alike. A row with a null doc_id is not counted as a
    document and never the largest, so it loses the lines that others have often enough. Repeated rows
    come out as often as they went in. No documents, no rows. Other columns are passed on."""
    if min_documents < 2:
        raise ValueError("min_documents must be 2 or more")
    small_batches(docs.sparkSession)
    row, lost, lines, last, n_lines, n_dropped = free_names(docs.columns, "row_", "lost_", "lines_", "last_", "n_lines", "n_dropped")
    own = docs.withColumn(row, F.xxhash64("text"))
    plain = own.select("doc_id", F.col(row).alias("row"), "text").where(F.length("text") >= min_chars)
    keys = plain.agg(F.sum(_keys_of(F.col("text")))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_KEY * keys).bit_length()))
    suspects = checkpointed(_suspects(plain, twice_seen(plain, min_chars, bits), min_chars, bits))
    losing = broadcast_if_small(_losing(suspects, min_documents))
    cut = losing.select(F.col("doc_id").alias(last), F.col("row").alias("row__"), F.col("lost").alias(lost))
    met = own.join(cut, own["doc_id"].eqNullSafe(cut[last]) & (own[row] == cut["row__"]), "left").drop(last, "row__")
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    left = F.when(F.col(lost).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda k: F.get(F.col(lines), k)), "\n"))
    made = met.withColumn(lines, parts).withColumns({n_lines: F.size(lines).cast("bigint"), n_dropped: F.coalesce(F.size(lost), F.lit(0)).cast("bigint"), "text": left})
    return made.drop(row, lost, lines)
