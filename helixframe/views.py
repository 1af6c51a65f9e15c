"""Views that read the given tables as intervals, masks, sequences, scores and cells.

SQL has the same views for DuckDB; both engines build them by the same integer arithmetic."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.materialise import small_batches

#: The chromosome names of these views, and positions a day.
CHROMS = ("AF", "AO", "NF", "NO", "RF", "RO")
STEP = 400
WINDOW = 201
_LETTER = bytes(b"ACGT"[(c - ord("a")) % 4] if c in b"abcdefghijklmnopqrstuvwxyz" else ord("N") for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored intervals: chrom, start, end, record_id, score."""
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    start = days * STEP + (F.col("l_orderkey") * 7919) % 397
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("chrom"), start.alias("start"), "l_quantity", key.alias("record_id"), F.col("l_extendedprice").alias("score"))
    return rows.select("chrom", "start", (F.col("start") + F.col("l_quantity").cast("bigint")).alias("end"), "record_id", "score")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as mask intervals: chrom, start, end."""
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    start = days * STEP + (F.col("o_orderkey") * 31) % 397
    chrom = F.element_at(F.array(*map(F.lit, CHROMS)), (F.col("o_custkey") % len(CHROMS)).cast("int") + 1)
    rows = table(spark, sf_dir, "orders").select(chrom.alias("chrom"), start.alias("start"), "o_custkey")
    return rows.select("chrom", "start", (F.col("start") + 20 + F.col("o_custkey") % 60).alias("end"))


def letters(text):
    """A text as DNA: white space left out, letters as A, C, G and T by turns, all else as N."""
    mapped = F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz \t\n\r\f\x0B", "ACGTACGTACGTACGTACGTACGTAC")  # what has no counterpart goes
    return F.regexp_replace(mapped, "[^ACGT]", "N")


def letter_bytes(text):
    """What letters makes of a text, as binary: a table of bytes does in Arrow batches what translate and a pattern do letter by letter."""

    def made(texts: pa.Array) -> pa.Array:
        plain = (None if t is None else t.decode("utf-8", "replace").lower().encode("ascii", "replace") for t in texts.to_pylist())
        return pa.array([None if t is None else t.translate(_LETTER, b" \t\n\r\f\x0b") for t in plain], pa.binary())

    return F.arrow_udf(made, "binary")(text.cast("binary"))


def wholes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as DNA: doc_id, lang, seq."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", letters(F.col("text")).alias("seq")).where(F.length("seq") > 0)


def sequences(spark: SparkSession, sf_dir: str, overlap: int = 0, beside: DataFrame | None = None) -> DataFrame:
    """documents as DNA in windows that begin every 201 letters and reach overlap letters into the next one, the last one of a text shorter: doc_id, k, window_id, lang, seq.

    With beside (doc_id and others) only the documents there are cut, and windows have its other columns."""
    small_batches(spark)
    docs, more = table(spark, sf_dir, "documents"), []
    if beside is not None:
        docs, more = docs.join(beside, "doc_id"), [c for c in beside.columns if c != "doc_id"]
    whole = docs.select("doc_id", "lang", *more, letter_bytes(F.col("text")).alias("seq"))  # letters are bytes, and a place in bytes is found at once
    last = F.floor((F.length("seq") - 1) / WINDOW)
    # an outer explode keeps Spark from making the letters once more for a filter on their number
    cut = whole.select("doc_id", "lang", *more, "seq", F.explode_outer(F.when(F.length("seq") > 0, F.sequence(F.lit(0).cast("bigint"), last))).alias("k")).where("k is not null")
    seq = F.col("seq").substr((F.col("k") * WINDOW + 1).cast("int"), F.lit(WINDOW + overlap)).cast("string")
    return cut.select("doc_id", "k", (F.col("doc_id") * (1 << 20) + F.col("k")).alias("window_id"), "lang", *more, seq.alias("seq"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as six chromosomes in pieces of CHUNK letters: chrom, piece, seq. Texts follow each other by doc_id; the last piece of each is filled up with N."""
    from helixframe.operators.sampling import CHUNK
    from helixframe.plans.running import running

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", chromosome(F.col("doc_id")).alias("chrom"), letter_bytes(F.coalesce("text", F.lit(""))).alias("whole"))
    sized = docs.select("doc_id", "chrom", F.ceil(F.length("whole") / CHUNK).cast("bigint").alias("n"), F.floor(F.col("doc_id") / 4096).alias("tile"))
    first = running(sized, ["chrom"], "tile", [F.col("doc_id")], sums={"first": F.col("n")}).select("doc_id", "first", "n")
    cut = docs.join(first, "doc_id").where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return cut.select("chrom", (F.col("first") + F.col("j")).alias("piece"), F.rpad(F.col("whole").substr((F.col("j") * CHUNK + 1).cast("int"), F.lit(CHUNK)).cast("string"), CHUNK, "N").alias("seq"))


def chromosome(number):
    return F.element_at(F.array(*map(F.lit, CHROMS)), (number % len(CHROMS)).cast("int") + 1)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a label: doc_id, lang, label (quality) and score (n_chars)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return docs.join(labels, "doc_id")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as observations: cell (flag, status, line number), trajectory, y, d, controls c1 and c2."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("|", "l_returnflag", "l_linestatus", "l_linenumber").alias("cell"),
        (F.col("l_suppkey") % 10).alias("trajectory"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        F.col("l_quantity").alias("d"),
        (F.col("l_discount") * 100).alias("c1"),
        (F.col("l_tax") * 100).alias("c2"),
    )


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as position weight matrices: vec_id, label, pwm (16 rows of 4)."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice(v, k * 4 + 1, 4))
    whole = F.transform(rows, lambda r: F.transform(r, lambda x: x / (F.element_at(r, 1) + F.element_at(r, 2) + F.element_at(r, 3) + F.element_at(r, 4))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", whole.alias("pwm"))


#: Windows of documents, the second of two kinds with what a motif of six columns needs of the next window.
_SEQUENCES = r"""v_letters AS (SELECT doc_id, lang, regexp_replace(translate(lower(regexp_replace(text, '[ \t\n\r\f\x0B]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N', 'g') AS whole FROM documents),
 v_sequences AS (SELECT doc_id, k, doc_id * 1048576 + k AS window_id, lang, substr(whole, k * 201 + 1, {letters}) AS seq FROM (SELECT doc_id, lang, whole, unnest(range((length(whole) + 200) // 201)) AS k FROM v_letters))"""
SQL = {
    "intervals": """v_intervals AS (SELECT chrom, start, start + CAST(l_quantity AS BIGINT) AS "end", record_id, score FROM (
 SELECT l_returnflag || l_linestatus AS chrom,
  datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 400 + (l_orderkey * 7919) % 397 AS start, l_quantity,
  concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS record_id, l_extendedprice AS score
 FROM lineitem))""",
    "mask": """v_mask AS (SELECT chrom, start, start + 20 + o_custkey % 60 AS "end" FROM (
 SELECT (['AF','AO','NF','NO','RF','RO'])[CAST(o_custkey % 6 AS INT) + 1] AS chrom,
  datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 400 + (o_orderkey * 31) % 397 AS start, o_custkey FROM orders))""",
    "sequences": _SEQUENCES.format(letters=WINDOW),
    "scan_windows": _SEQUENCES.format(letters=WINDOW + 5),
    "scored": """v_scored AS (SELECT d.doc_id, d.lang, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id))""",
    "cells": """v_cells AS (SELECT concat_ws('|', l_returnflag, l_linestatus, l_linenumber) AS cell, l_suppkey % 10 AS trajectory,
  l_extendedprice / 1000 AS y, l_quantity AS d, l_discount * 100 AS c1, l_tax * 100 AS c2 FROM lineitem)""",
    "matrices": """v_cols AS (SELECT vec_id, label, k, list_transform(range(4), lambda b: abs(CAST(embedding[4 * k + b + 1] AS DOUBLE))) AS r
  FROM embeddings, (SELECT unnest(range(16)) AS k)),
 v_pwm AS (SELECT vec_id, label, k, r[1] / (r[1] + r[2] + r[3] + r[4]) AS a, r[2] / (r[1] + r[2] + r[3] + r[4]) AS c,
  r[3] / (r[1] + r[2] + r[3] + r[4]) AS g, r[4] / (r[1] + r[2] + r[3] + r[4]) AS t FROM v_cols)""",
}
