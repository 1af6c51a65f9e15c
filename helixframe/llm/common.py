"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from helixframe.plans.materialise import checkpointed  # noqa: F401  (the operators take it from here)

#: Texts are turned into numpy arrays in pieces of about this many bytes, so that the
#: arrays of one piece (some 30 bytes for each byte of text) stay small whatever the batch.
PIECE_BYTES = 1 << 20
ROWS_A_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ROWS_A_BATCH rows: texts are long, and a task holds its batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, ROWS_A_BATCH)


def binary_values(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8, nulls as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def text_values(column: pa.Array) -> list[str]:
    """The column's texts, nulls as empty."""
    return pc.fill_null(column, "").to_pylist()


def byte_pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a text column; a long text is a piece of its own."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(values):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + piece_bytes, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """wanted, with underscores behind until none of them is a column already (names count alike in either case)."""
    taken = {c.lower() for c in columns}
    while taken & {w.lower() for w in wanted}:
        wanted = tuple(w + "_" for w in wanted)
    return list(wanted)


def other_columns(df: DataFrame, *replaced: str) -> list[str]:
    """The columns of df but those that are to be replaced."""
    gone = {r.lower() for r in replaced}
    return [c for c in df.columns if c.lower() not in gone]
