"""Tables that are computed once: cut lineage, and sides of joins whose size is known."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers.
BROADCAST_ROWS = 200_000
#: Arrow batches of whole texts and blocks take about so much, and those of short rows have so many.
BATCH, ROWS = "8m", 10_000


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches to about BATCH bytes for the session: a batch is held by Spark and by a worker, beside what is made of it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


@contextmanager
def row_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches are of ROWS rows: Spark does not take the size of a batch after each row, which costs more than to write the row. For short rows that are computed within."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1), "spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)}
    held = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, in the folder that the session names in spark.checkpoint.dir.

    Only a local master may go without and takes a temporary one; a cluster's machines do not
    share such a folder, so there this fails."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A short aggregate, computed once: with a broadcast hint if it has at most so many rows, else to be joined by its keys."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept
