"""Writers, resuming and provenance."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_fasta(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """id and seq as FASTA parts; refuses to replace unless told to."""
    text = rows.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))
    text.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None, overwrite: bool = False) -> None:
    """Parquet, in folders by the columns of by; the commit protocol makes it visible whole or not at all."""
    writer = rows.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_tsv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").csv(path, sep="\t", header=True)


def write_bed(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """chrom, start, end, peak_id and score, the score with up to 12 significant digits and no trailing zeros."""
    write_tsv_bare(rows.select("chrom", "start", "end", "peak_id", twelve_digits("score").alias("score")), path, overwrite)


def write_tsv_bare(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").csv(path, sep="\t", header=False)


def twelve_digits(column: str):
    """A double as text with 12 significant digits, trailing zeros cut; plain notation from 1e-4 to 1e12."""
    shown = F.format_string("%.11e", F.col(column))
    value = shown.cast("decimal(38,16)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    size = F.abs(F.col(column))
    mantissa = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    return F.when((size == 0) | ((size >= 1e-4) & (size < 1e12)), plain).otherwise(mantissa)


def write_json(spark: SparkSession, record: dict, path: str, overwrite: bool = False) -> None:
    """One record as one line of JSON with sorted keys."""
    spark.createDataFrame([(protocol_text(record),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_failure(spark: SparkSession, path: str, task: dict, error: BaseException, seconds: float | None = None) -> None:
    """What went wrong with a task and after how many seconds, beside where its result would stand; there may be an earlier record, which this replaces."""
    write_json(spark, {"status": "failed", "task": task, "error": type(error).__name__, "message": str(error)[:2000], "runtime_seconds": seconds}, f"{path}/failure", overwrite=True)


def write_uniform_background(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """The background in which all four letters are equally frequent."""
    rows = spark.createDataFrame([(f"{base} 0.25",) for base in "ACGT"], "value string")
    rows.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def reusable(spark: SparkSession, path: str, protocol: dict) -> bool:
    """Whether a finished result of the same protocol lies at path; fails on an unfinished one or one of another protocol."""
    files = spark._jvm.org.apache.hadoop.fs
    place = files.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return False
    if not system.exists(files.Path(f"{path}/table/_SUCCESS")):
        raise RuntimeError(f"{path} is unfinished")
    held = json.loads(spark.read.text(f"{path}/protocol").first()[0])
    if held != json.loads(protocol_text(protocol)):
        raise RuntimeError(f"{path} has another protocol")
    return True


def protocol_text(protocol: dict) -> str:
    """One canonical line: sorted keys, no spaces, decimals as text."""
    return json.dumps(protocol, sort_keys=True, separators=(",", ":"), default=lambda x: str(x) if isinstance(x, Decimal) else x.__dict__)


def write_result(rows: DataFrame, path: str, protocol: dict) -> None:
    """A table with its protocol, for reusable()."""
    spark = rows.sparkSession
    spark.createDataFrame([(protocol_text(protocol),)], "value string").coalesce(1).write.text(f"{path}/protocol")
    rows.write.parquet(f"{path}/table")


def _empty_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files without a byte, which Spark's readers pass over."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for top in system.globStatus(place) or []:
            for status in system.listStatus(top.getPath()) if top.isDirectory() else [top]:
                if status.isFile() and status.getLen() == 0:
                    found.append(status.getPath().toString())
    return found


def provenance(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, bytes, sha256 and md5 of files; a path without a file fails.

    A file goes through one task line by line, in order, so no file is held in memory; only a
    line is (one without line ends is a single one)."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    none = _empty_files(spark, paths)
    files = files.unionByName(spark.createDataFrame([(f, 0) for f in none], "file string, bytes bigint"))
    lines = spark.read.option("lineSep", "\n").text(paths)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")]
    stream = lines.select(*place, F.col("value").cast("binary").alias("line")).repartition("file").sortWithinPartitions("file", "at", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, both, size = None, (), 0

        def told() -> pa.RecordBatch:
            ended = [h.copy() for h in both]  # whether a line end is behind the last line, the file's size tells
            for h in ended:
                h.update(b"\n")
            return pa.RecordBatch.from_pydict({"file": [held], "size": [size], **{f"{h.name}_{k}": [x.hexdigest()] for h, e in zip(both, ended, strict=True) for k, x in ((0, h), (1, e))}})

        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != held:
                    if held is not None:
                        yield told()
                    held, both, size = file, (hashlib.sha256(), hashlib.md5()), 0
                else:
                    for h in both:
                        h.update(b"\n")
                    size += 1
                text = line.as_buffer()
                for h in both:
                    h.update(text)
                size += len(text)
        if held is not None:
            yield told()

    made = stream.select("file", "line").mapInArrow(run, "file string, size bigint, sha256_0 string, sha256_1 string, md5_0 string, md5_1 string")
    empty = {"sha256": hashlib.sha256().hexdigest(), "md5": hashlib.md5().hexdigest()}
    right = lambda name: F.when(F.col("size").isNull(), empty[name]).when(F.col("size") == F.col("bytes"), F.col(f"{name}_0")).when(F.col("size") + 1 == F.col("bytes"), F.col(f"{name}_1")).alias(name)
    joined = files.join(made, "file", "left").select("file", "bytes", right("sha256"), right("md5"))
    return joined.where(F.assert_true(F.col("sha256").isNotNull(), F.concat(F.lit("changed while it was read: "), "file")).isNull())


def provenance_record(spark: SparkSession, paths: list[str], settings: dict, commit: str | None = None) -> dict:
    """What a result came from: digests of its inputs, settings, versions of what computed it, and the commit that the caller names."""
    inputs = {r["file"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in provenance(spark, paths).collect()}  # a line a file
    versions = {"spark": spark.version, "python": platform.python_version(), "pyarrow": pa.__version__, "system": f"{platform.system()} {platform.machine()}"}
    return {"inputs": inputs, "settings": settings, "versions": versions, "commit": commit}


def checked_inputs(spark: SparkSession, record: dict) -> None:
    """Fails where an input of a provenance record is no longer what it was."""
    now = provenance_record(spark, list(record["inputs"]), {})["inputs"]
    for file, held in record["inputs"].items():
        if now.get(file) != held:
            raise RuntimeError(f"{file} has changed")
