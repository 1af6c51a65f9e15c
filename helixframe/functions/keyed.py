"""Column functions for reproducible draws, identities and numbers kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned_head(text: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of a text's SHA-256 as a decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("decimal(20,0)")


def keyed_start(seed: int, target: Column, attempt: Column, maximum: Column) -> Column:
    """A start from 0 to maximum: the leading 64 bits of a digest of seed, target and attempt, modulo maximum + 1."""
    text = F.concat(F.lit(f"{seed}\0"), target, F.lit("\0"), attempt.cast("string"))
    return (unsigned_head(text) % (maximum.cast("decimal(20,0)") + 1)).cast("bigint")


def stage_seed(base: int, stream: str, sample: Column, repeat: Column) -> Column:
    """The leading 32 bits of a digest of base:stream:sample:repeat, modulo 2**31 - 1."""
    text = F.concat_ws(":", F.lit(str(base)), F.lit(stream), sample.cast("string"), repeat.cast("string"))
    return (unsigned_head(text, 8) % F.lit(2147483647).cast("decimal(20,0)")).cast("bigint")


def minus_log10(text: Column) -> Column:
    """-log10 of a positive number written as text, also where a double would underflow."""
    mantissa = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double")
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    return F.when(mantissa > 0, -F.log10(mantissa) - exponent)
