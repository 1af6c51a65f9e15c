"""Secret scans: fixed forms, and random strings told by their token efficiency.

The fixed forms are assignments to names such as password or token, access keys, and long
runs of lower-case hexadecimal digits. Beyond them, a run of token characters that a byte-pair
vocabulary of natural text encodes with few characters a token is random: words are what
such a vocabulary compresses. Left out of that test are UUIDs, digests of known length, numbers,
and names and paths all of whose parts are words by the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from helixframe.llm.common import other_columns, small_batches, text_values

#: What the scan looks for, and how long a match must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_CHARS = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "token")
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+/_=-]+"  # numbers, rulers
)
SEPARATORS = re.compile(r"[+/_=-]+")
PART = re.compile(r"([A-Za-z]*)[0-9]{0,4}")
#: A run of fewer characters a token than this is random.
CHARS_A_TOKEN = 2.4


class TokenEfficiency:
    """Characters a token under a vocabulary in tiktoken's rank format."""

    def __init__(self, vocabulary_file: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def word(self, part: str) -> bool:
        """A part of a name or path: a number of up to four digits, or a word that the vocabulary holds or compresses, with such a number."""
        m = PART.fullmatch(part)
        if not m:
            return False
        letters = m.group(1).lower() if m.group(1).isupper() or m.group(1).istitle() else m.group(1)
        n = len(self.encode(letters))
        return n <= 1 or len(letters) >= CHARS_A_TOKEN * n

    def random(self, run: str) -> bool:
        if len(run) in DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
            return False
        if IDENTIFIER.fullmatch(run):
            return False
        if all(map(self.word, filter(None, SEPARATORS.split(run)))):
            return False
        return len(run) < CHARS_A_TOKEN * len(self.encode(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, in order; kind counts KINDS."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found


def spans(text: str, efficiency: TokenEfficiency) -> list[tuple[int, int, int]]:
    """base_spans and the random runs that touch none of them."""
    found = base_spans(text)
    runs = [m.span() for m in RUN.finditer(text)]
    for lo, hi in runs:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, lo, hi)]
    held = list(found)
    for lo, hi in runs:
        if not any(a < hi and lo < b for a, _, b in held) and efficiency.random(text[lo:hi]):
            found.append((lo, 3, hi))
    return sorted(found)


def scanned(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """docs with secret_spans, an array of (kind, start, end) in code points by start, then by KINDS.

    A null or empty text has none. Other columns and repeated rows are kept as they are; a
    column named secret_spans is replaced."""
    small_batches(docs.sparkSession)
    own = [docs.schema[c] for c in other_columns(docs, "secret_spans")]
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    added = T._parse_datatype_string("secret_spans array<struct<kind: string, start: bigint, end: bigint>>").fields
    at = [f.name for f in own].index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = TokenEfficiency(vocabulary_file)
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(text, efficiency)] for text in text_values(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(kind))], names=[*batch.schema.names, "secret_spans"])

    return docs.select([f.name for f in own]).mapInArrow(scan, T.StructType([*own, *added]))
