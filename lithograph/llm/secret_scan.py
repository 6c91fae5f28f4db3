"""Secrets in texts: fixed patterns, and strings on which a tokenizer is inefficient."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import table, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # runs of [0-9a-f]+ of 32 or more: the same matches, found faster
MIN_ASSIGNED, MIN_ACCESS = 8, 16

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MAX_CHARS_PER_TOKEN = 2.0
DIGEST_CHARS = frozenset((32, 40, 48, 56, 64, 96, 128))  # MD5, SHA-1, Tiger, SHA-2 and SHA-3 in hex
UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
TIME = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T_-].*)?|[\d/_=+-]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[A-Z]")


def is_digest_or_identifier(value: str) -> bool:
    """Whether a string is a known digest, a UUID, a time, digits and marks alone, or a name made of several words and numbers."""
    bare = value.strip("=-_/+")
    if len(bare) in DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare):
        return True
    if UUID.fullmatch(bare) or TIME.fullmatch(bare):
        return True
    parts = PART.findall(bare)
    words = [p for p in parts if len(p) >= 3]
    return len(words) >= 2 and sum(map(len, words)) >= 0.85 * sum(map(len, parts))


def random_strings(text: str, encoder) -> list[tuple[int, int]]:
    """Spans of the strings of 20 or more whose characters per token are few, digests and identifiers apart."""
    out = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if not is_digest_or_identifier(value) and len(value) / len(encoder.encode_ordinary(value)) <= MAX_CHARS_PER_TOKEN:
            out.append((m.start(), m.end()))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, per kind leftmost and non-overlapping."""
    out = []
    if (":" in text or "=" in text) and (low := text.lower()) and any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def outside(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of base, by one merge of both in order of start."""
    out, at, reach = [], 0, 0
    for a, b in spans:
        while at < len(base) and base[at][0] < b:
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= a:
            out.append((a, 3, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def tiktoken_encoder(ranks_file: bytes, pattern: str):
    """An encoder from the lines of a tiktoken vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def find_secrets(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, counts and digest of the fixed patterns' spans, and all spans.

    spans adds the random strings that overlap no span of the fixed patterns. Offsets count code points, ends are
    exclusive. Null texts count as empty (no spans: empty string, and its digest); null and repeated ids give a row
    each. Other columns are ignored; an empty table gives an empty result.
    """
    with open(vocabulary_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or tiktoken_encoder(*sent.value)
            columns: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = outside(random_strings(text, encoder), base)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                for column, value in zip(columns, (*counts, digest, _joined(sorted(base + more))), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict[str, str] = {}
