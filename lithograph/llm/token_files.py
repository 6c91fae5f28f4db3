"""Token ids of whole documents in files of patched frame-of-reference blocks."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import materialize, slices, table, texts

BLOCK = 128  #: ids in a block
PERCENTILE = 90  #: share of a block's ids that its packed width must hold; the rest are exceptions
SHARD_IDS = 1 << 20  #: ids after which a file row is closed (it may exceed this by one document)
END_ID = 2
CACHE = 1 << 19  #: words whose ids a generation of the worker's memory holds (about 100 MB)

# --- the format ----------------------------------------------------------------------------------
# A payload: four uint32 (ids, blocks, exceptions, packed bytes), then per block: minimum (uint32), width in bits
# (uint8), start of its packed bits (uint32, in bytes) and start of its exceptions (uint32); then the packed bits,
# then the exceptions' places in their block (uint8) and their values over the minimum (uint32). Little-endian.


def pack(ids: np.ndarray) -> bytes:
    """ids (0 to 2^32-1) as patched frame-of-reference blocks of 128; any length, empty too."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    filled = np.empty(blocks * BLOCK, dtype=np.uint32)
    filled[:n] = ids
    if n:
        filled[n:] = ids[-1]
    rows = filled.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = rows - low[:, None]
    at = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    held = np.partition(rest, at, axis=1)[:, at] if blocks else np.empty(0, np.uint32)
    width = np.zeros(blocks, dtype=np.uint8)
    for bit in range(32):
        width[held >= (1 << bit)] = bit + 1
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    block, place = np.nonzero(over)
    values = rest[over]
    rest[over] = 0
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.zeros(blocks + 1, dtype=np.int64)
    np.cumsum(size, out=start[1:])
    packed = np.zeros(int(start[-1]), dtype=np.uint8)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        words = np.zeros((2 * int(w), len(own)), dtype=np.uint64)
        columns = rest[own].T.astype(np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * int(w), 64)
            words[word] |= columns[j] << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= columns[j] >> np.uint64(64 - shift)
        into = start[own][:, None] + np.arange(16 * int(w))
        packed[into] = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(own), -1)
    first = np.searchsorted(block, np.arange(blocks))
    head = np.array([n, blocks, len(values), len(packed)], dtype="<u4")
    return b"".join(
        x.tobytes()
        for x in (head, low.astype("<u4"), width, start[:-1].astype("<u4"), first.astype("<u4"), packed, place.astype(np.uint8), values.astype("<u4"))
    )


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload."""
    n, blocks, exceptions, size = (int(x) for x in np.frombuffer(payload, "<u4", 4))
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    low, width, start, first = take("<u4", blocks), take("u1", blocks), take("<u4", blocks), take("<u4", blocks)
    packed, place, values = take("u1", size), take("u1", exceptions), take("<u4", exceptions)
    rows = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        from_ = start[own].astype(np.int64)[:, None] + np.arange(16 * int(w))
        words = np.ascontiguousarray(packed[from_].view("<u8").T)
        mask = np.uint64((1 << int(w)) - 1)
        columns = np.empty((BLOCK, len(own)), dtype=np.uint32)
        for j in range(BLOCK):
            word, shift = divmod(j * int(w), 64)
            x = words[word] >> np.uint64(shift)
            if shift + w > 64:
                x = x | (words[word + 1] << np.uint64(64 - shift))
            columns[j] = (x & mask).astype(np.uint32)
        rows[own] = columns.T
    owner = np.repeat(np.arange(blocks), np.diff(np.append(first, exceptions)))
    rows[owner, place] = values
    rows += low[:, None]
    return rows.reshape(-1)[:n]


# --- encoding ------------------------------------------------------------------------------------


#: Patterns (fixed values) of which no match holds white space: what they leave out is dropped.
SPACELESS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def cuts_at_spaces(definition: str) -> bool:
    """Whether a tokenizer's own definition shows that its tokens never cross ASCII white space, nor depend on what lies beyond.

    Its normaliser may only compose characters, lower them and squeeze white space; its first split must keep nothing
    but matches of a known pattern; and none of its added tokens may hold white space. NFC joins nothing to a space.
    """
    own = json.loads(definition)
    steps = lambda part, inner: [] if part is None else part[inner] if part["type"] == "Sequence" else [part]
    squeeze = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    normal = all(s["type"] in ("NFC", "Lowercase") or s == squeeze for s in steps(own["normalizer"], "normalizers"))
    split = [s for s in steps(own["pre_tokenizer"], "pretokenizers")][:1]
    dropped = bool(split) and split[0].get("behavior") == "Removed" and split[0].get("invert") and split[0].get("pattern", {}).get("Regex") in SPACELESS
    bare = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in own["added_tokens"])
    return bool(normal and dropped and bare and own["model"]["type"] == "BPE" and not own["truncation"] and not own["padding"])


class TextEncoder:
    """Ids of whole texts, encoded as such by the library: for every tokenizer."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids, as little-endian uint32, of each text."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]


class WordEncoder:
    """The same for a tokenizer that cuts at ASCII white space (cuts_at_spaces): each distinct word is encoded once.

    New words of a block of texts are encoded together, with a mark between them. Words seen lately are remembered in
    two generations of bounded size.
    """

    MARK = b"\x00"

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.mark = self._ids(self.MARK)

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype="<u4")  # without offsets

    def _encode_words(self, words: list[bytes]) -> None:
        plain = [w for w in words if self.MARK not in w]
        if len(self.mark) != 1 or len(plain) < len(words):
            self.new.update((w, self._ids(w).tobytes()) for w in (words if len(self.mark) != 1 else set(words).difference(plain)))
        if len(self.mark) == 1 and plain:
            ids = self._ids(b" \x00 ".join([*plain, b""]))
            ends = np.flatnonzero(ids == self.mark[0])
            starts = np.concatenate(([0], ends[:-1] + 1))
            raw = ids.tobytes()
            self.new.update(zip(plain, [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids, as little-endian uint32, of each text."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        distinct = set().union(*split)
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        known, old = self.new, self.old
        missing = []
        for w in distinct:
            if w not in known:
                if (ids := old.get(w)) is not None:
                    known[w] = ids
                else:
                    missing.append(w)
        if missing:
            self._encode_words(missing)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=1)
def encoder_of(definition: str) -> TextEncoder | WordEncoder:
    """One for each worker, whose memory then serves all its tasks."""
    return WordEncoder(definition) if cuts_at_spaces(definition) else TextEncoder(definition)


SCHEMA = "part int, shard int, doc_ids array<long>, lengths array<long>, payload binary"


def encode_shards(definition) -> callable:
    """A partition's documents, in its order, to file rows. definition: broadcast tokenizer file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, encoder = TaskContext.get().partitionId(), 0, None
        ids: list[bytes] = []
        docs: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, ids, docs, lengths
            payload = pack(np.frombuffer(b"".join(ids), dtype="<u4"))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "shard", "doc_ids", "lengths", "payload"],
            )
            shard, ids, docs, lengths = shard + 1, [], [], []
            return out

        end, total = np.array([END_ID], dtype="<u4").tobytes(), 0
        for batch in batches:
            encoder = encoder or encoder_of(definition.value)
            encoded = (ids for own in slices(batch.column("text").to_pylist()) for ids in encoder.encode_all(own))
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                docs.append(doc_id)
                ids.append(own + end)
                lengths.append(len(ids[-1]) // 4)
                total += lengths[-1]
                if total >= SHARD_IDS:
                    yield close()
                    total = 0
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token ids of every whole text, in ascending doc_id order, as a table of shards in the shared folder, read back.

    Each shard row holds a range of documents: their ids and lengths (the index) and the payload of token blocks.
    Each text is encoded without special tokens and ends with END_ID. Null texts count as empty (one id each); null
    doc_ids come first; rows of one doc_id stand in order of their texts. Other columns are ignored; an
    empty table gives no shards.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(encode_shards(definition), SCHEMA), "token-shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, part, shard, place, start_in_shard, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["payload"]).astype("<u4").tobytes()
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                view = memoryview(raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(np.full(len(starts), row["part"], np.int32)),
                        pa.array(np.full(len(starts), row["shard"], np.int32)),
                        pa.array(starts),
                        pa.array(lengths),
                        pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "part", "shard", "start_in_shard", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, "doc_id long, part int, shard int, start_in_shard long, n_tokens long, ids_crc32 long")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard: within its part by a window over the part, across parts by one row per part."""
    sizes = shards.select("part", "shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    in_part = sizes.select("part", "shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("in_part"))
    totals = sizes.groupBy("part").agg(F.sum("ids").alias("ids"))
    # One row for each range partition of the write: their number is a setting, whatever the data.
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("ids").over(across), F.lit(0)).alias("before"))
    return in_part.join(F.broadcast(parts), "part").select("part", "shard", (F.col("in_part") + F.col("before")).alias("shard_start"))


def token_index(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files written and read back."""
    shards = write_token_files(docs, tokenizer_path)
    starts = shard_starts(shards)
    return read_token_files(shards).join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_token_files": op3_token_files}
ORACLES: dict[str, str] = {}
