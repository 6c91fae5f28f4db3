"""Substring deduplication: documents are factored against indexed blocks of the corpus, relative Lempel-Ziv style."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import Words, block, materialize, mix64, powered, ranges_hash, release, table

WINDOW = 50  #: words that a factor has at least
ANCHOR = 11  #: words of an anchor: each window holds WINDOW - ANCHOR + 1 candidates and is filed under the least hash
BLOCK_CHARS = 3 << 20  #: characters of a reference block, about (one longer document makes a longer block)
HOT_SHARE = 32  #: an anchor with over about 1 / (HOT_SHARE * partitions) of all windows is split into parts by window hash
NO_ID = -(1 << 63)  #: stands for a null id


class Windows:
    """All windows of a block of texts: document, first word, anchor and a 63-bit hash beside it.

    attempt: 0 for hashes worked out at once; later ones, for corpora whose words collide under those, take SHA-256.
    """

    def __init__(self, texts: list[str], attempt: int = 0):
        self.words = Words(*block(texts))
        self.n_words = np.diff(self.words.bounds)
        prefix = powered(self.words.hashes())
        total = len(prefix) - 1
        if total < WINDOW:
            self.start = np.empty(0, dtype=np.int64)
            self.anchor = np.empty(0, dtype=np.uint64)
            self.hash = np.empty(0, dtype=np.uint64)
            self.doc = np.empty(0, dtype=np.int64)
            return
        at = np.arange(total - ANCHOR + 1)
        least = ranges_hash(prefix, at, at + ANCHOR)
        width, reach = WINDOW - ANCHOR + 1, 1
        while 2 * reach <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        doc = self.words.doc
        self.start = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])  # within one document
        self.anchor = least[self.start]
        if attempt:
            salt = attempt.to_bytes(8, "little")
            self.hash = np.array([int.from_bytes(hashlib.sha256(salt + self.spelled(i, WINDOW)).digest()[:8], "little") for i in self.start.tolist()], dtype=np.uint64) >> np.uint64(1)
        else:
            self.hash = ranges_hash(prefix, self.start, self.start + WINDOW) >> np.uint64(1)
        self.doc = doc[self.start]

    def spelled(self, first: int, words: int) -> bytes:
        """Consecutive words, joined by one space."""
        return b" ".join(self.words.raw[self.words.start[first] : self.words.end[first + words - 1]].tobytes().split())


class Block:
    """The documents of a block by id (rows of one id by text): what indexing, parsing and checking number alike."""

    def __init__(self, rows: pa.Table):
        ids, texts = rows.column("id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts = np.array([ids[i] for i in order], dtype=np.int64), [texts[i] for i in order]

    def bases(self, bounds: np.ndarray) -> np.ndarray:
        """For each document, where the words of its id begin; bounds: where those of each document do."""
        return bounds[:-1][np.searchsorted(self.ids, self.ids)]


def _joint(anchor: np.ndarray, hash_: np.ndarray) -> np.ndarray:
    """One number for look-ups; those who find it compare anchor and hash themselves."""
    return mix64(anchor + hash_ * np.uint64(0x9E3779B97F4A7C15))


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of data, cut at ends (of elements, a leading 0 among them), as binary values without a copy each."""
    offsets = (ends * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, the first row among them."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ends(first: np.ndarray, total: int) -> np.ndarray:
    """Where each run ends, given where they begin."""
    return np.append(first[1:], total)[: len(first)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


COUNTED = "anchor long, block int, windows long, low long, high long"


def count_anchors(own: Block, number: int, attempt: int = 0) -> pa.Table:
    """COUNTED: for each anchor of a block its windows and the least and the greatest id that has it."""
    w = Windows(own.texts, attempt)
    order = np.argsort(w.anchor, kind="stable")  # documents stand by id
    anchor, id_ = w.anchor[order], own.ids[w.doc[order]]
    first = _runs(anchor)
    last = _ends(first, len(anchor)) - 1
    return pa.table({
        "anchor": _signed(anchor[first]),
        "block": pa.array(np.full(len(first), number, dtype=np.int32)),
        "windows": pa.array((last - first + 1).astype(np.int64)),
        "low": pa.array(id_[first]),
        "high": pa.array(id_[last]),
    })


def _lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted value its place among the sorted known ones, and whether it is there."""
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    return at, (known[at] == wanted) if len(known) else np.zeros(len(wanted), dtype=bool)


def index_block(own: Block, asked: pa.Table, number: int, attempt: int = 0) -> pa.Table:
    """The distinct windows of a block under the anchors asked for (anchor, parts): (anchor, salt, block, id, windows, places).

    Each window is filed with the smallest id of the block that has it and its first place there, its hash shifted by
    one; the lowest bit says whether other ids of the block have it too. Places are kept as their differences.
    """
    w = Windows(own.texts, attempt)
    known, parts = asked.column("anchor").to_numpy().view(np.uint64), asked.column("parts").to_numpy()
    order = np.argsort(known)
    known, parts = known[order], parts[order]
    at, there = _lookup(known, w.anchor)
    at, start, anchor, hash_, doc = at[there], w.start[there], w.anchor[there], w.hash[there], w.doc[there]
    place = (start - own.bases(w.words.bounds)[doc]).astype(np.uint32)
    order = np.lexsort((start, hash_, anchor))  # documents stand by id
    at, anchor, hash_, id_, place = at[order], anchor[order], hash_[order], own.ids[doc[order]], place[order]
    first = _runs(anchor, hash_)
    last = _ends(first, len(anchor)) - 1
    several = id_[first] != id_[last]
    at, anchor, hash_, id_, place = at[first], anchor[first], hash_[first], id_[first], place[first]
    salt = (hash_ % parts[at].astype(np.uint64) if len(at) else hash_).astype(np.int32)
    order = np.lexsort((place, id_, salt, anchor))
    anchor, salt, id_, place = anchor[order], salt[order], id_[order], place[order]
    data = ((hash_ << np.uint64(1)) | several.astype(np.uint64))[order]
    first = _runs(anchor, salt, id_)
    ends = np.append(first, len(data))
    step = np.diff(place, prepend=np.uint32(0))
    step[first] = place[first]
    return pa.table({
        "anchor": _signed(anchor[first]),
        "salt": pa.array(salt[first]),
        "block": pa.array(np.full(len(first), number, dtype=np.int32)),
        "id": pa.array(id_[first]),
        "windows": _binary(data, ends),
        "places": _binary(step, ends),
    })


INDEXED = "anchor long, salt int, block int, id long, windows binary, places binary"
FOUND = "block int, anchor long, source long, source_block int, windows binary, places binary"


def _resolve(rows: pa.Table) -> pa.RecordBatch:
    """For rows of whole anchors: FOUND, the windows that several ids have, with the smallest (source) and its place of each."""
    anchor = rows.column("anchor").to_numpy().view(np.uint64)
    block_, own = rows.column("block").to_numpy(), rows.column("id").to_numpy()
    raw = rows.column("windows").to_pylist()
    sizes = np.array([len(x) // 8 for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype="<u8")
    row = np.repeat(np.arange(len(sizes)), sizes)
    total = np.cumsum(np.frombuffer(b"".join(rows.column("places").to_pylist()), dtype="<u4"), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    place = (total - np.concatenate(([0], total))[starts][row]).astype(np.uint32) if len(row) else total.astype(np.uint32)
    order = np.lexsort((block_[row], own[row], data >> np.uint64(1), anchor[row]))
    row, data, place = row[order], data[order], place[order]
    first = _runs(anchor[row], data >> np.uint64(1))
    size = np.diff(np.append(first, len(row)))
    shared = (np.add.reduceat((data & np.uint64(1)).astype(np.int64), first) > 0) | (size > 1) if len(first) else np.empty(0, dtype=bool)
    source, home, place = np.repeat(own[row[first]], size), np.repeat(block_[row[first]], size), np.repeat(place[first], size)
    keep = np.repeat(shared, size)
    row, source, home, place, data = row[keep], source[keep], home[keep], place[keep], data[keep] >> np.uint64(1)
    order = np.lexsort((place, home, source, row))
    row, source, home, place, data = row[order], source[order], home[order], place[order], data[order]
    first = _runs(row, source, home)
    ends = np.append(first, len(data))
    return pa.RecordBatch.from_arrays(
        [pa.array(block_[row[first]]), _signed(anchor[row[first]]), pa.array(source[first]), pa.array(home[first]), _binary(data, ends), _binary(place, ends)],
        names=["block", "anchor", "source", "source_block", "windows", "places"],
    )


def _resolve_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and salt: those of the last anchor wait for the next batch."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.nbytes
        if size < 4 << 20:
            continue
        rows = pa.Table.from_batches(waiting).combine_chunks()
        anchor, salt = rows.column("anchor").to_numpy(), rows.column("salt").to_numpy()
        cut = int(_runs(anchor, salt)[-1])
        if cut:
            yield _resolve(rows.slice(0, cut))
            waiting = rows.slice(cut).to_batches()
            size = sum(b.nbytes for b in waiting)
    if waiting:
        yield _resolve(pa.Table.from_batches(waiting).combine_chunks())


def greedy_factors(start: np.ndarray, doc: np.ndarray, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (by index) of the runs of consecutive windows that stand consecutively in one source: each is a factor.

    From its first window a factor is extended word by word, as long as the next window of the document is the next
    of the source; there, at its boundary, the next factor begins, or words of the document's own.
    """
    new = np.ones(len(start), dtype=bool)
    if len(new):
        new[1:] = (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return first, _ends(first, len(start)) - 1


class Found:
    """The factors of a block's documents: first word, words, document, source, its block and the factor's place there."""

    def __init__(self, own: Block, found: pa.Table, attempt: int = 0):
        w = self.windows = Windows(own.texts, attempt)
        raw = found.column("windows").to_pylist()
        sizes = np.array([len(x) // 8 for x in raw], dtype=np.int64)
        hash_ = np.frombuffer(b"".join(raw), dtype="<u8")
        place = np.frombuffer(b"".join(found.column("places").to_pylist()), dtype="<u4").astype(np.int64)
        anchor, source, home = (np.repeat(found.column(c).to_numpy(), sizes) for c in ("anchor", "source", "source_block"))
        anchor = anchor.view(np.uint64)
        key = _joint(anchor, hash_)
        order = np.argsort(key, kind="stable")
        key, anchor, hash_, source, home, place = key[order], anchor[order], hash_[order], source[order], home[order], place[order]
        at, hit = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if len(key) and len(w.hash):
            low = np.searchsorted(key, _joint(w.anchor, w.hash))
            at = np.minimum(low, len(key) - 1)
            for step in range(1, int(np.diff(np.append(_runs(key), len(key))).max())):  # keys that agree by chance
                other = np.minimum(low + step, len(key) - 1)
                at = np.where((anchor[at] == w.anchor) & (hash_[at] == w.hash), at, other)
            hit = np.flatnonzero((anchor[at] == w.anchor) & (hash_[at] == w.hash) & (source[at] < own.ids[w.doc]))
        at = at[hit]
        first, last = greedy_factors(w.start[hit], w.doc[hit], source[at], place[at])
        self.start, self.doc = w.start[hit][first], w.doc[hit][first]
        self.words = w.start[hit][last] - self.start + WINDOW
        self.source, self.home, self.place = source[at][first], home[at][first], place[at][first]

    def claims(self) -> pa.Table:
        """CLAIMS: each factor's source and place there, with the SHA-256 of its words, to be compared in the source's block."""
        digests = [hashlib.sha256(self.windows.spelled(a, n)).digest() for a, n in zip(self.start.tolist(), self.words.tolist(), strict=True)]
        return pa.table({
            "source_block": pa.array(self.home.astype(np.int32)),
            "source": pa.array(self.source.astype(np.int64)),
            "place": pa.array(self.place.astype(np.int64)),
            "words": pa.array(self.words.astype(np.int64)),
            "digest": pa.array(digests, pa.binary()),
        })


CLAIMS = "source_block int, source long, place long, words long, digest binary"


def refuted(own: Block, claims: pa.Table) -> int:
    """How many of the claims on this block's documents do not hold: the source has other words at that place."""
    asked = np.unique(claims.column("source").to_numpy())
    texts: dict[int, list[bytes]] = {}
    for i in np.flatnonzero(np.isin(own.ids, asked)).tolist():
        texts.setdefault(int(own.ids[i]), []).extend(own.texts[i].encode("utf-8", "surrogatepass").split())
    wrong = 0
    for source, place, words, digest in zip(*(claims.column(c).to_pylist() for c in ("source", "place", "words", "digest")), strict=True):
        wrong += hashlib.sha256(b" ".join(texts.get(source, [])[place : place + words])).digest() != digest
    return wrong


def parse_block(own: Block, found: pa.Table, attempt: int = 0) -> tuple[np.ndarray, np.ndarray, list, list[bytes]]:
    """Per document: words, removed words, factors (start, words, source, source_start), and its words that stay, joined by one space."""
    f = Found(own, found, attempt)
    bounds = f.windows.words.bounds
    factors: list[list[tuple[int, int, int, int]]] = [[] for _ in own.texts]
    covered = np.zeros(int(bounds[-1]) + 1, dtype=np.int32)
    np.add.at(covered, f.start, 1)
    np.add.at(covered, f.start + f.words, -1)
    for a, n, d, source, place in zip(f.start.tolist(), f.words.tolist(), f.doc.tolist(), f.source.tolist(), f.place.tolist(), strict=True):
        factors[d].append((a - int(bounds[d]), n, source, place))
    removed = np.cumsum(covered)[:-1] > 0
    counts = np.concatenate(([0], np.cumsum(removed)))
    n_removed = counts[bounds[1:]] - counts[bounds[:-1]]
    kept = []
    for i, text in enumerate(own.texts):
        words = text.encode("utf-8", "surrogatepass").split()
        if n_removed[i]:
            gone = removed[bounds[i] : bounds[i + 1]].tolist()
            words = [x for x, g in zip(words, gone, strict=True) if not g]
        kept.append(b" ".join(words))
    return f.windows.n_words, n_removed, factors, kept


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: long, words: long, source: long, source_start: long>>, kept string"


def repeated_passages(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, factors, kept (the text without the factors' words).

    Words are what stands between ASCII white space, unchanged. A word goes when a window of WINDOW consecutive words
    that covers it also starts in a document with a smaller id; windows are judged on the input alone.

    The corpus is cut into reference blocks by hash of the id. Each block indexes the places of its distinct windows
    under an anchor, the least hash of their ANCHOR-word sequences, which equal windows share; the index joins all
    blocks, so a document is factored against every block, the work growing with the text and not with pairs of
    copies. Anchors that one id alone has are left out of it, as none of their windows is repeated; an anchor of more
    than a small share of all windows is split by window. Of each window that several
    documents have, the smallest id and its place there go back to the blocks that hold it, and each document is
    parsed greedily: a factor (start, words, source, source_start) is extended word by word as long as document and
    source agree, then the next begins. In the source's block the words at that place, from the factor's first to its
    last, are compared with the factor's by their SHA-256. Windows agree in 64 bits of anchor and 63 bits of hash
    before; where a factor is refuted all the same, all is done again with window hashes from SHA-256, until every
    factor stands in its source. source_start counts the words of the source's rows in order of their texts, should
    several have its id.

    Null texts are empty: no words, and the digest of nothing. A null id counts as smaller than all others, and
    windows within rows of one id are no repeats. Repeated rows give a row each. Other columns are ignored; an empty
    table gives an empty result. keep_text=False leaves kept null, for callers who need digests alone.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(partitions, -(-chars // BLOCK_CHARS))
    limit = max(1_000, chars // (10 * HOT_SHARE * partitions))
    spread = F.when(F.col("id") == NO_ID, F.xxhash64("text")).otherwise(F.xxhash64("id"))
    dealt = own.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")).repartition(blocks, "block")

    attempt = 0
    while True:
        found = materialize(_sources(dealt, blocks, limit, attempt), "passage-sources")
        done = materialize(_parsed(dealt, found, keep_text, attempt), "repeated-passages")
        release(found)
        if done.filter("refuted > 0").limit(1).count() == 0:
            return done.filter("refuted IS NULL").drop("refuted")
        release(done)
        attempt += 1


def _sources(dealt: DataFrame, blocks: int, limit: int, attempt: int) -> DataFrame:
    """FOUND: the windows of each block that several ids have, with the smallest. Only anchors of several ids are indexed."""

    def count(rows: pa.Table) -> pa.Table:
        return count_anchors(Block(rows), rows.column("block")[0].as_py(), attempt)

    def index(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return index_block(Block(rows), asked, rows.column("block")[0].as_py() if rows.num_rows else -1, attempt)

    counted = dealt.groupBy("block").applyInArrow(count, COUNTED)
    everywhere = Window.partitionBy("anchor")  # a row for each block at most
    totals = counted.select("anchor", "block", *[f(c).over(everywhere).alias(c) for f, c in ((F.sum, "windows"), (F.min, "low"), (F.max, "high"))])
    asked = totals.filter("low < high").select("anchor", "block", F.ceil(F.col("windows") / limit).alias("parts"))
    filed = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(index, INDEXED)
    return filed.repartition(blocks, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_resolve_partition, FOUND)


def _parsed(dealt: DataFrame, found: DataFrame, keep_text: bool, attempt: int) -> DataFrame:
    """SCHEMA and refuted: null in rows of documents; other rows have the number of claims refuted in a block."""

    def claim(rows: pa.Table, hits: pa.Table) -> pa.Table:
        return Found(Block(rows), hits, attempt).claims()

    def check(rows: pa.Table, claims: pa.Table) -> pa.Table:
        n = refuted(Block(rows), claims) if claims.num_rows else 0
        return pa.table({"refuted": pa.array([n] if n else [], pa.int64())})

    def parse(rows: pa.Table, hits: pa.Table) -> pa.Table:
        own = Block(rows)
        n_words, n_removed, factors, kept = parse_block(own, hits, attempt)
        kinds = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "words", "source", "source_start")]))
        return pa.table({
            "doc_id": pa.array(own.ids, pa.int64(), mask=own.ids == NO_ID),
            "n_words": pa.array(n_words.astype(np.int64)),
            "n_removed": pa.array(n_removed.astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            "factors": pa.array([[{"start": a, "words": n, "source": None if s == NO_ID else s, "source_start": p} for a, n, s, p in f] for f in factors], kinds),
            "kept": pa.array([k.decode() for k in kept] if keep_text else [None] * len(kept), pa.string()),
        })

    # All three share the shuffle of the texts: this is one plan.
    claims = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(claim, CLAIMS).distinct()
    checked = dealt.groupBy("block").cogroup(claims.groupBy("source_block")).applyInArrow(check, "refuted long")
    parsed = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(parse, SCHEMA)
    return parsed.unionByName(checked, allowMissingColumns=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = repeated_passages(table(spark, sf_dir, "documents"), keep_text=False)
    return parsed.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("factors").cast("long").alias("n_factors"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES: dict[str, str] = {}
