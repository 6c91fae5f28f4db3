"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import Words, block, materialize, mix64, powered, ranges_hash, release, slices, small_batches, spread_join, spread_keys, sums, table, unused

SHINGLE = 5  #: words of a shingle
SIMILARITY = 0.8
BANDS, ROWS = 14, 4  #: a pair of similarity 0.8 shares a band with probability 0.9994
IDF_BITS = 21  #: log2 of the hashed word frequencies
CHUNK = 1 << 14
CROWD = 500  #: askers, and members, of a bucket in one group
TABLE_BITS = 16  #: log2 of the random draws of each hash function

NO_ID = -(1 << 63)  #: stands for a null id while ids are compared


# --- weighted shingles ---------------------------------------------------------------------------


def _words(texts: list[str]) -> tuple[Words, np.ndarray]:
    words = Words(*block([t.lower() for t in texts]))
    return words, words.hashes()


def word_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows of docs (text) have a word of each hash bucket, and the number of rows; counted over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << IDF_BITS, dtype=np.uint32), 0
        for batch in batches:
            for texts in slices(batch.column("text").to_pylist()):
                words, hashes = _words(texts)
                doc = words.doc
                at = (hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)
                distinct = np.unique(doc * (1 << IDF_BITS) + at)
                counts += np.bincount(distinct & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS).astype(np.uint32)
                rows += len(texts)
        if rows:
            yield _chunk(-1, b"", np.array([rows], "<u8").tobytes())
        for chunk in range((1 << IDF_BITS) // CHUNK):
            own = counts[chunk * CHUNK : (chunk + 1) * CHUNK]
            if len(at := np.flatnonzero(own)):
                kind = np.min_scalar_type(int(own.max())).newbyteorder("<")
                yield _chunk(chunk, at.astype("<u2").tobytes(), own[at].astype(kind).tobytes())

    def add(own: pa.Table) -> pa.Table:
        number, total, rows = own.column("chunk")[0].as_py(), np.zeros(CHUNK, dtype="<u8"), 0
        for at, counts in zip(own.column("at").to_pylist(), own.column("counts").to_pylist(), strict=True):
            if number < 0:
                rows += int(np.frombuffer(counts, "<u8")[0])
            else:
                where = np.frombuffer(at, "<u2")
                total[where] += np.frombuffer(counts, f"<u{len(counts) // len(where)}").astype("<u8")
        return pa.Table.from_batches([_chunk(number, b"", (total if number >= 0 else np.array([rows], "<u8")).tobytes())])

    schema = "chunk int, at binary, counts binary"
    out, n = np.zeros(1 << IDF_BITS, dtype=np.float64), 0
    for row in docs.select("text").mapInArrow(partial, schema).groupBy("chunk").applyInArrow(add, schema).collect():  # at most 129 rows of fixed size
        if row["chunk"] < 0:
            n = int(np.frombuffer(row["counts"], "<u8")[0])
        else:
            out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], "<u8")
    return out, n


def _chunk(number: int, at: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([at], pa.binary()), pa.array([counts], pa.binary())], names=["chunk", "at", "counts"])


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    return (1.0 + np.log((1.0 + n) / (1.0 + counts))).astype(np.float32)


def weighted_shingles(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: hashes, weights, and where each text's begin (one more at the end).

    Words are the lower-cased text between ASCII white space. A weight is the shingle's count times the mean inverse
    document frequency of its words. A text of one to four words has one shingle of all its words; one without words
    has none.
    """
    words, hashes = _words(texts)
    n = np.diff(words.bounds)
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    ends = sums(made.astype(np.uint64)).astype(np.int64)
    start = np.arange(ends[-1]) - np.repeat(ends[:-1] - words.bounds[:-1], made)
    stop = start + np.repeat(np.minimum(n, SHINGLE), made)
    shingles = ranges_hash(powered(hashes), start, stop)
    total = np.concatenate(([0.0], np.cumsum(idf[(hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)], dtype=np.float64)))
    weight = (total[stop] - total[start]) / np.maximum(stop - start, 1)
    found, weights, sizes = [], [], [0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own, first, count = np.unique(shingles[a:b], return_index=True, return_counts=True)
        found.append(own)
        weights.append(weight[a:b][first] * count)
        sizes.append(len(own))
    none = np.empty(0)
    return np.concatenate([none.astype(np.uint64), *found]), np.concatenate([none, *weights]), np.cumsum(sizes)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the larger; 0 when either has no shingle."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


# --- improved consistent weighted sampling -------------------------------------------------------


@lru_cache(maxsize=1)
def _draws() -> list[tuple]:
    """For each hash function: its multiplier, and r, beta and ln c by the upper bits of the multiplied hash."""
    rng = np.random.Generator(np.random.PCG64(20240601))
    size, out = 1 << TABLE_BITS, []
    for _ in range(BANDS * ROWS):
        r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        out.append((np.uint64(int(rng.integers(1 << 63)) * 2 + 1), r, rng.random(size).astype(np.float32), np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)))
    return out


def bands(shingles: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes for each text with shingles.

    The sample of a hash function is the shingle of least a = c / (y e^r), with y = e^(r (t - beta)) and
    t = floor(ln w / r + beta), together with t; its draws depend on the shingle alone.
    """
    starts = ends[:-1]
    own = np.diff(ends)
    log_weight = np.log(weights).astype(np.float32)
    out = np.empty((len(starts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        joint = np.full(len(starts), band + 1, dtype=np.uint64)
        for multiplier, r_, beta, log_c in _draws()[band * ROWS : (band + 1) * ROWS]:
            at = ((shingles * multiplier) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            shift = beta[at]
            r = r_[at]
            t = np.floor(log_weight / r + shift)
            log_a = log_c[at] - r * (t - shift + 1)
            least = np.minimum.reduceat(log_a, starts)
            hits = np.flatnonzero(log_a == np.repeat(least, own))
            first = hits[np.searchsorted(hits, starts)]
            joint = mix64(joint * np.uint64(0x9E3779B97F4A7C15) + shingles[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out[:, band] = joint
    return out


# --- classes -------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """id (null ids as NO_ID), text, and key: 16 bytes of the text's digest, the vertex of all equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"))


def _signatures(keyed: DataFrame, idf) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text").to_pylist()):
                shingles, weights, ends = weighted_shingles(texts, idf.value)
                some = np.diff(ends) > 0
                rows: list = [None] * len(texts)
                if some.any():
                    filled = bands(shingles, weights, np.append(ends[:-1][some], ends[-1])).astype("<i8")
                    for i, values in zip(np.flatnonzero(some).tolist(), filled.view(np.int64), strict=True):
                        rows[i] = values
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), batch.column("key").slice(at, len(texts)), pa.array(rows, pa.list_(pa.int64()))],
                    names=["id", "key", "bands"],
                )
                at += len(texts)

    return keyed.mapInArrow(run, "id long, key binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b: keys) with their exact weighted Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=16)
        def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
            return weighted_shingles([text], idf.value)[:2]

        for batch in batches:
            same = [weighted_jaccard(vector(x), vector(y)) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.float64())], names=["a", "b", "similarity"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    held = {side: spread_keys(pairs, side) for side in "ab"}  # leaders stand on either side of many pairs
    both = spread_join(spread_join(pairs, left, "a", "b", held["a"]), right, "b", "a", held["b"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, class_id, root) of the nodes with an edge: the least id of each connected component, and its node.

    Each round a node takes the least label of itself and its neighbours, then that label's own label, so that paths
    are halved; labels of rounds are written to the shared folder. Nodes of many edges and labels of many nodes are
    spread in the joins.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "near-edges")
    hubs = spread_keys(both, "b")
    labels = materialize(both.select(F.col("a").alias("key")).distinct().join(nodes, "key").select("key", F.struct("id", "key").alias("label")), "near-labels")
    while True:
        told = labels.select(F.col("key").alias("b"), "label")
        near = spread_join(both, told, "b", "a", hubs).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["key"] == near["a"]).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialize(lower.withColumn("root", F.col("label.key")), "near-labels")
        roots = labels.select(F.col("key").alias("root"), F.col("label").alias("next"))
        moved = spread_join(lower, roots, "root", "key", spread_keys(lower, "root")).select("key", "old", F.least("label", "next").alias("label"))
        moved = materialize(moved, "near-labels")
        release(labels, lower)
        labels = moved.select("key", "label")
        labels.written_to = moved.written_to
        if moved.filter("old.id <> label.id OR old.key <> label.key").limit(1).count() == 0:
            release(both)
            return labels.select("key", F.col("label.id").alias("class_id"), F.col("label.key").alias("root"))


def _between(active: DataFrame, roots: DataFrame, texts: DataFrame, idf, similarity: float, hot: list[tuple] | None = None) -> DataFrame:
    """Links (a, b) between different components that meet in a bucket, found exactly.

    In a bucket of more than two (one link is all that a pair has), every member outside the largest
    component asks for its links to members of other components. Askers and members are dealt into blocks of about
    CROWD, and each block of askers meets each block of members of its bucket: a group has about twice CROWD texts,
    however large the bucket is. In a group one look-up in the members' sorted shingles gives the weight that an asker
    shares with each of them; only links come out.
    """
    rows = active.filter("size > 2").select("band", "bucket", "key").join(roots, "key", "left").select("band", "bucket", "key", F.coalesce("root", "key").alias("root"))
    rows = materialize(rows, "near-crowd")
    shares = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / CROWD).cast("int")
    many = shares.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("size"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts"))
    many = many.filter("parts > 1").select("bucket", "largest", blocks(F.col("size")).alias("listed"), blocks(F.col("size") - F.col("most")).alias("asking"))
    dealt = spread_join(rows, many, "bucket", "key", hot)
    place = lambda n: F.pmod(F.xxhash64("key", "band"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_member = dealt.select("band", "bucket", "key", "root", F.lit(False).alias("asks"), each("asking").alias("i"), place(F.col("listed")).alias("j"))
    as_asker = dealt.filter("root <> largest").select("band", "bucket", "key", "root", F.lit(True).alias("asks"), place(F.col("asking")).alias("i"), each("listed").alias("j"))
    met = as_member.union(as_asker)
    held = met.join(texts, "key")

    def compare(group: pa.Table) -> pa.Table:
        keys, root = group.column("key").to_pylist(), group.column("root").to_pylist()
        asks = np.array(group.column("asks").to_pylist())
        found, weights, ends = weighted_shingles(group.column("text").to_pylist(), idf.value)
        owner = np.repeat(np.arange(len(keys)), np.diff(ends))
        total = np.bincount(owner, weights=weights, minlength=len(keys))
        component = np.unique(np.array([r.hex() for r in root]), return_inverse=True)[1]
        listed = np.flatnonzero(~asks[owner])
        listed = listed[np.argsort(found[listed], kind="stable")]
        sorted_, who, theirs = found[listed], owner[listed], weights[listed]
        a, b = [], []
        for i in np.flatnonzero(asks):
            mine = slice(ends[i], ends[i + 1])
            low, high = np.searchsorted(sorted_, found[mine], "left"), np.searchsorted(sorted_, found[mine], "right")
            size = high - low
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            shared = np.bincount(who[at], weights=np.minimum(np.repeat(weights[mine], size), theirs[at]), minlength=len(keys))
            alike = shared / np.maximum(total + total[i] - shared, 1e-9)
            for j in np.flatnonzero((alike >= similarity) & (component != component[i])):
                a.append(keys[i])
                b.append(keys[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return held.groupBy("band", "bucket", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicates: doc_id, class_id, kept, text_key; one row per input row.

    Equal texts are one vertex. Vertices that share a band are candidates: in each band's bucket every member is
    compared with two leaders: the one that meets most others over all its buckets, and one by a hash. That joins nearly
    all that belongs together; where a bucket still holds several components, members of the smaller ones are held
    against those of the others block by block, so that no link that can join classes is lost and no task holds a
    bucket. Candidates count as linked when their exact weighted Jaccard similarity, over counts and inverse
    document frequencies of all rows, is at least similarity. Classes are the connected components; class_id is
    their least doc_id. One row of each class is kept: that of this id (of several texts with it, the one of the least
    text_key; of rows that repeat both, one).

    Null texts count as empty; empty texts are one class. Null ids count as the smallest, and a class_id that is one
    is null. Rows of one doc_id with different texts are classed by their texts. Other columns are ignored; an empty
    table gives an empty result.
    """
    with small_batches(docs.sparkSession):  # all that runs Python ends in here
        return _near_classes(docs, similarity)


def _near_classes(docs: DataFrame, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    keyed = _keyed(docs)
    idf = spark.sparkContext.broadcast(inverse_frequencies(*word_frequencies(keyed)))  # of fixed size
    signed = materialize(_signatures(keyed, idf), "near-signatures")
    nodes = materialize(signed.groupBy("key").agg(F.min("id").alias("id"), F.first("bands", ignorenulls=True).alias("bands")), "near-nodes")
    member = nodes.select("key", F.posexplode("bands").alias("band", "bucket"))
    # A bucket's hash has its band in it, and so names it alone.
    sizes = materialize(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-sizes")
    limit = max(200, (sizes.agg(F.sum("size")).first()[0] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = [(r["bucket"], -(-r["size"] // limit)) for r in sizes.filter(F.col("size") > limit).collect()]  # bounded by the number of partitions
    met = materialize(spread_join(member, sizes, "bucket", "key", hot), "near-met")
    # Of many edited copies of one text that text meets most others, and so makes the best leader.
    central = met.groupBy("key").agg(F.sum("size").alias("met"))
    ranked = met.join(central, "key").withColumn("order", F.struct("met", F.xxhash64("key", "bucket").alias("hash"), "key"))
    leaders = ranked.groupBy("bucket").agg(F.max("order").alias("low"), F.max_by("order", F.col("order.hash")).alias("high"))
    active = materialize(spread_join(met, leaders, "bucket", "key", hot), "near-buckets")
    release(sizes, met)
    crowd = active.select("key").distinct().join(nodes, "key").select("key", "id")
    texts = materialize(keyed.join(crowd, ["key", "id"]).dropDuplicates(["key"]).select("key", "text"), "near-texts")
    stars = active.select(F.col("low.key").alias("a"), F.col("key").alias("b")).union(active.select(F.col("high.key").alias("a"), F.col("key").alias("b")))
    pairs = materialize(stars.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-candidates")
    linked = materialize(_verified(pairs, texts, idf, similarity).filter(F.col("similarity") >= similarity), "near-pairs").select("a", "b")
    release(pairs)
    roots = _components(nodes.select("key", "id"), linked).select("key", "root")
    linked = linked.union(materialize(_between(active, roots, texts, idf, similarity, hot), "near-pairs").select("a", "b"))
    release(active, texts)
    classes = _components(nodes.select("key", "id"), linked).select("key", "class_id", "root")
    named = nodes.select("key", "id").join(classes, "key", "left").select("key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("root", "key").alias("root"))
    rows = signed.select("id", "key")
    rows = spread_join(rows, named, "key", "id", spread_keys(rows, "key"))
    # The row that stays is one of the least id and, of several texts with it, the least key; of equal rows the first.
    last = (F.col("id") == F.col("class_id")) & (F.col("key") == F.col("root"))
    numbered = rows.withColumn("again", F.when(last, F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))))
    null = F.lit(None).cast("long")
    return numbered.select(
        F.when(F.col("id") == NO_ID, null).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("class_id") == NO_ID, null).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("again") == 1, F.lit(False)).alias("kept"),
        F.lower(F.hex("key")).alias("text_key"),
    )


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates: that with the least doc_id; all columns, whatever their names, stay as they are.

    Rows that repeat both its doc_id and its text are dropped too. Nulls are treated as in near_classes.
    """
    id_, key = unused("__row_id", docs), unused("__row_key", docs)
    kept = near_classes(docs, similarity).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.unhex("text_key").alias(key))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: F.unhex(F.substring(F.sha2(text, 256), 1, 32))})
    return own.join(kept, [id_, key], "left_semi").dropDuplicates([id_, key]).drop(id_, key)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES: dict[str, str] = {}
