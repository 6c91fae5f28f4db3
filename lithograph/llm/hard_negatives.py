"""Hard negatives by inner product: leading components of a PCA rotation discard, integer products decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import materialize, release, table
from lithograph.llm.vectors import finite, matrix, quantised

EVERY, SHIFTED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
LEAD = (16, 32)  #: leading components after which pairs are discarded
SLICE, ANCHORS = 1 << 16, 1 << 14  #: vectors and anchors that meet in one group, at most about
FIRST, GROWTH = 8, 16  #: slices of the first round, and how many times as many each later one has
CHUNK = 1 << 21  #: partial products held at once
NO_ID = -(1 << 63)


def _rotation(rows: DataFrame, size: int) -> np.ndarray:
    """Orthogonal: the eigenvectors of the second moments of all vectors, by falling eigenvalue. Only size * size sums reach the driver."""
    names = ["i", *(f"m{j}" for j in range(size))]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            own = matrix(batch.column("q"), size).astype(np.float64)
            total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *(pa.array(total[:, j]) for j in range(size))], names=names)

    told = rows.select("q").mapInArrow(moments, "i int, " + ", ".join(f"{c} double" for c in names[1:]))
    total = np.zeros((size, size))
    for row in told.groupBy("i").agg(*[F.sum(c) for c in names[1:]]).collect():
        total[row["i"]] = row[1:]
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


class Rotated:
    """Vectors as whole numbers and rotated, with the norms of what follows each number of leading components."""

    def __init__(self, whole: np.ndarray, rotation: np.ndarray):
        self.whole = whole.astype(np.int64)
        self.turned = whole.astype(np.float64) @ rotation
        self.norm = np.sqrt((self.turned**2).sum(1))
        self.rest = {at: np.sqrt((self.turned[:, at:] ** 2).sum(1)) for at in LEAD}


def _bounded(a: Rotated, v: Rotated, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair the partial product of the first leading components, and how far the whole may be from it.

    The rest of a product is at most the product of the rests' norms (Cauchy and Schwarz). Rounding of 64-bit floats in
    the rotation and the sums is below 1e-12 of the norms' product; the slack is a thousand times that.
    """
    at = LEAD[0]
    return a.turned[rows, :at] @ v.turned[:, :at].T, np.outer(a.rest[at][rows], v.rest[at]) + 1e-9 * np.outer(a.norm[rows], v.norm) + 1e-6


def _survivors(a: Rotated, v: Rotated, i: np.ndarray, j: np.ndarray, partial: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may still reach `least` after further components, and their integer products."""
    for before, at in zip(LEAD, LEAD[1:], strict=False):
        partial = partial + np.einsum("ij,ij->i", a.turned[i, before:at], v.turned[j, before:at])
        alive = partial + a.rest[at][i] * v.rest[at][j] + 1e-9 * a.norm[i] * v.norm[j] + 1e-6 >= least
        i, j, partial, least = i[alive], j[alive], partial[alive], least[alive]
    exact = np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", a.whole[i[k : k + 65536]], v.whole[j[k : k + 65536]]) for k in range(0, len(i), 65536))])
    return i, j, exact


def _first(groups: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: by falling score, then by id."""
    order = np.lexsort((ids, -score, groups))
    own = groups[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return order[place < k]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    return -np.partition(-values, k - 1, axis=1)[:, k - 1] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, CHUNK // max(1, width))
    return (slice(k, min(n, k + step)) for k in range(0, n, step))


def _numbers(group: pa.Table, name: str) -> np.ndarray:
    return np.asarray(group.column(name).combine_chunks(), dtype=np.int64)


def _best_positives(size: int, rotation: np.ndarray) -> Callable:
    """For one group of vectors and anchors: of each anchor the first POSITIVES others of its label, unless they are below its floor."""

    def run(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        v, a = (Rotated(matrix(t.column("q"), size), rotation) for t in (vectors, anchors))
        row, id_, label = (_numbers(vectors, c) for c in ("row", "id", "label"))
        own_row, own_label, floor = (_numbers(anchors, c) for c in ("row", "label", "floor"))
        found = []
        for rows in _chunks(len(own_row), len(row)):
            partial, apart = _bounded(a, v, rows)
            open_ = (own_label[rows, None] == label[None]) & (own_row[rows, None] != row[None])
            least = np.maximum(floor[rows].astype(np.float64), _kth(np.where(open_, partial - apart, -np.inf), POSITIVES))
            i, j = np.nonzero(open_ & (partial + apart >= least[:, None]))
            i, j, score = _survivors(a, v, i + rows.start, j, partial[i, j], least[i])
            enough = score >= floor[i]
            i, j, score = i[enough], j[enough], score[enough]
            best = _first(i, score, id_[j], POSITIVES)
            found.append((own_row[i[best]], id_[j[best]], score[best]))
        return _table(found, ["anchor", "id", "score"])

    return run


def _best_negatives(size: int, rotation: np.ndarray) -> Callable:
    """For one group: of each anchor and positive the first NEGATIVES vectors of other labels whose score lies between floor and high."""

    def run(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        v, a = (Rotated(matrix(t.column("q"), size), rotation) for t in (vectors, anchors))
        row, id_, label = (_numbers(vectors, c) for c in ("row", "id", "label"))
        own_row, own_label = (_numbers(anchors, c) for c in ("row", "label"))
        floor, high = (np.array(anchors.column(c).to_pylist(), dtype=np.int64).reshape(-1, POSITIVES) for c in ("floors", "highs"))
        found = []
        for rows in _chunks(len(own_row), len(row)):
            partial, apart = _bounded(a, v, rows)
            lower, upper = partial - apart, partial + apart
            other = own_label[rows, None] != label[None]
            keep, least = np.zeros(other.shape, dtype=bool), np.full(len(other), np.inf)
            for t in range(POSITIVES):
                top = high[rows, t, None]
                wanted = floor[rows, t] <= high[rows, t]
                if not wanted.any():
                    continue
                surely = _kth(np.where(other & (upper <= top), lower, -np.inf), NEGATIVES)
                lowest = np.where(wanted, np.maximum(floor[rows, t], surely), np.inf)
                keep |= other & (upper >= lowest[:, None]) & (lower <= top)
                least = np.minimum(least, lowest)
            i, j = np.nonzero(keep)
            i, j, score = _survivors(a, v, i + rows.start, j, partial[i, j], least[i])
            for t in range(POSITIVES):
                in_range = np.flatnonzero((score <= high[i, t]) & (score >= floor[i, t]))
                best = in_range[_first(i[in_range], score[in_range], id_[j[in_range]], NEGATIVES)]
                found.append((own_row[i[best]], np.full(len(best), t), id_[j[best]], score[best]))
        return _table(found, ["anchor", "place", "id", "score"])

    return run


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    none = np.empty(0, np.int64)
    return pa.table({n: np.concatenate([none, *(f[k] for f in found)]).astype(np.int64) for k, n in enumerate(names)})


def _rounds(slices: int) -> list[tuple[int, int]]:
    ends = [0, min(FIRST, slices)]
    while ends[-1] < slices:
        ends.append(min(slices, ends[-1] * GROWTH))
    return list(zip(ends, ends[1:], strict=False))


def _search(vectors: DataFrame, asked: DataFrame, shape: tuple[int, int], best: Callable, keys: list[str], k: int, floors: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """The k best (keys, id, score) of all rounds. asked: the anchors; floors: them with what the rounds before leave to reach.

    A group is one slice of the vectors and one block of the anchors. Each round takes GROWTH times the slices of those
    before it, against what these have found: so only few rows of an anchor leave its groups, however many there are.
    """
    slices, blocks = shape
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    top = None
    for low, high in _rounds(slices):
        listed = vectors.filter((F.col("slice") >= low) & (F.col("slice") < high)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        dealt = floors(top).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        dealt = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # columns of its own beside those of the vectors
        made = listed.groupBy("slice", "block").cogroup(dealt.groupBy("slice", "block")).applyInArrow(best, ", ".join(f"{c} long" for c in [*keys, "id", "score"]))
        before, rows = top, made if top is None else made.unionByName(top)
        top = materialize(rows.withColumn("at", rank).filter(F.col("at") <= k), "mined-best")
        kept = top.written_to
        top = top.drop("at")
        top.written_to = kept
        if before is not None:
            release(before)
    return top


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every EVERY-th row.

    embeddings: (vec_id, embedding, label). Rows with a null label, a null vector or a null or non-finite component take
    no part. Where vec_id is divisible by 7 the label is first (label + 1) % 10. A score is the inner product of the
    whole numbers floor(256 * x). Anchors are the rows whose vec_id is divisible by 50; positives of an anchor its
    first 5 other rows of its label; for each, the first 3 rows of other labels with 50 to 95 hundredths of its score
    are returned. Higher scores come first, then smaller ids.

    Anchors are a stated query set and meet all vectors in groups of a slice of the vectors and a block of the anchors,
    both of bounded size; labels play no part in the dealing, so a label of any size is spread. In a group all vectors
    are rotated to the principal axes of the whole table; products of the leading components, with the rest bounded by
    the product of its norms and a slack for rounding, discard pairs that cannot be among the best; what is left after
    more components is multiplied in integers. The floors that one round of groups finds hold for the next.

    Rows that repeat a vec_id are rows of their own. A null vec_id counts as the smallest, is no anchor and comes back
    as null. Of vectors of different lengths the shorter has zeros at its end. Components beyond 2^27 after scaling
    count as that bound. Other columns are ignored; an empty table, or one label, gives an empty result.
    """
    spark = embeddings.sparkSession
    id_, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(id_ % SHIFTED == 0, (label + 1) % LABELS).otherwise(label)
    kept = embeddings.filter(label.isNotNull() & finite(F.col("embedding"))).select(F.coalesce(id_, F.lit(NO_ID)).alias("id"), (id_ % EVERY == 0).alias("asks"), moved.alias("label"), "embedding")
    # Written once: the numbers of rows then stay what they are.
    rows = materialize(quantised(kept).withColumn("row", F.monotonically_increasing_id()), "mined-vectors")
    n, asking, size = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.max(F.length("q")), F.lit(0))).first()
    size = max(1, size // 4)
    slices, blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE)), max(1, -(-asking // ANCHORS))
    rotation = _rotation(rows, size)
    vectors = rows.select("row", "id", "label", "q", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"))
    anchors = rows.filter("asks").select("row", "id", "label", "q")

    def floors(top: DataFrame | None) -> DataFrame:
        if top is None:
            return anchors.withColumn("floor", F.lit(NO_ID).cast("long"))
        least = top.groupBy(F.col("anchor").alias("row")).agg(F.when(F.count(F.lit(1)) >= POSITIVES, F.min("score")).alias("floor"))
        return anchors.join(least, "row", "left").select("row", "id", "label", "q", F.coalesce("floor", F.lit(NO_ID)).alias("floor"))

    top = _search(vectors, anchors, (slices, blocks), _best_positives(size, rotation), ["anchor"], POSITIVES, floors)
    numbered = top.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id")) - 1).select("anchor", F.col("place").cast("long").alias("place"), F.col("id").alias("positive"), F.col("score").alias("reached"))
    positives = materialize(numbered, "mined-positives")
    # Hundreds and the rest apart, so that no product leaves a long.
    tens, rest = F.expr("(reached - pmod(reached, 100L)) div 100"), F.expr("pmod(reached, 100L)")
    high = tens * HIGH + F.expr(f"({HIGH} * pmod(reached, 100L)) div 100")
    low = tens * LOW + F.ceil(rest * LOW / 100).cast("long")
    # Of no use are places that an anchor lacks, and negative scores: half of one is above 95 hundredths of it.
    bounds = positives.select("anchor", "place", low.alias("low"), high.alias("high"))
    empty = F.array(*[F.lit(1).cast("long")] * POSITIVES), F.array(*[F.lit(0).cast("long")] * POSITIVES)

    def ranges(top: DataFrame | None) -> DataFrame:
        own = bounds.withColumn("floor", F.col("low"))
        if top is not None:
            least = top.groupBy("anchor", "place").agg(F.when(F.count(F.lit(1)) >= NEGATIVES, F.min("score")).alias("third"))
            own = bounds.join(least, ["anchor", "place"], "left").withColumn("floor", F.greatest("low", "third"))
        listed = own.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "floor", "high"))).alias("own"))  # POSITIVES at most
        filled = lambda name, other: F.slice(F.concat(F.col(f"own.{name}"), other), 1, POSITIVES)
        return anchors.join(listed, "row").select("row", "id", "label", "q", filled("floor", empty[0]).alias("floors"), filled("high", empty[1]).alias("highs"))

    found = _search(vectors, anchors, (slices, blocks), _best_negatives(size, rotation), ["anchor", "place"], NEGATIVES, ranges)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    named = found.withColumn("rank", rank).join(positives, ["anchor", "place"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return named.select(
        "anchor_id", known("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"),
        F.col("reached").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings whose vec_id is divisible by 50; see hard_negatives."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a, q b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
}
