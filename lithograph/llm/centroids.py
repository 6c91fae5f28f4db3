"""Centroid clustering: Lloyd's rounds over distinct quantised vectors with their multiplicities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import materialize, release, spread_join, table
from lithograph.llm.vectors import finite, matrix, quantised, wide

SIZE, CENTROIDS, ROUNDS, SALT = 64, 40, 5, "2"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number of equally near ones, and its squared distance; exact."""
    v, c = wide(vectors, centroids)
    apart = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]
    best = np.argmin(apart, axis=1)
    return best.astype(np.int32), apart[np.arange(len(v)), best].astype(np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted integer sums of the vectors nearest to each centroid, and their number: a row a centroid from each task, added by Spark."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            own, n = matrix(batch.column("q"), size).astype(np.int64), np.asarray(batch.column("n"), dtype=np.int64)
            if not len(own):
                continue
            at = nearest(own, centroids)[0]
            order = np.argsort(at, kind="stable")
            some, first = np.unique(at[order], return_index=True)
            total[some] += np.add.reduceat((own * n[:, None])[order], first, axis=0)
            count[some] += np.add.reduceat(n[order], first)
        some = np.flatnonzero(count)
        columns = [pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(size))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["cluster", "n", *(f"s{i}" for i in range(size))]
    told = distinct.mapInArrow(run, "cluster int, " + ", ".join(f"{c} long" for c in names[1:]))
    total, count = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
    for row in told.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():  # a row a centroid
        count[row["cluster"]], total[row["cluster"]] = row["n"], row[2:]
    return total, count


def centroid_clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector that counts.

    embeddings: (vec_id, embedding). Vectors of exactly `size` components, none null or non-finite, count; a component x
    becomes floor(256 * x). Equal quantised vectors are one row with its multiplicity; Lloyd's rounds run over these
    with integer sums weighted by the multiplicities, so that copies cost nothing and no rounding depends on the order
    of rows. The first centroids are the k vectors of least sha256 of `salt:vec_id`. A round assigns every vector to the
    nearest centroid (squared distance; the smaller number of equally near ones), and replaces every centroid that has
    vectors by their componentwise floor(sum / count); one without vectors stays. After the last round all are
    assigned once more, and the assignments joined back to the vec_ids by the sha256 of the quantised vector; vectors
    that a count shows to be frequent are spread in that join. What reaches the driver are k rows a round.

    With fewer than k vectors there are as many centroids. Rows that repeat a vec_id count each; a null vec_id is kept,
    and hashes as an empty one. Components beyond 2^27 after scaling count as that bound. An inertia beyond a long is
    null. Other columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = quantised(own.filter((F.size("embedding") == size) & finite(F.col("embedding"))))
    hashed = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    first = hashed.orderBy("hash", "q").limit(k).select("q").collect()  # k rows
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.stack([np.frombuffer(r["q"], "<i4") for r in first]).astype(np.int64)
    distinct = materialize(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")
    for _ in range(rounds):
        total, count = _sums(distinct, centroids)
        centroids = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, apart = nearest(matrix(batch.column("q"), size), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(at), pa.array(apart)], names=["digest", "n", "cluster", "distance"])

    digest = F.unhex(F.sha2("q", 256)).alias("digest")
    assigned = materialize(distinct.select("q", "n", digest).mapInArrow(assign, "digest binary, n long, cluster int, distance long"), "assigned-vectors")
    release(distinct)
    weighed = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).alias("inertia"), F.sum("n").alias("n")).collect()  # k rows
    inertia, n = {r["cluster"]: int(r["inertia"]) for r in weighed}, sum(r["n"] for r in weighed)
    fits = lambda x: x if x < 1 << 63 else None
    named = [(i, fits(v), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, v in inertia.items()]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    limit = max(200, n // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = [(r["digest"], -(-r["n"] // limit)) for r in assigned.filter(F.col("n") > limit).collect()]  # bounded by the number of partitions
    back = spread_join(rows.select("vec_id", digest), assigned.select("digest", "cluster", "distance"), "digest", "vec_id", hot)
    return back.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings of 64 components; see centroid_clusters."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Rounds are unrolled: SQL has no loop that replaces rows. Products of whole numbers below 2^53 are exact as doubles."""
    near = """n{0} AS (SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT q.vec_id, q.v, c.cluster, list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c.v) + list_inner_product(c.v, c.v) AS d FROM q, c{0} c) GROUP BY ALL)"""
    move = """c{1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (
  SELECT cluster, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS v FROM (
    SELECT cluster, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM n{0}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
    rounds = ",\n".join(f"{near.format(i)},\n{move.format(i, i + 1)}" for i in range(ROUNDS))
    return f"""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS cluster, v FROM q ORDER BY sha256('{SALT}:' || vec_id) LIMIT {CENTROIDS}
),
{rounds},
{near.format(ROUNDS)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM n{ROUNDS} JOIN c{ROUNDS} c USING (cluster)
"""


QUERIES = {"op11_centroids": op11_centroids}
ORACLES = {"op11_centroids": _sql()}
