"""Lexical and vector search, their fusion and the reranking rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.functions.text import tokens

# BM25's constants, the fusion constant, sizes of the candidate lists, the shortest content kept.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, POOL, TOP_K, MIN_CONTENT = 60, 50, 6, 4
VECTOR_GATE = 0.62

# Reranking rules as (question pattern, chunk types or document type, boost).
SUPERSEDED_PENALTY = -0.20
CHUNK_RULES = (
    (r"error|code|fault|e-?\d{1,3}\b", ("error_code",), 0.35),
    (r"part|number|p/n|replace|kit", ("table",), 0.25),
    (r"how do i|how to|step|procedure|install|replace|adjust", ("procedure",), 0.25),
    (r"volt|amp|psi|temperature|degrees|spec|rating|dimension", ("table", "spec"), 0.25),
    (r"safe|warning|caution|danger|lockout|shock", ("warning",), 0.30),
)
TROUBLE_RULE = (r"not (heating|working|brewing)|won'?t|fail|troubleshoot|diagnos", "service_repair", 0.20)


def bm25(docs: DataFrame, terms: list[str], eligible: DataFrame | None = None, k: int = POOL) -> DataFrame:
    """(doc_id, score): the k best documents for the terms; repeated terms count again.

    Statistics are those of all documents; eligible (doc_id) restricts the result only. One pass over the texts
    counts the query's terms row by row, without an index or a shuffle of postings; N, document frequencies and the
    mean length are one global aggregate of fixed size.
    """
    distinct = sorted(set(terms))
    if not distinct:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    counted = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).select(
        "doc_id", F.size("t").alias("dl"), F.filter("t", lambda w: w.isin(distinct)).alias("hits")
    )
    for i, term in enumerate(distinct):
        counted = counted.withColumn(f"f{i}", F.size("hits") - F.size(F.array_remove("hits", term)))
    counted = counted.drop("hits")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(distinct))])
    rows = counted.filter(reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(distinct))])).crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(IDF_FLOOR))
        tf = F.col(f"f{i}")
        return terms.count(distinct[i]) * idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    scored = rows.select("doc_id", F.round(reduce(lambda a, b: a + b, [part(i) for i in range(len(distinct))]), 6).alias("score"))
    if eligible is not None:
        scored = scored.join(eligible.select("doc_id"), "doc_id", "left_semi")
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def dot(vector: Column, query: list[float]) -> Column:
    literal = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, query: list[float], k: int = POOL) -> DataFrame:
    """(vec_id, score): the k vectors of largest dot product; exact, one scan and a bounded heap a partition."""
    return vectors.select("vec_id", F.round(dot(F.col("embedding"), query), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def reciprocal_rank_fusion(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(doc_id, fused): sum of 1 / (k + rank) over lists of (doc_id, score) of at most POOL rows each."""
    ranks = [r.select("doc_id", (1.0 / (k + F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))).alias("part")) for r in ranked]  # POOL rows
    return reduce(DataFrame.union, ranks).groupBy("doc_id").agg(F.sum("part").alias("fused"))


def rerank_boost(question: str, chunk_type: Column, doc_type: Column, is_current: Column) -> Column:
    """Sum of the rules that hold for the question and the row."""
    q = F.lit(question.lower())
    parts = [F.when(~is_current, SUPERSEDED_PENALTY).otherwise(0.0)]
    parts += [F.when(q.rlike(pattern) & chunk_type.isin(*kinds), boost).otherwise(0.0) for pattern, kinds, boost in CHUNK_RULES]
    pattern, kind, boost = TROUBLE_RULE
    parts.append(F.when(q.rlike(pattern) & (doc_type == kind), boost).otherwise(0.0))
    return reduce(lambda a, b: a + b, parts)


def hybrid_search(lexical: DataFrame, vector: DataFrame, chunks: DataFrame, question: str, k: int = TOP_K) -> DataFrame:
    """The k best chunks: both lists fused, hydrated from chunks, near-empty ones left out, boosted.

    Both lists hold what may be retrieved alone (ingest.eligible). chunks: (doc_id, text, chunk_type, doc_type,
    is_current). Ties go to the smaller id.
    """
    fused = reciprocal_rank_fusion(lexical, vector)
    rows = chunks.join(F.broadcast(fused), "doc_id")  # at most 2 * POOL rows
    kept = rows.filter(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= MIN_CONTENT)
    boost = rerank_boost(question, F.col("chunk_type"), F.col("doc_type"), F.col("is_current"))
    scored = kept.select(*chunks.columns, F.round(F.col("fused"), 6).alias("fused"), F.round(F.col("fused") + boost, 6).alias("combined"))
    return scored.orderBy(F.desc("combined"), "doc_id").limit(k)


def scoped_vectors(vectors: DataFrame, allowed: DataFrame, query: list[float], k: int = POOL) -> DataFrame:
    """(doc_id, score): the k nearest among the allowed (doc_id); vectors: (vec_id, embedding)."""
    own = vectors.join(allowed.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return vector_search(own, query, k).withColumnRenamed("vec_id", "doc_id")


BLOCK_VECTORS, BLOCK_QUERIES = 4096, 512


def _blocks(vectors: DataFrame, rows: int, id_: str, name: str) -> DataFrame:
    """One row for each block of about `rows` vectors: their ids, and their numbers end to end."""
    n = max(1, -(-vectors.count() // rows))
    own = F.sort_array(F.collect_list(F.struct(F.col(id_).alias("id"), F.col("embedding").alias("v"))))
    made = vectors.groupBy(F.pmod(F.xxhash64(id_), F.lit(n)).alias("block")).agg(own.alias("own"))
    return made.select(F.col("own.id").alias(f"{name}_ids"), F.flatten("own.v").alias(name))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest other vectors of each query, exactly.

    queries and vectors: (vec_id, embedding). Both are cut into blocks, and each block of queries meets each block of
    vectors as one product of matrices, of which the k best of a query leave the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, wanted = np.asarray(row.v_ids), np.asarray(row.q_ids)
                v, q = (np.asarray(x, dtype=np.float64).reshape(len(i), -1) for x, i in ((row.v, ids), (row.q, wanted)))
                score = np.where(wanted[:, None] == ids[None], -np.inf, np.round(q @ v.T, 6))
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids are sorted: ties go to the smaller
                out = pd.DataFrame({"query_id": np.repeat(wanted, best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})
                yield out[np.isfinite(out["score"])]

    pairs = _blocks(vectors, BLOCK_VECTORS, "vec_id", "v").crossJoin(_blocks(queries, BLOCK_QUERIES, "vec_id", "q"))
    found = pairs.mapInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", rank).filter(F.col("place") <= k).drop("place")


def vector_gate(vectors: DataFrame, queries: DataFrame, threshold: float = VECTOR_GATE, k: int = 5) -> DataFrame:
    """(query_id, best, relevant): the best of the k nearest other vectors for each query, and whether it reaches threshold."""
    return nearest(vectors, queries, k).groupBy("query_id").agg(F.max("score").alias("best")).withColumn("relevant", F.col("best") >= threshold)
