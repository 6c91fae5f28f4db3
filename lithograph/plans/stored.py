"""Queries that go through stored indexes, snapshots and streams, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.operators import cells, duplicate_index, mentions, patterns, segments
from lithograph.plans import catalogue
from lithograph.sources.files import state, table
from lithograph.sources.shared import new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _halves(docs):
    """The whole table as two batches, the smaller ids first."""
    middle = docs.agg(F.expr("percentile_approx(doc_id, 0.5)").alias("m")).first()["m"]
    return docs.filter(F.col("doc_id") <= middle), docs.filter(F.col("doc_id") > middle)


@query(catalogue.ORACLES["containment_pairs"])
def incremental_pairs(spark, d):
    """All documents come into a stored index in two batches, which together find what one run over all finds."""
    root = new_path(spark, "duplicate-index")
    first, second = _halves(catalogue._texts(spark, d))
    duplicate_index.create_index(first, root)
    duplicate_index.add_documents(first, root)
    duplicate_index.add_documents(second, root)
    return duplicate_index.indexed_pairs(spark, root)


_ITEMS = catalogue._TOP3.replace("r AS (SELECT *, row_number()", "q AS (SELECT * FROM p WHERE containment >= 0.55),\nr AS (SELECT *, row_number()").replace("AS place FROM p)", "AS place FROM q)")


@query(f"WITH {_ITEMS} SELECT item_id, doc_id AS kept_id, containment FROM r WHERE place = 1")
def cached_near_duplicates(spark, d):
    """The stored document nearest to each benchmark item: of equal documents the first stands for all."""
    root = new_path(spark, "duplicate-index")
    docs = catalogue._texts(spark, d)
    duplicate_index.create_index(docs, root)
    duplicate_index.add_documents(docs, root)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return duplicate_index.look_up(items, root).withColumnRenamed("doc_id", "item_id")


_SEGMENTED: dict[tuple, str] = {}


def _segmented(spark, d) -> str:
    """An index of all documents that came in three segments, of which some were retired, came back and were merged."""
    key = (spark.sparkContext.applicationId, state(spark, f"{d}/documents.parquet"))
    if key not in _SEGMENTED:
        _SEGMENTED[key] = _build_segments(spark, d, new_path(spark, "segments"))
    return _SEGMENTED[key]


def _build_segments(spark, d, root: str) -> str:
    docs = catalogue._texts(spark, d).select("doc_id", "text")
    first, second = _halves(docs)
    left, right = _halves(second)
    for batch in (first, left, right):
        segments.add_segment(batch, root)
    changed = docs.filter("doc_id % 4 = 1")
    segments.retire(changed.select("doc_id"), root)
    segments.add_segment(changed, root)
    segments.merge_segments(spark, root)
    return root


@query(catalogue.ORACLES["bm25_topk"])
def segmented_topk(spark, d):
    return segments.search(spark, _segmented(spark, d), " ".join(catalogue.TERMS)).best


@query(catalogue.ORACLES["postings"])
def segmented_terms(spark, d):
    return segments.term_statistics(spark, _segmented(spark, d))


# --- many patterns, names that are nearly said ---------------------------------------------------


@query(r"""
WITH c AS (SELECT item_id, '(^|[^A-Za-z0-9_])' || regexp_extract(lower(text), '^[a-z]+') || '[a-z]?([^A-Za-z0-9_]|$)' AS pattern FROM benchmark WHERE regexp_matches(lower(text), '^[a-z]')),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS body FROM documents)
SELECT doc_id, item_id FROM d JOIN c ON regexp_matches(body, pattern)""")
def model_hits(spark, d):
    """A catalogue of patterns, of the first word of each item, in all texts, which are read once for all patterns."""
    items = table(spark, d, "benchmark").withColumn("word", F.regexp_extract(F.lower("text"), "^[a-z]+", 0)).filter("word <> ''")
    pattern = F.concat(F.lit("(^|[^A-Za-z0-9_])"), "word", F.lit("[a-z]?([^A-Za-z0-9_]|$)"))
    listed = items.select("item_id", pattern.alias("pattern"))
    docs = catalogue._texts(spark, d).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    return patterns.matches(docs, "body", listed, "pattern", ["doc_id"]).select("doc_id", "item_id")


@query()
def fuzzy_match(spark, d):
    """Names of parts that are nearly said by another name: every pair of different names with a token_set_ratio of 85 or more."""
    names = table(spark, d, "part").select(F.lower("p_name").alias("text")).distinct()
    asked, named = (names.select(F.col("text").alias(c), "text") for c in ("ask", "named"))
    return mentions.fuzzy_pairs(asked, named).filter("ask <> named").select("ask", "named", F.round("ratio", 6).alias("ratio"))


@query(r"""
WITH n AS (SELECT s_suppkey AS machine_id, lower(s_name) AS name FROM supplier), q AS (SELECT c_custkey AS query_id, lower(replace(c_name, 'Customer#', 'supplier#')) AS q FROM customer),
f AS (SELECT query_id, machine_id FROM q JOIN n ON regexp_matches(q, '(^|[^\p{L}\p{N}_])' || name || '($|[^\p{L}\p{N}_])'))
SELECT query_id, machine_id FROM f""")
def name_hits(spark, d):
    """Questions that say a machine's whole name."""
    machines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("machine_id"), F.col("s_name").alias("label"), F.lower("s_name").alias("name"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.regexp_replace("c_name", "Customer#", "supplier#").alias("question"))
    return mentions.exact_mentions(asked, machines).select("query_id", "machine_id")


# --- vectors in cells ----------------------------------------------------------------------------


@query(catalogue.ORACLES["vector_topk"])
def vector_cells(spark, d):
    """The nearest vectors of one, by stored cells of which only those are opened that can hold one of them."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    root = new_path(spark, "cells")
    cells.build_cells(vectors, root)
    return cells.nearest(spark, root, vectors.filter("vec_id = 0")).best.select("vec_id", "score")


@query(catalogue.ORACLES["vector_gate"])
def vector_gate_cells(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    root = new_path(spark, "cells")
    cells.build_cells(vectors, root)
    best = cells.nearest(spark, root, vectors.filter("vec_id % 50 = 0"), 5, others=True).best
    return best.groupBy("query_id").agg(F.max("score").alias("best")).withColumn("relevant", F.col("best") >= 0.4)
