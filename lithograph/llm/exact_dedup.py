"""Exact deduplication by content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import SPACE, materialize, table

#: Characters of the text that the splitters compare before its hash; the splitters, unlike the texts, are then of bounded size.
SPLITTER_CHARS = 64
#: A text that over 1 / (SHARE * partitions) of the rows have, and LEAST_HOT rows at least, is spread over several runs.
SHARE, LEAST_HOT = 2, 100
RUN = ["head", "hash", "part", "run"]


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _content_sort(docs: DataFrame, n: int, carry: bool) -> DataFrame:
    """id, digest, keep_id, group_size, kept of every row, and with carry the row itself as a struct `row`."""
    norm = _normalised(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else norm.alias("norm"),
        F.substring(norm, 1, SPLITTER_CHARS).alias("head"),
        F.xxhash64(norm).alias("hash"),
    )
    # Texts with more rows than a task should hold, SHARE * n of them at most, are sorted in several runs.
    limit = max(LEAST_HOT, docs.count() // (SHARE * n))
    hot = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit).collect()
    part = F.lit(0).cast("long")
    if hot:
        parts = F.create_map(*[F.lit(x) for r in hot for x in (r["hash"], -(-r["rows"] // limit))])[F.col("hash")]
        spread = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("id"))
        part = F.when(parts.isNull(), part).otherwise(1 + F.pmod(spread, parts))
    # A constant part would stay among the range's keys and go from the windows': these would then not agree, and cost a shuffle.
    keys = ["head", "hash", "part"] if hot else ["head", "hash"]
    dealt = rows.withColumn("part", part).repartitionByRange(n, *keys)
    if carry:
        dealt = dealt.withColumn("norm", _normalised(F.col("row.text")))

    # Neighbours in content order are compared in full: a run ends where the text does.
    order = Window.partitionBy(*keys).orderBy("norm", F.col("id").asc_nulls_first())
    ends = dealt.withColumn("ends", F.coalesce(F.col("norm") != F.lag("norm").over(order), F.lit(False)).cast("long"))
    runs = ends.withColumn("run", F.sum("ends").over(order))
    run = [*keys, "run"]
    inside = Window.partitionBy(*run).orderBy("norm", F.col("id").asc_nulls_first())
    runs = runs.select(
        "id", *(["row"] if carry else []), *RUN, F.sha2("norm", 256).alias("digest"),
        F.row_number().over(inside).alias("place"),
        F.first("id").over(inside).alias("keep_id"),
        F.count(F.lit(1)).over(Window.partitionBy(*run)).alias("group_size"),
        "norm",
    )
    whole = runs.withColumn("kept", F.col("place") == 1)
    out = ["id", "digest", "keep_id", "group_size", "kept", *(["row"] if carry else [])]
    if not hot:
        return whole.select(*out)

    # The runs of one spread text are merged by that text: one row for each.
    runs = materialize(runs.withColumn("norm", F.when((F.col("part") > 0) & (F.col("place") == 1), F.col("norm"))), "exact-runs")
    heads = runs.filter("norm IS NOT NULL")
    least = F.struct(F.col("keep_id"), F.col("part"))
    merged = heads.groupBy("norm").agg(F.min(least).alias("least"), F.sum("group_size").alias("total"))
    named = heads.select("norm", *RUN).join(merged, "norm").select(*RUN, "least", "total")
    spread = runs.filter("part > 0").drop("keep_id").join(named, RUN)
    spread = spread.select(
        "id", "digest", F.col("least.keep_id").alias("keep_id"), F.col("total").alias("group_size"),
        ((F.col("place") == 1) & (F.col("part") == F.col("least.part"))).alias("kept"), *(["row"] if carry else []),
    )
    alone = runs.filter("part = 0").withColumn("kept", F.col("place") == 1).select(*out)
    return alone.unionByName(spread)


def exact_groups(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Texts are equal when identical after each run of ASCII white space is one space. Sampled splitters range-partition
    the rows by the first characters of the normalised text, and its hash where these agree; each partition is sorted
    (spilling to disk as needed) by that and by the whole text, so that equal texts are neighbours, and neighbours are
    compared in full to find where a run of equal texts ends. The smallest id of a run stays. Texts that a count shows
    to fill more than a share of a partition are sorted in several runs, dealt by id; the heads of these runs are then
    grouped by their whole text.

    Null texts count as empty; empty texts are equal to each other. Of rows with one doc_id and equal texts all
    but one are dropped (kept is false for them). Null ids sort first and are kept as null. An empty table gives
    an empty result. Other columns are ignored.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = _content_sort(docs.select("doc_id", "text"), n, carry=False)
    return sorted_.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of docs whose text no row with a smaller doc_id has; all columns, whatever their names, stay as they are.

    Whole rows go through the sort of exact_groups. Rows that share both doc_id and text are told apart by nothing
    that counts, so one of them stays. Null texts count as empty. Rows with a null doc_id are compared like those of
    the smallest id.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _content_sort(docs, n, carry=True).filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         min(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS place
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM g
"""
}
