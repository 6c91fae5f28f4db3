"""Sources: folders of files, ground truth, and tables."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.operators.metadata import resolved_type, type_note

CASES = (
    "cases array<struct<id:string,category:string,machine:string,question:string,expected_filename_contains:string,"
    "expected_keywords:array<string>,must_not_come_from:array<string>,expect_no_answer:boolean,expect_clarifying_question:boolean>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, path: str) -> str:
    """A text that changes when files below the path come, go or are written anew."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, listed = [], own.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(own, True)
    while listed.hasNext():
        s = listed.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sha256(repr(sorted(found)).encode()).hexdigest()


def folder(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(source_ref, filename, byte_size, modified, sha256, file_type, note, content) of all files under root.

    source_ref is relative to root, so that a moved folder keeps its references. Files are listed and read by Spark,
    from any store that it reaches; columns that are not used, content too, are not carried further.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    ref = F.regexp_replace("path", r"^[a-zA-Z0-9]+:/*", "/")
    ref = F.when(ref.startswith(base), F.substring(ref, F.lit(len(base) + 1), F.length(ref))).otherwise(ref)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        ref.alias("source_ref"), name.alias("filename"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("sha256"), resolved_type(name, F.col("content")).alias("file_type"), type_note(name, F.col("content")).alias("note"), "content",
    )


def safe_name(name):
    """A file name with everything but letters, digits, dots, marks and lines as underscores (a column)."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file, one row each."""
    return spark.read.schema(CASES).option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*")


def listing_audit(listing: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_ref, finding): missing, mismatch, renamed or ok for each document that is active."""
    own = documents.filter("deactivated_at IS NULL").select("source_ref", F.col("sha256").alias("own_sha"), F.col("filename").alias("own_name"))
    seen = listing.select("source_ref", "sha256", "filename", F.lit(True).alias("seen"))
    finding = F.when(F.col("seen").isNull(), "missing").when(F.col("sha256") != F.col("own_sha"), "mismatch").when(F.col("filename") != F.col("own_name"), "renamed").otherwise("ok")
    return own.join(seen, "source_ref", "left").select("source_ref", finding.alias("finding"))
