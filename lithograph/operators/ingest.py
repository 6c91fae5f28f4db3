"""Incremental ingestion: what to do with each listed file, and keyed writes over Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.sources import snapshots
from lithograph.sources.shared import saved


def eligible(documents: DataFrame, links: DataFrame | None = None, machine_id: int | None = None, include_superseded: bool = False) -> DataFrame:
    """Documents (id, …) that may be retrieved: indexed, active, approved and, unless superseded ones are asked for, of the current revision.

    With a machine only those that an approved link (document_id, machine_id, review_status) ties to it.
    """
    rows = documents.filter("status IN ('indexed', 'partial') AND deactivated_at IS NULL AND review_status = 'approved'")
    rows = rows if include_superseded else rows.filter("is_current_revision")
    if machine_id is None:
        return rows
    own = links.filter((F.col("machine_id") == machine_id) & (F.col("review_status") == "approved")).select(F.col("document_id").alias("id"))
    return rows.join(own, "id", "left_semi")


def actions(listing: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_ref, sha256, action, previous_id): what a run does with each listed file.

    listing: (source_ref, sha256, extract_status, n_chunks); documents: (id, source_ref, sha256, status,
    deactivated_at). A file that cannot be used does not retire the version before it, and neither does one without
    chunks. Of equal contents in one listing the first by source_ref is indexed.
    """
    active = documents.filter("deactivated_at IS NULL").select(F.col("id").alias("previous_id"), "source_ref", F.col("sha256").alias("old_sha"), F.col("status").alias("old_status"))
    elsewhere = documents.filter("deactivated_at IS NULL AND status IN ('indexed', 'partial')").groupBy("sha256").agg(F.min("source_ref").alias("first_ref"), F.max("source_ref").alias("last_ref"))
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("source_ref"))
    rows = listing.withColumn("place", first).join(active, "source_ref", "left").join(elsewhere, "sha256", "left")
    same = F.col("old_sha") == F.col("sha256")
    usable = F.col("extract_status").isin("ok", "partial")
    action = (
        F.when(same & F.col("old_status").isin("indexed", "partial", "duplicate"), "skipped_unchanged")
        .when(~usable & same, "retried")
        .when(~usable & F.col("previous_id").isNotNull(), "kept_previous")
        .when(~usable, F.col("extract_status"))
        .when((F.col("first_ref") != F.col("source_ref")) | (F.col("last_ref") != F.col("source_ref")) | (F.col("place") > 1), "duplicate")
        .when((F.col("n_chunks") == 0) & F.col("previous_id").isNotNull() & ~same, "kept_previous")
        .when(F.col("n_chunks") == 0, "failed")
        .when(F.col("previous_id").isNotNull() & ~same, "replaced")
        .when(F.col("extract_status") == "partial", "partial")
        .otherwise("indexed")
    )
    return rows.select("source_ref", "sha256", action.alias("action"), "previous_id")


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and the rows of new whose key it lacks."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of existing with their key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def append_note(column: Column, note: Column) -> Column:
    """The note after what is there already, ' | ' between; null with a null note."""
    return F.concat(F.coalesce(F.concat(column, F.lit(" | ")), F.lit("")), note)


def with_new_keys(existing: DataFrame, new: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """existing and a row for each key of new that it lacks, numbered after its largest id; other columns are null."""
    top = existing.agg(F.coalesce(F.max(id_), F.lit(0)).alias("top")).first()["top"]
    missing = new.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    # Written once, so that a number that was given stays given however often the result is computed.
    numbered = saved(missing.withColumn(id_, F.monotonically_increasing_id() + F.lit(top + 1)), "new-keys")
    return existing.unionByName(numbered, allowMissingColumns=True)


def merge_columns(existing: DataFrame, new: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """New keys are inserted as they are; of known ones the columns of `take` change, the others stay."""
    own = existing.withColumn("__old", F.lit(True)).alias("o")
    rows = own.join(new.alias("n"), keys, "full")
    n = lambda c: F.col(f"n.{c}") if c in new.columns else F.lit(None)
    value = lambda c: F.coalesce(n(c), F.col(f"o.{c}")) if c in take else F.when(F.col("__old"), F.col(f"o.{c}")).otherwise(n(c))
    return rows.select(*keys, *[value(c).alias(c) for c in existing.columns if c not in keys]).select(*existing.columns)


def update(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """rows with new values in those that `where` holds for."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def new_copies(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(storage_path, content): files (filename, sha256, content) by content, those left out that stored (storage_path) has."""
    path = F.concat(F.substring("sha256", 1, 16), F.regexp_extract(F.lower("filename"), r"(\.[^./]+)$", 1))
    return files.select(path.alias("storage_path"), "content").dropDuplicates(["storage_path"]).join(stored, "storage_path", "left_anti")


def grandfathered(documents: DataFrame) -> DataFrame:
    """Documents from before there were reviews count as approved; those that were deactivated stay as they are."""
    return update(documents, F.col("review_status").isNull() & F.col("deactivated_at").isNull(), review_status=F.lit("approved"))


def with_ordinals(sources: DataFrame) -> DataFrame:
    """Citations from before they had an ordinal take their rank."""
    return update(sources, F.col("is_citation") & F.col("citation_ordinal").isNull(), citation_ordinal=F.col("rank"))


# --- runs ----------------------------------------------------------------------------------------

RUN = "run_id string, status string, at timestamp"
EVENT = "run_id string, source_ref string, event string, detail string"
LEASE_SECONDS = 6 * 3600  #: after which a run counts as dead


def _append(spark: SparkSession, root: str, name: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def run(spark: SparkSession, root: str, list_files: Callable[[], DataFrame], handle: Callable[[DataFrame], DataFrame], seconds: float = LEASE_SECONDS) -> str:
    """One ingestion run, recorded below root: its row first, then its events; returns how it ended.

    list_files gives the listing; handle turns it into events (source_ref, event, detail), a failed file being an
    event of its own. A run that cannot list its files, or breaks off, is recorded as failed and raises. A run holds
    a lease on root: a second one beside it is refused, and one that was killed blocks others until the lease has ended.
    A run whose lease has been taken over meanwhile records no end, and raises.
    """
    root = root.rstrip("/")
    run_id, now = uuid.uuid4().hex, lambda: datetime.now(UTC).replace(tzinfo=None)
    try:
        fence = snapshots.acquire(spark, root, seconds, run_id)
    except snapshots.Conflict as e:
        raise RuntimeError(f"an ingestion run is already in progress: {e}") from None
    try:
        _append(spark, root, "runs", [(run_id, "running", now())], RUN)
        try:
            events = handle(list_files())
            own = events.select(F.lit(run_id).alias("run_id"), "source_ref", "event", "detail")
            own.write.mode("append").parquet(f"{root}/events")
            failed = spark.read.parquet(f"{root}/events").filter((F.col("run_id") == run_id) & (F.col("event") == "failed")).limit(1).count()
        except Exception as e:
            _append(spark, root, "events", [(run_id, "(run)", "failed", f"run aborted: {e}"[:500])], EVENT)
            _append(spark, root, "runs", [(run_id, "failed", now())], RUN)
            raise
        if not snapshots.holds(spark, root, fence):
            raise snapshots.Conflict(f"run {run_id} has lost its lease")
        status = "completed_with_errors" if failed else "completed"
        _append(spark, root, "runs", [(run_id, status, now())], RUN)
        return status
    finally:
        snapshots.release_lease(spark, root, fence)


def run_status(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, status, started_at, finished_at) of each run: its last status."""
    rows = spark.read.schema(RUN).parquet(f"{root.rstrip('/')}/runs")
    finished = F.max(F.when(F.col("status") != "running", F.col("at")))
    return rows.groupBy("run_id").agg(F.max_by("status", F.struct(F.col("status") != "running", "at")).alias("status"), F.min("at").alias("started_at"), finished.alias("finished_at"))


def newest_runs(runs: DataFrame, events: DataFrame, limit: int = 10) -> DataFrame:
    """(run_id, started_at, finished_at, status, counts): the last runs, each with how often each event happened."""
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
    counted = event_map(events.join(F.broadcast(last.select("run_id")), "run_id", "left_semi"), "run_id", "event")  # `limit` rows
    return last.join(counted, "run_id", "left").select("run_id", "started_at", "finished_at", "status", "counts")


def event_map(events: DataFrame, key: str, event: str) -> DataFrame:
    """(key, counts): how often each event happened, as a map."""
    counted = events.groupBy(key, event).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(event, "n")))).alias("counts"))


def publish(df: DataFrame, root: str, run: str) -> str:
    """Writes a run's table to its own folder, then names it as current by a row with the next number.

    Names are appended, never replaced: a reader finds the one before until the new one is there.
    """
    root = root.rstrip("/")
    path = f"{root}/run={run}"
    df.write.mode("errorifexists").parquet(path)
    before = _names(df.sparkSession, root)
    number = 1 if before is None else before.agg(F.max("number").alias("n")).first()["n"] + 1
    df.sparkSession.createDataFrame([(number, path)], NAMES).coalesce(1).write.mode("append").parquet(f"{root}/_published")
    return path


NAMES = "number long, path string"


def _names(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_published")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(NAMES).parquet(f"{root}/_published") if there else None


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table that was published last."""
    return spark.read.parquet(_names(spark, root.rstrip("/")).orderBy(F.desc("number")).first()["path"])
