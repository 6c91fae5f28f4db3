"""A keyed table in buckets: a change reads and rewrites the buckets of its keys, the others stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.operators.ingest import merge_columns
from lithograph.sources import snapshots
from lithograph.sources.snapshots import BUCKET, Part, Snapshot, spread_buckets

ROWS_OF_BUCKET = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 65_536
TABLE = "rows"


def _written(df: DataFrame, base: Snapshot, keys: list[str], n: int) -> list[Part]:
    """The parts of rows with unique keys, each labelled with its number of rows."""
    dealt = spread_buckets(df, F.struct(*keys), n).sortWithinPartitions(BUCKET, *keys)
    parts = snapshots.write_buckets(dealt, base.root, TABLE)
    own = base._replace(tables={TABLE: parts}, schemas=base.schemas | {TABLE: snapshots.schema_of(df)})
    spark = df.sparkSession
    counted = snapshots.rows(spark, own, TABLE).groupBy(F.pmod(F.xxhash64(F.struct(*keys)), F.lit(n)).cast("int").alias(BUCKET)).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r[BUCKET]: r["n"] for r in counted.collect()}  # a row a bucket
    return [p._replace(label=str(sizes.get(p.bucket, 0))) for p in parts]


def create_table(df: DataFrame, root: str, keys: list[str]) -> Snapshot:
    """A new table of rows with unique keys; how many buckets it has follows from its rows."""
    spark = df.sparkSession
    base = snapshots.open_snapshot(spark, root)
    if base.version:
        raise ValueError(f"{root} holds a table already")
    n = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-df.count() // ROWS_OF_BUCKET)))
    return snapshots.commit(spark, base, {TABLE: _written(df, base, keys, n)}, {TABLE: snapshots.schema_of(df)}, {"keys": keys, "buckets": n})


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return snapshots.rows(spark, snapshots.open_snapshot(spark, root, version), TABLE)


def size_of(snapshot: Snapshot) -> int:
    """How many rows a version has, from what its parts are labelled with: nothing is read."""
    return sum(int(p.label) for p in snapshot.tables[TABLE])


def _changed(new: DataFrame, root: str, change, fence: int | None) -> tuple[Snapshot, list[int]]:
    """A version in which the buckets of new's keys hold change(what they held, keys); that, and these buckets."""
    spark = new.sparkSession
    base = snapshots.open_snapshot(spark, root)
    keys, n = base.facts["keys"], base.facts["buckets"]
    touched = [r[0] for r in new.select(F.pmod(F.xxhash64(F.struct(*keys)), F.lit(n)).cast("int")).distinct().collect()]  # n at most
    rows = change(snapshots.rows(spark, base, TABLE, touched), keys)
    parts = [p for p in base.tables[TABLE] if p.bucket not in set(touched)] + _written(rows, base, keys, n)
    return snapshots.commit(spark, base, {TABLE: parts}, fence=fence), touched


def merge(new: DataFrame, root: str, take: list[str] | None = None, fence: int | None = None) -> tuple[Snapshot, list[int]]:
    """Inserts rows with new keys and changes the columns `take` (all, if none are named) of known ones; new has each key once."""
    columns = take if take is not None else [c for c in new.columns if c not in snapshots.open_snapshot(new.sparkSession, root).facts["keys"]]
    return _changed(new, root, lambda old, keys: merge_columns(old, new, keys, columns), fence)


def remove(keys: DataFrame, root: str, fence: int | None = None) -> tuple[Snapshot, list[int]]:
    """Takes the rows with these keys out."""
    return _changed(keys, root, lambda old, names: old.join(keys.select(*names).distinct(), names, "left_anti"), fence)
