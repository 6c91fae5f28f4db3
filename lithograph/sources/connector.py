"""Folders as a data source of Spark's: `spark.read.format("listing")`, and the same as a stream of what changes."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_ref string, filename string, byte_size long, changed long, sha256 string"
BLOCK = 1 << 20


def _row(root: str, ref: str) -> tuple:
    path = os.path.join(root, ref)
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(BLOCK):
            digest.update(part)
    found = os.stat(path)
    return ref, os.path.basename(ref), found.st_size, found.st_ctime_ns, digest.hexdigest()


class Files(InputPartition):
    """References below the root that one task reads."""

    def __init__(self, refs: list[str]):
        super().__init__(refs)
        self.refs = refs


def _listed(root: str) -> list[tuple[int, str]]:
    """(time of the last change, reference) of each file below the root; a file that comes or is moved in changes then."""
    out = []
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            out.append((os.stat(path).st_ctime_ns, os.path.relpath(path, root)))
    return sorted(out)


def _dealt(refs: list[str], tasks: int) -> list[Files]:
    return [Files(refs[k::tasks]) for k in range(min(tasks, len(refs)))]


class ListingReader(DataSourceReader):
    """All files, dealt to `tasks` tasks that hash them."""

    def __init__(self, options: dict):
        self.root, self.tasks = options["path"], int(options.get("tasks", 8))

    def partitions(self) -> list[Files]:
        return _dealt([ref for _, ref in _listed(self.root)], self.tasks)

    def read(self, partition: Files) -> Iterator[tuple]:
        for ref in partition.refs if partition else []:
            yield _row(self.root, ref)


class ListingStreamReader(DataSourceStreamReader):
    """Files that were added or changed; an offset is the last change that has been read, with the reference that had it."""

    def __init__(self, options: dict):
        self.root, self.tasks = options["path"], int(options.get("tasks", 8))

    def initialOffset(self) -> dict:
        return {"changed": 0, "ref": ""}

    def latestOffset(self) -> dict:
        listed = _listed(self.root)
        return {"changed": listed[-1][0], "ref": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["changed"], start["ref"]), (end["changed"], end["ref"])
        return _dealt([ref for changed, ref in _listed(self.root) if low < (changed, ref) <= high], self.tasks)

    def read(self, partition: Files) -> Iterator[tuple]:
        for ref in partition.refs:
            yield _row(self.root, ref)

    def commit(self, end: dict) -> None:
        """Nothing is held back: files stay where they are."""


class Listing(DataSource):
    """Files below `path`, a folder that all workers mount: (source_ref, filename, byte_size, changed, sha256)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> ListingStreamReader:
        return ListingStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format `listing` known to the session; other connectors are classes of their own, registered likewise."""
    spark.dataSource.register(Listing)
