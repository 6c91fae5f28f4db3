"""Keyed tables that rewrite what they touch, runs under leases, listings as a data source, and history without turns that ask back."""

import pytest
from pyspark.sql import functions as F

from lithograph.operators import answers, ingest, keyed
from lithograph.sources import connector, snapshots
from lithograph.sources.files import folder


def test_changes_rewrite_their_buckets_alone(spark, tmp_path):
    root = str(tmp_path / "keyed")
    old = spark.range(3000).selectExpr("id AS k", "id % 7 AS v", "'kept' AS note")
    first = keyed.create_table(old, root, ["k"])
    assert keyed.size_of(first) == 3000
    with pytest.raises(ValueError, match="already"):
        keyed.create_table(old, root, ["k"])
    new = spark.createDataFrame([(17, 100, "other"), (40, 101, "other"), (9999, 102, "new")], "k long, v long, note string")
    second, touched = keyed.merge(new, root, ["v"])
    assert len(touched) <= 3 and {p.bucket for p in set(second.tables["rows"]) - set(first.tables["rows"])} <= set(touched)
    assert len(set(second.tables["rows"]) & set(first.tables["rows"])) == 16 - len(touched)
    want = sorted(map(tuple, ingest.merge_columns(old, new, ["k"], ["v"]).collect()))
    assert sorted(map(tuple, keyed.read_table(spark, root).collect())) == want and keyed.size_of(second) == 3001
    third, _ = keyed.remove(new.select("k"), root)
    assert keyed.size_of(third) == 2998 and keyed.read_table(spark, root).filter("k IN (17, 40, 9999)").count() == 0
    assert sorted(map(tuple, keyed.read_table(spark, root, first.version).collect())) == sorted(map(tuple, old.collect()))
    fourth, _ = keyed.merge(new, root)  # all columns
    assert keyed.read_table(spark, root).filter("note = 'other'").count() == 2 and fourth.version == 4


def test_a_killed_run_does_not_block_for_ever(spark, tmp_path):
    """A run that was killed leaves its lease behind; once that has ended another goes on, and the first one's end is refused."""
    root = str(tmp_path / "runs")
    events = spark.createDataFrame([("a", "indexed", None)], "source_ref string, event string, detail string")
    snapshots.acquire(spark, root, -1, "killed")
    assert ingest.run(spark, root, lambda: events, lambda f: f) == "completed"

    def overtaken(rows):
        assert ingest.run(spark, root, lambda: events, lambda f: f) == "completed"
        return rows

    with pytest.raises(snapshots.Conflict, match="lost its lease"):
        ingest.run(spark, root, lambda: events, overtaken, seconds=-1)
    runs = ingest.run_status(spark, root)
    assert sorted(r["status"] for r in runs.collect()) == ["completed", "completed", "running"]
    newest = ingest.newest_runs(runs, spark.read.parquet(f"{root}/events"), 2).collect()
    assert len(newest) == 2 and all(r["counts"] == {"indexed": 1} for r in newest)


def test_listing_as_a_data_source(spark, tmp_path):
    """Batch reads agree with folder(); a stream takes up what has come or changed since, and nothing twice."""
    root, out = tmp_path / "files", tmp_path / "out"
    (root / "sub").mkdir(parents=True)
    for name in ("a.pdf", "sub/b.txt", "c"):
        (root / name).write_bytes(name.encode() * 100)
    connector.register(spark)
    columns = ["source_ref", "filename", "byte_size", "sha256"]
    listed = lambda: sorted(map(tuple, spark.read.format("listing").load(str(root)).select(*columns).collect()))
    assert listed() == sorted(map(tuple, folder(spark, str(root)).select(*columns).collect())) and len(listed()) == 3

    def step():
        rows = spark.readStream.format("listing").load(str(root))
        query = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["source_ref"] for r in spark.read.parquet(str(out)).collect())

    assert step() == ["a.pdf", "c", "sub/b.txt"]
    (root / "sub" / "d").write_bytes(b"new")
    (root / "c").write_bytes(b"changed")
    assert step() == ["a.pdf", "c", "c", "sub/b.txt", "sub/d"]
    assert len(step()) == 5
    latest = spark.read.parquet(str(out)).groupBy("source_ref").agg(F.max_by("sha256", "changed").alias("sha256"))
    assert sorted(map(tuple, latest.collect())) == sorted((r[0], r[3]) for r in listed())
    (tmp_path / "none").mkdir()
    assert spark.read.format("listing").load(str(tmp_path / "none")).count() == 0


def test_history_leaves_out_turns_that_ask_back(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}", t in (3, 5)) for t in range(10)] + [(2, 1, "assistant", "alone", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, is_clarifying boolean")
    got = {(r["conv_id"], r["turn"]): (r["n_history"], r["history"]) for r in answers.history(df, 3).collect()}
    line = lambda *turns: "\n".join(f"{'user' if t % 2 == 0 else 'assistant'}: t{t}" for t in turns)
    assert got == {(1, 1): (1, line(0)), (1, 3): (3, line(0, 1, 2)), (1, 5): (3, line(1, 2, 4)), (1, 7): (3, line(2, 4, 6)), (1, 9): (3, line(6, 7, 8)), (2, 1): (0, "")}
    plain = {(r["conv_id"], r["turn"]): r["history"] for r in answers.history(df.drop("is_clarifying"), 3).collect()}
    assert plain[(1, 7)] == line(4, 5, 6)


def test_a_copy_is_found_whichever_of_several_files_holds_it(spark):
    docs = spark.createDataFrame([(1, "a", "s", "indexed", None), (2, "c", "s", "indexed", None)], "id int, source_ref string, sha256 string, status string, deactivated_at timestamp")
    listing = spark.createDataFrame([(r, "s", "ok", 1) for r in "abcd"], "source_ref string, sha256 string, extract_status string, n_chunks int")
    got = {r["source_ref"]: r["action"] for r in ingest.actions(listing, docs).collect()}
    assert got == {"a": "skipped_unchanged", "b": "duplicate", "c": "skipped_unchanged", "d": "duplicate"}
