"""What the corpus operators share: reading tables, the shared scratch folder, keys and bounds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: ASCII white space: the only characters that separate words.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for cut lineage. Only a local session, as in tests, gets one of its own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lithograph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While jobs run inside, whole texts reach Python in batches of few rows; then the session's own setting holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to few rows each, so that Python holds few texts beside the batch that Spark has sent."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(texts: list[str], size: int = 1 << 18) -> Iterator[list[str]]:
    """Consecutive runs of the texts of about size characters."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for each application, which may be cleared when that has ended."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: lost executors then cost no recomputation upstream."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() has written and that no result still to be computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in any case of letters."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's. It goes to Spark as Arrow: from plain rows Spark makes an RDD of Python's, for which each executor keeps a second set of workers."""
    kinds = StructType.fromDDL(schema)
    columns = [pa.array([row[i] for row in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kinds)]
    return spark.createDataFrame(pa.table(columns, names=kinds.names), kinds)


def spread_keys(big: DataFrame, on: str, share: int = 4, least: int = 200) -> list[tuple]:
    """(value, parts) of the values of a column that a count shows to fill over 1 / (share * partitions) of the rows: share * partitions at most."""
    limit = max(least, big.count() // (share * int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = big.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > limit) & F.col(on).isNotNull())
    return [(r[on], -(-r["n"] // limit)) for r in counts.collect()]


def spread_join(big: DataFrame, small: DataFrame, on: str, by: str, hot: list[tuple]) -> DataFrame:
    """big joined with small, which has a row for each value of `on`; rows of hot values (of spread_keys) are dealt by `by`.

    small repeats the row of a hot value for each of its parts.
    """
    if not hot:
        return big.join(small, on)
    parts, part = unused("parts", big, small), unused("part", big, small)
    kind = big.schema[on].dataType.simpleString()
    listed = F.broadcast(local_table(big.sparkSession, hot, f"`{on}` {kind}, {parts} int"))  # bounded by the number of partitions
    dealt = big.join(listed, on, "left").withColumn(part, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1))).cast("int"))
    copied = small.join(listed, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
    return dealt.drop(parts).join(copied.drop(parts), [on, part]).drop(part)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's variable is bound, not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- hashing of whole blocks of text, vectorised -------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 16


def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _table(_BASE, _STEP), _table(_INVERSE, _STEP)
#: Powers of 2^16 each: enough for blocks of 4 GB.
_UP_FAR, _DOWN_FAR = _table(pow(_BASE, _STEP, 1 << 64), _STEP), _table(pow(_INVERSE, _STEP, 1 << 64), _STEP)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads the entropy of every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero, modulo 2^64."""
    out = np.empty(len(x) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(x, dtype=np.uint64, out=out[1:])
    return out


def ranges_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) from prefix sums of value times power; position-independent."""
    back = _DOWN[start & (_STEP - 1)] * _DOWN_FAR[start >> 16]
    return mix64((prefix[end] - prefix[start]) * back + (end - start).astype(np.uint64))


def powered(values: np.ndarray, plus: int = 0) -> np.ndarray:
    """Prefix sums, a leading zero among them, of (value + plus) times its place's power, modulo 2^64."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    for at in range(0, len(values), _STEP):
        own = values[at : at + _STEP].astype(np.uint64) + np.uint64(plus)
        own *= _UP[: len(own)]
        own *= _UP_FAR[at >> 16]
        np.cumsum(own, out=out[at + 1 : at + 1 + len(own)])
        out[at + 1 : at + 1 + len(own)] += out[at]
    return out


def ngram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; empty when there are fewer."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    start = np.arange(len(hashes) - n + 1)
    return ranges_hash(powered(hashes), start, start + n)


class Words:
    """Words of a block of byte strings laid end to end, with a space after each: bounds, hashes and the document of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        """raw: bytes of all documents, each followed by one space; offsets: the start of each document, and the end of the last."""
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        inside = np.concatenate(([False], ~blank, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.raw = raw
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        return ranges_hash(powered(self.raw, 1), self.start, self.end)


def block(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts laid end to end, a space after each, and their offsets."""
    parts = [(v or "").encode("utf-8", "surrogatepass") for v in values]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:]) if parts else None
    return np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8), offsets
