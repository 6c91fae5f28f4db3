"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import fold, pieces, small_batches, table

BITS = 22  #: log2 of the number of hashed features
SIZES = (5, 8)  #: characters of an n-gram, the spaces around words among them
CHUNK = 1 << 14  #: features in a row of partial counts
FIT_TOXIC, FIT_CLEAN = 5_000_000, 10_000_000  #: expected characters of the sample that the linear model is fitted on, at most
MIN_RATIO = 2.0  #: features whose log-count ratio is nearer to 0 are left out
MIN_DOCS = 5  #: and those that fewer labelled documents have
THRESHOLD = 0.3
STEPS, RATE, PENALTY = 150, 0.05, 3e-3
BROADCAST_LABELS = 4_000_000  #: labels are broadcast up to this number of rows (16 bytes each), else joined by a shuffle

_BLANK = re.compile(r"\s+")
_SEEDS = np.cumprod(np.full(16, 0x9E3779B97F4A7C15, dtype=np.uint64)) | np.uint64(1)


def ngrams(text: str | None) -> np.ndarray:
    """Hashed n-grams of the whole text, lower-cased and with single spaces, one for each place."""
    chars = np.frombuffer((" " + _BLANK.sub(" ", (text or "").lower()).strip() + " ").encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    found = [np.empty(0, dtype=np.int64)]
    for n in SIZES:
        if (m := len(chars) - n + 1) > 0:
            h = np.full(m, n, dtype=np.uint64)
            for j in range(n):
                h += chars[j : m + j] * _SEEDS[j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros((2, 1 << BITS), dtype=np.int32), [0, 0, 0, 0]
    for batch in pieces(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic, np.unique(ngrams(text))] += 1
            docs[toxic] += 1
            docs[2 + toxic] += len(text)
    if not sum(docs):
        return
    for chunk in range((1 << BITS) // CHUNK):
        own = counts[:, chunk * CHUNK : (chunk + 1) * CHUNK]
        if len(at := np.flatnonzero(own.any(axis=0))):
            kind = np.min_scalar_type(int(own.max())).newbyteorder("<")
            yield _count_row(chunk, at.astype("<u2").tobytes(), own[:, at].astype(kind).tobytes())
    yield _count_row(-1, b"", np.array(docs, dtype="<i8").tobytes())


def _count_row(chunk: int, at: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([at], pa.binary()), pa.array([counts], pa.binary())], names=["chunk", "at", "counts"])


def _add_counts(own: pa.Table) -> pa.Table:
    chunk, rows = own.column("chunk")[0].as_py(), zip(own.column("at").to_pylist(), own.column("counts").to_pylist(), strict=True)
    if chunk < 0:
        total, at = sum(np.frombuffer(x, "<i8") for _, x in rows), b""
    else:
        total = np.zeros((2, CHUNK), dtype=np.int64)
        for places, counts in rows:
            where = np.frombuffer(places, "<u2")
            total[:, where] += np.frombuffer(counts, f"<u{len(counts) // (2 * len(where))}").reshape(2, -1)
        often = np.flatnonzero(total.sum(axis=0) >= MIN_DOCS)
        total, at = total[:, often], often.astype("<u2").tobytes()
    return pa.Table.from_batches([_count_row(chunk, at, total.astype("<i8").tobytes())])


def log_count_ratios(labelled: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Ratio of each feature over all labelled rows (text, toxic 0/1), and the characters of either class.

    Each task counts the rows that have a feature; the counts, of bounded size, are added up by chunk of features.
    """
    schema = "chunk int, at binary, counts binary"
    summed = labelled.mapInArrow(_partial_counts, schema).groupBy("chunk").applyInArrow(_add_counts, schema)
    ratio, docs, chars, found = np.zeros(1 << BITS, dtype=np.float32), [0, 0], [0, 0], []
    for row in summed.collect():  # at most 257 rows, of at most 300 KB
        if row["chunk"] < 0:
            total = np.frombuffer(row["counts"], "<i8").tolist()
            docs, chars = total[:2], total[2:]
        else:
            found.append((row["chunk"] * CHUNK + np.frombuffer(row["at"], "<u2").astype(np.int64), np.frombuffer(row["counts"], "<i8").reshape(2, -1)))
    for at, counts in found:
        rate = (counts + 0.5) / (np.array(docs)[:, None] + 1.0)
        own = np.log(rate[1] / rate[0])
        own[np.abs(own) < MIN_RATIO] = 0
        ratio[at] = own
    return ratio, chars


def _margins(weights: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[at], dtype=np.float64)))
    return total[ends[1:]] - total[ends[:-1]]


def fit_linear(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (ratio times coefficient) of the features, and the bias.

    Logistic loss on presence times ratio, over the square root of the row's features, by Adam on the whole sample.
    """
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    used, at = np.unique(at, return_inverse=True)
    at = at.astype(np.int32)
    r = ratio[used].astype(np.float64)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(ends))
    norm = 1.0 / np.sqrt(np.maximum(np.diff(ends), 1.0))
    w, bias = np.full(len(r), 0.5), float(np.log((weight * toxic).sum() + 0.5) - np.log((weight * (1 - toxic)).sum() + 0.5))
    m, v, mb, vb = np.zeros(len(r)), np.zeros(len(r)), 0.0, 0.0
    weight = weight / max(weight.sum(), 1e-9)
    for step in range(1, STEPS + 1):
        z = _margins(w * r, at, ends) * norm + bias
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - toxic) * weight
        g = np.bincount(at, weights=(error * norm)[owner], minlength=len(r)) * r + PENALTY / max(len(r), 1) * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w = w - RATE * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= RATE * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    out = np.zeros(len(ratio), dtype=np.float32)
    out[used] = w * r
    return out, float(bias)


class Model:
    """Fitted weights: used marks the features with a ratio."""

    def __init__(self, used: np.ndarray, weights: np.ndarray, bias: float):
        self.used, self.weights, self.bias = used, weights, bias

    def score(self, text: str | None) -> float:
        at = present(text, self.used)
        z = float(self.weights[at].sum(dtype=np.float64)) / max(len(at), 1) ** 0.5 + self.bias
        return 1.0 / (1.0 + float(np.exp(-min(max(z, -40.0), 40.0))))


def present(text: str | None, used: np.ndarray) -> np.ndarray:
    """The distinct features of a text among those used."""
    at = ngrams(text)
    return np.unique(at[used[at]])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents outside the held-out fold.

    Ratios are taken over all of them, coefficients over a sample that FIT_TOXIC and FIT_CLEAN bound by its
    characters, and so by its bytes, drawn by hash of the id and weighted back to the true rates. Null or other labels are ignored, null texts count as empty; a
    document with several labels counts once for each. Without labels nothing is known to be toxic: every score is
    next to 0.
    """
    with small_batches(docs.sparkSession):  # all that is fitted is collected in here
        return _train(docs, labels)


def _train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(F.col("doc_id"), 4) != 2)
    small = known.count() <= BROADCAST_LABELS
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labelled = whole.join(F.broadcast(known) if small else known, "doc_id").select("text", "toxic")
    ratio, chars = log_count_ratios(labelled)
    used = ratio != 0
    rates = [min(1.0, bound / max(n, 1)) for bound, n in zip((FIT_CLEAN, FIT_TOXIC), chars, strict=True)]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0]) * float(1 << 30)
    sample = whole.join(F.broadcast(known.filter(drawn)), "doc_id").select("text", "toxic")  # its size is bounded
    mask = spark.sparkContext.broadcast(np.packbits(used))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(mask.value, count=1 << BITS).astype(bool)
        for batch in pieces(batches):
            found = [present(t, own).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.binary())], names=["toxic", "at"])

    rows = sample.mapInArrow(features, "toxic int, at binary").collect()  # bounded by FIT_TOXIC and FIT_CLEAN
    if not rows:
        return Model(np.zeros(1 << BITS, dtype=bool), np.zeros(1 << BITS, dtype=np.float32), -40.0)
    toxic = np.array([r["toxic"] for r in rows], dtype=np.float64)
    weights, bias = fit_linear([np.frombuffer(r["at"], "<i4").astype(np.int64) for r in rows], toxic, 1.0 / np.where(toxic == 1, rates[1], rates[0]), ratio)
    return Model(weights != 0, weights, bias)


def _sparse(model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    at = np.flatnonzero(model.used)
    return at.astype(np.int32), model.weights[at], model.bias


def _dense(parts: tuple[np.ndarray, np.ndarray, float]) -> Model:
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[parts[0]] = parts[1]
    return Model(weights != 0, weights, parts[2])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text; null texts count as empty. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(_sparse(model))  # bounded by the number of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _dense(sent.value)
        for batch in pieces(batches):
            scores = pa.array([own.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold; all columns and other rows stay as they are."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(_sparse(model))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns are called
    schema = plain.schema
    plain = plain.withColumn("text", plain[docs.columns.index("text")].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _dense(sent.value)
        for batch in pieces(batches):
            clean = pa.array([own.score(t) < threshold for t in batch.column(batch.num_columns - 1).to_pylist()], pa.bool_())
            yield batch.filter(clean).select(list(range(batch.num_columns - 1)))

    return plain.mapInArrow(run, schema).toDF(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
