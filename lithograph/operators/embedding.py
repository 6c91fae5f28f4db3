"""Vectors of texts by an embedder that can be exchanged; the one here needs no model and no network."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64
# Fixed value: what stands before a question, but not before a text, for models that want it.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A unit vector for each text: its words hashed to signed places; texts without words have the zero vector."""
    out = np.zeros((len(texts), dim), dtype=np.float64)
    for row, text in zip(out, texts, strict=True):
        codes = np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"[^\W_]+", text.lower())], dtype=np.int64)
        np.add.at(row, codes % dim, np.where(codes >> 16 & 1, 1.0, -1.0))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def embed(rows: DataFrame, key: str, embedder: Embedder = hashed) -> DataFrame:
    """(key, embedding) of rows (key, text); null texts count as empty. Batches go to the embedder inside tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": list(embedder(pdf["text"].fillna("").tolist()))})

    own = rows.select(key, F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def embed_question(question: str, embedder: Embedder = hashed, prefix: str = "") -> list[float]:
    return [float(x) for x in embedder([prefix + question])[0]]


def embed_pending(rows: DataFrame, embeddings: DataFrame, key: str, embedder: Embedder = hashed) -> DataFrame:
    """Vectors of the rows that embeddings (key, …) lacks."""
    return embed(rows.join(embeddings.select(key).distinct(), key, "left_anti"), key, embedder)
