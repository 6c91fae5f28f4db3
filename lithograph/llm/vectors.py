"""What the operators on embeddings share: which vectors count, and their components as whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Whole components beyond it count as this bound (x beyond 524,288): sums of squares of 64 of them still fit a long.
LIMIT = 1 << 27
#: Below it, sums of 64 products are exact in double precision too.
EXACT = 1 << 22


def finite(embedding: Column) -> Column:
    """Whether no component is null, NaN or infinite; false for a null vector."""
    return F.coalesce(F.forall(embedding.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(rows: DataFrame) -> DataFrame:
    """rows with q instead of embedding: floor(SCALE * x) of each component as little-endian 32-bit integers, end to end."""
    names = [c for c in rows.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("embedding")
            whole = np.floor(np.clip(np.asarray(own.flatten(), dtype=np.float64) * SCALE, -LIMIT, LIMIT)).astype("<i4")
            ends = np.zeros(len(own) + 1, dtype=np.int32)
            np.cumsum(np.asarray(pc.list_value_length(own), dtype=np.int32) * 4, out=ends[1:])
            q = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), q], names=[*names, "q"])

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"{kinds}, q binary")


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors of a column of q as rows of `size` numbers, shorter ones with zeros at the end."""
    values = [np.frombuffer(v, "<i4") for v in column.to_pylist()]
    if all(len(v) == size for v in values):
        return np.concatenate(values).reshape(-1, size) if values else np.zeros((0, size), dtype="<i4")
    out = np.zeros((len(values), size), dtype="<i4")
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = v
    return out


def wide(*parts: np.ndarray) -> list[np.ndarray]:
    """The matrices as doubles where their products are exact in them, else as 64-bit integers."""
    kind = np.float64 if all(p.shape[-1] <= 64 and (not p.size or np.abs(p).max() < EXACT) for p in parts) else np.int64
    return [p.astype(kind) for p in parts]
