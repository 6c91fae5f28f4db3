"""Exact vector search over stored cells: the triangle inequality says which cells a query need not open."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.operators.search import POOL
from lithograph.sources import snapshots
from lithograph.sources.shared import release, saved

VECTORS_OF_CELL, MOST_CELLS = 2000, 4096  #: vectors that a cell should hold, and cells, whose centres go to every task
PART = 4096  #: vectors of a cell that meet queries in one group; a larger cell has several parts
SLACK = 2e-6  #: scores are rounded to six places, and single precision leaves a little
STORED = "vec_id long, embedding array<float>, part int"
CELLS = "cell int, centre array<double>, n long, radius double"


class Found(NamedTuple):
    best: DataFrame  #: (query_id, vec_id, score)
    cells: int  #: pairs of a query and a cell that hold vectors
    opened: int  #: of these, the ones that were looked into


def build_cells(vectors: DataFrame, root: str) -> snapshots.Snapshot:
    """Stores vectors (vec_id, embedding) by the nearest of some of them, chosen by a hash; each cell has its radius.

    Vectors with nulls or of another length than most are not for this index: all have one length.
    """
    spark = vectors.sparkSession
    base = snapshots.open_snapshot(spark, root)
    if base.version:
        raise ValueError(f"{root} holds vectors already")
    n = vectors.count()
    k = max(1, min(MOST_CELLS, n // VECTORS_OF_CELL + 1, int(n**0.5) + 1))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).select("embedding").collect()  # k rows
    centres = np.array([r["embedding"] for r in chosen] or [[0.0]], dtype=np.float64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own = np.stack(pdf["embedding"].to_list()).astype(np.float64)
                apart = (own**2).sum(1)[:, None] - 2 * own @ centres.T + (centres**2).sum(1)[None]
                cell = apart.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), distance=np.sqrt(((own - centres[cell]) ** 2).sum(1)))

    told = saved(vectors.select("vec_id", "embedding").mapInPandas(assign, "vec_id long, embedding array<float>, cell int, distance double"), "vector-cells")
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in told.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()}  # k rows
    listed = spark.createDataFrame([(c, centres[c].tolist(), m, radius) for c, (m, radius) in sizes.items()], CELLS)
    parts = F.create_map(*[F.lit(x) for c, (m, _) in sizes.items() for x in (c, -(-m // PART))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = told.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce(parts[F.col("cell")], F.lit(1))).cast("int")).withColumnRenamed("cell", snapshots.BUCKET)
    written = dealt.select("vec_id", "embedding", "part", snapshots.BUCKET).repartition(snapshots.BUCKET, "part")
    tables = {"vectors": snapshots.write_buckets(written, base.root, "vectors"), "cells": snapshots.write_part(listed, base.root, "cells")}
    schemas = {"vectors": snapshots.schema_of(spark.createDataFrame([], STORED)), "cells": snapshots.schema_of(listed)}
    made = snapshots.commit(spark, base, tables, schemas)
    release(told)
    return made


def _opened(queries: DataFrame, cells: list, first: bool) -> DataFrame:
    """(query_id, embedding, cell) for the cells that may hold one of a query's best: with `first` those of the highest bound alone.

    queries: (query_id, embedding, least): what the score must reach. No vector of a cell has a higher product with the
    query than its centre has, and the query's norm times the radius.
    """
    number, counts = np.array([c["cell"] for c in cells], dtype=np.int32), np.array([c["n"] for c in cells])
    centres, radius = np.array([c["centre"] for c in cells]), np.array([c["radius"] for c in cells])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            own = np.stack(pdf["embedding"].to_list()).astype(np.float64)
            bound = own @ centres.T + np.linalg.norm(own, axis=1)[:, None] * radius[None] + SLACK
            if first:
                # As many cells of the highest bounds as hold the vectors that are wanted, the query's own aside.
                order = np.argsort(-bound, axis=1)
                before = np.cumsum(counts[order], axis=1) - counts[order]
                take = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(take, order, before <= pdf["wanted"].to_numpy()[:, None], axis=1)
            else:
                take = bound >= pdf["least"].to_numpy()[:, None]
            i, j = np.nonzero(take)
            yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[i], "embedding": pdf["embedding"].to_numpy()[i], "cell": number[j]})

    return queries.mapInPandas(run, "query_id long, embedding array<float>, cell int")


def nearest(spark: SparkSession, root: str, queries: DataFrame, k: int = POOL, others: bool = False) -> Found:
    """The k vectors of largest product with each query (vec_id, embedding), as a full scan gives them; others: but for the one of its own id.

    First each query opens the cells of the highest bounds that hold k vectors; the k-th score found there is what a
    cell's bound must reach to be opened too. Queries meet the vectors of a part of a cell in one group.
    """
    base = snapshots.open_snapshot(spark, root)
    cells = snapshots.rows(spark, base, "cells").collect()  # MOST_CELLS at most
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", F.lit(float("-inf")).alias("least"), F.lit(k + int(others)).alias("wanted"))
    none = spark.createDataFrame([], "query_id long, vec_id long, score double")
    if not cells:
        return Found(none, 0, 0)
    parts = spark.createDataFrame([(c["cell"], p) for c in cells for p in range(-(-c["n"] // PART))], "cell int, part int")
    vectors = _stored(spark, base)

    def meet(held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(own):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        held = held.sort_values("vec_id")
        ids, wanted = held["vec_id"].to_numpy(), own["query_id"].to_numpy()
        v, q = (np.stack(x["embedding"].to_list()).astype(np.float64) for x in (held, own))
        score = np.round(q @ v.T, 6)
        if others:
            score[wanted[:, None] == ids[None]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(wanted, best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})
        return out[np.isfinite(out["score"])]

    def scored(opened: DataFrame) -> DataFrame:
        to = opened.join(F.broadcast(parts), "cell").select("query_id", F.col("embedding").alias("embedding"), F.col("cell").alias("cell"), F.col("part").alias("part"))
        met = vectors.groupBy("cell", "part").cogroup(to.groupBy("cell", "part")).applyInPandas(meet, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return met.withColumn("place", rank).filter(F.col("place") <= k).drop("place")

    top = saved(scored(_opened(asked, cells, True)), "cells-first")
    least = top.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    again = asked.drop("least").join(least, "query_id", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
    opened = saved(_opened(again, cells, False), "cells-opened")
    return Found(scored(opened), asked.count() * len(cells), opened.count())


def _stored(spark: SparkSession, base: snapshots.Snapshot) -> DataFrame:
    """All vectors with their cell, which is the name of the folder that they lie in."""
    if not base.tables["vectors"]:
        return spark.createDataFrame([], f"{STORED}, cell int")
    rows = snapshots.rows(spark, base, "vectors")
    return rows.withColumn("cell", F.regexp_extract(F.input_file_name(), rf"{snapshots.BUCKET}=(\d+)/", 1).cast("int"))
