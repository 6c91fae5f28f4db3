"""Vectors in cells: the same as a full scan, and cells that cannot matter stay shut."""

import numpy as np
import pytest

from lithograph.operators import cells, search


def frame(spark, own):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(own)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("others", [False, True])
def test_cells_agree_with_a_scan(spark, tmp_path, monkeypatch, others):
    """Vectors in clumps, one of a third of all, copies with equal scores, several parts of a cell; few cells are opened."""
    monkeypatch.setattr(cells, "VECTORS_OF_CELL", 8)
    monkeypatch.setattr(cells, "PART", 50)
    rng = np.random.default_rng(4)
    clumps = rng.standard_normal((20, 16))
    own = clumps[np.concatenate([np.zeros(200, int), rng.integers(20, size=400)])] + 0.02 * rng.standard_normal((600, 16))
    own[300:310] = own[300]
    vectors = frame(spark, (own / np.linalg.norm(own, axis=1)[:, None]).astype(np.float32))
    root = str(tmp_path / "cells")
    cells.build_cells(vectors, root)
    with pytest.raises(ValueError, match="already"):
        cells.build_cells(vectors, root)
    asked = vectors.filter("vec_id % 50 = 0")
    found = cells.nearest(spark, root, asked, 7, others)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in found.best.collect()}
    if others:
        want = {(r["query_id"], r["vec_id"]): r["score"] for r in search.nearest(vectors, asked, 7).collect()}
    else:
        want = {(q["vec_id"], r["vec_id"]): r["score"] for q in asked.collect() for r in search.vector_search(vectors, list(q["embedding"]), 7).collect()}
    assert got == pytest.approx(want, abs=1e-6) and 0 < found.opened < 0.5 * found.cells


def test_few_vectors_and_none(spark, tmp_path):
    few = frame(spark, np.eye(3))
    cells.build_cells(few, str(tmp_path / "few"))
    assert cells.nearest(spark, str(tmp_path / "few"), few, 50).best.count() == 9
    cells.build_cells(few.limit(0), str(tmp_path / "none"))
    assert cells.nearest(spark, str(tmp_path / "none"), few).best.count() == 0
