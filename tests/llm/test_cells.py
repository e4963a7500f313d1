"""Nearest neighbours over many cells, and cells of several parts, against brute force."""

import numpy as np
import pytest

from lodestone.llm import nearest


@pytest.mark.parametrize(("clusters", "cell", "most"), [(40, 100, 16_000), (40, 300, 60), (0, 150, 16_000)])
def test_cells_and_parts(spark, monkeypatch, clusters, cell, most):
    monkeypatch.setattr(nearest, "CELL", cell)
    monkeypatch.setattr(nearest, "MAX_CELL", most)
    rng = np.random.default_rng(cell)
    x = rng.normal(size=(1500, 12)) if not clusters else rng.normal(size=(clusters, 12))[rng.integers(0, clusters, 1500)] + 0.2 * rng.normal(size=(1500, 12))
    x[7] = x[400]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(rows, "vec_id % 20 = 0", 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        want = sorted(range(1500), key=lambda i: (-score[i], i))[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
