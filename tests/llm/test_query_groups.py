"""Nearest neighbours are the same however many queries are searched at once; equal vectors have equal scores."""

import numpy as np

from lodestone.llm import nearest


def test_groups_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 13))
    rows = [(i, base[int(rng.integers(60))].tolist() if i % 3 else rng.normal(size=13).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(nearest, "CELL", 200)
    one = [tuple(r) for r in nearest.nearest(df, "vec_id % 20 = 0", 10).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(nearest, "QUERIES", 3)
    assert [tuple(r) for r in nearest.nearest(df, "vec_id % 20 = 0", 10).orderBy("query_id", "rank").collect()] == one
    assert len(one) == 45 * 10
    vectors = {i: tuple(v) for i, v in rows}
    scores: dict = {}
    for query, _, found, score in one:
        assert abs(score - float(np.dot(vectors[query], vectors[found]))) < 1e-9
        assert scores.setdefault((query, vectors[found]), score) == score
    for (q, a, i, s), (p, b, j, t) in zip(one, one[1:], strict=False):
        assert q != p or (a + 1 == b and (-s, i) < (-t, j))
