"""Approximate nearest neighbours by stable projections and a kd-tree.

Inner products become distances: each vector gets one more component, so that all have the greatest norm. Gaussian (2-stable)
projections to a few dimensions are split by a kd-tree; the top of the tree, fitted on a bounded sample, deals all
rows to cells, and each cell has a tree of its own. A cell of more rows than one task should hold is dealt in parts by a hash of the id; each
part has a tree, and a query that goes to the cell goes to all its parts. A query visits leaves in the order of their
projected distance, verifies their vectors on all dimensions, and stops when the chi-square test says that a vector nearer than its
k-th would have been projected nearer with probability ``confidence``. It searches its own cell first; the distance found there decides which other
cells it goes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

DIMENSIONS = 12
#: Rows of the sample that the cells are fitted on at most, rows of a cell on average if the sample allows so many cells, and rows of a part of a larger cell.
SAMPLE, CELL, MAX_CELL = 20_000, 4_000, 16_000
LEAF = 64
#: Queries of a cell that are searched at once.
QUERIES = 256
HITS = "query_id long, vec_id long, score double"


def chi2_quantile(p: float, m: int) -> float:
    """By bisection of the regularised lower incomplete gamma function, from its series."""
    from math import exp, lgamma, log

    def cdf(x: float) -> float:
        a, y = m / 2, x / 2
        if y <= 0:
            return 0.0
        term = total = 1 / a
        k = 0
        while term > 1e-14 * total:
            k += 1
            term *= y / (a + k)
            total += term
        return total * exp(-y + a * log(y) - lgamma(a))

    lo, hi = 0.0, 50.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def build(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: row numbers. Splits the widest dimension at its median; equal points stay together."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        own = points[rows]
        spread = own.max(axis=0) - own.min(axis=0) if len(rows) else np.zeros(1)
        k = int(spread.argmax())
        if len(rows) <= leaf or spread[k] <= 0:
            out.append(rows)
            continue
        cut = np.median(own[:, k])
        left = own[:, k] <= cut
        if left.all():
            left = own[:, k] < cut
        todo += [rows[~left], rows[left]]
    return out


def boxes(points: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([points[x].min(axis=0) for x in leaves]), np.stack([points[x].max(axis=0) for x in leaves])


def top_splits(points: np.ndarray, leaf: int) -> list[tuple]:
    """The top of the tree as (dimension, cut, left, right) or a cell's number, the root first."""
    nodes: list = [None]
    todo = [(0, np.arange(len(points)))]
    cells = 0
    while todo:
        at, rows = todo.pop()
        own = points[rows]
        spread = own.max(axis=0) - own.min(axis=0) if len(rows) else np.zeros(1)
        k = int(spread.argmax())
        left = own[:, k] <= np.median(own[:, k]) if len(rows) > leaf and spread[k] > 0 else None
        if left is None or left.all():
            nodes[at] = cells
            cells += 1
            continue
        nodes[at] = (k, float(np.median(own[:, k])), len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(nodes[at][2], rows[left]), (nodes[at][3], rows[~left])]
    return nodes


def cell_of(nodes: list, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if isinstance(nodes[at], tuple):
            k, cut, a, b = nodes[at]
            left = points[rows, k] <= cut
            todo += [(a, rows[left]), (b, rows[~left])]
        else:
            out[rows] = nodes[at]
    return out


class Cell:
    """The vectors of a cell with their tree. ids: up to k + 1 of each vector, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        self.leaves = build(projected, LEAF)
        self.order = np.concatenate(self.leaves) if len(ids) else np.zeros(0, np.int64)
        self.ends = np.cumsum([len(x) for x in self.leaves])
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.low, self.high = boxes(projected, self.leaves)

    def search(self, queries: np.ndarray, at: np.ndarray, own: np.ndarray, k: int, norm2: float, limit: float, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of the k best found of each query. known: the score of a k-th neighbour found elsewhere, or -inf.

        A squared distance is |q|^2 + M^2 - 2 score, M the greatest norm. Queries go through their leaves in steps; in a step a leaf is
        multiplied with all queries that visit it. What may stay is scored again pair by pair, so that equal vectors have equal scores.
        """
        gap = np.maximum(0, np.maximum(self.low[None] - at[:, None], at[:, None] - self.high[None]))
        bound = (gap * gap).sum(axis=2)
        visit = np.argsort(bound, axis=1, kind="stable")
        length2 = (queries * queries).sum(axis=1)
        slack = 1e-12 * np.sqrt(length2 * norm2)
        worst, active, done, step = known.copy(), np.arange(len(queries)), 0, 4
        who, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        while done < len(self.leaves):
            active = active[bound[active, visit[active, done]] <= limit * np.maximum(0.0, length2[active] + norm2 - 2 * worst[active])]
            if not len(active):
                break
            now = visit[active, done : done + step]
            flat = np.argsort(now, axis=None, kind="stable")
            leaves, starts = np.unique(now.ravel()[flat], return_index=True)
            found = [(who, row, score)]
            for leaf, pick in zip(leaves, np.split(active[flat // now.shape[1]], starts[1:]), strict=True):
                n = len(self.leaves[leaf])
                begin = self.ends[leaf] - n
                s = queries[pick] @ self.vectors[begin : begin + n].T
                least = worst[pick]
                if n > k + 1:  # one of them may be the query's own
                    least = np.maximum(least, np.partition(s, n - k - 1, axis=1)[:, n - k - 1])
                i, j = np.nonzero((s >= (least - slack[pick])[:, None]) & (self.ids[begin : begin + n][None] != own[pick][:, None]))
                found.append((pick[i], begin + j, np.einsum("ij,ij->i", self.vectors[begin + j], queries[pick[i]])))
            who, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((self.ids[row], -score, who))
            who, row, score = who[order], row[order], score[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            keep = place < k
            last = place == k - 1
            worst[who[last]] = np.maximum(worst[who[last]], score[last])
            who, row, score = who[keep], row[keep], score[keep]
            done += step
            step = min(64, step * 2)
        keep = score >= known[who]
        return who[keep], self.ids[row[keep]], score[keep]


def _search(k: int, norm2: float, limit: float, width: int):
    """Rows (cell, kind, id, vector, projected, known), of a cell the vectors (kind 0) before the queries (kind 1), to hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, index = None, [], None
        for batch in batches:
            cells, kinds, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            known = batch.column(5).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            vectors = batch.column(3).flatten().to_numpy().reshape(-1, width)
            projected = batch.column(4).flatten().to_numpy().reshape(len(ids), -1)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, parts, index = cells[a], [], None
                if kinds[a] == 0:
                    parts.append((ids[a:b].copy(), vectors[a:b].copy(), projected[a:b].copy()))
                    continue
                if index is None and parts:
                    index, parts = Cell(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                for i in range(a, b, QUERIES) if index is not None else ():
                    j = min(b, i + QUERIES)
                    who, got, s = index.search(vectors[i:j], projected[i:j], ids[i:j], k, norm2, limit, known[i:j])
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][who]), pa.array(got), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, confidence: float = 0.97, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found of greatest inner product for each row where ``queries`` (SQL on vec_id) holds, itself left out.

    Rows with a null id or a vector that is null, zero, or holds null or non-finite components take no part, nor those of
    another length than most. Of equal vectors, only the k + 1 least ids can be in a result, and only they are indexed; rows that repeat an
    id and vector count once. Scores are in double precision; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    schema = "query_id long, rank int, vec_id long, score double"
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(fine).distinct()
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    width = sizes[0]["n"]
    rows = rows.where(F.size("v") == width)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))  # Spark keeps the first k + 1 of each task before the shuffle
    good = scratch.table(rows.withColumn("norm2", norm2).withColumn("n", least).select("vec_id", "v", "norm2", (F.col("n") <= k + 1).alias("indexed"), F.expr(queries).alias("asked")).where("indexed or asked"))
    top, count = good.where("indexed").agg(F.max("norm2"), F.count("*")).first()
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(width + 1, dimensions))

    def project(x: np.ndarray) -> np.ndarray:
        n2 = (x * x).sum(axis=1)
        return x @ matrix[:-1] + np.sqrt(np.maximum(0.0, top - n2))[:, None] * matrix[-1]

    part = min(1.0, 1.1 * SAMPLE / count)
    sample = good.where("indexed").where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("v").limit(SAMPLE).toPandas()["v"]
    sampled = project(np.stack(sample.to_list())) if len(sample) else np.zeros((1, dimensions))
    nodes = top_splits(sampled, max(32, int(CELL * len(sampled) / count)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            p = project(x)
            # a query has no further component: its projection is of the vector alone
            q = x @ matrix[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(cell_of(nodes, p)), pa.array(cell_of(nodes, q)), pa.array(list(p)), pa.array(list(q))],
                names=["vec_id", "v", "indexed", "asked", "cell", "home", "p", "q"],
            )

    kind = "vec_id long, v array<double>, indexed boolean, asked boolean, cell long, home long, p array<double>, q array<double>"
    dealt = scratch.table(good.select("vec_id", "v", "indexed", "asked").mapInArrow(deal, kind))
    # the least box of each cell
    low = [F.min(F.col("p")[j]) for j in range(dimensions)]
    high = [F.max(F.col("p")[j]) for j in range(dimensions)]
    box = dealt.where("indexed").groupBy("cell").agg(F.array(*low).alias("low"), F.array(*high).alias("high"), F.count("*").alias("n")).orderBy("cell").collect()  # as many as cells, whose number the sample bounds
    at = np.array([b["cell"] for b in box])
    lows, highs = np.array([b["low"] for b in box]), np.array([b["high"] for b in box])
    limit = chi2_quantile(confidence, dimensions)
    known = {b["cell"] for b in box}
    many = {b["cell"]: -(-b["n"] // MAX_CELL) for b in box if b["n"] > MAX_CELL}
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for kv in many.items() for x in kv]), F.col("cell")), F.lit(1)) if many else F.lit(1)
    n_cells = int(at.max()) + 1
    own = F.col("cell") + n_cells * F.pmod(F.xxhash64("vec_id"), parts)
    stored = dealt.where("indexed").select(own.alias("cell"), F.lit(0).alias("kind"), "vec_id", "v", F.col("p").alias("x"), F.lit(None).cast("double").alias("known"))
    asked = dealt.where("asked")
    home = F.when(F.col("home").isin(list(known)), F.col("home")).otherwise(F.lit(int(at[0])))
    first = asked.select(home.alias("cell"), F.lit(1).alias("kind"), "vec_id", "v", F.col("q").alias("x"), F.lit(None).cast("double").alias("known"))

    def search(sent: DataFrame) -> DataFrame:
        to_parts = sent.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).withColumn("cell", F.col("cell") + n_cells * F.col("_part")).drop("_part")
        rows = stored.unionByName(to_parts).repartition("cell").sortWithinPartitions("cell", "kind", "vec_id")
        return rows.mapInArrow(_search(k, top, limit, width), HITS)

    at_home = scratch.table(search(first))
    # a query has k hits at most from each part of its cell
    kth = at_home.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("vec_id"), F.try_element_at("s", F.lit(k)).alias("known"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v, q = batch.column(0), batch.column(1), batch.column(2)
            x, y = v.flatten().to_numpy().reshape(-1, width), q.flatten().to_numpy().reshape(-1, dimensions)
            worst = np.array([-np.inf if w is None else w for w in batch.column(3).to_pylist()])
            homes = batch.column(4).to_numpy()
            d2 = np.maximum(0.0, (x * x).sum(axis=1) + top - 2 * worst)
            gap = np.maximum(0, np.maximum(lows[None] - y[:, None], y[:, None] - highs[None]))
            go = ((gap * gap).sum(axis=2) <= limit * d2[:, None]) & (at[None] != homes[:, None])
            i, j = np.nonzero(go)
            if len(i):
                pick = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(at[j]), ids.take(pick), v.take(pick), q.take(pick), batch.column(3).take(pick)], names=["cell", "vec_id", "v", "x", "known"])

    away = asked.join(kth, "vec_id", "left").select("vec_id", "v", "q", "known", home.alias("home")).mapInArrow(visits, "cell long, vec_id long, v array<double>, x array<double>, known double")
    rest = search(away.select("cell", F.lit(1).alias("kind"), "vec_id", "v", "x", "known"))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    both = at_home.unionByName(rest).distinct()
    return both.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
