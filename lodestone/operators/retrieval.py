"""Retrieval for whole tables of queries: BM25, dense, reciprocal-rank fusion, reranking, modes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..providers import Reranker
from ..session import fits, top_k

K1, B, RRF_K = 1.2, 0.75, 60
#: Query vectors held by a task at most, and by a broadcast.
QUERY_BLOCK = 20_000
#: Scores that a task holds at once, besides the best ones.
SCORES = 4_000_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf, length. terms: a table of the terms wanted; others are dropped before the shuffle if it is small."""
    doc = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("t"))
    flat = doc.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    if terms is not None:
        flat = flat.join(terms.select("term").distinct(), "term", "left_semi")
    return flat.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n documents, avg_length in tokens."""
    length = F.regexp_count(F.lower(text_col), F.lit(TOKEN))  # tokens are counted, not built
    return docs.agg(F.count("*").alias("n"), (F.sum(length) / F.count("*")).alias("avg_length"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 50, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank of the k best; ties go to the smaller id. A query's terms count once."""
    asked = queries.select(F.col(query_id), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    found = postings(docs, id_col, text_col, asked)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    one = F.broadcast(corpus_size(docs, text_col))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))
    scored = found.join(df, "term").join(one).select("term", "doc_id", (idf * F.col("tf") * (K1 + 1) / norm).alias("s"))
    total = scored.join(asked, "term").groupBy(query_id, "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))
    return top_k(total, [query_id], [F.desc("score"), F.col("doc_id")], k)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def dense(queries: DataFrame, corpus: DataFrame, k: int = 50, query_id: str = "query_id", query_vector: str = "vector", id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = False, normalise: bool = False) -> DataFrame:
    """query_id, id, score, rank of the k best by cosine of unit vectors (``normalise`` others).

    Queries are cut into blocks of QUERY_BLOCK vectors. A block is multiplied with each batch of the corpus, of which a task passes on k
    for each query; so the corpus is scanned, not shuffled, once for each block.
    """
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null")
    blocks = [q] if fits(q, QUERY_BLOCK) else [q.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i) for n in [-(-q.count() * 5 // (4 * QUERY_BLOCK))] for i in range(n)]
    schema = f"q {dict(q.dtypes)['q']}, id {corpus.schema[id_col].dataType.simpleString()}, score double"
    out = None
    sc = corpus.sparkSession.sparkContext
    sent = corpus.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    for part in blocks:
        rows = part.toPandas()
        if not len(rows):
            continue
        matrix = np.stack(rows["v"].to_list())
        held = sc.broadcast((rows["q"].to_numpy(), _unit(matrix) if normalise else matrix))  # at most QUERY_BLOCK vectors or so

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, m = held.value
            best_s, best_i = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
            for b in batches:
                for a in range(0, len(b), max(1, SCORES // len(ids))):
                    part = b.slice(a, max(1, SCORES // len(ids)))
                    own = part.column(0).to_numpy(zero_copy_only=False)
                    x = part.column(1).flatten().to_numpy().reshape(len(own), -1)
                    s = np.round(m @ (_unit(x) if normalise else x).T, 6)
                    if exclude_self:
                        s[ids[:, None] == own[None, :]] = -np.inf
                    s, i = np.concatenate((best_s, s), axis=1), np.concatenate((best_i, np.broadcast_to(own, s.shape)), axis=1)
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            ok = best_s > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(axis=1))), pa.array(best_i[ok]), pa.array(best_s[ok])], names=["q", "id", "score"])

        got = sent.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], schema)
    best = top_k(out, ["q"], [F.desc("score"), F.col("id")], k)
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def fuse(lists: list[DataFrame], query_id: str, id_col: str, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: the sum of 1 / (constant + rank); one shuffle, no join."""
    parts = [x.select(query_id, id_col, (1 / (constant + F.col("rank"))).alias("s")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    total = both.groupBy(query_id, id_col).agg(F.round(F.sum("s"), 6).alias("score"))
    return top_k(total, [query_id], [F.desc("score"), F.col(id_col)], k)


def rerank(candidates: DataFrame, reranker: Reranker, query_id: str, query_text: str, id_col: str, text_col: str, k: int, top_rerank: int = 50, threshold: float = 0.0) -> DataFrame:
    """The first top_rerank candidates of each query scored anew; scores under the threshold go, equal ones stay."""
    short = candidates.where(F.col("rank") <= top_rerank)

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=q.index)
        for text, rows in q.groupby(q, sort=False).groups.items():
            got = reranker.score(text, t[rows].tolist())
            if len(got) != len(rows) or not np.isfinite(got).all():
                raise ValueError("the reranker's answer isn't one finite score for each text")
            out[rows] = got
        return out

    scored = short.withColumn("score", F.round(F.pandas_udf(run, "double")(query_text, text_col), 6)).where(F.col("score") >= threshold)
    return top_k(scored.drop("rank"), [query_id], [F.desc("score"), F.col(id_col)], k)


def fetch_size(mode: str, k: int, top_rerank: int, most: int = 10_000) -> int:
    """Rows to fetch before a cut to k."""
    return min(most, max(k, top_rerank) if mode == "hybrid_reranked" else k)


def project_results(rows: DataFrame) -> DataFrame:
    """id, title, content, metadata, score of a store's rows: a reranker's score before a distance, before 0; metadata names the document unless it does already."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    own = F.when(F.col("document_id").isNotNull() & ~F.map_contains_key(meta, "document_id"), F.create_map(F.lit("document_id"), F.col("document_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    score = F.coalesce("_relevance_score", "`$dist`", F.lit(0.0)).cast("double")
    return rows.select("id", F.coalesce(F.col("title").cast("string"), F.lit("")).alias("title"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"), F.map_concat(meta, own).alias("metadata"), score.alias("score"))


def check_dimensions(vectors: DataFrame, vector_col: str, expected: int) -> DataFrame:
    """The rows, with an error at the first whose vector hasn't the catalogued dimension."""
    n = F.size(vector_col)
    return vectors.withColumn(vector_col, F.when(n == expected, F.col(vector_col)).otherwise(F.raise_error(F.concat(F.lit("vector dimension "), n.cast("string"), F.lit(f" isn't the catalogued {expected}")))))


MODES = ("dense", "bm25", "hybrid", "hybrid_reranked")


def resolve_mode(mode: str | None, has_vectors: bool, reranker: Reranker | None) -> str:
    """The mode asked for, or else the best that the corpus and models allow; an error if it can't be served."""
    mode = mode or ("bm25" if not has_vectors else "hybrid_reranked" if reranker else "hybrid")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(MODES)}")
    if mode != "bm25" and not has_vectors:
        raise ValueError(f"mode {mode} needs vectors, and the corpus has none")
    if mode == "hybrid_reranked" and reranker is None:
        raise ValueError("mode hybrid_reranked needs a reranker")
    return mode


def retrieve(queries: DataFrame, chunks: DataFrame, mode: str | None = None, k: int = 50, reranker: Reranker | None = None, top_rerank: int = 50, threshold: float = 0.0) -> DataFrame:
    """query_id, id, score, rank, title, content, document_id (its own id if null) for queries (query_id, text, vector) against chunks (id, title, content, document_id, vector)."""
    mode = resolve_mode(mode, "vector" in chunks.columns and "vector" in queries.columns, reranker)
    n = fetch_size(mode, k, top_rerank)
    lists = []
    if mode != "dense":
        lists.append(bm25(queries, chunks, n, "query_id", "text", "id", "content").withColumnRenamed("doc_id", "id"))
    if mode != "bm25":
        lists.append(dense(queries, chunks, n, "query_id", "vector", "id", "vector"))
    found = lists[0] if len(lists) == 1 else fuse(lists, "query_id", "id", n)
    full = found.join(chunks.select("id", "title", "content", "document_id"), "id")
    if mode == "hybrid_reranked":
        full = rerank(full.join(queries.select("query_id", F.col("text").alias("_q")), "query_id"), reranker, "query_id", "_q", "id", "content", k, top_rerank, threshold).drop("_q")
    return full.where(F.col("rank") <= k).select("query_id", "id", "score", "rank", "title", "content", F.coalesce("document_id", "id").alias("document_id"))
