"""Retrieval quality and latency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_runs, words
from ..session import fits, kept

#: Rows of keys, or of pairs of ids, that are broadcast at most.
MAX_BROADCAST = 200_000
CUTOFFS = (1, 3, 5, 10, 20, 50)


@dataclass(frozen=True)
class EvaluationConfig:
    """What a run may ask for."""

    cutoffs: tuple[int, ...] = CUTOFFS
    top_k: int = 50
    mode: str = "hybrid"
    rerank: bool = False
    candidate_k: int = 50

    def __post_init__(self) -> None:
        c = self.cutoffs
        if not c or c[0] < 1 or any(a >= b for a, b in zip(c, c[1:], strict=False)):
            raise ValueError("cutoffs must be positive and increase")
        if c[-1] > self.top_k:
            raise ValueError("the last cutoff is beyond top_k")
        if self.rerank and self.mode != "hybrid":
            raise ValueError("reranking needs the hybrid mode")
        if self.rerank and self.candidate_k < self.top_k:
            raise ValueError("candidate_k is below top_k")


def parse_cutoffs(text: str) -> tuple[int, ...]:
    return tuple(int(p) for p in text.split(",") if p.strip())


def containment(queries: DataFrame, docs: DataFrame, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", gram: int = 3) -> DataFrame:
    """query_id, id of the documents whose text holds a query's whole text.

    Both meet on the query's middle run of ``gram`` words in full (its first and last may be cut), and then are compared; shorter queries are
    compared with every document, as the table of short ones is small. Candidates are pairs of ids in the shared folder; texts are read for
    those only, and stay where they are if the pairs can be broadcast.
    """
    q = queries.select(F.col(query_id).alias("_q"), F.col(query_text).alias("_t")).withColumn("w", words(F.col("_t")))
    q = q.withColumn("i", F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))
    keys = q.where(F.size("i") >= gram).select("_q", F.array_join(F.slice("i", F.lit(1) + (F.size("i") - gram) / 2, gram), " ").alias("key"))
    d = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_x"))
    runs = d.select("_d", words(F.col("_x")).alias("w")).select("_d", F.explode(F.array_distinct(word_runs("w", gram))).alias("key"))
    pairs = kept(runs.join(F.broadcast(keys) if fits(keys, MAX_BROADCAST) else keys, "key").select("_q", "_d").distinct())
    long = d.join(F.broadcast(pairs) if fits(pairs, MAX_BROADCAST) else pairs, "_d").join(q.select("_q", "_t"), "_q").where(F.contains("_x", F.col("_t")))
    short = q.where(F.size("i") < gram).select("_q", "_t")
    rest = d.join(F.broadcast(short) if fits(short, 10_000) else short, F.contains(F.col("_x"), F.col("_t")))
    return long.select("_q", "_d").unionByName(rest.select("_q", "_d")).select(F.col("_q").alias(query_id), F.col("_d").alias(id_col)).distinct()


def first_rank(results: DataFrame, relevant: DataFrame, query_id: str, id_col: str, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank of its first relevant result; null if none was found. Every query of ``queries`` (or of relevant) has a row."""
    hits = results.join(relevant, [query_id, id_col], "left_semi").groupBy(query_id).agg(F.min("rank").alias("rank"))
    return (queries if queries is not None else relevant).select(query_id).distinct().join(hits, query_id, "left")


def collapse_documents(results: DataFrame, query_id: str, document_col: str) -> DataFrame:
    """query_id, document, rank: documents in the order of their first chunk."""
    first = results.groupBy(query_id, document_col).agg(F.min("rank").alias("first_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("first_rank")))


def ranking_metrics(ranks: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row for each cutoff: means of precision, recall, hit rate, reciprocal rank, average precision, nDCG. With one relevant item
    recall is the hit rate and average precision the reciprocal rank. All cutoffs come from one pass."""
    r = ranks.select("rank", F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("cutoff"))
    hit = F.coalesce(F.col("rank") <= F.col("cutoff"), F.lit(False))

    def mean(x: Column) -> Column:
        return F.round(F.avg(F.when(hit, x).otherwise(0.0)), 6)

    one, rr = F.lit(1.0), 1.0 / F.col("rank")
    return r.groupBy("cutoff").agg(
        F.count("*").alias("queries"),
        mean(1.0 / F.col("cutoff")).alias("precision"),
        mean(one).alias("recall"),
        mean(one).alias("hit_rate"),
        mean(rr).alias("mrr"),
        mean(rr).alias("map"),
        mean(1.0 / F.log2(F.col("rank") + 1.0)).alias("ndcg"),
    )


def rank_stats(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("queries"), F.count("rank").alias("hits"), F.count_if(F.col("rank").isNull()).alias("misses"), F.round(F.avg("rank"), 6).alias("mean_hit_rank"), F.median("rank").alias("median_hit_rank"))


def coverage(details: DataFrame, error_col: str = "error") -> DataFrame:
    """Queries, successes, failures and their share: failed ones count here and in latency, but have no rank."""
    ok = F.col(error_col).isNull()
    return details.agg(F.count("*").alias("queries"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.try_divide(F.count_if(ok), F.count("*")).alias("coverage"))


def latency(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Total, mean, linear p50 and p95, least and greatest."""
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.round(F.sum(v), 6).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.min(v).alias("least"), F.max(v).alias("greatest")
    )


def safe_score(x: Column) -> Column:
    """Null if it isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
