"""Training queries: round trips, hard negatives, status rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("sampled", "generated", "mined", "ready", "filtered", "failed")


def round_trip(queries: DataFrame, results: DataFrame, query_id: str, positive: str, id_col: str, k: int) -> DataFrame:
    """Adds positive_rank (null if not found) and status: mined if the positive is among the first k, else filtered. Rows not generated pass by."""
    hit = results.select(F.col(query_id), F.col(id_col).cast("string").alias("_p"), F.col("rank").alias("positive_rank"))
    both = queries.withColumn("_p", F.col(positive).cast("string")).join(hit, [query_id, "_p"], "left").drop("_p")
    status = F.when(F.coalesce(F.col("positive_rank") <= k, F.lit(False)), "mined").otherwise("filtered")
    return both.withColumn("status", F.when(F.col("status") == "generated", status).otherwise(F.col("status"))) if "status" in queries.columns else both.withColumn("status", status)


def candidates(queries: DataFrame, results: DataFrame, query_id: str, positive: str, id_col: str, most: int) -> DataFrame:
    """Results other than the positive: ``rank`` keeps its gap, ``prompt_rank`` counts from 1 without one."""
    other = results.join(queries.select(query_id, positive), query_id).where(F.col(id_col).cast("string") != F.col(positive).cast("string"))
    w = Window.partitionBy(query_id).orderBy("rank")
    return other.withColumn("prompt_rank", F.row_number().over(w)).where(F.col("prompt_rank") <= most).withColumn("source_ranks", F.create_map(F.lit("hybrid"), F.col("rank")))


def chosen_negatives(responses: DataFrame, found: DataFrame, query_id: str, ids: str, id_col: str) -> DataFrame:
    """The candidates that a response names, in its order and as often; unknown ids go."""
    flat = responses.select(query_id, F.posexplode(ids).alias("position", "_id"))
    return flat.join(found.withColumn("_id", F.col(id_col).cast("string")), [query_id, "_id"]).drop("_id").orderBy(query_id, "position")


def trainable(status: Column, query: Column, positive: Column) -> Column:
    return (status == "ready") & query.isNotNull() & (F.trim(query) != "") & positive.isNotNull()


def contrast(queries: DataFrame, keep: str, query: str) -> DataFrame:
    """The step after the narrowing response: ready with its query, or filtered; other states pass by."""
    mined = F.col("status") == "mined"
    ok = F.coalesce(F.col(keep), F.lit(False)) & F.col(query).isNotNull()
    return queries.withColumn("status", F.when(mined & ok, "ready").when(mined, "filtered").otherwise(F.col("status")))


def routes(rows: DataFrame, negatives: int) -> tuple[DataFrame, DataFrame]:
    """Training records, their hard negatives cut to a number, and failures."""
    good = trainable(F.col("status"), F.col("query"), F.col("positive"))
    return rows.where(good).withColumn("hard_negatives", F.slice("hard_negatives", 1, negatives)), rows.where(~F.coalesce(good, F.lit(False)))


def counters(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ready").alias("trainable"), F.count_if(F.col("status") != "ready").alias("failed"), F.count_if(F.col("status") == "failed").alias("crashed"))
