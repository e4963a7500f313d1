"""Tasks for agents and judges: where their rows come from, their projection, and answers that may need several attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

#: Criteria of a judge call, and calls after the first that a refused answer gets.
MAX_CRITERIA, MAX_RETRIES = 4, 5


def rows(spark: SparkSession, path: str, split: str, hub: Callable[[str, str], DataFrame]) -> DataFrame:
    """JSON lines of a local path that ends in .jsonl, which must exist; any other name is left to ``hub``."""
    if not path.endswith(".jsonl"):
        return hub(path, split)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return spark.read.json(path)


def project(data: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of a dataset in the order of an integer column, as tasks: idx from 0, prompt, question, rubric, table_name, doc_ids, complexity."""
    first = data.orderBy(order).limit(most)
    numbered = first.groupBy().agg(F.array_sort(F.collect_list(F.struct(order, "question", "rubric", "data_source", "doc_ids", "question_type"))).alias("r")).select(F.posexplode("r").alias("idx", "r"))  # most rows
    return numbered.select(F.col("idx").cast("long").alias("idx"), F.col("r.question").alias("prompt"), "r.question", "r.rubric", F.col("r.data_source").alias("table_name"), "r.doc_ids", F.col("r.question_type").alias("complexity"))


def attempts(pending: DataFrame, ask: Callable[[DataFrame, int], DataFrame], fault: Column, most: int = MAX_RETRIES + 1) -> DataFrame:
    """Asks for each row until its answer has no ``fault`` (a column that is null then), ``most`` times at most.

    ``ask`` gets the rows that are left, with ``errors``, the faults so far, and the number of the attempt, and adds columns. Each round's
    answers are written to the checkpoint folder, so that a model isn't asked again. Adds ``errors``, ``attempts`` and ``accepted``.
    """
    left, done = pending.withColumn("errors", F.array().cast("array<string>")), None
    for k in range(most):
        got = kept(ask(left, k).withColumn("_fault", fault).withColumn("attempts", F.lit(k + 1)))
        fine = got.where("_fault is null").withColumn("accepted", F.lit(True)).drop("_fault")
        done = fine if done is None else done.unionByName(fine)
        refused = got.where("_fault is not null").withColumn("errors", F.concat("errors", F.array("_fault")))
        if k == most - 1 or refused.isEmpty():
            return done.unionByName(refused.withColumn("accepted", F.lit(False)).drop("_fault"))
        left = refused.select(*pending.columns, "errors")
    raise ValueError("most must be 1 or more")


def names_differ(verdicts: Column, criteria: Column) -> Column:
    """A fault if a judge's verdicts aren't those of the criteria asked about, in their order; null if they are."""
    names = F.transform(verdicts["verdicts"], lambda v: v["name"])
    return F.when(verdicts["error"].isNotNull(), verdicts["error"]).when(~names.eqNullSafe(criteria), F.lit("the names aren't those of the criteria"))
