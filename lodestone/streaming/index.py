"""An index fed by a stream of documents: each micro-batch appends its chunks and postings once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import recursive
from ..operators.retrieval import postings


def feed(stream: DataFrame, root: str, size: int = 512):
    """Starts a query over streamed (id, title, text). A batch's files are in a folder of its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = recursive(batch, size, "id", "text", "title")
        chunks.write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")
        kept = batch.sparkSession.read.parquet(f"{root}/chunks/batch={number}")
        postings(kept.withColumn("key", F.struct("document_id", "position")), "key", "content").write.mode("overwrite").parquet(f"{root}/postings/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()


def append_records(stream: DataFrame, path: str):
    """Records appended as they finish, as JSON lines with exactly-once files; trainable ones and failures in folders of their own."""
    route = F.when(F.col("status") == "ready", "queries").otherwise("failures")
    return stream.withColumn("route", route).writeStream.format("json").partitionBy("route").option("path", path).option("checkpointLocation", f"{path}/_checkpoint").outputMode("append").trigger(availableNow=True).start()
