"""Helpers shared by the corpus operators: the shared folder, written tables, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship
from ..session import table as _read

__all__ = ["NULL_ID", "Scratch", "row_key", "shared_dir", "table"]

#: Stands for a null id inside join keys; no operator returns it.
NULL_ID = -(2**63)
#: Bytes of a batch that a Python stage gets, so that its memory follows neither the number nor the length of texts.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors, bounds the batches of Python stages, and lets joins with a small table filter large ones before their shuffle."""
    ship(spark)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return _read(spark, sf_dir, name)


class Scratch:
    """Intermediate results as Parquet in the shared folder, so that a lost executor costs no recomputation. The folder goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._lodestone_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing lazy still reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._lodestone_path)
            path.getFileSystem(conf).delete(path, True)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """rid, d: name a row by id and text. Rows that repeat both share a key, and so have one result."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d")]
