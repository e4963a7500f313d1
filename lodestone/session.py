"""Sessions, and helpers for plans over whole tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster, use the one it has."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.master(f"local[{n}]").appName("lodestone")
    base = {"spark.sql.shuffle.partitions": str(n), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python stages find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone", None) == sc.applicationId:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp()) / "lodestone_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._lodestone = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if all run in this process, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_index(df: DataFrame, id_col: str, order: list[Column], name: str, width: int = 1024) -> DataFrame:
    """Adds the row's number, from 0, in the order of the integer id_col and then ``order``.

    Rows are numbered within ranges of ``width`` ids; the ranges' counts, one row for each, are summed in order. No task sorts all rows.
    """
    ranged = df.withColumn("_range", F.floor(F.col(id_col) / width))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(id_col, *order))
    return ranged.join(before, "_range").withColumn(name, F.col("_before") + within - 1).drop("_range", "_before")


def running_index(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds the row's number, from 0, in any order: ranges are sorted, and written to the shared folder, and what comes before each is summed. No task sorts all rows."""
    place = F.monotonically_increasing_id()  # of a row in its partition, in the lower 33 bits
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND((1 << 33) - 1)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row for each partition
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k of each task before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows, by reading that many and one more."""
    return len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows
