"""Datasets: samples, splits, merges, versions, schema gates."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import version_parts
from ..session import dense_index


def sample_numbers(rows: int, n: int, seed: int, rng: random.Random | None = None) -> tuple[list[int], random.Random]:
    """n row numbers without repeats, as Python's generator draws them."""
    rng = rng or random.Random(seed)
    return rng.sample(range(rows), min(n, rows)), rng


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Rows whose number in the order of the integer id_col was drawn, with their place in the draw. Ids may have gaps."""
    numbers, _ = sample_numbers(df.count(), n, seed)
    drawn = df.sparkSession.createDataFrame(list(enumerate(numbers)), "draw long, number long")
    return dense_index(df, id_col, [], "number").join(drawn, "number").drop("number")


def stratified_split(df: DataFrame, stratum: str, key: Column, test_share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: of each stratum a share, one row at least, is test, in the order of a digest of seed and key."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    w = Window.partitionBy(stratum)
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(test_share)))
    return df.withColumn("split", F.when(F.row_number().over(w.orderBy(order, key)) <= n, "test").otherwise("train"))


def check_strata(df: DataFrame, stratum: str) -> None:
    """A stratum of one row can't be split."""
    few = [r[0] for r in df.groupBy(stratum).count().where("count < 2").limit(20).collect()]
    if few:
        raise ValueError(f"strata with one row only: {few}")


def merge(existing: DataFrame, incoming: DataFrame, replace: str | None = None, source_col: str = "source") -> DataFrame:
    """Both tables' rows; with ``replace``, those of that source that were there go first."""
    if set(existing.columns) != set(incoming.columns):
        raise ValueError(f"columns differ: {sorted(set(existing.columns) ^ set(incoming.columns))}")
    kept = existing if replace is None else existing.where(~F.col(source_col).eqNullSafe(F.lit(replace)))
    return kept.unionByName(incoming)


def latest_versions(df: DataFrame, label: str) -> DataFrame:
    """Rows of the newest version of each base, and those without a version."""
    base, version = version_parts(F.col(label))
    newest = F.max("_v").over(Window.partitionBy("_b"))
    return df.withColumn("_b", base).withColumn("_v", version).withColumn("_m", newest).where("_v is null or _v = _m").drop("_b", "_v", "_m")


def duplicates(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def gate(df: DataFrame, split: str, required: tuple[str, ...] = ("id", "title", "text")) -> list[str]:
    """Raises if a column is missing or the split's name isn't a word; returns warnings about further columns."""
    missing = [c for c in required if c not in df.columns]
    if missing or not re.fullmatch(r"\w+(\.\w+)*", split):
        raise ValueError(f"split {split!r}: missing columns {missing}" if missing else f"split name {split!r} isn't valid")
    return [f"extra column {c}" for c in df.columns if c not in required]
