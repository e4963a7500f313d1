"""Connected components of a table of links, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def stars(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: long u, v. Returns (u, v) for each linked node u that isn't the least of its component, whose least is v.

    Each round re-links larger neighbours to the least one, then smaller ones; it is joins and minima on the
    links only, written to the shared folder, and ends when a round changes nothing.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        t = scratch.table(df)
        return t, tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, state = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new, new_state = written(small.unionByName(lower.withColumnRenamed("m", "v")).distinct())
        scratch.drop(large, edges)
        edges, done, state = new, new_state == state, new_state
        if done:
            break
    return edges
