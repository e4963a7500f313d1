"""Temperature mixing of sources, in DataFrame operations only.

A source's weight is its share of the tokens to the power a, normalised. The exponent is bisected: the smallest in [0, 1], that is the most even
mix, at which no source is repeated more than ``max_repeats`` times for each pass of the least repeated one; or the one whose weights have a
given entropy. The budget, in tokens, is then spent source by source on permutations of its rows: as many whole passes as fit,
and of one more pass, in the order of a hash, whole blocks, and of one block the rows that fit.
Each whole pass has a permutation of its own: its blocks are placed by a hash of pass and block, and within a block its rows by a hash of pass and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

STEPS = 60
#: Sources whose weights are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: Rows that a block of a permutation has on average.
BLOCK_ROWS = 1_000


def n_tokens(text: Column) -> Column:
    """Words of a text between ASCII white space, at least one, so that each row costs something; null is empty."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def _unit(hashed: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") * F.lit(2.0**-53)


def _powers(a: Column) -> Column:
    return F.transform("ns", lambda n: F.pow(n.cast("double") / F.col("total"), a))


def weights(sizes: DataFrame, *, max_repeats: float = 1.5, entropy: float | None = None, keep_all: bool = True, budget: int | None = None) -> DataFrame:
    """sizes: source, n_rows, n_tokens. Adds exponent, weight, target (tokens). One row of arrays holds the sources while the exponent is bisected.

    ``budget`` defaults to the tokens at which the least repeated source is used exactly once (keep_all), or else to those there are.
    """
    one = sizes.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "n_rows", "n_tokens"))).alias("s"), F.sum("n_tokens").cast("double").alias("total")).withColumn("ns", F.col("s.n_tokens"))

    def enough(a: Column) -> Column:
        """Whether a mix with exponent a may be made more even."""
        p = _powers(a)
        if entropy is not None:
            z = F.aggregate(p, F.lit(0.0), lambda x, y: x + y)
            h = F.aggregate(p, F.lit(0.0), lambda x, y: x - F.when(y > 0, y / z * F.ln(y / z)).otherwise(0.0))
            return h >= entropy
        uses = F.zip_with(p, F.col("ns"), lambda x, n: x / n.cast("double"))
        return F.array_max(uses) / F.array_min(uses) <= max_repeats

    # bisection: ok(hi) holds for a repetition limit (at 1 all uses are equal), and for entropy the largest exponent that still reaches it is sought
    def step(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        good = enough(mid)
        low, high = (good, ~good) if entropy is not None else (~good, good)
        return F.struct(F.when(low, mid).otherwise(state["lo"]).alias("lo"), F.when(high, mid).otherwise(state["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step, lambda s: s["lo"] if entropy is not None else s["hi"])
    exact = F.when(enough(F.lit(0.0)), F.lit(0.0)).otherwise(found) if entropy is None else F.when(enough(F.lit(1.0)), F.lit(1.0)).otherwise(found)
    solved = one.withColumn("exponent", exact).withColumn("p", _powers(F.col("exponent"))).withColumn("z", F.aggregate("p", F.lit(0.0), lambda x, y: x + y))
    solved = solved.withColumn("w", F.transform("p", lambda x: x / F.col("z")))
    once = F.array_max(F.zip_with("ns", "w", lambda n, w: n.cast("double") / w))
    solved = solved.withColumn("budget", F.lit(float(budget)) if budget is not None else once if keep_all else F.col("total"))
    flat = solved.select(F.posexplode("s").alias("i", "x"), "exponent", "w", "budget")
    weight = F.element_at("w", F.col("i") + 1)
    return flat.select("x.source", "x.n_rows", "x.n_tokens", "exponent", weight.alias("weight"), F.round(weight * F.col("budget")).cast("long").alias("target"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 0, **options) -> DataFrame:
    """row (a row of docs as a struct), tokens, pass (from 0), place (in the mix, 0 to 1): each row as often as its source's target says.

    A null source is a source of its own. Repeated rows have one place and share their fate. With the default budget every row appears once at least.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("_source"), n_tokens(F.col(text_col)).alias("_tokens"), hashed.alias("_hash"), _unit(hashed).alias("_u"))
    light = Scratch(spark, "mixing").table(base.select("_source", "_u", "_tokens"))
    sizes = light.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n_rows"), F.sum("_tokens").alias("n_tokens"))
    plan = weights(sizes, **options).select(
        F.col("source").alias("_source"),
        F.expr("target div n_tokens").alias("_whole"),
        F.expr("target % n_tokens").alias("_rest"),
        (F.col("target") / F.col("n_tokens")).alias("_uses"),
        F.greatest(F.lit(1), F.expr(f"n_rows div {BLOCK_ROWS}")).alias("_blocks"),
    )
    # the sources' plan is a few numbers each: fixed here, so that later scans don't count the sources again
    rows = plan.limit(MAX_BROADCAST_SOURCES + 1).collect()
    few = len(rows) <= MAX_BROADCAST_SOURCES
    plan = spark.createDataFrame(rows, plan.schema) if few else plan

    def place(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(plan) if few else plan, "_source").withColumn("_block", F.least(F.floor(F.col("_u") * F.col("_blocks")), F.col("_blocks") - 1))

    placed = place(light)
    # tokens before each block: sums over blocks, which are few rows for many; then a sum within the one block that the budget ends in
    blocks = placed.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_n"), F.first("_rest").alias("_rest"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = blocks.withColumn("_before", before).where("_before < _rest and _before + _n > _rest").select("_source", F.col("_block").alias("_edge"), (F.col("_rest") - F.col("_before")).alias("_room"))
    ends = blocks.withColumn("_before", before).where("_before + _n <= _rest").groupBy("_source").agg(F.max("_block").alias("_last"))
    cut = ends.join(edges, "_source", "full")
    held = cut.limit(MAX_BROADCAST_SOURCES + 1).collect()
    few_cut = len(held) <= MAX_BROADCAST_SOURCES
    cut = spark.createDataFrame(held, cut.schema) if few_cut else cut
    cut = F.broadcast(cut) if few_cut else cut
    # the partial pass: whole blocks, then rows of the edge block while they fit
    inner = placed.join(cut, "_source").where("_block = _edge").select("_source", "_u", F.col("_tokens").alias("_n"), "_room")
    order = Window.partitionBy("_source").orderBy("_u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inner.groupBy("_source", "_u").agg(F.sum("_n").alias("_n"), F.first("_room").alias("_room")).withColumn("_sum", F.sum("_n").over(order)).where("_sum <= _room").groupBy("_source").agg(F.max("_u").alias("_until"))
    limits = fits.limit(MAX_BROADCAST_SOURCES + 1).collect()
    few_fits = len(limits) <= MAX_BROADCAST_SOURCES
    fits = spark.createDataFrame(limits, fits.schema) if few_fits else fits
    known = place(base).join(cut, "_source", "left").join(F.broadcast(fits) if few_fits else fits, "_source", "left")
    extra = (F.col("_block") <= F.coalesce("_last", F.lit(-1))) | ((F.col("_block") == F.col("_edge")) & (F.col("_u") <= F.col("_until")))
    passes = F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("long")
    out = known.where(passes > 0).withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    # a block is a run of a pass as long as its share, from a point that the pass chooses; the last, partial, pass keeps the order that its cut was made in
    start = _unit(F.xxhash64(F.lit(seed), F.lit("block"), "_pass", "_source", "_block")) * (1 - 1 / F.col("_blocks"))
    within = _unit(F.xxhash64(F.lit(seed), F.lit("row"), "_pass", "_hash")) / F.col("_blocks")
    at = F.when(F.col("_pass") < F.col("_whole"), start + within).otherwise(F.col("_u"))
    out = out.withColumn("_place", F.least((F.col("_pass") + at) / F.col("_uses"), F.lit(1.0)))
    return out.select("row", F.col("_tokens").alias("tokens"), F.col("_pass").alias("pass"), F.col("_place").alias("place"))
