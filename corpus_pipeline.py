"""A training-corpus pipeline: quality rules, SimHash near-dedup, repeated passages, mixing, packing.

Each stage reads all that the one before kept, from Parquet in the shared folder. Near-duplicates are texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more: candidates come from multi-index hashing of SimHash fingerprints, which such a pair meets in
with probability 0.99 or more, and each link is confirmed on the sets. Passages of 200 bytes or more that occur twice go from every document.
Mixing repeats rows of small sources, up to half of them, and drops no row; its output is in the
order of the mix, which packing reads.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_copies, packing, quality_rules, suffix_dedup
from lodestone.llm._shared import Scratch, table

#: The similarity as a fraction, so that it is compared exactly.
SHINGLE, SIMILARITY = 5, (4, 5)
MIN_BYTES = 200
MAX_REPEATS = 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the base rules or a learned rule reject. Null and empty texts have no words and go. Repeated rows share their fate. Without labels the base rules alone decide."""
    return quality_rules.filter_rows(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies the row of least doc_id. Null, empty and word-less texts are one class; a null doc_id counts as the least."""
    return near_copies.keep_one(docs, words=SHINGLE, ratio=SIMILARITY)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every passage that occurs twice; n_chars follows the text. Null stays null; a text that is all repeated stays as an empty one."""
    left = suffix_dedup.strip_repeats(docs, min_bytes=MIN_BYTES)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes each row as often as its source's weight says, once at least, in the order of the mix. A null source is a source."""
    mixed = mixing.mix(docs, max_repeats=MAX_REPEATS)
    return mixed.repartitionByRange("place").sortWithinPartitions("place").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all rows, in their order, into sequences. Null and empty texts are one end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passages),
    ("source_mixing", mix),
    ("packing", pack),
]

#: SQL has neither the learned rules, the suffix array nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    before = None
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
