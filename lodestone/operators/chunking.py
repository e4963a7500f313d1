"""Chunks: fixed windows of words, or recursive splits at paragraphs, sentences, words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import dense_index


def fixed_windows(docs: DataFrame, size: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document_id, position, content, source_index (a running number over the corpus)."""
    w = words(F.col(text_col))
    n = docs.select(F.col(id_col).alias("document_id"), w.alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"), F.lit(size))).otherwise(F.array().cast("array<int>"))
    flat = n.select("document_id", F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("w", s, size), " "))).alias("position", "content"))
    return dense_index(flat, "document_id", [F.col("position")], "source_index")


SPLITS = (r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?]\s)", r"(?<=\s)")


def recursive_chunks(text: str, size: int) -> list[str]:
    """Parts of at most ``size`` words whose concatenation is the text: cut at the coarsest separator that is fine enough, then merged with neighbours."""

    def n(s: str) -> int:
        return len(s.split())

    def parts(s: str, level: int) -> Iterator[str]:
        if n(s) <= size or level == len(SPLITS):
            yield s
            return
        for p in re.split(SPLITS[level], s):
            if p:
                yield from parts(p, level + 1)

    out: list[str] = []
    count = 0
    for p in parts(text, 0):
        if out and count + n(p) <= size:
            out[-1] += p
            count += n(p)
        else:
            out.append(p)
            count = n(p)
    return out


def recursive(docs: DataFrame, size: int = 512, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """id (= source_index), document_id, position, title, content. A blank text has no chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p, t, c) for d, t, x in zip(b["document_id"], b["title"], b["text"], strict=True) if isinstance(x, str) and x.strip() for p, c in enumerate(recursive_chunks(x, size))]
            yield pd.DataFrame(rows, columns=["document_id", "position", "title", "content"])

    sent = docs.select(F.col(id_col).cast("long").alias("document_id"), (F.col(title_col) if title_col else F.lit(None)).cast("string").alias("title"), F.col(text_col).alias("text"))
    flat = sent.mapInPandas(run, "document_id long, position int, title string, content string")
    return dense_index(flat, "document_id", [F.col("position")], "source_index").withColumn("id", F.col("source_index"))
