"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector, of length 1, of its hashed letter n-grams (1 to 3, within words). Each language's training vectors are clustered by
spherical k-means, in a task of its own; a text gets the language of the centroid of greatest cosine, of equals the first by name. A text farther
from that centroid than nearly all of the training texts of its cluster were is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fits
from ._shared import Scratch

SIZE = 1 << 13
CHUNK = 1 << 19
#: Training rows of a language at most, those of least hash.
MAX_ROWS = 1500
CLUSTERS = 4
#: MB of centroids that a model may have: a few languages' are broadcast, and a column with more values than fit isn't one of languages.
MAX_MODEL_MB = 256
REJECT_QUANTILE = 0.002


@lru_cache(1)
def _letters() -> np.ndarray:
    """The code of each BMP character's lower-case letter, 0 of what isn't a letter. Others than BMP letters share codes with it by their low bits."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts of each text, and its letters."""
    table = _letters()
    out = np.zeros((len(texts), SIZE), np.float32)
    letters = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < CHUNK or end == at):
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        cp = np.frombuffer(" ".join(part).encode("utf-32-le", "replace"), "<u4")
        doc = np.repeat(np.arange(len(part)), [len(x) + 1 for x in part])[: len(cp)]
        wide = cp >= 0x10000
        c = table[np.where(wide, 0, cp)]
        if wide.any():
            c[wide] = [ord(chr(x).lower()[0]) if chr(x).isalpha() else 0 for x in cp[wide].tolist()]
        own = np.bincount(doc[c > 0], minlength=len(part))
        h = c * np.uint32(0x9E3779B1)
        flat = np.zeros(len(part) * SIZE, np.int64)
        grams = [(h, c > 0)]
        if len(c) > 1:
            two = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + h[1:]
            grams.append((two, (c[:-1] > 0) & (c[1:] > 0)))
            if len(c) > 2:
                three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + h[2:]
                grams.append((three, (c[:-2] > 0) & (c[1:-1] > 0) & (c[2:] > 0)))
        for g, ok in grams:
            slot = ((g ^ (g >> np.uint32(16))) & np.uint32(SIZE - 1)).astype(np.int64) + doc[: len(g)] * SIZE
            flat += np.bincount(slot[ok], minlength=len(flat))
        out[at:end] = flat.reshape(len(part), SIZE)
        letters[at:end] = own
        at = end
    return out, letters


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        """In place of the counts."""
        v = np.log1p(counts, out=counts)
        v *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        v /= np.where(norm > 0, norm, 1)
        return v

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts, letters = gram_counts(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.where(letters > 0, np.clip(cos[np.arange(len(texts)), best].astype(float), 0, 1), 0.0)
        names = [self.languages[self.language_of[k]] if n else "und" for k, n in zip(best, letters, strict=True)]
        return names, score, (letters == 0) | (score < self.least[best])


def _k_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from rows that are far from those chosen."""
    chosen = [0]
    for _ in range(min(k, len(v)) - 1):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return c


def cluster(v: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language's unit vectors, and of each the cosine that nearly all vectors of its cluster reach."""
    c = _k_means(v, clusters)
    cos = v @ c.T
    best = cos.argmax(axis=1)
    return c, np.array([np.quantile(cos[best == j, j], REJECT_QUANTILE) if (best == j).any() else 0.0 for j in range(len(c))])


def inverse_frequency(n: int, df: np.ndarray) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def _model(idf: np.ndarray, parts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """parts: each language's name, centroids and least cosines."""
    if not parts:
        return Model([], idf, np.zeros((0, SIZE), np.float32), np.zeros(0, int), np.zeros(0))
    parts = sorted(parts, key=lambda p: p[0])
    return Model([p[0] for p in parts], idf, np.concatenate([p[1] for p in parts]), np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts]), np.concatenate([p[2] for p in parts]))


def learn(texts: list[str], langs: list[str], clusters: int = CLUSTERS) -> Model:
    """As fit() does, of texts in memory."""
    counts = gram_counts(texts)[0]
    model = _model(inverse_frequency(len(texts), np.count_nonzero(counts, axis=0)), [])
    v, lang = model.vectors(counts), np.array(langs)
    return _model(model.idf, [(x, *cluster(v[lang == x], clusters)) for x in sorted(set(langs))])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language, hash, text) with the text as its gram counts: slots and numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            counts, _ = gram_counts(part.column(2).to_pylist())
            row, slot = np.nonzero(counts)
            ends = np.cumsum([0, *np.bincount(row, minlength=part.num_rows)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (slot.astype(np.int32), counts[row, slot])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["l", "u", "slots", "counts"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None, max_rows: int = MAX_ROWS, clusters: int = CLUSTERS) -> Model:
    """Learns from at most max_rows texts of each language, those of least hash of id and text; a null id is a value like others, and of equal rows any counts.

    Counting the languages covers all rows; the share of rows to take follows from the counts, and few are taken beyond it. Texts become gram counts in
    tasks, and each language's are clustered in one task, of at most max_rows; the driver gets the centroids alone, 32 KB each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language")).alias("u"), (F.lit(True) if train is None else train).alias("ok"))
    rows = rows.where("ok and l is not null and t is not null")
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"))
    most = MAX_MODEL_MB * 2**20 // (4 * SIZE * clusters)
    if not fits(sizes, most):
        raise ValueError(f"{lang_col} has more than {most} values, whose centroids don't fit {MAX_MODEL_MB} MB; raise MAX_MODEL_MB if they are languages")
    scratch = Scratch(spark, "language")
    wide = rows.join(F.broadcast(sizes), "l").where(F.pmod("u", F.lit(1 << 30)) < 1.2 * max_rows / F.col("n") * (1 << 30) + 1)  # a row for each language, of a number that fits() has checked
    order = Window.partitionBy("l").orderBy(F.pmod("u", F.lit(1 << 30)), "u")
    grams = scratch.table(wide.select("l", "u", "t").mapInArrow(_sparse, "l string, u long, slots array<int>, counts array<float>").withColumn("i", F.row_number().over(order)).where(F.col("i") <= max_rows))
    n = grams.count()
    df = np.zeros(SIZE, np.int64)
    for r in grams.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():  # SIZE rows at most
        df[r["slot"]] = r["count"]
    model = _model(inverse_frequency(n, df), [])

    def learned(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("i")
        counts = np.zeros((group.num_rows, SIZE), np.float32)
        lists = [group.column(x).combine_chunks() for x in ("slots", "counts")]
        counts[np.repeat(np.arange(group.num_rows), np.diff(lists[0].offsets.to_numpy())), lists[0].flatten().to_numpy()] = lists[1].flatten().to_numpy()
        c, least = cluster(model.vectors(counts), clusters)
        return pa.table({"l": [group.column("l")[0].as_py()] * len(c), "j": pa.array(range(len(c)), pa.int32()), "c": [x.astype(np.float32).tobytes() for x in c], "least": least.astype(float)})

    found: dict[str, list] = {}
    for r in sorted(grams.groupBy("l").applyInArrow(learned, "l string, j int, c binary, least double").collect(), key=lambda r: (r["l"], r["j"])):
        found.setdefault(r["l"], []).append((np.frombuffer(r["c"], np.float32), r["least"]))
    scratch.drop(grams)
    return _model(model.idf, [(x, np.stack([c for c, _ in own]), np.array([q for _, q in own])) for x, own in found.items()])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred (und without letters, or if no language was learned), score (cosine, 0 to 1), rejected. Repeated rows are predicted each; whole texts are counted, in parts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MAX_MODEL_MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                names, score, rejected = sent.value.predict([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
