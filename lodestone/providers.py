"""Models are plug-ins: a provider maps batches of texts. These are the interfaces and deterministic stand-ins."""

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


class Encoder(Protocol):
    """Unit vectors. Queries may be encoded with a prompt; documents have none."""

    dimensions: int

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray: ...


class Reranker(Protocol):
    """A relevance score, higher for better, for each text."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str | None]: ...


class HashingEncoder:
    """Signed hashed words, normalised to length 1; a text without words is the first axis."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float64)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1 if h >> 63 else -1
            if not out[i].any():
                out[i, 0] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


class OverlapReranker:
    """Five times the share of the query's distinct words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(re.findall(r"[^\W_]+", query.lower()))
        return [5 * len(q & set(re.findall(r"[^\W_]+", (t or "").lower()))) / max(1, len(q)) for t in texts]


def checked(vectors: np.ndarray, n: int) -> np.ndarray:
    """A provider's answer must have one finite unit vector for each text."""
    if vectors.shape[:1] != (n,) or not np.isfinite(vectors).all() or not np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-3):
        raise ValueError("the encoder's answer isn't one finite unit vector for each text")
    return vectors


def encode(df: DataFrame, text_col: str, encoder: Encoder, out: str = "vector", query: bool = False) -> DataFrame:
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(checked(encoder.encode(x.fillna("").tolist(), query), len(x)))) if len(x) else x

    return df.withColumn(out, pandas_udf(run, "array<float>")(F.col(text_col)))


def generate(df: DataFrame, prompt_col: str, generator: Generator, out: str = "response", at_once: int | None = None) -> DataFrame:
    """Adds the response and an error: one row's failure doesn't stop the others. ``at_once`` limits the partitions, and so the calls at a time."""
    df = df if at_once is None else df.coalesce(at_once)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            try:
                got: list[tuple[str | None, str | None]] = [(r, None if r is not None else "no response") for r in generator.generate(x.tolist())]
            except Exception:
                got = []
                for p in x:
                    try:
                        got.append((generator.generate([p])[0], None))
                    except Exception as e:
                        got.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(got, columns=["r", "e"])

    udf = pandas_udf(run, "struct<r:string,e:string>")
    return df.withColumn("_g", udf(F.col(prompt_col))).withColumns({out: F.col("_g.r"), f"{out}_error": F.col("_g.e")}).drop("_g")
