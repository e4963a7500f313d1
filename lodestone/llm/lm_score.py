"""Masked pseudo-likelihood scores from a bidirectional window network over words.

Tokens are words: runs of bytes that are neither ASCII white space nor ASCII punctuation, each punctuation byte by itself, and each code
point from U+3000 on begins one. Case, accents, digits and all scripts are told apart. A word is known by the first
2**20 values of its hash (its bucket); words that share one are one word to the model.

The probability of a word between its two left and two right neighbours has two factors: the network's, of the word's class, and
the word's share in the counts of its class. The commonest words are classes of their own; the others are dealt by hash.
Over all buckets the product sums to 1. A document's score is the sum of the logarithms over all its words.

Counts take in every word of every text: counted in the tasks, summed by Spark. The network is trained in numpy, in rounds that
together pass once over every window of every text: in a round each partition trains on its share of rows, and the weights are averaged,
weighted by the windows seen. What is trained on grows with the corpus; a partition of few windows passes over them more than once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

REACH = 2
BUCKET_BITS, INPUT_BITS = 20, 14
BUCKETS, PAD = 1 << BUCKET_BITS, 1 << INPUT_BITS
#: Words that are classes of their own, and classes that share the rest.
OWN, SHARED = 64, 16
CLASSES = OWN + SHARED
WIDTH, HIDDEN = 8, 32
#: Added to each bucket's count, so that words that weren't counted have a probability.
PRIOR = 0.01
CHUNK = 1 << 20
ROUNDS, BATCH, RATE = 4, 4096, 0.01
#: A partition with fewer steps in a round passes over its windows again.
LEAST_STEPS = 60
#: Tasks that average what the trainers of a round found, each to one row of fixed size.
AVERAGERS = 8

_SPACE, _WORD, _MARK, _WIDE, _REST = range(5)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each byte of UTF-8."""
    out = np.full(256, _WORD, np.uint8)
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
    out[[c for c in range(128) if chr(c).isprintable() and not chr(c).isalnum() and c != 0x20]] = _MARK
    out[0x80:0xC0] = _REST
    out[0xE3:] = _WIDE
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of the texts, in order, and the number of its text."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    kind = _kinds()[data]
    before = np.concatenate(([_SPACE], kind[:-1]))
    at = np.flatnonzero((kind == _MARK) | (kind == _WIDE) | ((kind == _WORD) & ((before == _SPACE) | (before == _MARK))))
    if not len(at):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    powers = np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = np.where(kind == _SPACE, 0, data.astype(np.uint64) + 1)[at[0] :].astype(np.uint64) * powers[place]
    h = np.add.reduceat(value, at - at[0])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.searchsorted(ends, at, side="right")


def contexts(bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The input numbers of the two words to the left and the two to the right of each place; PAD beyond the text."""
    n = len(bucket)
    out = np.full((n, 2 * REACH), PAD, np.int32)
    word = bucket >> (BUCKET_BITS - INPUT_BITS)
    for d in range(1, REACH + 1):
        same = doc[d:] == doc[:-d]
        out[d:, REACH - d][same] = word[:-d][same]
        out[: n - d, REACH + d - 1][same] = word[d:][same]
    return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < CHUNK or end == at):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = [x or "" for x in batch.column(0).to_pylist()]
        for at, end in _chunks(texts):
            bucket, n = np.unique(words(texts[at:end])[0], return_counts=True)
            counts[bucket] += n
    seen = np.flatnonzero(counts)
    for at in range(0, len(seen), 50_000):
        some = seen[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["bucket", "n"])


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each bucket, and the logarithm of the bucket's share in its class. Of equal counts the lesser bucket comes first."""
    top = np.argsort(-counts, kind="stable")[:OWN]
    of = (OWN + np.arange(len(counts)) % SHARED).astype(np.uint8)
    of[top] = np.arange(OWN)
    mass = counts + PRIOR
    return of, np.log(mass / np.bincount(of, mass, CLASSES)[of]).astype(np.float32)


def start_weights(shares: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """The embedding, two layers and their offsets; without input each class has its share."""
    rng = np.random.default_rng(seed)
    return [
        rng.normal(0, 0.3, (PAD + 1, WIDTH)).astype(np.float32),
        rng.normal(0, (2 * REACH * WIDTH) ** -0.5, (2 * REACH * WIDTH, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        np.zeros((HIDDEN, CLASSES), np.float32),
        np.log(shares).astype(np.float32),
    ]


def forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedded inputs, hidden layer and log-probabilities of the classes, for rows of four input numbers."""
    emb, w1, b1, w2, b2 = weights
    e = emb[x].reshape(len(x), -1)
    h = np.tanh(e @ w1 + b1)
    z = h @ w2 + b2
    z -= z.max(axis=1, keepdims=True)
    return e, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradients(weights: list[np.ndarray], x: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the target classes, and its gradients."""
    emb, w1, _, w2, _ = weights
    e, h, logp = forward(weights, x)
    rows = np.arange(len(x))
    loss = -float(logp[rows, target].mean())
    dz = np.exp(logp)
    dz[rows, target] -= 1
    dz /= len(x)
    dh = (dz @ w2.T) * (1 - h * h)
    de = (dh @ w1.T).reshape(-1, WIDTH)
    flat = x.ravel()
    demb = np.stack([np.bincount(flat, de[:, k], len(emb)) for k in range(WIDTH)], axis=1).astype(emb.dtype)
    return loss, [demb, e.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]


class Trainer:
    """Adam over batches of windows, from given weights."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights = [w.copy() for w in weights]
        self.m, self.v = ([np.zeros_like(w) for w in weights] for _ in range(2))
        self.rate, self.step, self.seen = rate, 0, 0

    def learn(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over the windows, in an order drawn anew."""
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            _, grads = gradients(self.weights, x[rows], target[rows])
            self.step += 1
            self.seen += len(rows)
            for w, m, v, g in zip(self.weights, self.m, self.v, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.02 * (g * g - v)
                w -= np.float32(self.rate / (1 - 0.9**self.step)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.98**self.step))) + np.float32(1e-8))


def windows(texts: list[str], of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Input numbers and target classes of all places, a chunk of texts at a time."""
    for at, end in _chunks(texts):
        bucket, doc = words(texts[at:end])
        if len(bucket):
            yield contexts(bucket, doc), of[bucket]


def train(weights: list[np.ndarray], batches: Iterator[list[str]], of: np.ndarray, rate: float, seed: int) -> Trainer:
    """Passes over every window of the texts; over those of a small set again, until there were LEAST_STEPS steps. Only such a set is held."""
    trainer, rng = Trainer(weights, rate), np.random.default_rng(seed)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for texts in batches:
        for x, target in windows(texts, of):
            trainer.learn(x, target, rng)
            held = [*held, (x, target)] if trainer.step < LEAST_STEPS else []
    seen = trainer.seen
    while held and trainer.step < LEAST_STEPS:
        trainer.learn(*(np.concatenate(p) for p in zip(*held, strict=True)), rng)
    trainer.seen = seen
    return trainer


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0.0
    for batch in batches:
        for share, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = share * np.frombuffer(w, np.float32).astype(np.float64)
            total = found if total is None else total + found
            n += share
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()])], names=["n", "w"])


class Model:
    """Weights of the network, and class and log-share of each bucket: of one size whatever the corpus."""

    def __init__(self, weights: list[np.ndarray], of: np.ndarray, inner: np.ndarray):
        self.weights, self.of, self.inner = weights, of, inner

    def log_probabilities(self, bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.empty(len(bucket))
        x, target = contexts(bucket, doc), self.of[bucket]
        for at in range(0, len(bucket), BATCH):
            logp = forward(self.weights, x[at : at + BATCH])[2]
            out[at : at + BATCH] = logp[np.arange(len(logp)), target[at : at + BATCH]]
        return out + self.inner[bucket]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Counts of all words, and the network trained on the windows of every text. Null and empty texts add nothing; repeated rows count as often as they come. Without words every class has the same share."""
    scratch = Scratch(docs.sparkSession, "words")
    part = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(rounds))
    texts = docs.select(F.col(text_col).cast("string").alias("t"), part.alias("part")).where("t is not null")
    counted = scratch.table(texts.select("t").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    got = counted.toArrow()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    of, inner = classes(counts)
    mass = np.bincount(of, counts + PRIOR, CLASSES)
    weights = start_weights(mass / mass.sum())
    for k in range(rounds if counts.any() else 0):
        rate = RATE * 0.5**k

        def run(batches: Iterator[pa.RecordBatch], weights: list[np.ndarray] = weights, rate: float = rate, k: int = k) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            trainer = train(weights, (b.column(0).to_pylist() for b in batches), of, rate, task * rounds + k)
            if trainer.seen:
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([float(trainer.seen)]), pa.array([np.concatenate([w.ravel() for w in trainer.weights]).tobytes()])], names=["task", "n", "w"])

        found = texts.where(F.col("part") == k).select("t").mapInArrow(run, "task int, n double, w binary")
        means = found.repartition(AVERAGERS, "task").sortWithinPartitions("task").mapInArrow(_average, "n double, w binary").collect()  # AVERAGERS rows at most, of one size
        if means:
            means.sort(key=lambda r: bytes(r["w"]))
            n = np.array([r["n"] for r in means])
            mean = sum(np.frombuffer(r["w"], np.float32) * s for r, s in zip(means, n / n.sum(), strict=True)).astype(np.float32)
            cut = np.cumsum([w.size for w in weights])[:-1]
            weights = [x.reshape(w.shape) for x, w in zip(np.split(mean, cut), weights, strict=True)]
    scratch.drop(counted)
    return Model(weights, of, inner)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (words), pseudo_log_likelihood (sum) and per_token (its mean; null without words; null text is empty).

    Whole texts are scored, of any length; repeated rows have a result each, and the same one. A null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for at, end in _chunks(texts):
                bucket, doc = words(texts[at:end])
                sums[at:end] = np.bincount(doc, model.log_probabilities(bucket, doc), end - at)
                sizes[at:end] = np.bincount(doc, minlength=end - at)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = pa.array(sums / sizes, mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sums), mean], names=["doc_id", "n_tokens", "pseudo_log_likelihood", "per_token"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, pseudo_log_likelihood double, per_token double")
