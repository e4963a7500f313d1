"""SimHash near-duplicates by multi-index hashing.

Words are runs of other than ASCII white space, A-Z lower-cased; a shingle is consecutive words joined by a space,
counted with repeats (fewer words: the whole sequence; none: fingerprint zero). A bit of the
fingerprint is 1 if set in over half of the shingles' hashes (XXH64, seed 42; words after the first
64 bits mix that hash further). Equal fingerprints are one node. Each node is put into a table under the value of
each segment of its fingerprint and, for segments with radius 1, under the values one set
bit away; two nodes whose segment values differ in one bit meet under the larger one. With radius 2 it is put under all values one bit
away, and two that differ in two bits meet between them. Nodes that meet are compared over
all bits. A bucket of some nodes yields a spanning forest of its links, not all pairs. Where 2 of 64 bits may differ, the nodes
of buckets with more than ``MAX_BUCKET`` don't gather there: they meet at the fingerprints one bit from them or
fewer, of which each has 65 nodes at most, and two nodes have one in common exactly if they link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import NULL_ID, Scratch, row_key
from .components import stars

SEED = 42
CHUNK = 100_000
CROWD = 16
MAX_BUCKET = 4096


def _more_bits(h: np.ndarray, word: int) -> np.ndarray:
    """A further 64 bits from each hash (the finaliser of splitmix64)."""
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip((ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), np.uint64, len(words) - size + 1)


def hash_prints(hashes: Iterable[np.ndarray], n_words: int, rows: int | None = None) -> np.ndarray:
    """One row of n_words 64-bit words for each list of hashes; ``rows`` if their number isn't known."""
    out = np.zeros((len(hashes) if rows is None else rows, n_words), np.uint64)
    held: list[np.ndarray] = []
    at: list[int] = []
    total = 0

    def flush() -> None:
        if not held:
            return
        h, n = np.concatenate(held), np.array([len(x) for x in held])
        starts = np.cumsum(n) - n
        for w in range(n_words):
            counts = np.zeros((len(n), 64), np.int32)
            for first in range(0, len(h), CHUNK):  # a very long text is counted in parts
                part = h[first : first + CHUNK]
                bits = np.unpackbits((_more_bits(part, w) if w else part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                own = np.flatnonzero((starts < first + len(part)) & (starts + n > first))
                counts[own] += np.add.reduceat(bits, np.maximum(starts[own] - first, 0), axis=0, dtype=np.int32)
            out[at, w] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]

    for i, h in enumerate(hashes):
        if len(h):
            held.append(h)
            at.append(i)
            total += len(h)
        if total >= CHUNK:
            flush()
            held, at, total = [], [], 0
    flush()
    return out


def fingerprints(texts: list[bytes], size: int, n_words: int) -> np.ndarray:
    return hash_prints((shingle_hashes(t, size) for t in texts), n_words, len(texts))


def _fingerprint(size: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints([x or b"" for x in batch.column(3).to_pylist()], size, n_words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(prints[:, w]) for w in range(n_words)], names=["rid", "d", "doc", *(f"f{w}" for w in range(n_words))])

    return run


def segment_keys(prints: np.ndarray, segments: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """segments: (first bit, bits, radius 0 to 2), none across 64-bit words. Yields rows and the bucket of each."""
    everyone = np.arange(len(prints))
    for k, (first, bits, radius) in enumerate(segments):
        value = (prints[:, first // 64].view(np.uint64) >> np.uint64(first % 64)) & np.uint64((1 << bits) - 1)
        tag = np.uint64(k << 56)
        yield everyone, (value | tag).view(np.int64)
        for b in range(bits if radius else 0):
            rows = everyone if radius == 2 else np.flatnonzero((value >> np.uint64(b)) & np.uint64(1) == 0)
            yield rows, (value[rows] ^ np.uint64(1 << b) | tag).view(np.int64)


def _deal(segments: list[tuple[int, int, int]], n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.stack([batch.column(w).to_numpy(zero_copy_only=False) for w in range(n_words)], axis=1)
            for rows, bucket in segment_keys(prints, segments):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket)] + [pa.array(prints[rows, w]) for w in range(n_words)], names=["bucket", *(f"f{w}" for w in range(n_words))])

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, as numpy counts those of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect exactly what links of up to ``distance`` connect: a breadth-first search that compares each node reached with those not yet reached."""
    rest, found = np.arange(len(prints)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = _apart(prints[rest], prints[x]) <= distance
            if near.any():
                reached = rest[near].tolist()
                found += [(x, y) for y in reached]
                todo += reached
                rest = rest[~near]
    return found


def bucket_links(bucket: np.ndarray, node: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets, which are in order."""
    n = len(bucket)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, n))
    crowded = np.repeat(sizes > CROWD, sizes)
    left, right = [], []
    for k in range(1, min(CROWD, int(sizes.max(initial=1)))):
        i = np.flatnonzero((bucket[k:] == bucket[:-k]) & ~crowded[k:])
        i = i[_apart(prints[i], prints[i + k]) <= distance]
        left.append(i)
        right.append(i + k)
    for s, m in zip(starts[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist(), strict=True):
        pairs = forest(prints[s : s + m], distance)
        if pairs:
            x, y = np.array(pairs).T
            left.append(x + s)
            right.append(y + s)
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
    return node[x], node[y]


def _link(distance: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def solve(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not held:
                return
            bucket, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))
            held, size = ([(bucket[cut:], prints[cut:])] if cut < len(bucket) else []), len(bucket) - cut
            u, v = bucket_links(bucket[:cut], np.arange(cut), prints[:cut], distance)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(prints[x, w]) for x in (u, v) for w in range(n_words)], names=[f"{x}{w}" for x in "uv" for w in range(n_words)])

        for batch in batches:
            prints = np.stack([batch.column(1 + w).to_numpy(zero_copy_only=False) for w in range(n_words)], axis=1)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), prints))
            size += len(prints)
            if size >= 2 * sum(len(h[0]) for h in held[:1]) and size >= 100_000:
                yield from solve(False)
        yield from solve(True)

    return run


def _ball_links(nodes: DataFrame) -> DataFrame:
    """Links u, v that connect the 64-bit fingerprints f0 of nodes just as all links of up to 2 bits do: each to the least one beside a shared neighbour."""
    balls = nodes.select("node", F.expr("explode(concat(array(f0), transform(sequence(0, 63), b -> f0 ^ shiftleft(1L, b))))").alias("centre"))
    least = balls.groupBy("centre").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return balls.join(least, "centre").where("node > v").select(F.col("node").alias("u"), "v").distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, bits: int = 64, distance: int = 2, segments: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """rid, d, doc, f0.. (the fingerprint), root (a number of the component), component (its least id; null if it has no id but null).

    With the default segments (32 bits with radius 1, 32 bits with radius 0) every pair within distance 2 meets: if neither
    half agrees wholly, both differ in one bit. Null text counts as empty; rows without words link with one another.
    """
    n_words = bits // 64
    segments = segments or [(0, 32, 1), (32, 32, 0)]
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    f = [f"f{w}" for w in range(n_words)]
    sent = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t"))
    rows = scratch.table(sent.mapInArrow(_fingerprint(words, n_words), "rid long, d long, doc long, " + ", ".join(f"{x} long" for x in f)))

    def name(*words: str) -> Column:
        return F.col(words[0]) if n_words == 1 else F.xxhash64(*words)

    nodes = scratch.table(rows.groupBy(*f).agg(F.min(F.coalesce("doc", F.lit(2**63 - 1))).alias("least")).select(name(*f).alias("node"), *f, "least"))
    dealt = nodes.select(*f).mapInArrow(_deal(segments, n_words), "bucket long, " + ", ".join(f"{x} long" for x in f))
    found = None
    if (bits, distance) == (64, 2):
        crowded = scratch.table(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > MAX_BUCKET).select("bucket"))
        if not crowded.isEmpty():
            found = _ball_links(dealt.join(crowded, "bucket", "left_semi").select(F.col("f0").alias("node"), "f0").distinct())
            dealt = dealt.join(crowded, "bucket", "left_anti")
    links = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link(distance, n_words), ", ".join(f"{x}{w} long" for x in "uv" for w in range(n_words)))
    links = links.select(*[name(*[f"{x}{w}" for w in range(n_words)]).alias(x) for x in "uv"])
    star = stars(links if found is None else links.unionByName(found), scratch)
    rooted = nodes.join(star.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(*f, "least", F.coalesce("root", "node").alias("root"))
    # written, so that the join on root, which many rows may share, has plain exchanges on both sides and can be split
    least = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component")))
    known = scratch.table(rooted.join(least, "root").select(*f, "root", F.nullif("component", F.lit(2**63 - 1)).alias("component")))
    return rows.join(known, f)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with the least id in their class (of rows that share it, one), all columns kept."""
    classes = simhash_classes(docs, id_col, text_col, **options)
    kept = classes.groupBy("root").agg(F.min(F.struct("d", "rid")).alias("k")).select("k.rid", "k.d")
    rows = docs.select(*row_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(kept, ["rid", "d"]).dropDuplicates(["rid", "d"]).select("row.*")


__all__ = ["NULL_ID", "fingerprints", "forest", "keep_one", "simhash_classes"]
