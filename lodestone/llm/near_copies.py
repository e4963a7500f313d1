"""Near copies of texts: SimHash by multi-index hashing, each link confirmed by exact Jaccard similarity.

Shingles are those of ``simhash``, as a set of 64-bit hashes (a text of fewer words is one shingle; without words it has none).
Equal sets are one node. A node's fingerprint has a bit for each of several hundred: set if it is in over half of the set's hashes.
``layout`` cuts it into segments so wide that a bucket holds few nodes of other texts, and so many that two sets at the asked
similarity meet with probability 0.99 or more: in some segment they differ in two bits or fewer. A node is put into a table under each
value of the Hamming ball of radius 1 about each segment; two nodes meet where their balls do. Nodes that meet are compared over all bits,
and those within ``limit`` are candidates, which are confirmed on the whole sets.

A group of n copies has n * n candidates, so they are tried in two waves: first each node with the least of those that it
meets in a bucket, and as many pairs more as connect all that meet there. If some of a group meet others too, all the nodes that candidates connect
are compared, except where the links found so far have joined them: those outside the group's largest class are dealt, with their sets, to parts of the
group, and a part confirms its own pairs. So every candidate pair is either confirmed, refused or inside one class, and no task holds a whole group. A
bucket of more than ``MAX_BUCKET`` nodes is dealt in parts in the first wave, and all its nodes are one group for the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import NULL_ID, Scratch, row_key
from .components import stars
from .simhash import SEED, hash_prints, segment_keys, shingle_hashes

#: Nodes of a bucket on average, at most, and nodes of one that are compared in one task, at most.
OCCUPANCY, MAX_BUCKET = 256, 4096
#: Hashes of the sets that a part of a group has, on average, at most.
PART_HASHES = 500_000
#: Texts, and pairs of sets, that a worker holds at once.
SLICE = 500
#: Of pairs at the asked similarity, the part that may fail to meet.
MISSED = 0.01
Ratio = tuple[int, int]


def layout(rows: int, ratio: Ratio, missed: float = MISSED) -> tuple[int, list[tuple[int, int, int]], int]:
    """64-bit words of a fingerprint, segments (first bit, bits, radius 2) and the limit of differing bits, for so many rows."""
    share = ratio[0] / ratio[1]
    p = acos(2 * share / (1 + share)) / pi  # that a bit differs, for sets of one size, the worst case
    width = next(w for w in range(12, 33) if w == 32 or rows * (w + 1) <= OCCUPANCY << w)
    meet = sum(comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(3))
    n, per_word = ceil(log(missed) / log(1 - meet)), 64 // width
    words = max(2, ceil(n / per_word))
    places = [(64 * (i // per_word) + width * (i % per_word), width, 2) for i in range(n)]
    return words, places, ceil(64 * words * p + 3 * sqrt(64 * words * p * (1 - p)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _nodes(size: int, n_words: int, with_set: bool):
    """Rows (rid, d, text) to their node, fingerprint and, if asked, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [np.unique(shingle_hashes(t or b"", size)) for t in batch.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            prints = hash_prints(sets, n_words).view(np.int64)
            cols, names = [batch.column(0), batch.column(1), pa.array(node), *(pa.array(prints[:, w]) for w in range(n_words))], ["rid", "d", "node", *(f"f{w}" for w in range(n_words))]
            if with_set:
                cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))))
                names.append("s")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _deal(segments: list[tuple[int, int, int]], n_words: int):
    """Nodes (node, fingerprint) to a row for each of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                prints = np.stack([part.column(1 + w).to_numpy(zero_copy_only=False) for w in range(n_words)], axis=1)
                for rows, bucket in segment_keys(prints, segments):
                    if len(rows):
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), *(c.take(take) for c in part.columns)], names=["bucket", *part.schema.names])

    return run


def _within(start: np.ndarray, end: np.ndarray, limit: int, prints: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j, differing bits) of one bucket that may be linked. end: of each row's bucket; apart: labels that must differ."""
    i, k = start, 1
    while len(i := i[i + k < end[i]]):
        j = i + k
        ok = apart[i] != apart[j]
        x, y = i[ok], j[ok]
        bits = np.bitwise_count(prints[x, 0] ^ prints[y, 0]).astype(np.int32)
        for w in range(1, prints.shape[1]):
            bits += np.bitwise_count(prints[x, w] ^ prints[y, w])
        near = bits <= limit
        if near.any():
            yield x[near], y[near], bits[near]
        k += 1


def first_pairs(bucket: np.ndarray, node: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the least that it meets in its bucket, and what else connects all that meet; and, as a pair of a node with itself, one of those among whom other pairs meet too."""
    n = len(bucket)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    degree, least = np.zeros(n, np.int64), np.full(n, n)
    for i, j, _ in _within(np.arange(n), end, limit, prints, node):
        for a, b in ((i, j), (j, i)):  # neither has a row twice
            degree[a] += 1
            least[a] = np.minimum(least[a], b)
    met = np.flatnonzero(degree)
    pairs = np.unique(np.sort(np.stack((met, least[met])), axis=0), axis=1)
    busy = np.flatnonzero(degree > np.bincount(pairs.ravel(), minlength=n))
    if len(busy):  # what these pairs leave apart, though some pair meets, gets one pair more
        label = _labels(n, pairs)
        more = [np.zeros((4, 0), np.int64)]
        for i, j, _ in _within(busy, end, limit, prints, label):
            more.append(np.stack((np.minimum(label[i], label[j]), np.maximum(label[i], label[j]), i, j)))
        found = np.concatenate(more, axis=1)
        pairs = np.concatenate((pairs, found[2:, np.unique(found[:2], axis=1, return_index=True)[1]]), axis=1)
        busy = np.unique(_labels(n, pairs)[busy])
    return node[np.concatenate((pairs[0], busy))], node[np.concatenate((pairs[1], busy))]


def _labels(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least row that pairs connect to each."""
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[pairs[0]], label[pairs[1]])
        np.minimum.at(label, pairs[0], low)
        np.minimum.at(label, pairs[1], low)
        label = label[label]
    return label


def _meet(n_words: int, limit: int):
    """Rows (bucket, part, node, fingerprint), those of a part of a bucket together, to pairs u, v; u = v: a node in whose group more pairs meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def solve(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not held:
                return
            x = np.concatenate(held, axis=1)
            group = np.concatenate(([0], np.cumsum((x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1]))))
            cut = x.shape[1] if last else int(np.searchsorted(group, group[-1]))
            held, size = [x[:, cut:]], x.shape[1] - cut
            if not cut:
                return
            prints = np.ascontiguousarray(x[3:, :cut].T).view(np.uint64)
            u, v = first_pairs(group[:cut], x[2, :cut], prints, limit)
            both = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v))), axis=1)
            for at in range(0, both.shape[1], 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(both[0, at : at + 50_000]), pa.array(both[1, at : at + 50_000])], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3 + n_words)]))
            size += batch.num_rows
            if size >= 50_000 and size >= 2 * held[0].shape[1]:
                yield from solve(False)
        yield from solve(True)

    return run


def _confirm(ratio: Ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            a, b = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = ratio[1] * both >= ratio[0] * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def part_links(node: np.ndarray, root: np.ndarray, right: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], limit: int, ratio: Ratio) -> list[tuple[int, int]]:
    """Links that join what the pairs of a ``right`` node with any node join, of those within limit and of similarity ratio; roots that are equal are joined already."""
    sizes = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    found = []
    for r in np.flatnonzero(right).tolist():
        near = np.bitwise_count(prints ^ prints[r]).sum(axis=1, dtype=np.int32) <= limit
        near &= root != root[r]
        if not near.any():
            continue
        lo, hi = np.searchsorted(every, sets[r], "left"), np.searchsorted(every, sets[r], "right")
        n = hi - lo
        both = np.bincount(owner[np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)], minlength=len(sets))
        for x in np.flatnonzero(near & (ratio[1] * both >= ratio[0] * (sizes + sizes[r] - both))).tolist():
            a, b = top(int(root[r])), top(int(root[x]))
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((int(node[r]), int(node[x])))
    return found


def _compare(n_words: int, limit: int, ratio: Ratio):
    """Rows (class, part, right, node, root, fingerprint, set), those of a part of a class together, to links u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def solve() -> Iterator[pa.RecordBatch]:
            if held:
                right, node, root, prints, sets = zip(*held, strict=True)
                found = part_links(np.array(node), np.array(root), np.array(right), np.stack(prints).view(np.uint64), list(sets), limit, ratio)
                if found:
                    u, v = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            group, part, right, node, root = (batch.column(i).to_pylist() for i in range(5))
            prints = np.stack([batch.column(5 + w).to_numpy(zero_copy_only=False) for w in range(n_words)], axis=1)
            for i in range(batch.num_rows):
                if (group[i], part[i]) != key:
                    yield from solve()
                    held, key = [], (group[i], part[i])
                held.append((right[i], node[i], root[i], prints[i].copy(), batch.column(5 + n_words)[i].values.to_numpy().copy()))
        yield from solve()

    return run


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, ratio: Ratio = (4, 5)) -> tuple[DataFrame, DataFrame]:
    """Rows as (rid, d, node), and (node, root) of the nodes that links of Jaccard similarity ratio or more connect to another, which has the least number.

    Null, empty and word-less texts have one set, the empty one, and so one node. Repeated rows share a node.
    """
    scratch = Scratch(docs.sparkSession, "near")
    n_words, segments, limit = layout(docs.count(), ratio)
    f = [f"f{w}" for w in range(n_words)]
    kinds = ", ".join(f"{x} long" for x in f)
    sent = docs.select(*row_key(id_col, text_col), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t"))
    own = f"rid long, d long, node long, {kinds}"
    made = scratch.table(sent.mapInArrow(_nodes(words, n_words, False), own))
    nodes = scratch.table(made.groupBy("node", *f).agg(F.min(F.struct("d", "rid")).alias("k")))
    entries = nodes.select("node", *f).mapInArrow(_deal(segments, n_words), f"bucket long, node long, {kinds}")

    def named(star: DataFrame, label: str) -> DataFrame:
        return star.select(F.col("u").alias("node"), F.col("v").alias(label))

    # a bucket of so many has a value of its segment that a part of them share
    values = [F.shiftrightunsigned(f"f{at // 64}", at % 64).bitwiseAND((1 << bits) - 1).bitwiseOR(F.lit(k << 56)) for k, (at, bits, _) in enumerate(segments)]
    often = nodes.select(F.explode(F.array(*values)).alias("value")).groupBy("value").count().where(F.col("count") > MAX_BUCKET // (segments[0][1] + 1))
    part, apart = F.lit(0).cast("long"), None
    if not often.isEmpty():
        crowded = scratch.table(entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("v")).where(F.col("n") > MAX_BUCKET))
        if not crowded.isEmpty():
            apart = scratch.table(entries.select("bucket", F.col("node").alias("u")).join(crowded, "bucket").where("u <> v").select("u", "v").distinct())
            entries = entries.join(crowded, "bucket", "left")
            part = F.coalesce(F.expr(f"pmod(xxhash64(node, bucket), (n + {MAX_BUCKET - 1}) div {MAX_BUCKET})"), part)
    dealt = entries.select("bucket", part.alias("part"), "node", *f).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")
    tried = scratch.table(dealt.mapInArrow(_meet(n_words, limit), "u long, v long").distinct())
    pairs, busy = tried.where("u <> v"), tried.where("u = v").select(F.col("u").alias("node"))
    grouped = pairs if apart is None else pairs.unionByName(apart)  # the nodes of a crowded bucket are one group, of pairs not tried
    busy = busy if apart is None else busy.unionByName(apart.select(F.col("u").alias("node"))).distinct()
    live = grouped.select(F.col("u").alias("node")).union(grouped.select("v")).distinct()
    # texts are read again for the few sets that are compared; the condition on the key lets Spark filter texts by a Bloom filter before their shuffle
    wanted = scratch.table(nodes.join(live, "node", "left_semi").select("k.rid", "k.d"))
    texts = sent.join(wanted.where(F.col("rid") >= NULL_ID), ["rid", "d"])
    sets = scratch.table(texts.mapInArrow(_nodes(words, n_words, True), own + ", s array<long>").drop("rid", "d").dropDuplicates(["node"]))
    a, b = sets.select(F.col("node").alias("u"), F.col("s").alias("x")), sets.select(F.col("node").alias("v"), F.col("s").alias("y"))
    links = scratch.table(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(_confirm(ratio), "u long, v long"))
    star = stars(links, scratch)
    more = scratch.table(_open_parts(sets, named(stars(grouped, scratch), "class"), named(star, "root"), busy, f).mapInArrow(_compare(n_words, limit, ratio), "u long, v long"))
    if not more.isEmpty():
        star = stars(links.unionByName(more), scratch)
    scratch.drop(nodes, tried)
    return made.select("rid", "d", "node"), named(star, "root")


def _open_parts(sets: DataFrame, classes: DataFrame, roots: DataFrame, busy: DataFrame, f: list[str]) -> DataFrame:
    """The nodes of groups that have pairs not tried yet, dealt so that each outside a group's largest class meets all its nodes in some part."""
    known = sets.select("node", F.size("s").alias("n")).join(classes, "node", "left").join(roots, "node", "left").join(busy.withColumn("busy", F.lit(1)), "node", "left")
    known = known.select("node", "n", F.coalesce("class", "node").alias("class"), F.coalesce("root", "node").alias("root"), "busy")
    sizes = known.groupBy("class", "root").agg(F.sum("n").alias("n"), F.max("busy").alias("busy"))
    open_ = sizes.groupBy("class").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("strays"), F.max("busy").alias("busy")).where("strays > 0 and busy = 1")
    parts = open_.select("class", "top", F.expr(f"n div {PART_HASHES} + 1").alias("lefts"), F.expr(f"strays div {PART_HASHES} + 1").alias("rights"))
    here = known.select("node", "class", "root").join(parts, "class")
    left = here.select("*", F.lit(False).alias("right"), F.explode(F.expr("sequence(0L, rights - 1)")).alias("y"), F.expr("pmod(xxhash64(node), lefts)").alias("x"))
    right = here.where("root <> top").select("*", F.lit(True).alias("right"), F.expr("pmod(xxhash64(node, 1), rights)").alias("y"), F.explode(F.expr("sequence(0L, lefts - 1)")).alias("x"))
    # a node that is on both sides of a part comes once, as a right one
    dealt = left.unionByName(right).groupBy("class", "root", "node", F.expr("x * rights + y").alias("part")).agg(F.max("right").alias("right"))
    return dealt.join(sets, "node").select("class", "part", "right", "node", "root", *f, "s").repartition("class", "part").sortWithinPartitions("class", "part", "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row of docs with the least id of each class, all columns kept; of rows that share an id, that of least hash of the text, then of the other columns.

    Null, empty and word-less texts are one class, of which one row stays. Rows with a null id count as the least id.
    """
    rows, star = similar_classes(docs, id_col, text_col, **options)
    one = rows.groupBy("node").agg(F.min(F.struct("d", "rid")).alias("k")).join(star, "node", "left")
    kept = one.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k")).select("k.rid", "k.d")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    return docs.select(*row_key(id_col, text_col), row.alias("row"), order.alias("o")).join(kept, ["rid", "d"]).groupBy("rid", "d").agg(F.min_by("row", "o").alias("row")).select("row.*")


__all__ = ["keep_one", "layout", "similar_classes"]
