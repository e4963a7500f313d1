"""Repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every window of ``min_bytes`` bytes is named by the rightmost smallest hash among its
``ANCHOR``-byte strings, so equal windows have equal names wherever they stand.
A run of windows with one name is a fragment. Names seen once need no more work. Fragments of other
names are grouped by content: a content that occurs twice is repeated as a whole; contents that
share a name but differ go, one copy of each, into blocks. A block's texts are sorted to depth
``min_bytes``, transformed, and their common prefixes derived breadth-first by backward extension,
in increasing order; expansion stops at ``min_bytes``. Rows whose boundary was not reached share
that many bytes. A name whose different contents exceed ``MAX_NAME`` bytes doesn't go to one block: its windows are named by
a hash of all their bytes and counted. Names, contents and such windows are counted with map-side aggregation, so one group
may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits
from ._shared import Scratch, row_key

ANCHOR = 64
PIECE = 1 << 20
BLOCK = 1 << 20
#: Bytes that the different contents of a name, taken as 2 * min_bytes long each, may have to go through one transform.
MAX_NAME = 4 * BLOCK
#: Different contents of a name that shares a block with names near it at most.
MAX_SHARED = 64
#: Rows of a content above which its rows are found without a shuffle on it; of such contents, so many are broadcast at most.
HOT_ROWS, MAX_BROADCAST, SALTS = 10_000, 10_000, 64
SEPARATOR = 0xFF  # never a byte of UTF-8
FRAGMENT = "rid long, d long, s int, e int, key long, fh long"
SPAN = "rid long, d long, s int, e int"

_MIX = np.uint64(0xD6E8FEB86659FD93)
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)


def _anchor_hash(a: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes (a power of two) from each position."""
    h = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step, mul = 1, int(_MIX)
    while step < width:
        right = h[step:]
        h = h[:-step] * np.uint64(mul) + (right ^ (right >> np.uint64(31)))
        mul = (mul * int(_MIX) + 2) % 2**64 | 1
        step *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(m: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def fragments(a: np.ndarray, ends: np.ndarray, min_bytes: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (of bytes) and name of each fragment of the documents that end at ``ends`` in ``a`` (under 2**24 bytes)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(a) < min_bytes:
        return none
    h = _anchor_hash(a, anchor)
    back = _POS_MASK - np.arange(len(h), dtype=np.uint64)
    m = _sliding_min((h & ~_POS_MASK) | back, min_bytes - anchor + 1)
    doc_end = np.repeat(ends, np.diff(ends, prepend=0))[: len(m)]
    ok = np.arange(len(m)) + min_bytes <= doc_end
    new = np.empty(len(m), bool)
    new[0] = True
    # a document's last windows cross its end, so that the next document's first valid window follows an invalid one
    new[1:] = (m[1:] != m[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new & ok)
    if not len(starts):
        return none
    stop = np.flatnonzero(np.concatenate((new[1:] | ~ok[1:], [True])) & ok)
    at = (_POS_MASK - (m[starts] & _POS_MASK)).astype(np.int64)
    return starts, stop + min_bytes, h[at].view(np.int64)


def _pieces(texts: list[bytes], min_bytes: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of about PIECE bytes; a longer document is cut so that each window is in one piece."""
    held, size = [], 0
    for i, b in enumerate(texts):
        if len(b) < min_bytes:
            continue
        for at in range(0, len(b) - min_bytes + 1, 4 * PIECE):
            part = b[at : at + 4 * PIECE + min_bytes - 1] if len(b) > 4 * PIECE else b
            held.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _name_fragments(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, d = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            for held in _pieces(texts, min_bytes):
                joined = b"".join(p for _, _, p in held)
                ends = np.cumsum([len(p) for _, _, p in held])
                s, e, key = fragments(np.frombuffer(joined, np.uint8), ends, min_bytes)
                if not len(s):
                    continue
                view, digest = memoryview(joined), xxhash.xxh64_intdigest
                fh = np.fromiter((digest(view[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s)).view(np.int64)
                which = np.searchsorted(ends, s, side="right")
                doc = np.array([i for i, _, _ in held])[which]
                shift = np.array([at for _, at, _ in held])[which] - np.concatenate(([0], ends[:-1]))[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[doc]), pa.array(d[doc]), pa.array((s + shift).astype(np.int32)), pa.array((e + shift).astype(np.int32)), pa.array(key), pa.array(fh)],
                    names=["rid", "d", "s", "e", "key", "fh"],
                )

    return run


def sort_to_depth(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the cyclic text t in the order of their first ``depth`` bytes or more."""
    n = len(t)
    ext = np.concatenate((t, np.resize(t, 8)))
    v = np.zeros(n, np.uint64)
    for k in range(8):
        v = (v << np.uint64(8)) | ext[k : k + n]
    width = 8
    while True:
        order = np.argsort(v)
        got = v[order]
        step = np.empty(n, np.uint64)
        step[0] = 0
        step[1:] = got[1:] != got[:-1]
        ranks = np.cumsum(step, dtype=np.uint64)
        if width >= depth or int(ranks[-1]) == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = ranks
        v = (rank << np.uint64(32)) | np.roll(rank, -(width % n))
        width *= 2


def long_common_prefixes(t: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """True at row i if rows i - 1 and i of the sorted rotations share ``limit`` bytes or more.

    Breadth-first backward extension: level l holds the intervals of strings of length l whose right
    boundary has a common prefix of l - 1; extending each by every byte before its rows
    gives the boundaries with common prefix l. Boundaries not reached by level ``limit`` remain.
    """
    n = len(t)
    bwt = t[order - 1]
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by_symbol] = np.arange(n, dtype=np.int32)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by_symbol[1:]] = np.where(same, by_symbol[:-1], -1)
    after[by_symbol[:-1]] = np.where(same, by_symbol[1:], n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(limit):
        size = hi - lo + 1
        first_at = np.cumsum(size) - size
        rows = np.arange(int(size.sum())) + np.repeat(lo - first_at, size)
        right = np.sort(lf[rows[after[rows] > np.repeat(hi, size)]])
        left = np.sort(lf[rows[before[rows] < np.repeat(lo, size)]])
        fresh = unset[right + 1]
        lo, hi = left[fresh].astype(np.int64), right[fresh].astype(np.int64)
        if not len(hi):
            break
        unset[hi + 1] = False
    return unset[:n]


def repeated_windows(texts: list[bytes], min_bytes: int) -> list[np.ndarray]:
    """For each text, whether the window from each position occurs at another position of any of the texts."""
    joined = np.frombuffer(b"".join(x + b"\xff" for x in texts), np.uint8)
    order = sort_to_depth(joined, min_bytes)
    shared = long_common_prefixes(joined, order, min_bytes)
    hit = np.zeros(len(joined), bool)
    rows = np.flatnonzero(shared)
    hit[order[rows]] = True
    hit[order[rows - 1]] = True
    out, at = [], 0
    for x in texts:
        own = hit[at : at + len(x)].copy()
        own[max(0, len(x) - min_bytes + 1) :] = False
        out.append(own)
        at += len(x) + 1
    return out


def spans_of(windows: np.ndarray, min_bytes: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the marked windows; runs that touch are one."""
    at = np.flatnonzero(windows)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > min_bytes)
    return list(zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.concatenate((cut, [len(at) - 1]))] + min_bytes).tolist(), strict=True))


def _slice_texts(min_bytes: int):
    """Rows (rid, d, text, parts of crowded, block, s, e) to slices, one for fragments of a block whose windows follow one another; a crowded name's fragments stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, d, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or b""
                held: list = []
                for crowded, block, s, e in sorted({(p["crowded"], p["block"], p["s"], p["e"]) for p in parts}):
                    if held and not crowded and held[:2] == [crowded, block] and s == held[3] - min_bytes + 1:
                        held[3] = e
                    else:
                        if held:
                            out.append((*held[:2], rid, d, held[2], text[held[2] : held[3]]))
                        held = [crowded, block, s, e]
                if held:
                    out.append((*held[:2], rid, d, held[2], text[held[2] : held[3]]))
            if out:
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["crowded", "block", "rid", "d", "s", "part"])

    return run


def window_hashes(a: np.ndarray, min_bytes: int) -> np.ndarray:
    """A hash of the ``min_bytes`` bytes from each position, made of those of two overlapping parts."""
    width = 1 << (min_bytes.bit_length() - 1)
    h = _anchor_hash(a, width)
    n, shift = len(a) - min_bytes + 1, min_bytes - width
    both = h[:n] * np.uint64(0x9E3779B97F4A7C15) + (h[shift : shift + n] ^ (h[shift : shift + n] >> np.uint64(29)))
    both ^= both >> np.uint64(32)
    return both * _MIX


def _hash_windows(min_bytes: int):
    """Slices of crowded names to windows: name, hash, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                parts = some.column(4).to_pylist()
                sizes = np.array([len(x) for x in parts])
                starts = np.cumsum(sizes) - sizes
                n = sizes - min_bytes + 1
                row = np.repeat(np.arange(len(parts)), n)
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                w = window_hashes(np.frombuffer(b"".join(parts), np.uint8), min_bytes)[starts[row] + within]
                key, rid, d, s = (some.column(i).to_numpy(zero_copy_only=False)[row] for i in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(w.view(np.int64)), pa.array(rid), pa.array(d), pa.array((s + within).astype(np.int32))], names=["key", "w", "rid", "d", "s"])

    return run


def _split_block(rows: list[tuple], min_bytes: int) -> Iterator[list[tuple]]:
    """A block too large for one transform, dealt by longer anchors: equal windows still meet."""
    groups: dict[int, list[tuple]] = {}
    for rid, d, s, part in rows:
        starts, ends, keys = fragments(np.frombuffer(part, np.uint8), np.array([len(part)]), min_bytes, 128)
        for x, y, k in zip(starts.tolist(), ends.tolist(), keys.tolist(), strict=True):
            groups.setdefault(k, []).append((rid, d, s + x, part[x:y]))
    held, size = [], 0
    for group in groups.values():
        if len(group) > 1:
            held += group
            size += sum(len(r[3]) for r in group)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _expand_blocks(min_bytes: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = [(rid, d, s + x, s + y) for (rid, d, s, part), hit in zip(rows, repeated_windows([r[3] for r in rows], min_bytes), strict=True) for x, y in spans_of(hit, min_bytes)]
        cols = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["rid", "d", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block_rows: list[tuple] = []
        block, size, block_size = None, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if block_size > 4 * BLOCK:
                for part in _split_block(block_rows, min_bytes):
                    yield solve(part)
                return
            held += block_rows
            size += block_size
            if size >= BLOCK:
                yield solve(held)
                held, size = [], 0

        for batch in batches:
            for b, rid, d, s, part in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if b != block:
                    yield from close()
                    block, block_rows, block_size = b, [], 0
                if block_rows and block_rows[-1][:3] == (rid, d, s):
                    continue  # of a repeated row
                block_rows.append((rid, d, s, part))
                block_size += len(part)
        yield from close()
        if held:
            yield solve(held)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200) -> DataFrame:
    """Key (rid, d) of each row that has repeated bytes, with ``spans``: a set of (s, e), unmerged.

    Null text is empty. Texts under min_bytes have no spans. Repeated rows are documents of their own, so all their
    windows are repeated. Matches never cross rows. ``min_bytes`` is at least 137.
    """
    if min_bytes < 2 * ANCHOR + 9:
        raise ValueError(f"min_bytes must be at least {2 * ANCHOR + 9}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    keyed = docs.select(*row_key(id_col, text_col), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t"))
    named = scratch.table(keyed.mapInArrow(_name_fragments(min_bytes), FRAGMENT))
    # written, so that the join on key, which many rows may share, has plain exchanges on both sides and can be split
    twice = scratch.table(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    again = scratch.table(named.join(twice, "key"))
    scratch.drop(named, twice)
    contents = scratch.table(again.groupBy("key", "fh").agg(F.count("*").alias("n"), F.min(F.struct("rid", "d", "s", "e")).alias("one")))
    names = scratch.table(contents.groupBy("key").agg(F.count("*").alias("n_contents"), F.min("one").alias("first")).where("n_contents > 1"))
    hot = scratch.table(contents.where(F.col("n") > HOT_ROWS).select("key", "fh"))
    whole = again.join(contents.where("n > 1").select("key", "fh"), ["key", "fh"]).select("rid", "d", "s", "e")
    if not hot.isEmpty():
        left, right, on = again, F.broadcast(hot), ["key", "fh"]
        if not fits(hot, MAX_BROADCAST):
            left, right, on = again.withColumn("salt", F.pmod(F.xxhash64("rid", "d", "s"), F.lit(SALTS)).cast("int")), hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"]
        cold = left.join(right, on, "left_anti").join(contents.where(F.col("n").between(2, HOT_ROWS)).select("key", "fh"), ["key", "fh"])
        whole = cold.select("rid", "d", "s", "e").unionByName(left.join(right, on).select("rid", "d", "s", "e"))
    # fragments near one another in the first document that has them share a block, so that neighbours join into longer slices
    crowded = F.col("n_contents") * (2 * min_bytes) > MAX_NAME
    block = F.when(F.col("n_contents") > MAX_SHARED, F.col("key")).otherwise(F.xxhash64("first.rid", "first.d", F.expr("first.s div 2048")))
    parts = (
        contents.join(names, "key")
        .select("one.rid", "one.d", F.struct(crowded.alias("crowded"), block.alias("block"), "one.s", "one.e").alias("part"))
        .groupBy("rid", "d")
        .agg(F.collect_list("part").alias("parts"))
    )
    slices = scratch.table(keyed.join(parts, ["rid", "d"]).select("rid", "d", "t", "parts").mapInArrow(_slice_texts(min_bytes), "crowded boolean, block long, rid long, d long, s int, part binary"))
    dealt = slices.where("not crowded").select("block", "rid", "d", "s", "part").repartition("block").sortWithinPartitions("block", "rid", "d", "s")
    mixed = dealt.mapInArrow(_expand_blocks(min_bytes), SPAN)
    windows = slices.where("crowded").select("block", "rid", "d", "s", "part").mapInArrow(_hash_windows(min_bytes), "key long, w long, rid long, d long, s int")
    equal = scratch.table(windows.groupBy("key", "w").agg(F.count("*").alias("n")).where("n > 1").select("key", "w"))
    hit = windows.join(equal, ["key", "w"]).select("rid", "d", "s", (F.col("s") + min_bytes).alias("e"))
    return whole.unionByName(mixed).unionByName(hit).groupBy("rid", "d").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # a set: rows that repeat have their spans once


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]]) if spans else text


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans drawn in to character boundaries, so that what is left is text."""
    out = []
    for s, e in spans:
        while s < len(text) and text[s] & 0xC0 == 0x80:
            s += 1
        while e < len(text) and e > s and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text, spans = text or b"", _merged(spans)
            left = _kept(text, spans)
            rows.append((doc, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), spans))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(batch.schema.get_field_index("t")).to_pylist(), batch.column(batch.schema.get_field_index("spans")).to_pylist()
        out = [None if t is None else _kept(t, _whole_characters(t, _merged(x))).decode() for t, x in zip(texts, spans, strict=True)]
        keep = [i for i, f in enumerate(batch.schema.names) if f not in ("t", "spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.string())], names=[*(batch.schema.names[i] for i in keep), "kept"])


def _with_spans(docs: DataFrame, id_col: str, text_col: str, min_bytes: int, *cols: Column) -> DataFrame:
    """cols of each row, its text's bytes t, and its spans."""
    spans = repeated_spans(docs, id_col, text_col, min_bytes)
    keyed = docs.select(*row_key(id_col, text_col), *cols, F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t"))
    return keyed.join(spans, ["rid", "d"], "left").drop("rid", "d")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200) -> DataFrame:
    """Per row: bytes, removed bytes, maximal removed runs, SHA-256 of the rest, and the runs. Rows with a null id keep it."""
    both = _with_spans(docs, id_col, text_col, min_bytes, F.col(id_col).cast("long").alias("doc_id")).select("doc_id", "t", "spans")
    return both.mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200) -> DataFrame:
    """The rows of docs, their columns unchanged but for the text, which loses its repeated characters; null text stays null."""
    rest = [c for c in docs.columns if c != text_col]
    sent = _with_spans(docs, id_col, text_col, min_bytes, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)] + ["kept string"])
    out = sent.mapInArrow(_strip, schema)
    named = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {text_col: F.col("kept")}
    return out.select(*[named[c].alias(c) for c in docs.columns])
