"""Packing by the sum of squares.

Each partition is a stream of documents. A document's whole windows are cut off first; the rest goes, online, to the fill
level that least raises the sum over levels of the squared number of partly filled windows at that level
(an empty window counts as level zero). What is still open at the end of a stream is cut to whole windows, and the last
of it to powers of two, so that a stream wastes nothing. Open windows hold four bytes for each of their tokens, so a stream's
memory is bounded by its partition, whose size spark.sql.files.maxPartitionBytes sets; how many are open doesn't change what is done.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import byte_alphabet

LENGTH = 2048
END = 1
MEMO = 350_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Words that the tokenizer's normaliser only lower-cases and whose splits are those of PIECES: printable ASCII but for the apostrophe, and Latin-1 letters.
PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall


class Encoder(dict):
    """Token ids, as little-endian 32-bit bytes, by word; words met are remembered.

    The tokenizer drops white space and no piece crosses ASCII white space. Plain words go to its model, split as it would, and others to the whole of it.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if not PLAIN(text) or "<|" in text:  # which starts the special tokens
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            pieces = PIECES(text.lower())
            if len(pieces) > 1:
                ids = b"".join([self[p.encode()] for p in pieces])
            else:
                ids = array("I", [t.id for t in self.model.tokenize(pieces[0].encode().decode("latin-1").translate(self.letters))]).tobytes()
        self[word] = ids
        return ids

    def words(self, text: str) -> list[bytes]:
        """Lower-cased here already, as the tokenizer would, unless a combining mark could join a capital."""
        b = text.encode()
        return (b if b"\xcc" in b else b.lower()).split()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > MEMO:
            self.clear()
        return [b"".join(map(self.__getitem__, self.words(t))) for t in texts]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path)


class Packer:
    """Takes pieces (document, start, ids) online; gives closed windows, lists of pieces."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(length + 1)]

    def level(self, size: int) -> int:
        """The fill level to which size is added: of least cost, of equals the fullest."""
        top = self.length - size
        below, above = self.count[1 : top + 1], self.count[1 + size : top + size + 1]
        cost = np.where(below > 0, 2 * (above - below) + 2, np.iinfo(np.int64).max)
        if top and below[-1] > 0:
            cost[-1] = 1 - 2 * below[-1]  # full windows aren't counted
        new = 2 * int(self.count[size]) + 1
        if not len(cost):
            return 0
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return best + 1 if cost[best] <= new else 0

    def add(self, doc: int, start: int, ids: np.ndarray) -> list | None:
        size = len(ids)
        if size == self.length:
            return [(doc, start, ids)]
        h = self.level(size)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        window.append((doc, start, ids))
        if h + size == self.length:
            return window
        self.open[h + size].append(window)
        self.count[h + size] += 1
        return None

    def close(self) -> Iterator[list]:
        """What is open, cut to whole windows and at last to powers of two."""
        pieces = [p for windows in self.open[::-1] for w in windows for p in w]
        left = sum(len(p[2]) for p in pieces)
        self.count[:] = 0
        self.open = [[] for _ in self.open]
        window: list = []
        room = 0
        for doc, start, ids in pieces:
            while len(ids):
                if not room:
                    if window:
                        yield window
                    window = []
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                part = ids[:room]
                window.append((doc, start, part))
                start, ids, room, left = start + len(part), ids[len(part) :], room - len(part), left - len(part)
        if window:
            yield window


def _pack(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length)
        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal made
            at = 0
            for (doc, total), start, ids in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids), total, made, at))
                at += len(ids)
            made += 1

        def batch_out() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(docs), 500):
                ids_of = encoder(path).encode([x or "" for x in texts.slice(at, 500).to_pylist()])
                for doc, ids in zip(docs[at : at + 500], ids_of, strict=True):
                    a = np.append(np.frombuffer(ids, "<u4"), np.uint32(END)).astype("<u4")
                    for start in range(0, len(a), length):
                        if window := packer.add((doc, len(a)), start, a[start : start + length]):
                            emit(window)
                if len(rows) >= 10_000:
                    yield batch_out()
        for window in packer.close():
            emit(window)
        if rows:
            yield batch_out()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty: one piece, of the end token. Repeated rows are documents of their own. Each input partition packs its rows in their order
    without a shuffle; a task that runs again gives the same pieces if its partition has the same order, as files have.
    """
    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return sent.mapInArrow(_pack(tokenizer_path, length), SCHEMA)
