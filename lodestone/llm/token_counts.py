"""Word-piece counts by a longest-match automaton.

The vocabulary's byte strings form a trie. Each node has a failure link: the node reached when as many whole pieces as
greedy longest match is sure of are popped from its string, and how many were popped. A word is
read once, byte by byte; each failed step pops pieces, so the number of steps is linear in its length and no piece is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str, end_mark: str = "</w>") -> list[bytes]:
    """The byte strings of a byte-level vocabulary file; the mark of word ends is dropped."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    return sorted({bytes(map(alphabet.__getitem__, t)) for x in tokens if (t := x.removesuffix(end_mark)) and all(c in alphabet for c in t)})


class Automaton(dict):
    """counts[word]: the pieces of a word by greedy longest match, or one if no pieces make it up. Remembers words."""

    def __init__(self, pieces: Iterable[bytes]):
        super().__init__()
        self.next: list[dict[int, int]] = [{}]
        is_piece = [False]
        for p in pieces:
            node = 0
            for c in p:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    is_piece.append(False)
            is_piece[node] = True
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.pops: list[int] = [0] * n
        level = [0]
        while level:  # parents first
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if is_piece[v]:
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    w, pops = self.fail[u], self.pops[u]
                    while w >= 0 and c not in self.next[w]:
                        pops += self.pops[w]
                        w = self.fail[w]
                    if w >= 0:
                        self.fail[v], self.pops[v] = self.next[w][c], pops
            level = below

    def count(self, word: bytes) -> int:
        step, fail, pops = self.next, self.fail, self.pops
        node = n = 0
        for c in word:
            while (to := step[node].get(c)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self[word] = self.count(word)
        return n


@lru_cache(1)
def _automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _automaton(path)
        for batch in batches:
            words = [0] * batch.num_rows
            tokens = [0] * batch.num_rows
            for i, text in enumerate(batch.column(1)):
                split = (text.as_py() or "").lower().encode().split()
                words[i], tokens[i] = len(split), sum(map(of.__getitem__, split))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each whole text, lower-cased, split at ASCII white space; null text has none."""
    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return sent.mapInArrow(_count(vocabulary_path), "doc_id long, n_words long, n_tokens long")
