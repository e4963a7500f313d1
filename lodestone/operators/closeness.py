"""Indel similarity of words and texts: exact ratios, keys by which close words meet, and the ratios of many names and texts at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words of names up to so long have keys; of longer ones the keys would be too many.
LONGEST_KEYED = 64
#: Bits of the table of keys that words are held against, and how many words hold them.
BITS = 26
WORDS = 1 << BITS - 6
#: Ranges of windows that are compared at once.
RANGES = 20_000
_STEP, _FULL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _masks(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_subsequence(masks: dict[str, int], n: int, t: str) -> int:
    """Length of the longest common subsequence, a column of the table in the bits of one number."""
    full = (1 << n) - 1
    v = full
    for c in t:
        m = v & masks.get(c, 0)
        v = ((v + m) | (v - m)) & full
    return n - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 x common subsequence / both lengths."""
    return 200 * common_subsequence(_masks(a), len(a), b) / (len(a) + len(b)) if a and b else 0.0


def _window_starts(a: str, b: str, cutoff: float) -> list[int]:
    """Starts of the windows of ``b`` that can reach the cutoff.

    Such a window is at most d edits from ``a``, so of d + 1 parts of ``a`` one occurs in it unchanged, at most d places from its own.
    """
    n = len(a)
    d = math.floor(2 * n * (100 - cutoff) / 100 + 1e-9)
    if d + 1 > n:
        return list(range(1 - n, len(b)))
    starts: set[int] = set()
    for i in range(d + 1):
        at, end = i * n // (d + 1), (i + 1) * n // (d + 1)
        p = b.find(a[at:end])
        while p >= 0:
            low, high = p - at - d, p - at + d
            if high >= 0:
                starts.update(range(low if low > 0 else -d, min(high, len(b) - 1) + 1))
            p = b.find(a[at:end], p + 1)
    return sorted(starts)


def partial_ratio(a: str, b: str, cutoff: float = 0) -> float:
    """The best Indel ratio of the shorter text and a window of the longer, of its length or, at the ends, less; 0 if that is below the cutoff."""
    if len(a) > len(b):
        a, b = b, a
    if not a or a in b:
        return 100.0 if a else 0.0
    masks, n, best = _masks(a), len(a), 0.0
    letters = set(a)
    for start in _window_starts(a, b, cutoff):
        w = b[max(0, start) : max(0, start + n)]
        # a best window starts and ends with letters of the shorter text
        if w and (w[0] in letters if start > 0 else w[-1] in letters):
            best = max(best, 200 * common_subsequence(masks, n, w) / (n + len(w)))
            if best == 100:
                break
    return best if best >= cutoff else 0.0


# keys of words


@lru_cache(None)
def edits(m: int, n: int, cutoff: int) -> int:
    """The most insertions and deletions between words of lengths m and n within the cutoff; -1 if such words never are."""
    most = (m + n) * (100 - cutoff) // 100
    most -= (most ^ (m - n)) & 1
    return most if most >= abs(m - n) else -1


@lru_cache(None)
def _segments(m: int, n: int, cutoff: int) -> list[tuple[np.uint64, int, int, range]]:
    """Mark, start and end of the segments of a name's word of length n, and the shifts with which one is found in a word of length m.

    Of d + 1 segments one is left unchanged by d edits, shifted by the insertions before it less the deletions.
    """
    d = edits(m, n, cutoff)
    out = []
    for i in range(d + 1):
        at, end = i * n // (d + 1), (i + 1) * n // (d + 1)
        low, high = max(-((d - (m - n)) // 2), -at), min((d + (m - n)) // 2, m - end)
        mark = hashlib.blake2b(f"{cutoff} {m} {n} {i}".encode(), digest_size=8).digest()
        out.append((np.uint64(int.from_bytes(mark, "little")), at, end, range(low, high + 1)))
    return out


def least_length(n: int, cutoff: int) -> int:
    """The length of the shortest word within the cutoff of one of length n."""
    return max(3, -(-n * cutoff // (200 - cutoff)))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(rows):
            yield int(sizes[rows[0]]), rows


def _prefixes(words: list[str], rows: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the first 0 to m characters of each word: a row for each length."""
    codes = np.array([words[i] for i in rows], dtype=f"U{m}").view(np.uint32).reshape(len(rows), m)
    out = np.zeros((m + 1, len(rows)), np.uint64)
    for j in range(m):
        out[j + 1] = out[j] * np.uint64(_STEP) + codes[:, j] + np.uint64(1)
    return out


def _key(prefixes: np.ndarray, at: int, end: int, mark: np.uint64) -> np.ndarray:
    h = (prefixes[end] - prefixes[at] * np.uint64(pow(_STEP, end - at, 1 << 64))) ^ mark
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def name_keys(words: list[str], cutoff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and keys of words of names: of each length that a word within the cutoff can have, and of each segment. With a cutoff of 100, the words themselves, of any length."""
    for n, rows in _by_length(words):
        if cutoff == 100 or 3 <= n <= LONGEST_KEYED:
            prefixes = _prefixes(words, rows, n)
            for m in [n] if cutoff == 100 else range(least_length(n, cutoff), n * (200 - cutoff) // cutoff + 1):
                for mark, at, end, _ in _segments(m, n, cutoff):
                    yield rows, _key(prefixes, at, end, mark)


def word_keys(words: list[str], cutoff: int, lengths: frozenset[int], bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and keys of words that names of such lengths may have: close words share one. Only keys in the table of the names' keys."""
    for m, rows in _by_length(words):
        fit = [n for n in lengths if (n == m if cutoff == 100 else m >= 3 and edits(m, n, cutoff) >= 0)]
        prefixes = _prefixes(words, rows, m) if fit else None
        for n in fit:
            for mark, at, end, shifts in _segments(m, n, cutoff):
                for shift in shifts:
                    keys = _key(prefixes, at + shift, end + shift, mark)
                    hit = np.flatnonzero(_within(keys, bits))
                    if len(hit):
                        yield rows[hit], keys[hit]


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the table for each key."""
    return keys >> np.uint64(64 - BITS), (keys >> np.uint64(5)) & np.uint64((1 << BITS) - 1)


def _within(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    first, second = _places(keys)
    out = (bits[first >> np.uint64(6)] >> (first & np.uint64(63))) & np.uint64(1)
    at = np.flatnonzero(out)
    out[at] = (bits[second[at] >> np.uint64(6)] >> (second[at] & np.uint64(63))) & np.uint64(1)
    return out


def enter(keys: np.ndarray, bits: np.ndarray) -> None:
    for place in _places(keys):
        np.bitwise_or.at(bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))


# many ratios at once


def _ranges(a: str, b: str, cutoff: float, found: dict[str, list[int]]) -> tuple[list[int], list[int]]:
    """First and last starts of ranges, which may overlap, that hold the windows of ``b`` that can reach the cutoff. ``a`` isn't in ``b``, nor longer.

    A window as long as ``a`` lacks as many of its characters, h at most, as it has others: of 2 h + 1 parts one occurs in it
    unchanged, at most h places from its own; without h there is none. Shorter windows are at the ends of ``b``, at most d places over.
    ``found`` keeps where parts of names are in ``b``.
    """
    n = len(a)
    d = math.floor(2 * n * (100 - cutoff) / 100 + 1e-9)
    h = d // 2
    if d >= n:
        return [1 - n], [len(b) - 1]
    if not d:
        return [], []
    lows, highs = [-d, len(b) - n + 1], [-1, len(b) - n + d]
    for i in range(2 * h + 1 if h else 0):
        at, end = i * n // (2 * h + 1), (i + 1) * n // (2 * h + 1)
        part = a[at:end]
        places = found.get(part)
        if places is None:
            places, p = [], b.find(part)
            while p >= 0:
                places.append(p)
                p = b.find(part, p + 1)
            found[part] = places
        for p in places:
            low, high = max(p - at - h, 0), min(p - at + h, len(b) - n)
            if low <= high:
                lows.append(low)
                highs.append(high)
    return lows, highs


def partial_ratios(texts: list[str], pairs: list[tuple[int, str]], cutoff: float) -> list[float]:
    """partial_ratio of a name and a text, for each pair of a text's number and a name, by texts; the windows of all pairs are compared together."""
    out = np.zeros(len(pairs))
    by_size: dict[int, list[int]] = {}
    ranges: list[tuple[list[int], list[int]]] = [([], [])] * len(pairs)
    last, found = -1, {}
    for k, (i, a) in enumerate(pairs):
        if i != last:
            last, found = i, {}
        if len(a) > len(texts[i]) or len(a) > 63 or a in texts[i]:
            out[k] = partial_ratio(a, texts[i], cutoff)
        else:
            ranges[k] = _ranges(a, texts[i], cutoff, found)
            if ranges[k][0]:
                by_size.setdefault(len(a), []).append(k)
    if by_size:
        gap = " " * 64
        codes = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        used = np.zeros(int(codes.max()) + 1, bool)
        used[codes] = True
        letters, code = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[codes]
        number = {chr(c): j for j, c in enumerate(letters.tolist())}
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + 64) - sizes  # of each text among the codes
        for n, ks in by_size.items():
            names = {a: j for j, a in enumerate(dict.fromkeys(pairs[k][1] for k in ks))}
            masks = np.zeros((len(names), len(letters)), np.uint64)  # of each letter in each name
            for a, j in names.items():
                for c, mask in _masks(a).items():
                    if c in number:
                        masks[j, number[c]] = mask
            which = np.array([names[pairs[k][1]] for k in ks]) * len(letters)
            text = np.array([pairs[k][0] for k in ks])
            best = np.zeros(len(ks))
            at, flat_masks, full = 0, masks.ravel(), np.uint64((1 << n) - 1)
            while at < len(ks):
                end, lows, highs, each = at, [], [], []
                while end < len(ks) and (len(lows) < RANGES or end == at):
                    low, high = ranges[ks[end]]
                    lows += low
                    highs += high
                    each.append(len(low))
                    end += 1
                low = np.array(lows)
                many = np.array(highs) - low + 1
                ends = np.cumsum(many)
                start = np.arange(ends[-1]) + np.repeat(low - ends + many, many)
                pair = np.repeat(np.repeat(np.arange(at, end), each), many)
                i = text[pair]
                first = np.maximum(start, 0)
                size = np.minimum(start + n, sizes[i]) - first
                v = np.full(len(pair), full)
                base, row = starts[i] + first, which[pair]
                for t in range(n):
                    # places after the window's end change nothing
                    m = v & np.where(t < size, flat_masks[row + code[base + t]], np.uint64(0))
                    v = ((v + m) | (v - m)) & full
                ratio = 200 * (n - np.bitwise_count(v).astype(np.int64)) / (n + size)
                best[at:end] = np.maximum.reduceat(ratio, np.append(0, np.flatnonzero(np.diff(pair)) + 1))
                at = end
            out[ks] = np.where(best >= cutoff, best, 0.0)
    return out.tolist()
