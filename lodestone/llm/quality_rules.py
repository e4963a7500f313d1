"""Quality rules: a learned decision list over text statistics.

Sequential covering: grow a conjunction of thresholds by information gain on two thirds of the labelled sample until it
covers no good row, prune it on the rest, keep it if it is precise there, drop what it covers,
repeat. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_echoes"]
#: Labelled rows used to fit at most; they are those of least hash.
MAX_LABELLED = 20_000
#: Rules of a list, and conditions of a rule, at most.
MAX_RULES, MAX_CONDITIONS = 16, 6

_KINDS = np.full(256, 3, np.int64)  # 0 white space, 1 continuation byte, 2 symbol, 3 other mark, 4 A-Z, 5 a-z, 6 digit, 7 first byte of a longer character
_KINDS[[0x20, *range(9, 14)]] = 0
_KINDS[0x80:0xC0] = 1
_KINDS[list(SYMBOLS)] = 2
_KINDS[ord("A") : ord("Z") + 1] = 4
_KINDS[ord("a") : ord("z") + 1] = 5
_KINDS[ord("0") : ord("9") + 1] = 6
_KINDS[0xC0:] = 7


def _repeats(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows that occur twice or more in it. hashes: of words, texts one after another."""
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), sizes)
    x = hashes.view(np.uint64)
    step, mul = 1, np.uint64(0x9E3779B97F4A7C15)
    while step < WINDOW:
        right = x[step:]
        x = x[:-step] * mul + (right ^ (right >> np.uint64(29)))
        x ^= x >> np.uint64(32)
        mul = mul * np.uint64(5) + np.uint64(2)
        step *= 2
    if not len(x):
        return np.zeros(len(ends), np.int64)
    at = np.flatnonzero(doc[: len(x)] == doc[WINDOW - 1 :])
    named = x[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(named)
    same = named[order[1:]] == named[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(ends))


def text_stats(texts: list[bytes]) -> np.ndarray:
    """STATS of each text, in columns."""
    out = np.zeros((len(texts), len(STATS)), np.int64)
    held: list[int] = []
    size = 0

    def flush() -> None:
        lengths = np.array([len(texts[i]) for i in held])
        a = np.frombuffer(b"".join(texts[i] for i in held), np.uint8)
        kinds = np.bincount(np.repeat(np.arange(len(held)) * 8, lengths) + _KINDS[a], minlength=8 * len(held)).reshape(-1, 8)
        words = [texts[i].split() for i in held]
        n_words = np.array([len(w) for w in words])
        hashes = np.fromiter((hash(x) for w in words for x in w), np.int64, int(n_words.sum()))
        lines = [[x for x in texts[i].split(b"\n") if x.strip()] for i in held]
        n_lines = np.array([len(x) for x in lines])
        dup = n_lines - np.array([len(set(x)) for x in lines])
        with np.errstate(over="ignore"):
            repeat = _repeats(hashes, np.cumsum(n_words))
        doc = np.repeat(np.arange(len(held)), n_words)
        echoes = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=len(held))  # words like the one before
        out[held] = np.stack([n_words, lengths - kinds[:, 0] - kinds[:, 1], kinds[:, 2], dup, repeat, n_lines, kinds[:, 4], kinds[:, 5], kinds[:, 6], kinds[:, 3], echoes], axis=1)

    for i, b in enumerate(texts):
        held.append(i)
        size += len(b)
        if size >= CHUNK:
            flush()
            held, size = [], 0
    if held:
        flush()
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = text_stats([x or b"" for x in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of each whole text (null: empty)."""
    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t"))
    return sent.mapInArrow(_stats, "doc_id long, " + ", ".join(f"{x} long" for x in STATS))


def features() -> dict[str, Column]:
    """What rules test: ratios, in doubles, of STATS."""

    def per(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "duplicate_lines": per("n_dup_lines", "n_lines"),
        "repeated_words": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "capitals": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "marks": per("n_marks", "word_chars"),
        "echoes": per("n_echoes", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


Rule = list[tuple[int, bool, float]]  # feature, at least (else at most), threshold


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, least, t in rule:
        out &= (x[:, k] >= t) if least else (x[:, k] <= t)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, max_conditions: int) -> Rule:
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while (inside & ~bad).any() and len(rule) < max_conditions:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, found = 1e-9, None
        for k in range(x.shape[1]):
            v = x[inside, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 101), method="nearest"))
            b = bad[inside]
            vp, vn = np.sort(v[b]), np.sort(v[~b])
            for least in (True, False):
                pp = len(vp) - np.searchsorted(vp, cuts) if least else np.searchsorted(vp, cuts, side="right")
                nn = len(vn) - np.searchsorted(vn, cuts) if least else np.searchsorted(vn, cuts, side="right")
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - np.log2(p / (p + n))), 0)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, found = gain[i], (k, least, float(cuts[i]))
        if not found:
            break
        rule.append(found)
        inside &= covers([found], x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, precision: float = 0.97) -> list[Rule]:
    """Ordered rules, each of which says reject. x: features of each labelled row, in a fixed order; bad: its label.

    Rules are learned until none is precise enough, ``max_rules`` at most; one grows until it covers no good row, to ``max_conditions`` at most.
    These two bound the model, as thresholds do, and not the rows that it judges.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    test = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules and (left & bad & ~test).sum() >= 3:
        rule = _grow(x[left & ~test], bad[left & ~test], max_conditions)
        if not rule:
            break

        def worth(r: Rule) -> float:
            hit = covers(r, x[left & test])
            p, n = int((hit & bad[left & test]).sum()), int((hit & ~bad[left & test]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)  # of equals the longest
        hit = covers(rule, x[left])
        p, n = int((hit & bad[left]).sum()), int((hit & ~bad[left]).sum())
        if p < 3 or p / (p + n) < precision or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def verdict(rules: list[Rule], names: list[str]) -> Column:
    """True if kept: the first rule that holds rejects; if none does, the row is kept."""
    out = None
    feats = features()
    for i, rule in enumerate(rules):
        cond = F.lit(True)
        for k, least, t in rule:
            cond &= (feats[names[k]] >= t) if least else (feats[names[k]] <= t)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(True) if out is None else out.otherwise(F.lit(-1)) < 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learns from at most max_labelled rows of labels, those of least hash; base failures are left out, as rules don't see them."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.min(label_col).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # the limit bounds it
    stats = with_stats(sample.select(F.struct("doc_id", "label").alias("both"), "text").select(F.expr("both.doc_id * 2 + int(both.label > 0)").alias("doc_id"), "text"))
    rows = stats.where(~base_failed()).select("doc_id", *(c.alias(n) for n, c in features().items())).limit(2 * max_labelled).toPandas()
    rows = rows.drop_duplicates().sort_values(list(rows.columns))
    rows = rows.iloc[np.argsort(rows["doc_id"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
    return learn(rows[list(features())].to_numpy(float), rows["doc_id"].to_numpy(np.int64) % 2 == 0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, the first five STATS, base_failed, kept, and the other STATS, of each row of docs. Without labels no rule is learned, and base failures alone go."""
    rules = fit(docs, labels, id_col, text_col, **options)
    judged = with_stats(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules, list(features())))
    return judged.select("doc_id", *STATS[:5], "base_failed", "kept", *STATS[5:])


def filter_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that judge() keeps, all columns kept. Text and verdict pass through one Python stage, without a join."""
    rules = fit(docs, labels, id_col, text_col, **options)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("t")
            got = text_stats([(x or "").encode() for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[:, k]) for k in range(len(STATS)))], names=[*batch.schema.names, *STATS])

    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(text_col).cast("string").alias("t"))
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)), "t string", *(f"{x} long" for x in STATS)])
    kept = sent.mapInArrow(run, schema).where(~base_failed() & verdict(rules, list(features())))
    named = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {text_col: F.col("t")}
    return kept.select(*[named[c].alias(c) for c in docs.columns])
