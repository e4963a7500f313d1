"""Near copies against brute force at the threshold."""

import random

import pytest

import corpus_pipeline
from lodestone.llm import near_copies


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def roots(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i for i in range(len(texts)) if top(i) == i}


@pytest.mark.parametrize("boiler", [0, 60])
def test_every_pair_at_the_threshold_and_no_other(spark, boiler):
    r = random.Random(boiler)
    shared = [f"common{i}" for i in range(boiler)]
    texts = []
    for i in range(120):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 160))] + shared
        texts.append(" ".join(words))
        for _ in range(r.randrange(3)):
            copy = list(words)
            for _ in range(r.randrange(1, 6)):
                copy[r.randrange(len(copy))] = f"x{r.random()}"
            texts.append(" ".join(copy))
    base = [f"hot{i}" for i in range(100)]
    texts += [" ".join(base[:k] + [f"y{i}"] + base[k + 1 :]) for i, k in enumerate(r.choices(range(100), k=60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(roots(texts))


def test_crowded_buckets_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MAX_BUCKET", 6)
    monkeypatch.setattr(near_copies, "PART_HASHES", 700)
    r = random.Random(3)
    base = [f"hot{i}" for i in range(100)]
    texts = [" ".join(base[:k] + [f"y{i}"] + base[k + 1 :]) for i, k in enumerate(r.choices(range(100), k=50))]
    texts += [" ".join(base[:a] + [f"z{i}"] + base[a + 1 : b] + [f"q{i}"] + base[b + 1 :]) for i in range(25) for a, b in [sorted(r.sample(range(100), 2))]]
    texts += [" ".join(f"w{r.randrange(4000)}" for _ in range(60)) for _ in range(40)] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in near_copies.keep_one(docs).collect()) == sorted(roots(texts))


def test_odd_rows_of_near_copies(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c", "x"), (1, None, "x"), (2, "", "y"), (3, "\t ", "z"), (4, long, "x"), (5, long + " end", "x"), (6, "a b c", "x"), (6, "a b c", "w"), (7, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = near_copies.keep_one(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 4), (False, 7), (True, 0)]
    assert near_copies.keep_one(docs.limit(0)).count() == 0
