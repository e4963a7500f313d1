"""Operators that compare rows, against brute force, on odd tables too."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lodestone.llm import nearest, queries, simhash, suffix_dedup
from lodestone.llm._shared import Scratch
from lodestone.llm.components import stars

from .test_texts import DOCS, ODD, check_packing


def brute_repeats(texts, m):
    n = Counter(t[p : p + m] for t in texts for p in range(len(t) - m + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for p in range(len(t) - m + 1):
            if n[t[p : p + m]] > 1:
                mark[p : p + m] = b"\1" * m
        out.append(mark)
    return out


def check_repeats(rows, got, m=200):
    marks = brute_repeats([(t or "").encode() for _, t in rows], m)
    want = Counter()
    for (doc, t), mark in zip(rows, marks, strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, y in zip(b, mark, strict=True) if not y)
        spans = sum(1 for i, y in enumerate(mark) if y and not (i and mark[i - 1]))
        want[doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_interval_expansion_matches_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        letters = rng.choice([b"ab", b"abc", bytes(range(97, 123))])
        parts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4)]
        texts = [b"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(6)]
        m = rng.choice([3, 8, 20])
        n = Counter(t[p : p + m] for t in texts for p in range(len(t) - m + 1))
        for t, hit in zip(texts, suffix_dedup.repeated_windows(texts, m), strict=True):
            assert hit.tolist() == [p + m <= len(t) and n[t[p : p + m]] > 1 for p in range(len(t))]


def test_repeats_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], queries.op1_suffix_dedup(spark, "/root/testdata/sf0.001").collect())


def test_repeats_of_odd_texts(spark):
    rng = random.Random(5)
    part = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (150, 199, 200, 260, 600)]
    texts = [None, "", "x" * 5000, "ab" * 900, part[3], part[3], part[4][:300] + "!" + part[4][300:], part[4], part[0] + part[1] + part[2], "é" + part[2] + part[0], part[4][50:] + "z"]
    texts += [part[4][: 100 + i] + str(i) + part[4][100 + i :] for i in range(0, 400, 7)]
    rows = [*[(i, t) for i, t in enumerate(texts)], (4, part[3]), (None, part[2])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rid string, spans int")
    check_repeats(rows, suffix_dedup.repeat_report(docs).collect())
    left = suffix_dedup.strip_repeats(docs)
    assert left.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert got[0] is None and got[1] == "" and got[5] == "" and got[2] == "" and got[9].startswith("é")
    assert suffix_dedup.repeat_report(docs.limit(0)).count() == 0 and suffix_dedup.strip_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("limit", "broadcast"), [(1, 0), (8, 100)])
def test_crowded_names_and_hot_contents(spark, monkeypatch, limit, broadcast):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common, other = word(330), word(210)
    texts = [word(rng.randint(0, 90)) + common + word(rng.randint(0, 90)) for _ in range(60)] + [word(40) + other[:200] + word(9) for _ in range(12)] + [other + word(5), common, common, None, ""]
    texts += texts[:6]
    rows = [*enumerate(texts), (0, texts[0]), (None, common)]
    for name, value in {"MAX_NAME": 400 * limit, "MAX_SHARED": 4, "HOT_ROWS": 3, "MAX_BROADCAST": broadcast}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_repeats(rows, suffix_dedup.repeat_report(docs).collect())


def test_equal_windows_have_equal_hashes():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2, 3000).astype(np.uint8)
    a[1000:1400], a[2000:2400] = a[:400], a[:400]
    for m in (137, 200, 256):
        h = suffix_dedup.window_hashes(a, m)
        seen = {}
        for p in range(len(a) - m + 1):
            assert seen.setdefault(a[p : p + m].tobytes(), h[p]) == h[p]
        assert len(set(seen.values())) == len(seen) < len(h)


def test_a_large_block_is_split(monkeypatch):
    rng = random.Random(6)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(500))
    rows = [(i, i, 0, base[: 100 + i] + b"%d" % i + base[100 + i :]) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4000)
    found = defaultdict(set)
    for group in suffix_dedup._split_block(rows, 200):
        for (rid, _, s, part), hit in zip(group, suffix_dedup.repeated_windows([r[3] for r in group], 200), strict=True):
            found[rid] |= {s + p for p in np.flatnonzero(hit).tolist()}
    want = suffix_dedup.repeated_windows([r[3] for r in rows], 200)
    assert all(found[i] == set(np.flatnonzero(w).tolist()) for i, w in enumerate(want))


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def least_ids(ids, prints, distance):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        least[find(i)].append(x)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("rows", [None, [(r[0], r[1]) for r in ODD], []])
def test_fingerprints_and_components(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if rows is None else spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rid string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = simhash.simhash_classes(docs).collect()
    prints = [brute_print(t) for _, t in rows]
    want = zip([i for i, _ in rows], prints, least_ids([i for i, _ in rows], prints, 2), strict=True)
    assert Counter((r["doc"], r["f0"] % 2**64, r["component"]) for r in got) == Counter(want)


def test_crowded_buckets_meet_in_hamming_balls(spark, monkeypatch):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(300)] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [*enumerate(texts), (900, None), (901, ""), (None, texts[0])]
    monkeypatch.setattr(simhash, "MAX_BUCKET", 2)
    got = simhash.simhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [brute_print(t) for _, t in rows]
    want = least_ids([i for i, _ in rows], prints, 2)
    assert len(set(want)) < len(set(prints))
    assert Counter((r["doc"], r["f0"] % 2**64, r["component"]) for r in got) == Counter(zip([i for i, _ in rows], prints, want, strict=True))


def test_spark_and_python_hash_alike(spark):
    s = "a bc déf"
    assert spark.sql(f"select xxhash64('{s}')").first()[0] % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


@pytest.mark.parametrize("segments", [[(0, 32, 1), (32, 32, 0)], [(0, 64, 2)]])
def test_every_close_pair_meets_also_in_a_crowd(segments):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base[:20]:
        for _ in range(30):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = list(dict.fromkeys(prints))
    a = np.array(prints, np.uint64).view(np.int64)[:, None]
    rows, buckets = (np.concatenate(x) for x in zip(*simhash.segment_keys(a, segments), strict=True))
    order = np.argsort(buckets, kind="stable")
    u, v = simhash.bucket_links(buckets[order], np.arange(len(prints))[rows[order]], a[rows[order]], 2)
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        assert (prints[x] ^ prints[y]).bit_count() <= 2
        up[find(x)] = find(y)
    least = defaultdict(lambda: len(prints))
    for i in range(len(prints)):
        least[find(i)] = min(least[find(i)], i)
    assert [least[find(i)] for i in range(len(prints))] == least_ids(list(range(len(prints))), prints, 2)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["u"]: r["v"] for r in stars(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}


def test_nearest_finds_the_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 24))) * rng.uniform(0.5, 2, (3000, 1))
    v[100:400] = v[100]
    rows = [(i, [float(y) for y in x], "z") for i, x in enumerate(v)]
    rows += [(5000, None, "z"), (5020, [0.0] * 24, "z"), (5040, [float("nan")] * 24, "z"), (5060, [None, *[1.0] * 23], "z"), (None, [1.0] * 24, "z"), (5080, [1.0], "z"), (20, rows[20][1], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, p string")
    got = defaultdict(list)
    for r in nearest.nearest(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)).tolist() if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(x - s[i]) < 1e-9 for _, i, x in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert hits >= 0.95 * 20 * len(got)
    assert nearest.nearest(df.limit(0), "true").count() == 0
    few = nearest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>"), "vec_id = 0").collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 1), (2, 2)]


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    x, ids = np.stack(p["embedding"].to_list()).astype(float), p["vec_id"].to_numpy()
    got = defaultdict(set)
    for r in nearest.nearest(df, "vec_id % 20 = 0").collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, n = hits + len(best & got[ids[i]]), n + 20
    assert hits >= 0.95 * n


def test_chi_square_quantiles():
    for p, m, want in ((0.95, 1, 3.841), (0.95, 10, 18.307), (0.99, 4, 13.277)):
        assert abs(nearest.chi2_quantile(p, m) - want) < 1e-3


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    rows, copies = [], {}
    for i in range(150):
        w = [word() for _ in range(rng.randint(80, 400))]
        rows.append((i, " ".join(w)))
        if i < 100:
            c = w.copy()
            for k in rng.sample(range(len(c)), max(1, len(c) // 100)):
                c[k] = word()
            rows.append((1000 + i, " ".join(c)))
            copies[1000 + i] = jaccard(rows[-2][1], rows[-1][1])
    docs = spark.createDataFrame([(*r, "rid") for r in [*rows, rows[0]]], "doc_id long, text string, rid string")
    kept = Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert all(kept[i] == 1 for i in range(150))
    close = [i for i, j in copies.items() if j >= 0.8]
    assert len(close) > 90 and sum(kept[i] for i in close) <= 0.02 * len(close)


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    quality = corpus_pipeline.quality(spark, docs, sf)
    judged = {r["doc_id"]: r["kept"] for r in queries.op7_quality_rules(spark, sf).collect()}
    assert {r["doc_id"] for r in quality.collect()} == {i for i in ids if judged[i]}
    kept = corpus_pipeline.near_dedup(spark, quality, sf)
    before = {r["doc_id"]: r["text"] for r in quality.collect()}
    after = {r["doc_id"] for r in kept.collect()}
    for i in before.keys() - after:
        assert any(jaccard(before[i], before[j]) > 0.6 for j in before if j < i)
    for i in after:
        assert not any(jaccard(before[i], before[j]) >= 0.85 for j in after if j < i)
    passages = corpus_pipeline.passages(spark, kept, sf)
    marks = brute_repeats([before[i].encode() for i in sorted(after)], 200)
    got = {r["doc_id"]: r for r in passages.collect()}
    for i, mark in zip(sorted(after), marks, strict=True):
        left = bytes(b for b, m in zip(before[i].encode(), mark, strict=True) if not m)
        assert len(got[i]["text"].encode()) - len(left) in range(0, 3 * 2 * 20) and got[i]["n_chars"] == len(got[i]["text"])
    mixed = corpus_pipeline.mix(spark, passages, sf)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == after
    table = Scratch(spark, "test").table(mixed)
    check_packing([(r["doc_id"], r["text"]) for r in table.collect()], corpus_pipeline.pack(spark, table, sf).collect())
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    for name, rows in (("odd", ODD), ("none", [])):
        os.makedirs(tmp_path / name)
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
    odd = spark.createDataFrame(ODD, DOCS)
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.passages, corpus_pipeline.mix):
        assert stage(spark, odd, "").columns == odd.columns
        assert stage(spark, odd.limit(0), "").count() == 0
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd, "").collect())[3] == 1
