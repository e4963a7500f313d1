"""Operators that treat each text alone, against brute force, on odd tables too."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, language_id, lm_score, mixing, packing, quality_rules, queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, t int, row string"
ODD = [
    (1, None, None, None, None, "x", 1, "r"),
    (2, "", "en", "a", 0, None, None, None),
    (3, "one two", "en", "a", 7, "x", 1, "r"),
    (3, "one two", "en", "a", 7, "x", 1, "r"),
    (None, "no id\nhere <|endoftext|> É", "en", None, 7, "x", 1, "r"),
    (5, "word " * 30_000, "en", "b", 150_000, "x", 1, "r"),
    (6, " \t\x0b　\x85😀", None, "b", 5, "x", 1, "r"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)]


def test_stats_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: [r[c] for c in quality_rules.STATS[:5]] for r in quality_rules.with_stats(docs).collect()}
    assert got == {r["doc_id"]: brute_stats(r["text"]) for r in docs.collect()}


def test_rules_reject_labelled_junk_and_keep_the_rest(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op7_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["base_failed"], r["kept"]): r["count"] for r in out.groupBy("quality", "base_failed", "kept").count().collect()}
    assert n.get((1, False, False), 0) <= 0.01 * n[1, False, True]
    assert n.get((0, False, True), 0) <= 0.2 * n[0, False, False]


def test_learned_rules_are_ordered_conditions():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 10))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] > 0.7) & (x[:, 6] < 0.2))
    hit = np.zeros(2000, bool)
    for rule in quality_rules.learn(x, bad):
        hit |= quality_rules.covers(rule, x)
    assert (hit == bad).mean() > 0.97


def test_quality_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(odd, labels).collect()}
    assert len(out) == 6 and out[5, 30_000]["n_repeat_words"] == 30_000 and not any(r["kept"] for r in out.values())
    kept = quality_rules.filter_rows(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 0
    assert quality_rules.judge(none, labels).count() == 0


def greedy(word, vocabulary):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(40):
        pieces = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        a = token_counts.Automaton(pieces)
        for _ in range(200):
            w = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 10)))
            assert a.count(w) == greedy(w, pieces)


def test_token_counts(spark, sf, odd, none):
    v = set(token_counts.vocabulary(PATH))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, PATH).collect()}
    assert got == {r["doc_id"]: sum(greedy(w, v) for w in r["text"].lower().encode().split()) for r in docs.collect()}
    assert sorted(r["n_words"] for r in token_counts.token_counts(odd, PATH).collect()) == [0, 0, 1, 2, 2, 5, 30_000]
    assert token_counts.token_counts(none, PATH).count() == 0


def check_packing(docs, pieces):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc, len(ids)] += 1
    sequences = defaultdict(list)
    whole = Counter()
    texts = defaultdict(list)
    for doc, text in docs:
        texts[doc].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        assert any(zlib.crc32(a[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for a in texts[p["doc_id"]] if len(a) == p["doc_tokens"])
        whole[p["doc_id"]] += p["length"]
    assert whole == Counter({d: sum(map(len, a)) for d, a in texts.items()})
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, sum(whole.values())


def test_packing_is_whole_and_tight(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padding, tokens = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack(docs, PATH).collect())
    assert padding <= 0.01 * tokens
    check_packing([(r[0], r[1]) for r in ODD], packing.pack(odd, PATH).collect())
    assert packing.pack(none, PATH).count() == 0


def test_level_lowers_the_sum_of_squares():
    rng, p = random.Random(2), packing.Packer(64)
    for _ in range(2000):
        size = rng.randint(1, 63)

        def cost(h, size=size):
            n = p.count.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 64
            return int((n[1:64] ** 2).sum())

        options = [h for h in range(64 - size + 1) if h == 0 or p.count[h]]
        h = p.level(size)
        assert h in options and cost(h) == min(map(cost, options))
        p.add(0, 0, np.zeros(size, "<u4"))


def test_encoder_gives_the_tokenizers_ids():
    rng = random.Random(3)
    letters = [*"abzAZ019'st.re ve!<|>~_-\n\t\x0b\x1c\x7f", "é", "É", "ß", "ÿ", "²", "ª", "µ", "×", "İ", "Σ", "Å", "́", "̱", "H", "K", "\xa0", " ", "中", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    e = packing.encoder(PATH)
    want = e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.frombuffer(a, "<u4").tolist() == b.ids for a, b in zip(e.encode(texts), want, strict=True))


def test_chats_round_trip(spark, sf):
    marks = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "[\\INST]", "<\\/s>", "[", "<", "/", "a", "\n", " "]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[TEXT]", "", None]), "".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) or None) for c in range(300) for t in range(rng.randint(1, 4))]
    df = spark.createDataFrame([*rows, (0, None, "user", "x"), (None, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    got = chat_format.digest(chat_format.format_chats(df)).collect()
    assert len(got) == 301 and all(r["round_trip"] for r in got)
    want = defaultdict(list)
    for c, t, r, x in df.collect():
        want[c].append((-1 if t is None else t, r or "", x or ""))
    for r in got:
        turns = sorted(want[r["conv_id"]])
        assert r["n_turns"] == len(turns) and r["loss_chars"] == sum(len(x) for _, role, x in turns if role == "assistant")
    read = chat_format.format_chats(df).select("conv_id", F.transform(chat_format.parse_parts(F.col("formatted")), chat_format._parse_turn).alias("t")).collect()
    assert all([(x["role"], x["text"]) for x in r["t"]] == [x[1:] for x in sorted(want[r["conv_id"]])] for r in read)
    assert chat_format.digest(chat_format.format_chats(df.limit(0))).count() == 0


def test_mixing_weights_and_rows(spark, odd, none):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 == 0 else f"s{i % 10}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, max_repeats=2.0).select("row.*", "tokens", "pass", "place").collect()
    size, used, seen = Counter(), Counter(), Counter()
    for i, t, s in rows:
        size[s] += len(t.split())
    for r in out:
        used[r["source"]] += r["tokens"]
        seen[r["doc_id"]] += 1
        assert 0 <= r["place"] <= 1
    uses = {s: used[s] / size[s] for s in size}
    assert len(seen) == 6000 and min(uses.values()) > 0.999 and 1.95 < max(uses.values()) <= 2.001
    assert len({(r["doc_id"], r["pass"]) for r in out}) == len(out)
    again = mixing.mix(docs, max_repeats=2.0).select("row.doc_id", "pass").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["pass"]) for r in out)
    assert mixing.mix(odd).select("row.*").columns == odd.columns and mixing.mix(odd).count() >= len(ODD)
    assert mixing.mix(none).count() == 0
    sizes = spark.createDataFrame([("a", 10, 900), ("b", 10, 90), ("c", 10, 10)], "source string, n_rows long, n_tokens long")
    w = np.array([r["weight"] for r in mixing.weights(sizes, entropy=0.9).collect()])
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-6


def test_language_on_held_out_texts(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    out = queries.op2_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    model = language_id.fit(odd)
    got = language_id.predict(odd, model).collect()
    assert len(got) == 7 and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 6}
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(none)).collect()} == {"und"}


def _by_hand(model, text):
    """Sum of log-probabilities, a word at a time: words by a pattern, hashes in Python integers, the network by loops."""
    mask = (1 << 64) - 1
    buckets = []
    marks = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())).encode()
    for w in re.findall(rb"[" + marks + rb"]|[\xe3-\xff][\x80-\xbf]*[^\x09-\x0d " + marks + rb"\xe3-\xff]*|[^\x09-\x0d " + marks + rb"\xe3-\xff]+", text.encode()):
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) & mask
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & mask
        h ^= h >> 29
        buckets.append((h * 0x9E3779B97F4A7C15 & mask) >> 44)
    emb, w1, b1, w2, b2 = (w.astype(np.float64) for w in model.weights)
    total = 0.0
    for i, b in enumerate(buckets):
        near = [buckets[j] >> 6 if 0 <= j < len(buckets) else lm_score.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
        z = np.tanh(np.concatenate([emb[x] for x in near]) @ w1 + b1) @ w2 + b2
        total += z[model.of[b]] - np.log(np.exp(z).sum()) + float(model.inner[b])
    return len(buckets), total


def test_lm_gradients():
    rng = np.random.default_rng(0)
    w = [x.astype(np.float64) for x in lm_score.start_weights(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))]
    w[3] = rng.normal(0, 0.3, w[3].shape)
    x, target = rng.integers(0, lm_score.PAD + 1, (20, 4)), rng.integers(0, lm_score.CLASSES, 20)
    _, grads = lm_score.gradients(w, x, target)
    for i, g in enumerate(grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = [y.copy() for y in w], [y.copy() for y in w]
        up[i][at] += 1e-5
        down[i][at] -= 1e-5
        slope = (lm_score.gradients(up, x, target)[0] - lm_score.gradients(down, x, target)[0]) / 2e-5
        assert abs(g[at]) > 1e-5 and abs(slope - g[at]) < 1e-6


def test_lm_scores(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lm_score.fit(docs)
    got = {r["doc_id"]: r for r in lm_score.score(docs, model).collect()}
    rows = docs.orderBy("doc_id").collect()
    odd_texts = ["Ünïcode、日本語 x日本, a.b\tc\n\x00 d\x7fe", "word", " . "]
    other = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string"), model).collect()}
    for r, text in [(got[r["doc_id"]], r["text"]) for r in rows[:10]] + [(other[i], t) for i, t in enumerate(odd_texts)]:
        n, want = _by_hand(model, text or "")
        assert r["n_tokens"] == n and abs(r["pseudo_log_likelihood"] - want) < 1e-4 * max(1, abs(want))
    # all words that there are have probability 1 together, in any context
    p = np.exp(model.inner.astype(np.float64) + lm_score.forward(model.weights, np.array([[5, 6, 7, lm_score.PAD]]))[2][0][model.of])
    assert abs(p.sum() - 1) < 1e-3
    # the network beats the words' own shares, and beats them on texts it never saw
    seen, unseen = docs.where("doc_id % 5 > 0"), docs.where("doc_id % 5 = 0")
    part = lm_score.fit(seen)
    bucket, doc = lm_score.words([r["text"] or "" for r in unseen.collect()])
    counted = lm_score.words([r["text"] or "" for r in seen.collect()])[0]
    mass = np.bincount(counted, minlength=lm_score.BUCKETS) + lm_score.PRIOR
    assert part.log_probabilities(bucket, doc).mean() > np.log(mass / mass.sum())[bucket].mean() + 0.1
    # the order of words, their case and their script count
    r = random.Random(1)
    mean = np.mean([x["per_token"] for x in got.values() if x["per_token"] is not None])
    mixed = [(x["doc_id"], " ".join(r.sample(w, len(w)))) for x in rows if len(w := (x["text"] or "").replace(".", " .").replace(",", " ,").split()) > 50]
    shuffled = lm_score.score(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    assert sum(x["per_token"] < got[x["doc_id"]]["per_token"] for x in shuffled) >= 0.9 * len(shuffled)
    texts = ["The state of the art", "THE STATE OF THE ART", "日本語 は 日本", "本日語 日本 は", "in 1999 and 2000", "in 1998 and 2001"]
    assert len({x["per_token"] for x in lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}) == len(texts)
    plain = spark.createDataFrame([(i, "".join(r.choice("qxzjkvw ") for _ in range(300))) for i in range(20)], "doc_id long, text string")
    assert max(x["per_token"] for x in lm_score.score(plain, model).collect()) < mean


def test_lm_on_odd_tables(spark, odd, none):
    model = lm_score.fit(odd)
    got = lm_score.score(odd, model).collect()
    assert len(got) == odd.count() and all((x["per_token"] is None) == (x["n_tokens"] == 0) and x["pseudo_log_likelihood"] <= 0 for x in got)
    assert {x["doc_id"] for x in got if x["n_tokens"] == 0} == {x["doc_id"] for x in odd.collect() if not (x["text"] or "").strip()}
    empty = lm_score.fit(none)
    assert lm_score.score(none, empty).count() == 0
    assert all(np.isfinite(x["pseudo_log_likelihood"]) for x in lm_score.score(odd, empty).collect())
    twice = lm_score.score(odd.unionAll(odd), model).collect()
    assert sorted(map(str, twice)) == sorted(map(str, got * 2))
