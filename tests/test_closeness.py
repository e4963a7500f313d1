"""Close words by keys, and many ratios at once, against plain comparison."""

import random

from pyspark.sql import functions as F

from lodestone.operators import closeness, matching


def edited(r, a, most, letters):
    out = list(a)
    for _ in range(r.randint(0, most)):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randint(0, 1)] = r.choice(["", *letters])
    return "".join(out)


def test_ratios_of_many_names_and_texts_are_those_of_one():
    r, hits = random.Random(3), 0
    for letters in ("abcd ", "abcdefgh ñ中😀"):
        texts, pairs = [], []
        for i in range(250):
            names = ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 4, 7, 9, 10, 12, 15, 22, 41, 63, 64, 80]))) for _ in range(6)]
            ends = ["".join(r.choice(letters) for _ in range(r.choice([0, 0, 1, 3, 40]))) for _ in range(2)]
            texts.append(ends[0] + edited(r, names[0], max(1, len(names[0]) // 6), letters) + ends[1] if i % 9 else "")
            pairs += [(i, a) for a in names]
        for cutoff in (55, 80, 90, 97):
            want = [matching.partial_ratio(a, texts[i], cutoff) for i, a in pairs]
            assert closeness.partial_ratios(texts, pairs, cutoff) == want
            hits += sum(x > 0 for x in want)
    assert hits > 800


def test_close_words_are_those_of_all_pairs(spark):
    r = random.Random(4)
    right = [f"{k:09d}" for k in range(0, 400, 7)] + ["".join(r.choice("abé1") for _ in range(r.choice([1, 2, 3, 5, 9, 10, 11, 20, 31, 63, 64, 65, 90]))) for _ in range(120)]
    left = [edited(r, a, max(1, len(a) // 7), "abz") for a in right for _ in range(3)] + right[::2]
    left_rows, right_rows = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    for cutoff in (80, 90, 97):
        want = {(a, b) for a in left for b in right if min(len(a), len(b)) >= 3 and matching.indel_ratio(a, b) >= cutoff}
        got = [(x["l"], x["r"]) for x in matching.close_tokens(left_rows, right_rows, cutoff).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 150


def test_names_in_parts_by_ids_and_odd_rows(spark, monkeypatch):
    names = matching.dictionary(spark.createDataFrame([(f"Customer#{k:09d}",) for k in range(60)] + [("Alexander Hamiltonian",), ("Hamiltonian",), ("of it",)], "name string"))
    rows = [(1, "about Alexandr Hamiltonian here"), (1, "Alexander Hamiltonian"), (2, "customer 000000007"), (3, None), (4, ""), (None, "hamiltonian of it"), (5, "0000000071 hamiltoniann")]  # the last name's ratio is below 97
    docs = spark.createDataFrame(rows, "id long, text string")
    whole = sorted(map(tuple, matching.match(docs, names, "id", "text", 20).collect()), key=repr)
    monkeypatch.setattr(matching, "MAX_BROADCAST", 25)
    assert sorted(map(tuple, matching.match(docs, names, "id", "text", 20).collect()), key=repr) == whole
    found = {(i, n) for i, n, k in whole if k == 1}
    assert found >= {(1, "Alexander Hamiltonian"), (2, "Customer#000000007"), (None, "Hamiltonian")} and {i for i, _, _ in whole} == {1, 2, None}
    assert sum(i == 2 for i, _, _ in whole) == 20


def test_names_that_no_text_has_are_left_out(spark):
    """Of many numbered names only those that words of texts nearly are meet them; by letter pairs each word with two zeros met all."""
    words = spark.createDataFrame([("00000123x",), ("prose",), ("9876543210",)], "l string")
    numbers = spark.range(20_000).select(F.format_string("%09d", "id").alias("r"))
    sought = matching.Sought([(90, numbers)])
    assert sought.words(["00000123x", "prose", "9876543210", "000012345", "00012345"]) == ["000012345", "00012345"]
    got = sorted(map(tuple, matching.close_tokens(words.union(spark.createDataFrame([("00012345",)], "l string")), numbers, 90).select("l", "r").collect()))
    assert got == [("00012345", x) for x in sorted({"00012345"[:i] + c + "00012345"[i:] for i in range(9) for c in "0123456789"} & {f"{k:09d}" for k in range(20_000)})]


def test_names_are_broadcast_only_if_counted_and_few(spark, monkeypatch):
    """Spark's estimate of names, from compressed files, let all of them be broadcast through the driver."""
    monkeypatch.setattr(matching, "MAX_BROADCAST", 100)
    names = matching.dictionary(spark.createDataFrame([(f"Customer#{k:09d}",) for k in range(500)] + [("Hamiltonian",), ("x" * 70,)], "name string"))
    docs = spark.createDataFrame([(1, "customer 000000007 hamiltoniann"), (2, "x" * 69 + " hamiltonians")], "id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    found = {(x["id"], x["name"]) for x in matching.match(docs, names, "id", "text", 600).collect()}
    assert (1, "Customer#000000007") in found and (2, "x" * 70) in found
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows, runs = [], store.executionsList()
    for e in (runs.apply(i).executionId() for i in range(runs.size())):
        if e not in before:
            values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if node.name() == "BroadcastExchange" else []
                rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    assert rows and max(rows) <= 100
