"""Operators on small cases: evaluation, judging, mining, matching, facts, sources, sinks, plans, streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import datasets, evaluation, facts, judging, matching, mining, retrieval, tools
from lodestone.plans import inspect
from lodestone.providers import HashingEncoder, OverlapReranker, encode, generate
from lodestone.sources import corpora, records
from lodestone.streaming import index as streaming


def test_ranking_metrics(spark):
    m = {r["cutoff"]: r for r in evaluation.ranking_metrics(spark.createDataFrame([(3,)], "rank int"), (1, 3)).collect()}
    assert m[1]["hit_rate"] == 0 and (m[3]["precision"], m[3]["recall"], m[3]["mrr"], m[3]["map"], m[3]["ndcg"]) == (0.333333, 1.0, 0.333333, 0.333333, 0.5)
    ranks = spark.createDataFrame([(1,), (None,), (4,)], "rank int")
    s = evaluation.rank_stats(ranks).first()
    assert (s["hits"], s["misses"], s["mean_hit_rank"], s["median_hit_rank"]) == (2, 1, 2.5, 2.5)
    assert evaluation.ranking_metrics(ranks, (3,)).first()["mrr"] == 0.333333


def test_documents_collapse(spark):
    rows = spark.createDataFrame([(0, 7, 1), (0, 7, 2), (0, 9, 3)], "q int, document_id int, rank int")
    assert sorted((r["document_id"], r["rank"]) for r in evaluation.collapse_documents(rows, "q", "document_id").collect()) == [(7, 1), (9, 2)]


def test_percentiles(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, "E: x"), (10.0, None)], "s double, e string")
    assert abs(evaluation.latency(rows, "s").first()["p95"] - 8.95) < 1e-9
    assert judging.call_metrics(rows, [], "s", "e").first()["p95_seconds"] == 10
    assert judging.error_histogram(rows, "e").first()["error_type"] == "E"


def test_configurations():
    evaluation.EvaluationConfig(cutoffs=evaluation.parse_cutoffs("1,3,5"))
    for bad in ({"cutoffs": (3, 1)}, {"cutoffs": (100,)}, {"rerank": True, "mode": "bm25"}, {"rerank": True, "candidate_k": 10}):
        with pytest.raises(ValueError):
            evaluation.EvaluationConfig(**bad)


def test_classification(spark):
    rows = spark.createDataFrame([(1, 1), (0, 0), (1, None)], "t int, p int")
    r = rows.agg(*judging.classification(F.col("t"), F.col("p"))).first()
    assert (r["coverage"], r["strict_accuracy"], r["accuracy"], r["kappa"], r["mcc"]) == (0.666667, 0.666667, 1.0, 1.0, 1.0)
    r = spark.createDataFrame([(1, 1), (1, 1)], "t int, p int").agg(*judging.classification(F.col("t"), F.col("p"))).first()
    assert [r[k] for k in ("specificity", "balanced_accuracy", "mcc", "kappa")] == [None] * 4


def test_call_batches(spark):
    rows = judging.call_batches(spark.createDataFrame([("e", i) for i in range(9)], "e string, i int"), "e", "i", 4).collect()
    assert sorted({(r["batch_index"], r["criteria_in_call"]) for r in rows}) == [(0, 4), (1, 4), (2, 1)]


def test_threshold_and_modes(spark):
    class Fixed:
        def score(self, query, texts):
            return [float(t) for t in texts]

    c = spark.createDataFrame([(0, "q", 1, "3.0", 1), (0, "q", 2, "2.99", 2), (0, "q", 3, "9", 3)], "query_id int, q string, id int, content string, rank int")
    got = retrieval.rerank(c, Fixed(), "query_id", "q", "id", "content", 5, 2, 3.0).collect()
    assert [(r["id"], r["score"], r["rank"]) for r in got] == [(1, 3.0, 1)]
    assert retrieval.resolve_mode(None, True, None) == "hybrid" and retrieval.resolve_mode(None, False, None) == "bm25" and retrieval.resolve_mode(None, True, OverlapReranker()) == "hybrid_reranked"
    for mode, vectors in (("dense", False), ("hybrid_reranked", True), ("x", True)):
        with pytest.raises(ValueError):
            retrieval.resolve_mode(mode, vectors, None)
    assert retrieval.fetch_size("hybrid_reranked", 10, 50) == 50 and retrieval.fetch_size("bm25", 20_000, 50) == 10_000


def test_mining(spark):
    results = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (0, 7, 3)], "query_id int, id int, rank int")
    queries = spark.createDataFrame([(0, "5", "generated"), (1, "9", "failed")], "query_id int, positive string, status string")
    got = mining.candidates(queries, results, "query_id", "positive", "id", 5).orderBy("rank").collect()
    assert [(r["id"], r["rank"], r["prompt_rank"]) for r in got] == [(6, 2, 1), (7, 3, 2)]
    assert {r["query_id"]: r["status"] for r in mining.round_trip(queries, results, "query_id", "positive", "id", 50).collect()} == {0: "mined", 1: "failed"}
    named = spark.createDataFrame([(0, ["7", "x", "6", "7"])], "query_id int, ids array<string>")
    assert [r["id"] for r in mining.chosen_negatives(named, results, "query_id", "ids", "id").collect()] == [7, 6, 7]


def test_fusion_is_symmetric(spark):
    a, b = (spark.createDataFrame([(0, i, r) for r, i in enumerate(x, 1)], "q int, id int, rank int") for x in ([1, 2, 3], [3, 4]))
    x, y = (sorted(map(tuple, retrieval.fuse(z, "q", "id", 10).collect())) for z in ([a, b], [b, a]))
    assert x == y and [r for r in x if r[1] == 3][0][3] == 1


def test_scan_rules(spark):
    c = spark.createDataFrame([(0, 9, "A", "x x"), (1, 10, "B", "x x"), (2, 9, "C", "none"), (3, 9, "D", "x  x")], "source_index long, document_id long, title string, content string")
    got = tools.text_scan(c, "x", snippet_chars=4).collect()
    assert [(r["document_id"], r["total"], r["title"]) for r in got] == [("9", 4, "A"), ("10", 2, "B")] and got[0]["snippet"] == "x x"
    tied = tools.text_scan(c.where("source_index < 2"), "X").collect()
    assert [r["document_id"] for r in tied] == ["10", "9"]
    assert tools.text_scan(c, "").count() == 0 and tools.render_scan(tools.text_scan(c, "zzz")).first()["xml"] == ""


def test_matching(spark):
    names = matching.dictionary(spark.createDataFrame([("United",), ("United States",), ("united  states",), ("x" * 40,), ("Alexander Hamiltonian",)], "name string"))
    passages = spark.createDataFrame([(0, "the United States, united"), (1, "x" * 39 + "y"), (2, "about Alexandr Hamiltonian here")], "id int, text string")
    got = {}
    for r in matching.match(passages, names, "id", "text").orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["name"])
    assert got == {0: ["United States", "United"], 1: ["x" * 40], 2: ["Alexander Hamiltonian"]}
    assert matching.partial_ratio("abcd", "xxabcdxx") == 100 and matching.partial_ratio("abcd", "xxabxdxx") == 75
    names = names.withColumn("position", F.col("name"))
    linked = matching.linked(spark.createDataFrame([("United", 0, "United States"), ("United", 0, "United")], "own string, g int, name string"), names, ["own", "g"], "own").first()
    assert linked["linked"] == ["United States"]


def test_facts(spark):
    asked = spark.createDataFrame([("a", "E", "s", [2, 1]), ("b", "E", "s", [1, 3]), ("c", "F", "s", [9])], "custom_id string, entity_name string, data_source string, doc_ids array<long>")
    fact = "<fact><statement>{}</statement><doc_ids>1</doc_ids></fact>"
    got = spark.createDataFrame([("a", fact.format("One") + fact.format("Two")), ("b", fact.format(" one") + fact.format("Three")), ("z", "")], "custom_id string, content string")
    ok, stray, missing = facts.join_responses(asked, got)
    assert [r["custom_id"] for r in stray.collect()] == ["z"] and [r["custom_id"] for r in missing.collect()] == ["c"]
    memory = facts.entity_memory(ok, [F.col("custom_id")])
    r = memory.first()
    assert [f["statement"] for f in r["facts"]] == ["One", "Two", "Three"] and r["entity_doc_ids"] == [2, 1, 3]
    page = memory.select(facts.entity_markdown(F.col("entity_name"), F.col("data_source"), F.col("entity_doc_ids"), F.col("facts")).alias("value"))
    assert page.first()[0].startswith("# Entity: E\nSource: s\nEntity docs: 2,1,3\n\n## Facts\n\n### Document 1\n- One\n- Two\n- Three\n")
    assert [r["doc_id"] for r in facts.heading_doc_ids(page).collect()] == [1]
    ordered = facts.in_file_order(memory, spark.createDataFrame([("X", 0), ("E", 1)], "entity_name string, position int"))
    assert facts.usable(ordered).first()["position"] == 0
    slots = facts.round_robin(spark.range(5).withColumnRenamed("id", "slot"), spark.createDataFrame([(0, "p"), (1, "q")], "position long, e string"))
    assert [r["e"] for r in slots.orderBy("slot").collect()] == ["p", "q", "p", "q", "p"]
    paths = facts.workspace_paths(spark.createDataFrame([(0, "facts/A/a.md", "a"), (1, "facts/A/A.md", "A")], "entity_index int, path string, name string"), "path", "name").orderBy("entity_index").collect()
    assert paths[0]["path"] == "facts/A/a.md" and paths[1]["path"].startswith("facts/A/A--")
    assert facts.run_status(2, 2) == "completed" and facts.run_status(2, 1) == "partial" and facts.run_status(2, 0) == "empty"


def test_splits_and_merges(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 100), ("b", 101)], "t string, k long")
    got = datasets.stratified_split(df, "t", F.col("k")).groupBy("t", "split").count().collect()
    assert {(r["t"], r["split"]): r["count"] for r in got} == {("a", "test"): 2, ("a", "train"): 18, ("b", "test"): 1, ("b", "train"): 1}
    with pytest.raises(ValueError):
        datasets.check_strata(df.where("k <> 101"), "t")
    with pytest.raises(ValueError):
        datasets.merge(df, df.drop("k"))
    with pytest.raises(ValueError):
        datasets.gate(df, "train")
    assert datasets.sample_numbers(100, 5, 7)[0] == __import__("random").Random(7).sample(range(100), 5)


def test_files_and_loaders(spark, tmp_path):
    for name, text in (("b/_index.md", "# skip\n" + "w " * 60), ("b/one.md", "# Heading\n" + "w " * 60), ("a/two-words.md", "w " * 60), ("a/short.md", "few")):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    got = corpora.load_corpus(spark, "handbook", str(tmp_path / "tree")).orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in got] == [(1, "Two words"), (2, "Heading")] and got[0]["text"].startswith("# Two words\n\nw") and got[1]["text"].startswith("# Heading\nw")
    (tmp_path / "rfc").mkdir()
    (tmp_path / "rfc" / "rfc7.txt").write_bytes(b"\xff " + b"w " * 60)
    r = corpora.load_corpus(spark, "rfcs", str(tmp_path / "rfc")).first()
    assert r["title"] == "RFC 7" and r["text"].startswith("# RFC 7\n\n")
    spark.range(3).write.parquet(str(tmp_path / "p/train"))
    spark.range(4).write.parquet(str(tmp_path / "p/other"))
    assert corpora.split_path(spark, str(tmp_path / "p")).endswith("/train")
    with pytest.raises(ValueError):
        corpora.split_path(spark, str(tmp_path / "p"), "test")
    assert corpora.cached(spark, str(tmp_path / "c"), lambda: spark.range(2)).count() == 2
    d = corpora.documents(spark.createDataFrame([(1, "T", None, "x", 5)], "id long, title string, content string, text string, year int")).first()
    assert d["content"] == "x" and d["metadata"] == {"year": "5"}
    with pytest.raises(ValueError):
        corpora.unique_documents(spark.createDataFrame([(1,), (1,)], "id long"))
    with pytest.raises(KeyError):
        corpora.find("none")


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert [(r["line"], r["x"]) for r in records.read_strict(spark, str(tmp_path / "a.jsonl"), "x long").orderBy("line").collect()] == [(1, 1), (3, 2)]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{bad\n')
    with pytest.raises(ValueError, match="line 2"):
        records.read_strict(spark, str(tmp_path / "b.jsonl"), "x long")
    out = lambda i, c: json.dumps({"custom_id": i, "response": {"choices": [{"message": {"content": c}}]}})
    (tmp_path / "c.jsonl").write_text("\n".join([out("a", "1"), "{bad", out("b", "2"), out("a", "3"), json.dumps({"custom_id": "d", "response": {"choices": []}}), json.dumps({"response": {}})]))
    rows, counts = records.read_batch(spark, str(tmp_path / "c.jsonl"))
    assert {r["custom_id"]: r["content"] for r in rows.collect()} == {"a": "3", "b": "2"}
    c = counts.first()
    assert (c["malformed"], c["missing_id"], c["missing_choices"], c["duplicate_ids"]) == (1, 1, 1, 1)
    records.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    assert records.read_json(str(tmp_path / "m.json"), {"a": int}) == {"a": 1}
    for f in (lambda: records.write_json(spark, str(tmp_path / "m.json"), {}), lambda: records.write_json(spark, str(tmp_path / "n.json"), {"a": float("nan")}), lambda: records.read_json(str(tmp_path / "m.json"), {"b": str})):
        with pytest.raises((FileExistsError, ValueError, TypeError)):
            f()
    records.write_lines(spark.range(3), str(tmp_path / "out"))
    assert records.count_lines(spark, str(tmp_path / "out")) == 3
    with pytest.raises(Exception):  # noqa: B017
        records.write_lines(spark.sql("select double('nan') x"), str(tmp_path / "nan"))


def test_traces(spark):
    trace = {"id": "t", "errors": [], "nodes": [{"sampled": True, "message": {"role": "assistant", "content": "A"}}, {"sampled": False, "message": {"role": "assistant", "content": "B"}}], "info": {"judge": [{"parsed": [{"name": "c", "reason": "", "verdict": " Yes"}, {"name": "d", "reason": "", "verdict": "no"}]}]}, "task": {"data": {"question": "Q", "rubric": [{"criterion": "c"}, {"criterion": "d"}]}}, "metrics": {"c": 1.0, "d": 1.0}}
    df = spark.createDataFrame([(json.dumps(trace),)], "v string").select(F.from_json("v", records.TRACE).alias("t")).select("t.*")
    got = records.judge_examples(df).orderBy("criterion_index").collect()
    assert [(r["response"], r["ground_truth"], r["error"]) for r in got] == [("A", 1, None), ("A", None, "metric and verdict differ")]


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", " ".join(f"w{j % (i + 5)}" for j in range(40)) + ".") for i in range(8)], "id long, title string, text string")
    records.build_index(docs, str(tmp_path), "c", size=16, encoder=HashingEncoder())
    entry = records.open_corpus(spark, str(tmp_path), "c")
    assert entry["document_count"] == 8 and entry["vector_dimensions"] == 64 and entry["ready"]
    chunks = spark.read.parquet(entry["chunks_namespace"])
    assert chunks.count() == entry["chunk_count"] == 24 and records.chunk_at(chunks, 5).first()["source_index"] == 5
    with pytest.raises(FileExistsError):
        records.build_index(docs, str(tmp_path), "c")
    with pytest.raises(KeyError):
        records.open_corpus(spark, str(tmp_path), "d")
    queries = encode(spark.createDataFrame([(0, "w7 w8"), (1, "w2")], "query_id int, text string"), "text", HashingEncoder(), query=True)
    for mode, n in (("bm25", 3), ("dense", 3), ("hybrid", 3), ("hybrid_reranked", 2)):
        got = retrieval.retrieve(queries, chunks, mode, n, OverlapReranker(), 5)
        rows = got.collect()
        assert rows and max(r["rank"] for r in rows) <= n and all(r["document_id"] is not None for r in rows)
    with pytest.raises(ValueError):
        records.delete_corpora(spark, [entry["chunks_namespace"]], "other")
    assert len(records.delete_corpora(spark, [entry["chunks_namespace"]] * 2, "corpus")) == 1


def test_providers(spark):
    v = HashingEncoder(8).encode(["a b", ""])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and v.dtype == np.float32

    class Half:
        def generate(self, prompts):
            if len(prompts) > 1 or prompts[0] == "bad":
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

    got = generate(spark.createDataFrame([("a",), ("bad",)], "p string").coalesce(1), "p", Half()).collect()
    assert {r["p"]: (r["response"], r["response_error"]) for r in got} == {"a": ("A", None), "bad": (None, "RuntimeError: no")}


def test_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    top = retrieval.top_k(docs.select("doc_id", "lang"), ["lang"], [F.col("doc_id")], 3) if hasattr(retrieval, "top_k") else None
    ops = inspect.operators(top)
    assert ops["WindowGroupLimit"] == 2 and ops["CartesianProduct"] == 0 and inspect.shuffles(top) == 1
    assert set(inspect.read_columns(top)) == {"doc_id", "lang"}
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    dense = retrieval.dense(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e, 5)
    assert inspect.operators(dense)["CartesianProduct"] == inspect.operators(dense)["BroadcastNestedLoopJoin"] == 0


def test_stream_feeds_an_index(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "t", "a b c"), (2, "t", "b c")], "id long, title string, text string").write.parquet(src)
    stream = spark.readStream.schema("id long, title string, text string").parquet(src)
    streaming.feed(stream, str(tmp_path / "ix"), 2).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ix/chunks")).count() == 3
    assert spark.read.parquet(str(tmp_path / "ix/postings")).where("term = 'b'").count() == 2
    rows = spark.readStream.schema("id long, title string, text string").parquet(src).select("id", F.when(F.col("id") == 1, "ready").otherwise("failed").alias("status"))
    streaming.append_records(rows, str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out/route=queries")).count() == 1


def test_task_rows_and_attempts(spark, tmp_path):
    from lodestone import prompts
    from lodestone.operators import retrieval, tasks
    from lodestone.sources import corpora

    (tmp_path / "a.jsonl").write_text('{"question": "q"}\n')
    hub = lambda name, split: spark.createDataFrame([(name, split)], "name string, split string")
    assert tasks.rows(spark, str(tmp_path / "a.jsonl"), "train", hub).first()["question"] == "q"
    assert tuple(tasks.rows(spark, "org/data", "train", hub).first()) == ("org/data", "train")
    with pytest.raises(FileNotFoundError):
        tasks.rows(spark, str(tmp_path / "b.jsonl"), "train", hub)
    with pytest.raises(ValueError):
        corpora.personas(hub("a", "b"), "name", 0)
    with pytest.raises(ValueError):
        prompts.render("{a} {b}", a=F.lit("x"))
    docs = spark.createDataFrame([("go", "1"), ("c~2", "2"), ("c~3", "3"), ("x", "4")], "language string, text string")
    assert sorted(r["text"] for r in corpora.developer_docs(["go", "c~3"]).where(docs).collect()) == ["1", "3"]
    errors = spark.createDataFrame([(["a", "b", "c", "d"],), ([],)], "e array<string>").select(prompts.with_errors(F.lit("p"), F.col("e")).alias("p")).collect()
    assert [r["p"] for r in errors] == ["p\n\nEarlier answers were refused:\n- b\n- c\n- d", "p"]
    vectors = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert retrieval.check_dimensions(vectors, "v", 2).count() == 1
    with pytest.raises(Exception, match="isn't the catalogued 3"):
        retrieval.check_dimensions(vectors, "v", 3).collect()


def test_samples_of_gapped_ids(spark):
    from lodestone.operators import datasets

    rows = spark.createDataFrame([(10 * i + 3,) for i in range(40)], "doc_id long")
    assert datasets.seeded_sample(rows, "doc_id", 15, 3).count() == 15 and datasets.seeded_sample(rows, "doc_id", 99, 3).count() == 40


def test_partial_ratio_with_a_cutoff_loses_no_window():
    r, hits = random.Random(5), 0
    for _ in range(1500):
        a = "".join(r.choice("abcd ") for _ in range(r.randint(1, 24)))
        edited = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(edited) + 1)
            edited[at : at + r.randint(0, 1)] = r.choice(["", "a", "e"])
        ends = ["".join(r.choice("abcdef ") for _ in range(r.choice([0, 0, 3, 30]))) for _ in range(2)]
        b = ends[0] + "".join(edited) + ends[1]
        for cutoff in (60, 80, 90, 97):
            score = matching.partial_ratio(a, b)
            assert matching.partial_ratio(a, b, cutoff) == (score if score >= cutoff else 0)
            hits += score >= cutoff
    assert hits > 1000
