"""Helpers and plans that hold at any size."""

from pyspark.sql import functions as F

from lodestone.functions.text import word_runs
from lodestone.operators import evaluation, matching, retrieval
from lodestone.session import running_index


def test_running_index_counts_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.expr("case when id % 10 <> 0 then id % 3 end").alias("b")).repartition(7)
    rows = running_index(df, [F.col("b").isNull(), F.col("b"), F.col("a")], "n").collect()
    want = sorted(rows, key=lambda r: (r["b"] is None, r["b"] or 0, r["a"]))
    assert [r["n"] for r in want] == list(range(1000))
    assert running_index(df.limit(0), ["a"], "n").count() == 0
    same = spark.range(20).select(F.lit(1).alias("a"))
    assert sorted(r["n"] for r in running_index(same, ["a"], "n").collect()) == list(range(20))


def test_word_runs(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(word_runs("w", 2)).collect()] == [["a b", "b c"], [], [], None]
    assert df.select(word_runs("w", 1)).first()[0] == ["a", "b", "c"]


def test_dense_is_the_same_in_small_parts(spark, monkeypatch):
    v = F.expr("transform(sequence(1, 4), k -> double((vec_id * 37 * k) % 11 - 5))")
    e = spark.range(200).select(F.col("id").alias("vec_id")).withColumn("embedding", v)
    q = e.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, retrieval.dense(q, e, 5, exclude_self=True).collect()))
    monkeypatch.setattr(retrieval, "SCORES", 50)
    assert sorted(map(tuple, retrieval.dense(q, e, 5, exclude_self=True).collect())) == whole and len(whole) == 23 * 5


def test_joins_beyond_the_broadcast_limit(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "x two three four five six seven y"), (3, None), (4, ""), (5, "three")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "two three four five six"), (2, "three"), (3, "wo three four five si"), (4, "seven eight nine ten eleven")], "item_id long, text string")
    want = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 5), (3, 1), (3, 2)]
    names = matching.dictionary(spark.createDataFrame([("two three",), ("Three",), ("eight",)], "name string"))
    found = [(1, "Three"), (1, "two three"), (2, "Three"), (2, "two three"), (5, "Three")]
    for most in (200_000, 0):
        monkeypatch.setattr(evaluation, "MAX_BROADCAST", most)
        monkeypatch.setattr(matching, "MAX_BROADCAST", most)
        assert sorted(map(tuple, evaluation.containment(asked, docs).collect())) == want
        assert sorted((r["doc_id"], r["name"]) for r in matching.exact(docs, names, "doc_id", "text").collect()) == found
