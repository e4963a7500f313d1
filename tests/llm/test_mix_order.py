"""The mixing stage's rows are in the order of their places."""

import corpus_pipeline
from lodestone.llm import mixing


def test_stage_is_in_the_order_of_places(spark):
    rows = [(i, "big" if i < 900 else "small", f"text number {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, "").collect()]
    want = mixing.mix(docs, max_repeats=corpus_pipeline.MAX_REPEATS).select("place", "row.doc_id").collect()
    assert got == [r["doc_id"] for r in sorted(want, key=lambda r: r["place"])]
    assert len(got) > 1000 and all(a != b for a, b in zip(got, got[1:]))
