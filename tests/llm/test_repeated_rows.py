"""Many equal rows: spans are held once."""

from lodestone.llm import suffix_dedup


def test_thousands_of_equal_rows(spark):
    text = " ".join(f"word{i * i}" for i in range(120))
    rows = [(1, text)] * 1500 + [(i, text) for i in range(2, 1502)] + [(9999, "alone " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spans = suffix_dedup.repeated_spans(docs)
    assert spans.count() == 1501 and max(len(r["spans"]) for r in spans.collect()) < 60
    got = suffix_dedup.repeat_report(docs).collect()
    assert len(got) == len(rows) and all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for r in got if r["doc_id"] != 9999)
    assert [r["n_removed"] for r in got if r["doc_id"] == 9999] == [0]
