"""The quota's fold over whole tables, against the rule on all rows."""

from collections import defaultdict

from lodestone.catalogue import QUERIES
from lodestone.operators import facts


def test_all_rows_with_whole_texts(spark, tmp_path):
    start = "the same first thirty letters or so, then "
    rows = [(i, "copies", "One  copy" if i % 2 else "one copy") for i in range(60)] + [(i, "copies", f"other {i}") for i in range(60, 90)]
    rows += [(100 + i, "prefix", f"{start}{i // 2}") for i in range(50)] + [(200 + i, "blank", " " if i < 45 else f"{start}{i}") for i in range(70)]
    rows += [(300 + 3 * i + (i > 50), "late", f"q {i % 40}") for i in range(90)] + [(900 + i, None, f"n {i}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    each = defaultdict(list)
    for i, source, text in sorted(rows):
        each[source].append((i, text, "complex" if i % 3 == 0 else "simple"))
    want = {(s, r[k][0], r[k][1]) for s, r in each.items() for k in facts.fill_quota([x[1:] for x in r], 10, 0.7)}
    got = QUERIES["qa_quota_fold"](spark, str(tmp_path)).collect()
    assert {(r["source"], r["doc_id"], r["question"]) for r in got} == want and len(got) == len(want)
