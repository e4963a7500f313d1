"""Text functions and parsers on small cases whose answers follow by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import parsing as P
from lodestone.functions import text as T
from lodestone.operators import chunking, facts, matching, tools
from lodestone.sources import corpora


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()) or "x int")
    return df.select(column.alias("v")).first()["v"]


def test_word_bounds(spark):
    rows = [(n, "w " * n) for n in (49, 50, 8000, 8001)] + [(-1, None)]
    kept = spark.createDataFrame(rows, "n int, t string").where(corpora.in_word_range(F.col("t"))).collect()
    assert [r["n"] for r in kept] == [50, 8000]


@pytest.mark.parametrize(
    ("f", "x", "title", "body"),
    [(T.first_line, "T\nb1\nb2", "T", "b1\nb2"), (T.first_nonblank_line, "\n \nT\nb", "T", "b"), (T.first_line, "T", "T", ""), (T.first_line, "", "", "")],
)
def test_titles_and_bodies(spark, f, x, title, body):
    a, b = f(F.col("x"))
    assert (one(spark, a, x=x), one(spark, b, x=x)) == (title, body)
    merged = one(spark, T.merge_title(a, b), x=x)
    assert merged == (f"# {title}\n\n{body}" if title and body else f"# {title}" if title else body)


def test_other_titles(spark):
    assert one(spark, T.pep_title(F.col("x")), x="PEP: 8 Title: Style Guide Author: A Status: B\nrest") == "Style Guide"
    assert one(spark, T.pep_title(F.col("x")), x="No header here\nrest") == "No header here"
    assert one(spark, T.front_matter_title(F.col("x")), x="---\ntitle: A b\ndate: x\n---\n") == "A b"
    assert one(spark, T.block_title(F.col("x")), x="---\nid: 1\nTitle: 'Q'\n---\ntext") == "Q"
    assert one(spark, T.block_title(F.col("x")), x="---\nid: 1\n---\ntitle: no") is None
    assert one(spark, T.heading_title(F.col("x")), x="a\n# H one \nb") == "H one"
    assert one(spark, T.file_title(F.col("x")), x="my-file_name") == "My file name"
    assert one(spark, T.rfc_title(F.col("x")), x="rfc2119") == "RFC 2119"
    assert one(spark, T.merge_title(F.lit("T"), F.col("x"), True), x="  # T\nb") == "  # T\nb"


def test_snippets_and_counts(spark):
    x = "a" * 30 + "needle" + "b" * 30
    assert one(spark, T.snippet(F.col("x"), F.lit(30), 4), x=x) == x[20:40]
    assert one(spark, T.count_literal(F.col("x"), "aa"), x="aaaa") == 2
    assert one(spark, T.find_literal(F.col("x"), "B."), x="aab.") == 2
    assert one(spark, T.xml_attribute(F.col("x")), x='a"b<') == "'a\"b&lt;'"
    assert one(spark, T.slug(F.col("x")), x="--a b/c..") == "a-b-c"
    assert one(spark, T.collapse_key(F.col("x")), x=" A\n b ") == "a b"


def test_python_functions(spark):
    assert one(spark, T.normalize(F.col("x")), x="Ａ-b,  Ç") == "a b ç"
    assert one(spark, T.workspace_path(F.col("x")), x="Émile/Zola") == "facts/E/%C3%89mile%2FZola.md"
    path = lambda x: one(spark, T.workspace_path(F.col("x")), x=x).split("/")
    assert path(" 3d")[1] == "3" and path("-")[1] == "_" and len(path("é" * 100)[2]) == 160 + 2 + 12 + 3
    assert path("straße (a~b) *+%")[2] == "stra%C3%9Fe (a~b) %2A%2B%25.md" and path("ßx")[1] == "SS" and path("  ")[1:] == ["_", "entity.md"]


def test_versions(spark):
    from lodestone.operators.datasets import latest_versions

    rows = spark.createDataFrame([("x~4.9",), ("x~4.10",), ("y",), ("x~rc",)], "label string")
    assert sorted(r[0] for r in latest_versions(rows, "label").collect()) == ["x~4.10", "x~rc", "y"]


def test_fact_parsing(spark):
    x = "<fact><statement> S </statement><doc_ids>5, 3,5</doc_ids><mentioned_entities>A, a, T ,</mentioned_entities></fact><fact><statement>s</statement></fact><fact><statement> </statement></fact>"
    (f,) = one(spark, P.facts(F.col("x"), F.lit("t")), x=x)
    assert (f["statement"], f["doc_ids"], f["fact_id"], f["mentioned_entities"]) == ("S", [3, 5], 0, ["A"])
    assert one(spark, P.integers(F.col("x")), x="1-2") == [-2, 1]
    assert one(spark, P.judgment(F.col("x")), x="<judgment>Yes</judgment><judgment>no</judgment>") is None
    assert one(spark, P.judgment(F.col("x")), x="x <Judgment> Correct </judgment>") == "correct"
    assert one(spark, P.result_text(F.col("x"), "query"), x="pre <result><query> q </query></result> post") == "q"
    assert one(spark, P.hard_negative_ids(F.col("x")), x='<hard_negatives><chunk id="7"/><chunk id="x"/></hard_negatives>') == ["7", "x"]


def test_verdicts_and_rubrics(spark):
    from lodestone.catalogue import RUBRIC_TEXT, VERDICT_TEXTS

    got = [one(spark, P.verdicts(F.col("x")), x=x) for x in VERDICT_TEXTS]
    assert [len(g["verdicts"]) for g in got] == [1, 1, 1, 0] and got[2]["verdicts"][0]["name"] == "b" and got[1]["verdicts"][0]["reason"] == "1 < 2 & 3" and got[3]["error"]
    assert got[2]["verdicts"][0]["reason"] == "q"
    row = "<criterion><name>{0}</name><reason>{1}</reason><verdict>no</verdict></criterion>"
    for inside, want in ((row.format("a", "x &lt; <i>y <b>z</b></i>"), ["x < y z"]), (row.format("a", "1 < 2 &lt;"), ["1 < 2 &lt;"]), (row.format("a", "r") + "<criterion><name>b</name></criterion>", None), ("", None)):
        v = one(spark, P.verdicts(F.col("x")), x=f"<criteria n='1'>{inside}</criteria >")
        assert [r["reason"] for r in v["verdicts"]] == (want or []) and (v["error"] is None) == bool(want)
    assert one(spark, P.verdicts(F.col("x")), x=None)["error"]
    assert P.parse_rubric(RUBRIC_TEXT)["doc_ids"] == [1, 2, 3] and P.parse_rubric(RUBRIC_TEXT)["rubric"][1] == {"criterion": "Second", "doc_ids": [3]}
    for bad in (RUBRIC_TEXT.replace("2. ", "3. "), RUBRIC_TEXT + "x", RUBRIC_TEXT.replace("Docs: 3", "Docs: x"), RUBRIC_TEXT.replace("## Docs\n", ""), None, "# Question rubric"):
        assert P.parse_rubric(bad)["error"] and P.parse_rubric(bad)["entity"] is None


def test_regex_guard():
    for bad in ("(?=x)", r"(a)\1", "(?>a)", "(?<!a)b", "(?(1)a|b)"):
        with pytest.raises(Exception):  # noqa: B017
            tools.check_regex(bad)
    for good in (r"a\(\?=b", "[a-z]+", "(?:a|b)", "(?i)x"):
        tools.check_regex(good)


def test_quota():
    simple, hard = [(f"q{i}", "simple") for i in range(4)], [(f"c{i}", "complex") for i in range(4)]
    assert facts.fill_quota(simple + hard, 4, 0.7) == [0, 4, 5, 6]
    assert facts.fill_quota([("A b", "complex"), ("a  B", "complex"), ("", "complex")], 2, 1.0) == [0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c.\n", max_size=300), st.integers(1, 9))
def test_chunks_join_to_the_text(text, size):
    parts = chunking.recursive_chunks(text, size)
    assert "".join(parts) == text and all(len(p.split()) <= size for p in parts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", max_size=12), st.text(alphabet="abcd", max_size=12))
def test_indel_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 200 * table[-1][-1] / (len(a) + len(b)) if a and b else 0
    assert matching.indel_ratio(a, b) == matching.indel_ratio(b, a) == want <= matching.bound(len(a), len(b)) + 1e-9
