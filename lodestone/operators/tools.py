"""What agents call: search, read, text scan. Each answers for a table of requests or returns rows and their rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_literal, find_literal, snippet, xml_escape

#: Fixed limits of the tools.
MAX_QUERIES, MAX_READS, SEARCH_K, SCAN_K, SNIPPET = 3, 3, 10, 25, 200
_LOOK = re.compile(r"\(\?(?:[=!>(]|<[=!])|\(\?P=")


def check_regex(pattern: str) -> None:
    """Refuses what linear-time engines lack: look-around, back-references, conditionals, atomic groups. Java would take them."""
    re.compile(pattern)
    bare = re.sub(r"\\\\", "", pattern)
    if _LOOK.search(re.sub(r"\\[^1-9k]", "", bare)) or re.search(r"\\[1-9]|\\k[<{']", bare):
        raise ValueError(f"not supported in patterns: look-around, back-reference, conditional or atomic group: {pattern!r}")


def text_scan(chunks: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = False, limit: int = SCAN_K, snippet_chars: int = SNIPPET) -> DataFrame:
    """document_id, title, total, snippet, rank for chunks (source_index, document_id, title, content) with matches.

    A document's snippet comes from its chunk with most matches, of equals the first. Ranks go by total, then by the id as text.
    Matches that cross chunks aren't found; an empty pattern finds nothing.
    """
    text = F.col("content")
    if regex:
        check_regex(pattern)
        p = F.lit(pattern if case_sensitive else f"(?i){pattern}")
        count, at = F.regexp_count(text, p), F.regexp_instr(text, p) - 1
    else:
        count, at = count_literal(text, pattern, case_sensitive), find_literal(text, pattern, case_sensitive)
    found = chunks.where(F.lit(bool(pattern))).withColumn("n", count).where("n > 0").withColumn("at", at)
    key = F.coalesce(F.col("document_id").cast("string"), F.col("title"))
    best = F.max_by(F.struct("content", "at"), F.struct("n", (-F.col("source_index")).alias("i")))
    docs = found.groupBy(key.alias("document_id")).agg(F.sum("n").alias("total"), F.min_by("title", "source_index").alias("title"), best.alias("b"))
    top = docs.orderBy(F.desc("total"), "document_id").limit(limit)
    return top.select("document_id", "title", "total", snippet(F.col("b.content"), F.col("b.at"), snippet_chars).alias("snippet"))


def requests(df: DataFrame, array_col: str, most: int) -> DataFrame:
    """The first ``most`` entries of each request, with their positions."""
    return df.select("*", F.posexplode(F.slice(array_col, 1, most)).alias("position", "entry"))


def _lines(*parts: Column | str) -> Column:
    return F.array_join(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), "\n")


def _element(tag: str, x: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), xml_escape(F.coalesce(x.cast("string"), F.lit(""))), F.lit(f"</{tag}>"))


def _element_lines(tag: str, r: Column, snippet_field: str) -> Column:
    return _lines(f"<{tag}>", _element("id", r["document_id"]), _element("title", r["title"]), _element("snippet", r[snippet_field]), f"</{tag}>")


def render_search(found: Column) -> Column:
    """The answer to a call. found: an array of structs (query, results), of which the first MAX_QUERIES count; results: structs (document_id, title, content), in order."""

    def one(q: Column) -> Column:
        head = F.array(F.concat(F.lit('<query value="'), xml_escape(q["query"]), F.lit('">')))
        return F.array_join(F.concat(head, F.transform(q["results"], lambda r: _element_lines("result", r, "content")), F.array(F.lit("</query>"))), "\n")

    return F.array_join(F.concat(F.array(F.lit("<search_results>")), F.transform(F.slice(found, 1, MAX_QUERIES), one), F.array(F.lit("</search_results>"))), "\n")


def read(asked: DataFrame, documents: DataFrame, key: str = "request_id", ids: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, xml for each request: the full texts of its first MAX_READS ids, in their order, or that there is none. Ids are integers and aren't quoted."""
    wanted = requests(asked.select(key, ids), ids, MAX_READS).select(key, "position", F.col("entry").alias("_id"))
    got = wanted.join(documents.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t")), "_id", "left")
    name = F.col("_id").cast("string")
    body = F.coalesce(F.col("_t"), F.concat(F.lit("Error: Document with id '"), name, F.lit("' not found in corpus.")))
    row = _lines(F.concat(F.lit("<document id="), name, F.lit(">")), xml_escape(body), "</document>")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("x")))), lambda r: r["x"])
    found = got.groupBy(key).agg(rows.alias("_rows"))
    return asked.select(key).join(found, key, "left").select(key, F.array_join(F.concat(F.array(F.lit("<documents>")), F.coalesce("_rows", F.array().cast("array<string>")), F.array(F.lit("</documents>"))), "\n").alias("xml"))


def render_scan(rows: DataFrame) -> DataFrame:
    """xml: the scan's rows, at most its limit, in one row; empty if nothing was found."""
    order = F.struct((-F.col("total")).alias("a"), "document_id", "title", "snippet")
    every = F.transform(F.array_sort(F.collect_list(order)), lambda r: _element_lines("match", r, "snippet"))
    return rows.agg(F.array_join(every, "\n").alias("xml"))
