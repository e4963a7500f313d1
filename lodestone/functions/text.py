"""Scalar text functions as Spark columns. ``\\s`` is taken with Unicode white space where the rule says words or strip."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"
TOKEN = r"[\p{L}\p{N}]+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGES, "")


def words(x: Column) -> Column:
    """Runs between white space; none for an empty text."""
    return F.filter(F.split(x, SPACE), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def word_runs(array_col: str, n: int) -> Column:
    """The runs of n words of an array of words, joined by spaces."""
    if n == 1:
        return F.col(array_col)
    starts = F.slice(array_col, F.lit(1), F.greatest(F.lit(0), F.size(array_col) - (n - 1)))
    return F.transform(starts, lambda x, i: F.concat_ws(" ", x, *[F.get(F.col(array_col), i + j) for j in range(1, n)]))


def tokens(x: Column) -> Column:
    """Lower-case letter and digit runs: what full-text search indexes."""
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))


def single_line(x: Column) -> Column:
    return F.array_join(words(x), " ")


def collapse_key(x: Column) -> Column:
    """Key of texts equal but for case and white space."""
    return single_line(F.lower(x))


def trim_key(x: Column) -> Column:
    return F.lower(strip(x))


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_attribute(x: Column) -> Column:
    """Escaped and quoted; in single quotes if it holds double ones only."""
    e = xml_escape(x)
    for a, b in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    double, single = F.contains(e, F.lit('"')), F.contains(e, F.lit("'"))
    return F.when(double & ~single, F.concat(F.lit("'"), e, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(e, F.lit('"'), F.lit("&quot;")), F.lit('"')))


def slug(x: Column, lower: bool = False, limit: int = 80) -> Column:
    out = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.left(F.lower(out) if lower else out, F.lit(limit))


def safe_name(x: Column) -> Column:
    """A data source's name as an identifier."""
    return F.translate(x, "-/.", "___")


def count_literal(x: Column, literal: str, case_sensitive: bool = False) -> Column:
    """Occurrences that don't overlap."""
    a, b = (x, literal) if case_sensitive else (F.lower(x), literal.lower())
    return F.regexp_count(a, F.lit(re.escape(b)))


def find_literal(x: Column, literal: str, case_sensitive: bool = False) -> Column:
    """Position from 0 of the first occurrence, -1 if there is none; in the lower-cased text unless case_sensitive."""
    a, b = (x, literal) if case_sensitive else (F.lower(x), literal.lower())
    return F.instr(a, b) - 1


def snippet(x: Column, at: Column, chars: int = 200) -> Column:
    """The text around position ``at``: half of chars, at least 10, to each side."""
    half = max(10, chars // 2)
    start = F.greatest(F.lit(0), at - half)
    return F.substr(x, start + 1, at + half - start)


def version_parts(label: Column) -> tuple[Column, Column]:
    """Base and version numbers (null if there are none) of labels like name~4.10.1."""
    number = F.regexp_extract(F.substr(label, F.instr(label, "~") + 1), r"^(\d+(?:\.\d+)*)", 1)
    has = F.contains(label, F.lit("~")) & (number != "")
    base = F.when(F.contains(label, F.lit("~")), F.substring_index(label, "~", 1)).otherwise(label)
    return base, F.when(has, F.transform(F.split(number, r"\."), lambda p: p.cast("int")))


# titles


def first_line(x: Column) -> tuple[Column, Column]:
    """Title and body: the first line, and the other lines."""
    return strip(F.substring_index(x, "\n", 1)), strip(F.when(F.contains(x, F.lit("\n")), F.substr(x, F.instr(x, "\n") + 1)).otherwise(F.lit("")))


def first_nonblank_line(x: Column) -> tuple[Column, Column]:
    """As first_line, but blank lines before the title are dropped."""
    return first_line(F.regexp_replace(x, r"(?U)^\s+", ""))


def pep_title(x: Column) -> Column:
    """After the first Title: of the first line, up to the first stop word; or that whole line."""
    line = F.regexp_extract(x, r"^([^\r\n]*)", 1)
    # fixed values: the header fields that end a title, by precedence
    stops = [" Author:", " Status:", " Type:", " Created:", " Python-Version:"]
    title = F.regexp_extract(line, r" Title: ?(.*)$", 1)
    cut = title
    for s in reversed(stops):
        cut = F.when(F.contains(title, F.lit(s)), F.substring_index(title, s, 1)).otherwise(cut)
    return F.when(F.contains(line, F.lit(" Title:")) & (title != ""), strip(cut)).otherwise(strip(line))


def front_matter_title(x: Column) -> Column:
    """The title: that is the first line after a line of three dashes, or null."""
    return F.nullif(F.regexp_extract(x, r"(?m)^---\s*\ntitle:\s*(.+?)\s*\n", 1), F.lit(""))


def heading_title(x: Column) -> Column:
    """The first level-one heading, or null."""
    return F.nullif(strip(F.regexp_extract(x, r"(?m)^# (.*)$", 1)), F.lit(""))


def block_title(x: Column) -> Column:
    """title: of the front matter between lines of dashes at the start, without quotes, or null."""
    block = F.regexp_extract(x, r"^[ \t]*---[ \t]*\n([\s\S]*?)(?:\n[ \t]*---|\z)", 1)
    return F.nullif(F.regexp_replace(strip(F.regexp_extract(block, r"(?im)^title:(.*)$", 1)), r"^['\"]+|['\"]+$", ""), F.lit(""))


def file_title(stem: Column) -> Column:
    """A file's name with dashes and underscores as spaces, first letter in upper case."""
    clean = strip(F.regexp_replace(stem, r"[-_]+", " "))
    return F.when(clean == "", stem).otherwise(F.concat(F.upper(F.left(clean, F.lit(1))), F.substr(clean, F.lit(2))))


def rfc_title(stem: Column) -> Column:
    number = F.regexp_extract(stem, r"(?i)^rfc(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("RFC "), number)).otherwise(stem)


def merge_title(title: Column, body: Column, unless_there: bool = False) -> Column:
    """Heading, blank line, body; either alone if the other is blank. unless_there: a body that starts with the heading stays."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("# "), title)
    both = F.concat(head, F.lit("\n\n"), body)
    out = F.when(strip(title) == "", body).when(strip(body) == "", head).otherwise(both)
    return F.when((strip(title) != "") & F.startswith(F.regexp_replace(body, r"(?U)^\s+", ""), head), body).otherwise(out) if unless_there else out


# what Spark has no function for


def _mapped(f: Callable[[str], str], x: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return pandas_udf(run, "string")(x)


def normalize(x: Column) -> Column:
    """Compatibility-normalised, lower case, punctuation as spaces, single spaces."""
    return _mapped(normalize_text, x)


def normalize_text(x: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", x).lower()).split())


def _initials(ascii_only: bool) -> tuple[str, str]:
    """BMP characters whose compatibility form starts with a letter A to Z, in either case, or a digit; and that start. ascii_only: the canonical form, and the digits 0 to 9."""
    form = "NFD" if ascii_only else "NFKD"
    starts = {chr(c): unicodedata.normalize(form, chr(c))[0].upper() for c in range(0x30, 0x10000) if not 0xD800 <= c < 0xE000}
    kept = {c: b for c, b in starts.items() if len(b) == 1 and (b in string.ascii_uppercase or (b in string.digits if ascii_only else b.isdigit()))}
    return "".join(kept), "".join(kept.values())


#: The longest file name, what is left of a longer one, and the length of its digest.
MAX_NAME, CUT_NAME, DIGEST = 180, 160, 12


def workspace_path(x: Column, ascii_only: bool = False) -> Column:
    """facts/<initial>/<name>.md: the initial without accent, or an underscore; the name percent-encoded, a long one cut and given a digest.

    ascii_only, as DuckDB's functions have it: only white space of ASCII (without the vertical tab) is stripped, and the initial is one of
    A to Z and 0 to 9, without accents; ß and signs like ² go to the underscore.
    """
    name = F.regexp_replace(x, r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", "") if ascii_only else strip(x)
    first, (known, starts) = F.substring(name, 1, 1), _initials(ascii_only)
    other = F.lit("_") if ascii_only else F.when(first == "ß", "SS").otherwise("_")
    folder = F.when((first != "") & (F.instr(F.lit(known), first) > 0), F.translate(first, known, starts)).otherwise(other)
    code = F.url_encode(name)
    for was, now in (("+", " "), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("*", "%2A")):  # which forms write in another way than paths
        code = F.replace(code, F.lit(was), F.lit(now))
    code = F.when(code == "", F.lit("entity")).otherwise(code)
    short = F.concat(F.left(code, F.lit(CUT_NAME)), F.lit("--"), F.left(F.sha2(F.encode(x, "UTF-8"), 256), F.lit(DIGEST)))
    return F.concat(F.lit("facts/"), folder, F.lit("/"), F.when(F.length(code) > MAX_NAME, short).otherwise(code), F.lit(".md"))
