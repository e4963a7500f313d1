"""Corpora as (id, title, text): a typed registry of loaders over columnar tables and file trees."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.datasets import latest_versions
from ..session import dense_index

MIN_WORDS, MAX_WORDS = 50, 8000
NoTitle = tuple[Column, Column]


@dataclass(frozen=True)
class Corpus:
    """How a corpus becomes documents.

    titles: title and body of the raw text. merge: A (heading and body), B (unless the body starts with the heading), C (heading and whole
    text), or none. ids: column to read, or None to number rows in order; dense: after the filters, else before them.
    """

    titles: Callable[[DataFrame], tuple[Column, Column]]
    merge: str | None = "A"
    text_col: str = "text"
    id_col: str | None = None
    dense: bool = False
    words: tuple[int, int] | None = (MIN_WORDS, MAX_WORDS)
    where: Callable[[DataFrame], DataFrame] | None = None
    description: str | None = None


def _by(f: Callable[[Column], tuple[Column, Column]]) -> Callable[[DataFrame], tuple[Column, Column]]:
    return lambda df: f(F.col("text"))


#: Loaders by safe name.
REGISTRY: dict[str, Corpus] = {
    "news": Corpus(_by(T.first_line)),
    "patents": Corpus(_by(T.first_nonblank_line)),
    "peps": Corpus(_by(lambda x: (T.pep_title(x), x)), merge="C"),
    "web": Corpus(_by(lambda x: (F.coalesce(T.front_matter_title(x), F.lit("")), x)), merge=None, id_col="docid", where=lambda df: df.where(english(F.left("text", F.lit(500))))),
    "articles": Corpus(lambda df: (F.col("title"), F.col("text"))),
    "developer_docs": Corpus(lambda df: (F.col("title"), F.col("text")), dense=True, where=lambda df: latest_versions(df, "language")),
    "handbook": Corpus(lambda df: (F.coalesce(T.heading_title(F.col("text")), T.file_title(stem(F.col("path")))), F.col("text")), merge="B", where=lambda df: df.where(~F.col("path").rlike(r"/_index\.[^/]*$"))),
    "site": Corpus(lambda df: (F.coalesce(T.block_title(F.col("text")), T.heading_title(F.col("text")), T.file_title(stem(F.col("path")))), F.col("text")), merge="B", where=lambda df: df.where(~F.col("path").rlike(r"/_index\.[^/]*$"))),
    "guides": Corpus(lambda df: (F.coalesce(T.heading_title(F.col("text")), T.file_title(stem(F.col("path")))), F.col("text")), merge="B"),
    "rfcs": Corpus(lambda df: (T.rfc_title(stem(F.col("path"))), F.col("text"))),
}


def allow_list(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The rows whose column is one of the values."""
    return df.where(F.col(column).isin(allowed))


def developer_docs(technologies: list[str]) -> Corpus:
    """The developer_docs corpus of these technologies only, each as its rows name it."""
    every = REGISTRY["developer_docs"]
    return replace(every, where=lambda df: every.where(allow_list(df, "language", technologies)))


def personas(df: DataFrame, id_col: str, limit: int | None = None) -> DataFrame:
    """All rows, or the first ``limit`` by id."""
    if limit is None:
        return df
    if limit <= 0:
        raise ValueError("limit must be positive")
    return df.orderBy(id_col).limit(limit)


def register(name: str, corpus: Corpus) -> None:
    key = name.translate(str.maketrans("-/.", "___"))
    if key in REGISTRY:
        raise ValueError(f"there is a corpus {key!r} already")
    REGISTRY[key] = corpus


def find(name: str) -> Corpus:
    key = name.translate(str.maketrans("-/.", "___"))
    if key not in REGISTRY:
        raise KeyError(f"no corpus {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[key]


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


#: Frequent English words, by which a text counts as English.
ENGLISH = ["the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "as", "by", "it", "was", "are"]


def english(x: Column, share: float = 0.1) -> Column:
    """Whether so many of a text's words are frequent English ones."""
    w = T.words(F.lower(x))
    return F.try_divide(F.size(F.filter(w, lambda t: t.isin(ENGLISH))), F.size(w)) >= share


def in_word_range(x: Column, least: int = MIN_WORDS, most: int = MAX_WORDS) -> Column:
    """Null texts are outside."""
    return F.coalesce(T.word_count(x).between(least, most), F.lit(False))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, text of each file below a folder: UTF-8 with bad bytes replaced, stripped. A file that can't be read is skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").load(path)
    text = F.decode(F.col("content"), "UTF-8") if spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "true" else F.col("content").cast("string")
    return raw.select(F.col("path"), T.strip(text).alias("text"))


def non_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise FileNotFoundError(f"{what}: no file found")
    return df


def load(df: DataFrame, corpus: Corpus, order: list[str]) -> DataFrame:
    """id, title, text (and path, if it has one) of raw rows. ``order`` is what rows without ids are numbered by: paths or an integer column."""
    rows = df
    if corpus.id_col is None and not corpus.dense:
        rows = number(rows, order)
    if corpus.where:
        rows = corpus.where(rows)
    title, body = corpus.titles(rows)
    if corpus.merge in ("A", "B"):
        merged = T.merge_title(title, body, corpus.merge == "B")
    elif corpus.merge == "C":
        merged = F.when(T.strip(title) != "", F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    else:
        merged = body
    out = rows.withColumn("_title", title).withColumn("_text", merged)
    if corpus.words:
        out = out.where(in_word_range(F.col("_text"), *corpus.words))
    if corpus.id_col is not None:
        out = out.withColumn("id", F.col(corpus.id_col).cast("long"))
    elif corpus.dense:
        out = number(out, order)
    return out.select("id", F.col("_title").alias("title"), F.col("_text").alias("text"), *(["path"] if "path" in df.columns else []))


def number(df: DataFrame, order: list[str]) -> DataFrame:
    """Dense ids from 0. Rows are ranged by an integer column, or by hashing nothing: paths are sorted within their folder's first letters."""
    first = order[0]
    if dict(df.dtypes)[first] in ("bigint", "int", "smallint", "tinyint"):
        return dense_index(df, first, [F.col(c) for c in order[1:]], "id")
    # strings: ranges of equal folder, in order; a folder's files are few against the corpus
    from pyspark.sql import Window

    folder = F.regexp_extract(F.col(first), r"^(.*?)[^/]*$", 1)
    counts = df.groupBy(folder.alias("_f")).agg(F.count("*").alias("_n"))
    before = counts.select("_f", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_f").orderBy(*order)) - 1
    return df.withColumn("_f", folder).join(before, "_f").withColumn("id", F.col("_b") + within).drop("_f", "_b")


def load_corpus(spark: SparkSession, name: str, path: str, order: list[str] | None = None) -> DataFrame:
    """A registered corpus from a folder of Parquet splits (train, or else the first) or of text files."""
    corpus = find(name)
    tree = name in ("handbook", "site", "guides", "rfcs")
    if tree:
        pattern = "*.txt" if name == "rfcs" else "*.{md,mdx}"
        return load(non_empty(files(spark, path, pattern), name), corpus, ["path"])
    return load(spark.read.parquet(split_path(spark, path)), corpus, order or ["id"])


def splits(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def split_path(spark: SparkSession, path: str, split: str | None = None) -> str:
    """The folder of a split: the one named, or train, or the first; the path itself if it has none."""
    there = splits(spark, path)
    if split and split not in there:
        raise ValueError(f"no split {split!r}; there are {there}")
    chosen = split or ("train" if "train" in there else there[0] if there else None)
    return f"{path}/{chosen}" if chosen else path


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A prepared table, built and written first if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.parquet(path)
    return spark.read.parquet(path)


def documents(df: DataFrame, known: tuple[str, ...] = ("id", "title", "content", "text", "metadata", "document_id")) -> DataFrame:
    """id, title, content, metadata, document_id: content else text else empty; other columns go to metadata, where they overwrite nothing. A blank id is an error."""
    bad = F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == "")
    content = F.coalesce(*[F.col(c) for c in ("content", "text") if c in df.columns], F.lit(""))
    extra = [c for c in df.columns if c not in known]
    made = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(c).cast("string") for c in extra])) if extra else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    if "metadata" in df.columns:
        made = F.map_concat(F.map_filter(made, lambda k, _: ~F.map_contains_key("metadata", k)), F.col("metadata"))
    own = F.col("document_id") if "document_id" in df.columns else F.lit(None).cast(df.schema["id"].dataType)
    return df.select(F.when(bad, F.raise_error(F.lit("a document has no id"))).otherwise(F.col("id")).alias("id"), (F.col("title") if "title" in df.columns else F.lit("")).alias("title"), content.alias("content"), made.alias("metadata"), own.alias("document_id"))


def unique_documents(df: DataFrame) -> DataFrame:
    """documents(), after a check that no id is there twice."""
    from ..operators.datasets import duplicates

    found = duplicates(df, "id").limit(5).collect()
    if found:
        raise ValueError(f"ids that are there more than once: {[r['id'] for r in found]}")
    return documents(df)
