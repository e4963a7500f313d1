"""JSON lines, strict and tolerant; rollout traces; metadata; run folders; the index and its catalogue."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_VERSION = 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of the lines that aren't blank. A file is read whole, for line numbers; batch outputs are many files of bounded size."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return raw.select("file", (F.col("line") + 1).alias("line"), "value").where(F.trim("value") != "")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line and the fields of each line; a line that isn't an object of the schema is an error that names its number."""
    parsed = lines(spark, path).withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    is_object = F.startswith(F.ltrim("value"), F.lit("{"))
    bad = parsed.where(F.col("r").isNull() | F.col("r._bad").isNotNull() | ~is_object).orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}, line {bad[0]['line']}: not a JSON object of the right form")
    return parsed.select("file", "line", "r.*").drop("_bad")


BATCH = "custom_id string, response struct<choices:array<struct<message:struct<content:string>>>>, _bad string"


def read_batch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Batch outputs: usable rows (custom_id, content, file, line; a repeated id's last), and one row of counts of what was wrong."""
    from ..operators.facts import last_responses

    flagged = (
        lines(spark, path)
        .withColumn("r", F.from_json("value", BATCH, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        .select("file", "line", "r.custom_id", F.col("r._bad").isNotNull().alias("malformed"), F.get(F.col("r.response.choices"), F.lit(0))["message"]["content"].alias("content"))
    )
    no_id = ~F.col("malformed") & (F.trim(F.coalesce("custom_id", F.lit(""))) == "")
    no_choice = ~F.col("malformed") & ~no_id & F.col("content").isNull()
    good = flagged.where(~F.col("malformed") & ~no_id & F.col("content").isNotNull()).select("custom_id", "content", "file", "line")
    counts = flagged.agg(F.count("*").alias("lines"), F.count_if("malformed").alias("malformed"), F.count_if(no_id).alias("missing_id"), F.count_if(no_choice).alias("missing_choices"), (F.count(F.when(F.col("content").isNotNull(), F.col("custom_id"))) - F.count_distinct(F.when(F.col("content").isNotNull(), F.col("custom_id")))).alias("duplicate_ids"))
    return last_responses(good, [F.col("file"), F.col("line")]).drop("place"), counts


TRACE = "id string, errors array<string>, nodes array<struct<sampled:boolean,message:struct<role:string,content:string>>>, info struct<judge:array<struct<parsed:array<struct<name:string,reason:string,verdict:string>>>>>, task struct<data:struct<question:string,prompt:string,rubric:array<struct<criterion:string>>>>, metrics map<string,double>"


def last_reply(nodes: Column) -> Column:
    """The content of the last sampled assistant message; null if there is none."""
    own = F.filter(nodes, lambda n: n["sampled"] & (n["message"]["role"] == "assistant"))
    return F.try_element_at(own, F.lit(-1))["message"]["content"]


def judge_examples(traces: DataFrame) -> DataFrame:
    """One row for each criterion of a trace: example_id, question, response, criterion_index, criterion_name, ground_truth (0/1), error.

    A trace without a reply, with errors, or whose metric and verdict of a criterion differ has an error and no truth.
    """
    verdicts = F.flatten(F.transform("info.judge", lambda j: j["parsed"]))
    flat = traces.select(F.col("id").alias("example_id"), F.coalesce("task.data.question", "task.data.prompt").alias("question"), last_reply(F.col("nodes")).alias("response"), "errors", "metrics", verdicts.alias("v"), F.posexplode("task.data.rubric").alias("criterion_index", "c"))
    name = F.col("c.criterion")
    own = F.get(F.filter("v", lambda x: x["name"] == name), F.lit(0))["verdict"]
    by_verdict = F.when(F.lower(F.trim(own)) == "yes", 1).when(F.lower(F.trim(own)) == "no", 0)
    by_metric = F.try_element_at("metrics", name)
    error = F.when(F.size("errors") > 0, "the rollout has errors").when(F.col("response").isNull(), "no reply").when(by_verdict.isNull(), "no verdict").when(by_metric.isNotNull() & (by_metric != by_verdict), "metric and verdict differ")
    return flat.select("example_id", "question", "response", "criterion_index", name.alias("criterion_name"), F.when(error.isNull(), by_verdict).alias("ground_truth"), error.alias("error"))


def read_json(path: str, required: dict[str, type]) -> dict:
    """A small metadata file on the driver, its fields' types checked."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    if not isinstance(got, dict):
        raise TypeError(f"{path}: not an object")
    wrong = [k for k, t in required.items() if not isinstance(got.get(k), t) or (t is int and isinstance(got[k], bool))]
    if wrong:
        raise TypeError(f"{path}: missing or of another type: {wrong}")
    return got


def write_json(spark: SparkSession, path: str, value: dict, overwrite: bool = False) -> None:
    """Through a temporary name in the same store, so that readers see all of it or nothing; NaN is refused."""
    text = json.dumps(value, allow_nan=False, indent=2, ensure_ascii=False) + "\n"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(conf)
    if fs.exists(to) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if overwrite else how.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(part, to, options)


def write_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; a NaN or infinity in a number column is an error."""
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            c = F.col(f"`{f.name}`")
            df = df.withColumn(f.name, F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{f.name} isn't finite"))).otherwise(c))
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def run_name(kind: str, rows: int, run_id: str, now: datetime | None = None) -> str:
    """A run's folder: slug, UTC time, number of rows, start of the run's id."""
    slug = re.sub(r"[^A-Za-z0-9._-]+", "-", kind).strip("-.")[:80].lower() or "run"
    return f"{slug}-{(now or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}-{rows}-{run_id[:8]}"


def debug_dump(results: DataFrame, key: str) -> DataFrame:
    """key and its results as an array, best first."""
    return results.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", "id", "title", "content")))).alias("results"))


def namespaces(prefix: str, namespace: str, table: str) -> dict[str, str]:
    base = f"{prefix}.{namespace}"
    return {"catalog": f"{base}.catalog", "chunks": f"{base}.{table}.chunks", "documents": f"{base}.{table}.documents"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def build_index(docs: DataFrame, root: str, name: str, *, size: int = 512, encoder=None, prefix: str = "corpus", namespace: str = "main") -> DataFrame:
    """Writes documents (id, title, text), their chunks with vectors if there is an encoder, postings, and last the catalogue row that makes them ready.

    A corpus that is there already, ready or not, is never overwritten.
    """
    from ..operators.chunking import recursive
    from ..operators.retrieval import postings
    from ..providers import encode

    spark = docs.sparkSession
    at = {k: f"{root}/{v}" for k, v in namespaces(prefix, namespace, name).items()}
    if any(_exists(spark, at[k]) for k in ("documents", "chunks")) or not find_entry(spark, root, name, prefix, namespace).isEmpty():
        raise FileExistsError(f"the corpus {name!r} is there already")
    extra = [c for c in docs.columns if c not in ("id", "title", "text")]
    meta = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
    docs.select("id", "title", F.col("text").alias("content"), meta.alias("metadata_json"), F.lit(None).cast("long").alias("document_id")).write.parquet(at["documents"])
    chunks = recursive(docs, size, "id", "text", "title").select("id", "title", "content", F.lit("{}").alias("metadata_json"), "document_id", "source_index")
    (encode(chunks, "content", encoder) if encoder else chunks).write.parquet(at["chunks"])
    written = spark.read.parquet(at["chunks"])
    postings(written, "id", "content").write.parquet(f"{at['chunks']}.postings")
    row = written.agg(F.count("*").alias("chunk_count"), *([F.max(F.size("vector")).alias("vector_dimensions")] if encoder else [F.lit(0).alias("vector_dimensions")])).select(
        F.lit(name).alias("table_name"), F.lit(namespace).alias("logical_namespace"), F.lit(at["chunks"]).alias("chunks_namespace"), F.lit(at["documents"]).alias("documents_namespace"), F.lit(CATALOG_VERSION).alias("schema_version"), "chunk_count",
        F.lit(spark.read.parquet(at["documents"]).count()).cast("long").alias("document_count"), F.lit(encoder is not None).alias("vector_available"), "vector_dimensions", F.lit(type(encoder).__name__ if encoder else None).cast("string").alias("embedding_model"), F.lit(True).alias("ready"),
    )
    row.write.mode("append").parquet(at["catalog"])
    return find_entry(spark, root, name, prefix, namespace)


CATALOG = "table_name string, logical_namespace string, chunks_namespace string, documents_namespace string, schema_version int, chunk_count long, document_count long, vector_available boolean, vector_dimensions int, embedding_model string, ready boolean"


def find_entry(spark: SparkSession, root: str, name: str, prefix: str = "corpus", namespace: str = "main") -> DataFrame:
    path = f"{root}/{namespaces(prefix, namespace, name)['catalog']}"
    if not _exists(spark, path):
        return spark.createDataFrame([], CATALOG)
    return spark.read.schema(CATALOG).parquet(path).where(F.col("table_name") == name)


def open_corpus(spark: SparkSession, root: str, name: str, prefix: str = "corpus", namespace: str = "main") -> dict:
    """The catalogue row, checked: there, of this version, ready, both tables present. Its counts need no scan."""
    found = find_entry(spark, root, name, prefix, namespace).limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{len(found)} catalogue rows for {name!r}")
    row = found[0].asDict()
    if row["schema_version"] != CATALOG_VERSION or not row["ready"]:
        raise ValueError(f"corpus {name!r} isn't ready or of another version")
    gone = [row[k] for k in ("chunks_namespace", "documents_namespace") if not _exists(spark, row[k])]
    if gone:
        raise FileNotFoundError(f"tables that are gone: {gone}")
    return row


def chunk_at(chunks: DataFrame, index: int) -> DataFrame:
    if index < 0:
        raise ValueError("source_index starts from 0")
    return chunks.where(F.col("source_index") == index).limit(1)


def delete_corpora(spark: SparkSession, paths: list[str], guard: str, confirm: bool = False) -> list[str]:
    """Deletes tables whose name starts with the guard, each once; without confirm only says which."""
    targets = list(dict.fromkeys(paths))
    other = [p for p in targets if not p.rsplit("/", 1)[-1].startswith(guard)] if guard else targets
    if other:
        raise ValueError(f"outside {guard!r}: {other}")
    for t in targets if confirm else []:
        p = spark._jvm.org.apache.hadoop.fs.Path(t)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return targets
