"""Fact extraction, entity memory, rubric and question data work."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.text import collapse_key, single_line, strip
from ..session import dense_index, running_index, top_k
from .matching import required


def requests(groups: DataFrame, entity: str, source: str, index: str, group: str, prompt: str) -> DataFrame:
    """Batch requests: custom_id, body, entity_name, data_source, doc_ids, chunk_ids for rows with document_ids and chunk_ids."""
    message = F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))
    return groups.select(
        F.format_string("entity-%05d-group-%05d", F.col(index).cast("int"), F.col(group).cast("int")).alias("custom_id"),
        F.struct(F.array(message).alias("messages")).alias("body"),
        F.col(entity).alias("entity_name"),
        F.col(source).alias("data_source"),
        F.array_distinct("document_ids").alias("doc_ids"),
        F.col("chunk_ids"),
    )


def last_responses(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Of rows with one custom_id the last content, at the place of the first."""
    w = Window.partitionBy("custom_id")
    back = w.orderBy(*[c.desc() for c in order])
    return rows.withColumn("place", F.min(F.struct(*order)).over(w)).withColumn("_n", F.row_number().over(back)).where("_n = 1").drop("_n")


def join_responses(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answered requests, responses nobody asked for, requests without a response (by custom_id)."""
    return (
        requests.join(responses, "custom_id"),
        responses.join(requests.select("custom_id"), "custom_id", "left_anti"),
        requests.join(responses.select("custom_id"), "custom_id", "left_anti").orderBy("custom_id"),
    )


def dedup_statements(rows: DataFrame, entity: str, statement: str, order: list[Column]) -> DataFrame:
    """Of an entity's statements equal but for case and white space the first; ``ord`` numbers those left."""
    first = F.row_number().over(Window.partitionBy(entity, collapse_key(F.col(statement))).orderBy(*order))
    kept = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))


def entity_memory(answered: DataFrame, order: list[Column]) -> DataFrame:
    """entity_name, data_source, entity_doc_ids, facts from answered requests (with content): facts in order of request and place, repeats by
    statement dropped, first within a response and then across them."""
    one = answered.withColumn("o", F.struct(*order)).withColumn("fs", parsing.facts(F.col("content"), F.col("entity_name")))
    flat = one.select("entity_name", "o", F.posexplode("fs").alias("p", "f"))
    kept = dedup_statements(flat.withColumn("statement", F.col("f.statement")), "entity_name", "statement", [F.col("o"), F.col("p")])
    facts = kept.groupBy("entity_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "f"))), lambda s: s["f"]).alias("facts"))
    docs = one.select("entity_name", "o", F.posexplode("doc_ids").alias("p", "doc_id")).groupBy("entity_name", "doc_id").agg(F.min(F.struct("o", "p")).alias("at"))
    ids = docs.groupBy("entity_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda s: s["doc_id"]).alias("entity_doc_ids"))
    head = one.groupBy("entity_name").agg(F.min_by("data_source", "o").alias("data_source"), F.min("o").alias("first"))
    return head.join(ids, "entity_name", "left").join(facts, "entity_name", "left").withColumn("facts", F.coalesce("facts", F.from_json(F.lit("[]"), parsing.FACTS)))


def in_file_order(memory: DataFrame, entities: DataFrame, name: str = "entity_name") -> DataFrame:
    """Entities by their position in the entity file, then the others as they came; adds entity_index."""
    placed = memory.join(entities.groupBy(name).agg(F.min("position").alias("position")), name, "left")
    return running_index(placed, [F.col("position").isNull(), F.col("position"), F.col("first")], "entity_index")


def group_by_documents(facts: DataFrame, entity: str = "entity_name") -> DataFrame:
    """entity, doc_ids, first, statements: facts (ord, doc_ids, statement) grouped by their exact documents, in order of the first."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "statement"))), lambda s: s["statement"])
    return facts.groupBy(entity, "doc_ids").agg(F.min("ord").alias("first"), lines.alias("statements"))


def entity_markdown(name: Column, source: Column, doc_ids: Column, facts: Column) -> Column:
    """An entity's page of a fact workspace: facts under headings of their documents, in the order of first use."""
    keys = F.array_distinct(F.transform(facts, lambda f: f["doc_ids"]))

    def section(ids: Column) -> Column:
        own = F.filter(facts, lambda f: f["doc_ids"] == ids)
        text = F.transform(own, lambda f: F.concat(F.lit("- "), single_line(f["statement"]), F.when(F.size(f["mentioned_entities"]) > 0, F.concat(F.lit("\n  Mentions: "), F.array_join(F.transform(f["mentioned_entities"], single_line), "; "))).otherwise(F.lit(""))))
        title = F.concat(F.when(F.size(ids) == 1, F.lit("### Document ")).otherwise(F.lit("### Documents ")), F.array_join(F.transform(ids, lambda i: i.cast("string")), ", "))
        return F.concat(F.lit("\n"), title, F.lit("\n"), F.array_join(text, "\n"))

    head = F.concat(F.lit("# Entity: "), single_line(name), F.lit("\nSource: "), single_line(source), F.lit("\nEntity docs: "), F.array_join(F.transform(doc_ids, lambda i: i.cast("string")), ","), F.lit("\n\n## Facts"))
    return F.concat(head, F.when(F.size(keys) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(keys, section), "\n"))).otherwise(F.lit("")), F.lit("\n"))


def workspace_paths(entities: DataFrame, path_col: str, name_col: str) -> DataFrame:
    """Paths made unique without regard to case: a later entity's gets a digest of its name."""
    again = F.row_number().over(Window.partitionBy(F.lower(path_col)).orderBy("entity_index")) > 1
    digest = F.left(F.sha2(F.col(name_col), 256), F.lit(12))
    return entities.withColumn(path_col, F.when(again, F.concat(F.regexp_replace(path_col, r"\.md$", "--"), digest, F.lit(".md"))).otherwise(F.col(path_col)))


def heading_doc_ids(pages: DataFrame, text_col: str = "value") -> DataFrame:
    """The distinct document ids of the headings of Markdown pages."""
    heads = F.regexp_extract_all(text_col, F.lit(r"(?m)^\s*### Documents? ([^\r\n]+)$"), F.lit(1))
    return pages.select(F.explode(heads).alias("h")).select(F.explode(parsing.integers(F.col("h"))).alias("doc_id")).distinct()


def round_robin(slots: DataFrame, entities: DataFrame, slot: str = "slot", position: str = "position") -> DataFrame:
    """Slot s goes to entity s mod n; entities are numbered from 0 without gaps."""
    n = entities.agg(F.count("*").alias("_n"))
    return slots.join(F.broadcast(n)).withColumn(position, F.col(slot) % F.col("_n")).drop("_n").join(entities, position)


def usable(memory: DataFrame) -> DataFrame:
    """Entities with a fact, numbered anew in their order."""
    return running_index(memory.where(F.size("facts") > 0).drop("position"), ["entity_index"], "position")


def shortfall(assigned: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    return assigned.join(accepted.select(key), key, "left_anti")


def entity_summaries(assigned: DataFrame, accepted: DataFrame, entity: str, key: str) -> DataFrame:
    """Requested and generated of each entity, with the keys of what was generated."""
    both = assigned.join(accepted.select(key, F.lit(True).alias("_ok")), key, "left")
    return both.groupBy(entity).agg(F.count("*").alias("requested"), F.count("_ok").alias("generated"), F.array_sort(F.collect_list(F.when(F.col("_ok"), F.col(key)))).alias("keys"))


def first_by_question(rows: DataFrame, question: str, order: list[Column]) -> DataFrame:
    """Of records with the same question but for case and white space the first."""
    w = Window.partitionBy(collapse_key(F.col(question))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def grounded(doc_ids: Column, allowed: Column, least: int = 2) -> tuple[Column, Column]:
    """A question's documents that are allowed, in its order, and whether they are enough."""
    kept = F.array_intersect(doc_ids, allowed)
    return kept, F.size(kept) >= least


def fill_quota(candidates: list[tuple[str, str]], target: int, complex_ratio: float) -> list[int]:
    """Numbers of the candidates (question, complexity) accepted in order: a simple one only while slots are left beyond the complex ones still due."""
    due, taken, seen = required(target, complex_ratio), [], set()
    for i, (question, complexity) in enumerate(candidates):
        key = question_key(question)
        left = target - len(taken)
        if not left:
            break
        if not key or key in seen or (complexity != "complex" and left <= max(0, due)):
            continue
        taken.append(i)
        seen.add(key)
        due -= complexity == "complex"
    return taken


def question_key(question: str | None) -> str:
    """What questions that count as repeats share; empty if blank."""
    return " ".join((question or "").lower().split())


def _key_digests(questions: pd.Series) -> pd.Series:
    return pd.Series([hashlib.blake2b(k.encode("utf-8", "replace"), digest_size=16).digest() if (k := question_key(q)) else None for q in questions], dtype=object)


def accept(candidates: DataFrame, entity: str, order: str, question: str, complexity: str, target: int, complex_ratio: float) -> DataFrame:
    """fill_quota for each entity, over all its candidates, of which it sees those that the rule can look at: of complex and other
    ones each the first row of a question, and of those 2 * target. A simple one that is passed over stays so, as its repeats do; and of
    2 * target different questions, those taken before can be ``target`` at most."""
    names = candidates.columns
    keyed = candidates.withColumn("_key", F.pandas_udf(_key_digests, "binary")(question)).withColumn("_hard", F.coalesce(F.col(complexity) == "complex", F.lit(False))).where("_key is not null")
    first = keyed.groupBy(F.col(entity).alias("_e"), F.col("_hard").alias("_h"), F.col("_key").alias("_k")).agg(F.min(order).alias("_o"))
    near = top_k(first, ["_e", "_h"], [F.asc_nulls_last("_o"), F.col("_k")], 2 * target, "_n")
    same = F.col(entity).eqNullSafe(F.col("_e")) & (F.col("_hard") == F.col("_h")) & (F.col("_key") == F.col("_k")) & F.col(order).eqNullSafe(F.col("_o"))
    few = keyed.join(near, same).select(*names)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.iloc[fill_quota(list(zip(rows[question], rows[complexity], strict=True)), target, complex_ratio)]

    return few.groupBy(entity).applyInPandas(run, candidates.schema)


def run_status(requested: int, generated: int, failed: bool = False) -> str:
    return "failed" if failed else "empty" if not generated else "completed" if generated >= requested else "partial"


def entities_kept(concepts: DataFrame, corpus: DataFrame, quota: int, order: list[Column], doc_id: str = "doc_id") -> DataFrame:
    """Named entities of known documents, of those alike but for case the first, up to the quota."""
    known = concepts.where(strip(F.col("name")) != "").join(corpus.select(F.col(doc_id)), doc_id, "left_semi")
    w = Window.partitionBy(F.lower(strip(F.col("name")))).orderBy(*order)
    return known.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(*order).limit(quota)


def entity_rounds(corpus: DataFrame, extract, n: int, seed: int, batch: int = 30, id_col: str = "doc_id") -> Iterator[DataFrame]:
    """Rounds of seeded samples passed to ``extract`` until the caller has enough, after max(30, 2 n) rounds, or when 5 rounds in a row yield an empty frame."""
    from .datasets import sample_numbers

    numbered = dense_index(corpus, id_col, [], "_number")  # ids may have gaps
    rows, idle, rng = corpus.count(), 0, None
    for k in range(max(30, 2 * n)):
        numbers, rng = sample_numbers(rows, min(rows, batch), seed, rng)
        found = extract(numbered.where(F.col("_number").isin(numbers)).drop("_number"), k)
        idle = idle + 1 if found.isEmpty() else 0
        yield found
        if idle == 5:
            return
