"""The corpus operators' queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_format, language_id, lm_score, mixing, nearest, packing, quality_rules, simhash, suffix_dedup, token_counts
from ._shared import table

VOCABULARY = "word_bpe_49k.json"
#: What both turns of conversation -1 say.
PROBE = "</s>[INST] ok [/INST]"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents")).drop("spans")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(docs, train=F.coalesce(~held_out, F.lit(False)))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), "pass", "place")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select -1L conv_id, turn, role, '{PROBE}' text from values (0L, 'user'), (1L, 'assistant') v(turn, role)")
    return chat_format.digest(chat_format.format_chats(rows.unionByName(extra))).drop("escaped")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_language_id, op3_lm_score, op4_nearest, op5_token_counts, op6_mixing, op7_quality_rules, op8_packing, op9_chat_format, op10_simhash, pipeline)
}

#: DuckDB SQL. The other queries learn, approximate, or need hashes and tokenizers that SQL lacks; tests compare those with brute force.
ORACLE: dict[str, str] = {
    "op9_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, regexp_matches(role || text, '\[\\*(/?INST|/?ROLE|TEXT)\]|<\\*/?s>') as conflict from rows
), flagged as (
  select *, bool_or(conflict) over (partition by conv_id) as escaped from marked
), sized as (
  select *,
    case when escaped then len(regexp_extract_all(text, '\[\\*(?:/?INST|/?ROLE|TEXT)\]|<\\*/?s>')) + case when role in ('user', 'assistant') then 0 else len(regexp_extract_all(role, '\[\\*(?:/?INST|/?ROLE|TEXT)\]|<\\*/?s>')) end else 0 end as extra
  from flagged
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(text) + case role when 'user' then 13 when 'assistant' then 7 else length(role) + 19 end + extra)::bigint as formatted_chars,
  true as round_trip
from sized group by conv_id
""",
}
