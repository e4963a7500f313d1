"""Named queries over whole tables, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prompts
from .functions import parsing as P
from .functions import text as T
from .operators import chunking, datasets, evaluation, facts, judging, matching, mining, retrieval, tasks, tools
from .providers import OverlapReranker
from .session import dense_index, table
from .sources import corpora, records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# shared pieces of SQL
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
MERGE = "case when {t} = '' then {b} when {b} = '' then '# ' || {t} else '# ' || {t} || chr(10) || chr(10) || {b} end"
FIRST = f"""select doc_id, {STRIP.format("split_part(x, chr(10), 1)")} as title,
  {STRIP.format("case when contains(x, chr(10)) then substr(x, strpos(x, chr(10)) + 1) else '' end")} as body"""


# corpora


@query(f"select doc_id, len({WORDS.format('text')})::bigint as n_words from documents where len({WORDS.format('text')}) between 50 and 8000")
def corpus_word_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(corpora.in_word_range(F.col("text"))).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query(f"with a as ({FIRST} from (select doc_id, text as x from documents)) select doc_id, title, {MERGE.format(t='title', b='body')} as text from a")
def corpus_title_merge(spark: SparkSession, d: str) -> DataFrame:
    title, body = T.first_line(F.col("text"))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), T.merge_title(title, body).alias("text"))


@query(rf"with a as ({FIRST} from (select doc_id, regexp_replace(text, '^\s+', '') as x from documents)) select doc_id, title, {MERGE.format(t='title', b='body')} as text from a")
def corpus_title_first_nonblank(spark: SparkSession, d: str) -> DataFrame:
    title, body = T.first_nonblank_line(F.col("text"))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), T.merge_title(title, body).alias("text"))


@query("select doc_id, case when trim(t) = '' then '' else t end as title, starts_with(text, '# ') as has_heading from (select doc_id, text, regexp_extract(text, '^([^\r\n]*)', 1) as t0 from documents) a, lateral (select regexp_replace(t0, '^\\s+|\\s+$', '', 'g') as t)")
def corpus_pep_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.pep_title(F.col("text")).alias("title"), F.startswith("text", F.lit("# ")).alias("has_heading"))


@query("select doc_id, n_chars from documents where lang = 'en'")
def corpus_english_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", "n_chars")


@query(f"select doc_id, (row_number() over (order by doc_id) - 1)::bigint as id from documents where len({WORDS.format('text')}) between 50 and 8000")
def corpus_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "documents").where(corpora.in_word_range(F.col("text"))).select("doc_id")
    return dense_index(kept, "doc_id", [], "id")


@query(f"select doc_id, id from (select doc_id, text, (row_number() over (order by doc_id) - 1)::bigint as id from documents) where len({WORDS.format('text')}) between 50 and 8000")
def corpus_gapped_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("_keep", corpora.in_word_range(F.col("text"))).select("doc_id", "_keep")
    return dense_index(docs, "doc_id", [], "id").where("_keep").select("doc_id", "id")


@query(f"""with a as ({FIRST} from (select doc_id, text as x from documents)), n as (select *, (row_number() over (order by doc_id) - 1)::bigint as id, {MERGE.format(t='title', b='body')} as text from a)
select id, title, text from n where len({WORDS.format('text')}) between 50 and 8000""")
def corpus_load_news(spark: SparkSession, d: str) -> DataFrame:
    return corpora.load(table(spark, d, "documents").select("doc_id", "text"), corpora.find("news"), ["doc_id"])


LABELS = "case when doc_id % 11 = 0 then source when doc_id % 11 = 1 then source || '~rc' else source || '~' || (doc_id % 7)::varchar || '.' || (doc_id % 13)::varchar end"


@query(f"""with a as (select doc_id, {LABELS} as label from documents),
v as (select *, split_part(label, '~', 1) as base, case when regexp_matches(label, '~[0-9]') then list_transform(string_split(split_part(label, '~', 2), '.'), lambda p: p::int) end as v from a),
m as (select base, max(v) as m from v where v is not null group by base)
select doc_id, label from v left join m using (base) where v is null or v = m""")
def latest_version_per_base(spark: SparkSession, d: str) -> DataFrame:
    label = F.expr("case when doc_id % 11 = 0 then source when doc_id % 11 = 1 then source || '~rc' else source || '~' || string(doc_id % 7) || '.' || string(doc_id % 13) end")
    return datasets.latest_versions(table(spark, d, "documents").select("doc_id", label.alias("label")), "label")


@query(r"select page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 80) as slug, translate(url, '-/.', '___') as safe_name from pages")
def slug_and_safe_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.safe_name(F.col("url")).alias("safe_name"))


@query("select conv_id, count(*) as n from conversations group by conv_id having count(*) > 1")
def duplicate_ids_check(spark: SparkSession, d: str) -> DataFrame:
    return datasets.duplicates(table(spark, d, "conversations"), "conv_id")


# chunks and the index

CHUNKS = f"""w as (select doc_id, {WORDS.format('text')} as w from documents),
c as (select doc_id as document_id, i as position, array_to_string(w[(i * 128 + 1):(i * 128 + 128)], ' ') as content from w, lateral (select unnest(range(0, ((len(w) + 127) // 128)::bigint)) as i)),
chunks as (select document_id, position::int as position, content, (row_number() over (order by document_id, position) - 1)::bigint as source_index from c)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, d, "documents"), 128)


@query(f"with {CHUNKS} select * from chunks")
def chunk_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d)


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive(table(spark, d, "documents"), 128)


@query(f"with {CHUNKS} select * from chunks where source_index = 100")
def chunk_lookup_by_source_index(spark: SparkSession, d: str) -> DataFrame:
    return records.chunk_at(_chunks(spark, d), 100)


ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""with a as (select doc_id as request_id, unnest([doc_id, -doc_id - 1, doc_id // 2]) as id, unnest([0, 1, 2]) as position from labels),
r as (select request_id, position, '<document id=' || id::varchar || '>' || chr(10) || {ESC.format("case when d.doc_id is null then 'Error: Document with id ''' || id::varchar || ''' not found in corpus.' else coalesce(d.text, '') end")} || chr(10) || '</document>' as x from a left join documents d on d.doc_id = id)
select request_id, '<documents>' || chr(10) || string_agg(x, chr(10) order by position) || chr(10) || '</documents>' as xml from r group by request_id""")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "labels").select(F.col("doc_id").alias("request_id"), F.expr("array(doc_id, -doc_id - 1, doc_id div 2, 9L)").alias("ids"))
    return tools.read(asked, table(spark, d, "documents"))


@query(f"with {CHUNKS} select (select count(*) from chunks) as chunk_count, (select count(*) from documents) as document_count, (select max(len(embedding)) from embeddings)::int as vector_dimensions")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum(F.ceil(T.word_count(F.col("text")) / F.lit(128))).alias("chunk_count")
    docs = table(spark, d, "documents").agg(n, F.count("*").alias("document_count"))
    return docs.join(F.broadcast(table(spark, d, "embeddings").agg(F.max(F.size("embedding")).alias("vector_dimensions"))))  # one row


# retrieval

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
BM25 = f"""t as (select doc_id, {TOKENS.format('text')} as t from documents), size as (select count(*)::double as n, sum(len(t)) / count(*)::double as avg_length from t),
q as (select distinct item_id, unnest({TOKENS.format('text')}) as term from benchmark),
tf as (select doc_id, term, count(*)::double as tf, any_value(length)::double as length from (select doc_id, len(t) as length, unnest(t) as term from t) where term in (select term from q) group by doc_id, term),
df as (select term, count(*)::double as df from tf group by term),
s as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / avg_length))), 6) as score
  from q join tf using (term) join df using (term), size group by item_id, doc_id),
bm25 as (select item_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 10)"""


BM25_50 = BM25.replace("where rank <= 10", "where rank <= 50")


def _bm25(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return retrieval.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), k)


@query(f"with {BM25} select item_id, doc_id, score, rank from bm25")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("item_id", "doc_id", "score", "rank")


DENSE = """dense as (select query_id, vec_id, score, rank::int as rank from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank
  from (select a.vec_id as query_id, b.vec_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b)) where rank <= 10)"""


def _dense(spark: SparkSession, d: str, exclude_self: bool = False) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.dense(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e, 10, exclude_self=exclude_self)


@query(f"with {DENSE} select * from dense")
def dense_top10(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d)


@query(f"""with {BM25}, {DENSE}, l as (select item_id, doc_id, rank from bm25 union all select query_id, vec_id, rank from dense where query_id in (select item_id from benchmark)),
f as (select item_id, doc_id, round(sum(1 / (60 + rank)::double), 6) as score from l group by item_id, doc_id)
select item_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from f) where rank <= 10""")
def hybrid_rrf_top10(spark: SparkSession, d: str) -> DataFrame:
    e, items = table(spark, d, "embeddings"), table(spark, d, "benchmark").select("item_id")
    asked = e.join(items, e.vec_id == items.item_id, "left_semi").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    dense = retrieval.dense(asked, e, 10, query_id="item_id").withColumnRenamed("vec_id", "doc_id")
    return retrieval.fuse([_bm25(spark, d), dense], "item_id", "doc_id", 10)


@query(f"""with {BM25_50}, p as (select b.item_id, b.doc_id, list_distinct({TOKENS.format('q.text')}) as q, list_distinct({TOKENS.format('d.text')}) as x from bm25 b join benchmark q using (item_id) join documents d using (doc_id)),
r as (select item_id, doc_id, round(5 * len(list_intersect(q, x))::double / greatest(1, len(q)), 6) as score from p)
select item_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score >= 3) where rank <= 5""")
def rerank_threshold(spark: SparkSession, d: str) -> DataFrame:
    found = _bm25(spark, d, 50)
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    full = found.join(q, "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return retrieval.rerank(full, OverlapReranker(), "item_id", "q", "doc_id", "text", 5, 50, 3.0).select("item_id", "doc_id", "score", "rank")


@query(f"""with {BM25}, r as (select item_id, string_agg('<result>' || chr(10) || '<id>' || doc_id::varchar || '</id>' || chr(10) || '<title>' || {ESC.format("coalesce(source, '')")} || '</title>' || chr(10) || '<snippet>' || {ESC.format("coalesce(d.text, '')")} || '</snippet>' || chr(10) || '</result>', chr(10) order by rank) as x from bm25 join documents d using (doc_id) group by item_id),
answers as (select item_id, '<query value="' || {ESC.format('text')} || '">' || chr(10) || coalesce(x || chr(10), '') || '</query>' as x from benchmark left join r using (item_id))
select item_id // 3 as call, '<search_results>' || chr(10) || string_agg(x, chr(10) order by item_id) || chr(10) || '</search_results>' as xml from answers group by item_id // 3""")
def search_tool_rows(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    found = _bm25(spark, d, tools.SEARCH_K).join(table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("content")), "doc_id")
    rows = found.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("document_id"), F.col("source").alias("title"), "content"))).alias("results"))
    full = asked.join(rows, "item_id", "left").withColumn("results", F.coalesce("results", F.expr("array()").cast(rows.schema["results"].dataType)))
    calls = full.groupBy(F.expr("item_id div 3").alias("call")).agg(F.array_sort(F.collect_list(F.struct("item_id", "query", "results"))).alias("found"))
    return calls.select("call", tools.render_search(F.col("found")).alias("xml"))


def _scan_sql(count: str, at: str) -> str:
    return f"""with {CHUNKS}, f as (select c.*, d.source, {count} as n, {at} as pos from chunks c join documents d on d.doc_id = c.document_id),
b as (select document_id, sum(n)::bigint as total, arg_min(source, source_index) as title, arg_max(content, n * 1000000000 - source_index) as content, arg_max(pos, n * 1000000000 - source_index) as pos from f where n > 0 group by document_id)
select document_id::varchar as document_id, total, title, substr(content, (greatest(0, pos - 100) + 1)::bigint, (pos + 100 - greatest(0, pos - 100))::bigint) as snippet from b order by total desc, document_id::varchar limit 25"""


def _scan(spark: SparkSession, d: str, pattern: str, **options) -> DataFrame:
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"))
    return tools.text_scan(_chunks(spark, d).join(titles, "document_id"), pattern, **options)


@query(_scan_sql("(length(lower(content)) - length(replace(lower(content), 'tion', '')))::bigint // 4", "strpos(lower(content), 'tion') - 1"))
def text_scan_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, "Tion")


FIXED_SCAN = _scan_sql("(length(lower(content)) - length(replace(lower(content), 'tion', '')))::bigint // 4", "strpos(lower(content), 'tion') - 1")


@query(f"""select string_agg('<match>' || chr(10) || '<id>' || {ESC.format('document_id')} || '</id>' || chr(10) || '<title>' || {ESC.format("coalesce(title, '')")} || '</title>' || chr(10) || '<snippet>' || {ESC.format('snippet')} || '</snippet>' || chr(10) || '</match>', chr(10) order by total desc, document_id) as xml from ({FIXED_SCAN})""")
def text_scan_markup(spark: SparkSession, d: str) -> DataFrame:
    return tools.render_scan(_scan(spark, d, "Tion"))


@query(_scan_sql("(length(content) - length(replace(content, 'The', '')))::bigint // 3", "strpos(content, 'The') - 1"))
def text_scan_case_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, "The", case_sensitive=True)


@query(_scan_sql(r"len(regexp_extract_all(content, '(?i)\bth[ae]t?\b'))::bigint", r"length(regexp_extract(content, '(?is)^(.*?)\bth[ae]t?\b', 1))"))
def text_scan_regex(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, r"\bth[ae]t?\b", regex=True)


@query("select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from pages")
def xml_escape_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.xml_escape(F.col("html")).alias("escaped"))


@query(r"select page_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') as title, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1))::bigint as paragraphs from pages")
def page_title_extract(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", P.block(html, "title").alias("title"), F.size(P.blocks(html, "p")).cast("long").alias("paragraphs"))


@query("select conv_id, arg_max(text, turn) filter (role = 'assistant') as reply from conversations group by conv_id")
def last_assistant_reply(spark: SparkSession, d: str) -> DataFrame:
    node = F.struct("turn", F.lit(True).alias("sampled"), F.struct("role", F.col("text").alias("content")).alias("message"))
    traces = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return traces.select("conv_id", records.last_reply(F.col("nodes")).alias("reply"))


# evaluation

QRELS = "qrels as (select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text))"
RANKS = "ranks as (select item_id, min(rank) as rank from (select distinct item_id from qrels) left join (select item_id, rank from bm25 semi join qrels using (item_id, doc_id)) using (item_id) group by item_id)"
METRICS = """select cutoff, count(*) as queries, {0}, {1} as recall, {1} as hit_rate, {2} as mrr, {2} as map, round(avg(case when rank <= cutoff then 1 / log2(rank + 1) else 0 end), 6) as ndcg
from {3}, (select unnest([1, 3, 5, 10])::int as cutoff) group by cutoff""".format(
    "round(avg(case when rank <= cutoff then 1 / cutoff::double else 0 end), 6) as precision", "round(avg(case when rank <= cutoff then 1.0::double else 0 end), 6)", "round(avg(case when rank <= cutoff then 1 / rank::double else 0 end), 6)", "{0}"
)


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.containment(table(spark, d, "benchmark"), table(spark, d, "documents"))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.first_rank(_bm25(spark, d), _qrels(spark, d), "item_id", "doc_id")


@query(f"with {QRELS} select * from qrels")
def qrels_by_containment(spark: SparkSession, d: str) -> DataFrame:
    return _qrels(spark, d)


@query(f"with {BM25}, {QRELS}, {RANKS} {METRICS.format('ranks')}")
def ir_metrics_bm25(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ranking_metrics(_ranks(spark, d), (1, 3, 5, 10))


@query(f"with {BM25}, {QRELS}, {RANKS} select count(*) as queries, count(rank) as hits, count(*) - count(rank) as misses, round(avg(rank), 6) as mean_hit_rank, median(rank)::double as median_hit_rank from ranks")
def rank_stats_bm25(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rank_stats(_ranks(spark, d))


OTHERS = DENSE.replace("embeddings a, embeddings b)", "embeddings a join embeddings b on a.vec_id <> b.vec_id)")


@query(f"with {OTHERS}, ranks as (select e.vec_id, min(case when o.label = e.label then rank end) as rank from embeddings e left join dense on query_id = e.vec_id left join embeddings o on o.vec_id = dense.vec_id group by e.vec_id) {METRICS.format('ranks')}")
def ir_metrics_dense_by_label(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    found = _dense(spark, d, exclude_self=True).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    hits = found.where("label = own").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return evaluation.ranking_metrics(labels.select(F.col("vec_id").alias("query_id")).join(hits, "query_id", "left"), (1, 3, 5, 10))


@query(f"with {DENSE}, c as (select query_id, label, min(rank) as first_rank from dense join embeddings using (vec_id) group by query_id, label) select query_id, label, first_rank, row_number() over (partition by query_id order by first_rank)::int as rank from c")
def document_rank_collapse(spark: SparkSession, d: str) -> DataFrame:
    found = _dense(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return evaluation.collapse_documents(found, "query_id", "label")


@query("select event_type, count(value) as n, round(sum(value), 6) as total, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, min(value) as least, max(value) as greatest from events group by event_type")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency(table(spark, d, "events"), "value", ["event_type"])


@query("select count(*) as queries, count(*) filter (event_id % 5 <> 0) as successes, count(*) filter (event_id % 5 = 0) as failures, count(*) filter (event_id % 5 <> 0) / count(*)::double as coverage from events")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.coverage(table(spark, d, "events").select(F.expr("case when event_id % 5 = 0 then 'Timeout: ' || event_id end").alias("error")))


# judging

CALLS = "select event_id, user_id, event_type, value as seconds, case when event_id % 7 = 0 then event_type || ': ' || event_id::varchar when event_id % 11 = 0 then 'Timeout' end as error, case when event_id % 3 <> 0 then event_id % 100 end as tokens, case when event_id % 3 <> 0 then value / 1000 end as cost from events"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("_events")
    return spark.sql(CALLS.replace("::varchar", "").replace("events", "_events"))


@query(f"select split_part(error, ':', 1) as error_type, count(*) as n from ({CALLS}) where error is not null group by 1")
def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return judging.error_histogram(_calls(spark, d), "error")


@query(f"select event_type, count(*) as calls, round(count(*) filter (error is null) / count(*)::double, 6) as success_rate, round(avg(seconds), 6) as mean_seconds, round(median(seconds), 6) as median_seconds, round(quantile_disc(seconds, 0.95), 6) as p95_seconds, max(seconds) as max_seconds from ({CALLS}) group by event_type")
def call_metrics(spark: SparkSession, d: str) -> DataFrame:
    return judging.call_metrics(_calls(spark, d), ["event_type"], "seconds", "error")


@query(f"select event_type, sum(tokens)::bigint as total_tokens, round(sum(cost), 6) as total_cost, round(avg(tokens), 6) as mean_tokens, count(tokens) as calls_with_usage from ({CALLS}) group by event_type")
def usage_totals_nullsum(spark: SparkSession, d: str) -> DataFrame:
    return judging.usage(_calls(spark, d), ["event_type"], "tokens", "cost")


PREDICTIONS = "select l.doc_id, d.source, d.lang, l.quality as truth, l.toxic, d.n_chars, case when l.doc_id % 17 = 0 then null when d.n_chars > 800 then 1 else 0 end::int as prediction, case when d.n_chars > 400 or l.doc_id % 5 = 0 then 1 else 0 end::int as other, (l.doc_id % 3 + 1)::int as requested from labels l join documents d on l.doc_id = d.doc_id"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    for name in ("labels", "documents"):
        table(spark, d, name).createOrReplaceTempView(f"_{name}")
    sql = PREDICTIONS.replace("(l.doc_id % 3 + 1)::int", "int(l.doc_id % 3 + 1)").replace("end::int", "end").replace("from labels l join documents d", "from _labels l join _documents d")
    return spark.sql(sql)


def _classify_sql(by: str, source: str, extra: str = "") -> str:
    c = "count(*) filter (truth = {0} and prediction = {1})::double"
    return f"""with p as (select {by}{extra}count(truth) as n_rows, {c.format(1, 1)} as tp, {c.format(0, 0)} as tn, {c.format(0, 1)} as fp, {c.format(1, 0)} as fn from {source}),
g as (select *, tp + tn + fp + fn as graded, tp / nullif(tp + fn, 0) as rec, tn / nullif(tn + fp, 0) as spec from p),
k as (select *, (tp + tn) / nullif(graded, 0) as acc, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / nullif(graded * graded, 0) as chance from g)
select {{cols}}n_rows, tp::bigint as tp, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, round(graded / nullif(n_rows, 0), 6) as coverage, round((tp + tn) / nullif(n_rows, 0), 6) as strict_accuracy, round(acc, 6) as accuracy,
round(tp / nullif(tp + fp, 0), 6) as precision, round(rec, 6) as recall, round(spec, 6) as specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round((rec + spec) / 2, 6) as balanced_accuracy,
round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) as mcc, round((acc - chance) / nullif(1 - chance, 0), 6) as kappa, round((tp + fn) / nullif(graded, 0), 6) as truth_rate, round((tp + fp) / nullif(graded, 0), 6) as prediction_rate from k"""


@query(_classify_sql("source, ", f"({PREDICTIONS}) group by source").format(cols="source, "))
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).groupBy("source").agg(*judging.classification(F.col("truth"), F.col("prediction")))


CALLED = f"""select *, ((i - 1) // 4)::bigint as batch_index, ((i - 1) % 4 + 1)::int as position, least(4, n - ((i - 1) // 4) * 4)::bigint as criteria_in_call from (select *, row_number() over (partition by source order by doc_id) as i, count(*) over (partition by source) as n from ({PREDICTIONS}))"""


def _called(spark: SparkSession, d: str) -> DataFrame:
    return judging.call_batches(_predictions(spark, d), "source", "doc_id", 4)


@query(f"select doc_id, source, batch_index, position, criteria_in_call from ({CALLED})")
def judge_call_batches(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d).select("doc_id", "source", "batch_index", "position", "criteria_in_call")


@query(
    _classify_sql("requested, criteria_in_call, position, ", f"({CALLED}) group by grouping sets ((requested), (requested, criteria_in_call), (requested, position))", "case when grouping(criteria_in_call) = 0 then 'actual' when grouping(position) = 0 then 'position' else 'requested' end as breakdown, ").format(
        cols="requested, criteria_in_call, position, breakdown, "
    )
)
def classification_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return judging.breakdown(_called(spark, d), "requested", "criteria_in_call", "position", "truth", "prediction")


@query(f"with e as (select source, bool_and(coalesce(prediction = truth, false)) as r, bool_and(prediction is not null) as g from ({PREDICTIONS}) group by source) select count(*) as examples, count(*) filter (g) as complete, count(*) filter (r) as exact, round(count(*) filter (r) / count(*)::double, 6) as exact_rate from e")
def example_exact_match(spark: SparkSession, d: str) -> DataFrame:
    return judging.example_metrics(_predictions(spark, d), "source", "truth", "prediction")


@query(f"""with p as (select coalesce(prediction = truth, false) as a, coalesce(other = truth, false) as b, prediction is not distinct from other as s from ({PREDICTIONS}))
select count(*) as pairs, round((count(*) filter (b) - count(*) filter (a)) / count(*)::double, 6) as accuracy_delta, round(count(*) filter (s) / count(*)::double, 6) as agreement, round(count(*) filter (not s) / count(*)::double, 6) as flip_rate, count(*) filter (a and not b) as regressions, count(*) filter (b and not a) as improvements, count(*) filter (b and not a) - count(*) filter (a and not b) as net from p""")
def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    return judging.compare(p, p.select("doc_id", "source", F.col("other").alias("prediction")), ["doc_id", "source"], "truth", "prediction")


@query(f"select source, round(sum((1 + toxic) * (case when n_chars < 60 then 0 else truth end)::double) / sum(1 + toxic), 6) as score from ({PREDICTIONS}) group by source")
def rubric_weighted_score(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d).withColumn("weight", 1 + F.col("toxic")).withColumn("response", F.when(F.col("n_chars") < 60, " ").otherwise("x"))
    return judging.rubric_score(p, ["source"], "truth", "weight", "response")


@query("select avg(quality) as positive_rate, count(*) as n from labels")
def dataset_positive_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.avg("quality").alias("positive_rate"), F.count("*").alias("n"))


# mining and datasets

POSITIVE = "pos as (select item_id, min(doc_id) as positive from qrels group by item_id)"


def _positives(spark: SparkSession, d: str) -> DataFrame:
    return _qrels(spark, d).groupBy("item_id").agg(F.min("doc_id").alias("positive"))


@query(f"with {BM25_50}, {QRELS}, {POSITIVE} select item_id, positive, rank as positive_rank, case when rank <= 50 then 'mined' else 'filtered' end as status from pos left join bm25 on pos.item_id = bm25.item_id and doc_id = positive".replace("select item_id, positive, rank", "select pos.item_id, positive, rank"))
def round_trip_filter(spark: SparkSession, d: str) -> DataFrame:
    return mining.round_trip(_positives(spark, d), _bm25(spark, d, 50), "item_id", "positive", "doc_id", 50)


@query(f"with {BM25}, {QRELS}, {POSITIVE} select * from (select item_id, doc_id, score, rank, positive, row_number() over (partition by item_id order by rank)::int as prompt_rank from bm25 join pos using (item_id) where doc_id <> positive) where prompt_rank <= 5")
def hard_negative_mining(spark: SparkSession, d: str) -> DataFrame:
    return mining.candidates(_positives(spark, d), _bm25(spark, d), "item_id", "positive", "doc_id", 5).select("item_id", "doc_id", "score", "rank", "positive", "prompt_rank")


@query("with s as (select doc_id, lang, row_number() over (partition by lang order by md5('42:' || doc_id::varchar), doc_id) as i, count(*) over (partition by lang) as n from documents) select doc_id, lang, case when i <= greatest(1, floor(n * 0.1::double)) then 'test' else 'train' end as split from s")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return datasets.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"))


@query("select lang, count(*) as n from documents group by lang")
def stratum_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("select doc_id, source, n_chars from documents where source is distinct from 'src1' union all select doc_id + 1000000, 'src1', n_chars from documents where source = 'src2'")
def merge_replace_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    incoming = docs.where("source = 'src2'").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("src1").alias("source"), "n_chars")
    return datasets.merge(docs, incoming, "src1")


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return datasets.seeded_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 50, 7)


@query("with e as (select n_name, (row_number() over (order by n_nationkey) - 1)::bigint as position from nation) select s_suppkey as slot, position, n_name from supplier join e on s_suppkey % (select count(*) from nation) = position")
def round_robin_assign(spark: SparkSession, d: str) -> DataFrame:
    entities = dense_index(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", [], "position").drop("n_nationkey")
    return facts.round_robin(table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot")), entities).select("slot", "position", "n_name")


@query("select c_custkey, c_name from customer anti join (select o_custkey as c_custkey from orders) using (c_custkey)")
def anti_join_shortfall(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return facts.shortfall(table(spark, d, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query("""select 'answered' as kind, count(*) as n from labels semi join (select doc_id from documents where doc_id % 2 = 0) using (doc_id) union all
select 'unasked', count(*) from (select doc_id from documents where doc_id % 2 = 0) anti join labels using (doc_id) union all select 'unanswered', count(*) from labels anti join (select doc_id from documents where doc_id % 2 = 0) using (doc_id)""")
def unmatched_requests(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "labels").select(F.col("doc_id").alias("custom_id"))
    got = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("custom_id"))
    parts = zip(("answered", "unasked", "unanswered"), facts.join_responses(asked, got), strict=True)
    out = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


LINES = rf"select source, doc_id, i, {STRIP.format('line')} as statement, array_to_string({WORDS.format('lower(line)')}, ' ') as key from (select source, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as i from documents)"


@query(f"with l as ({LINES}), k as (select *, row_number() over (partition by source, key order by doc_id, i) as n from l where statement <> ''), o as (select source, statement, row_number() over (partition by source order by doc_id, i) as ord from k where n = 1) select source, count(*) as statements, md5(string_agg(statement, chr(10) order by ord)) as digest from o group by source")
def ordered_fact_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    flat = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("source", "doc_id", "i", T.strip(F.col("line")).alias("statement")).where("statement <> ''")
    kept = facts.dedup_statements(flat, "source", "statement", [F.col("doc_id"), F.col("i")])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "statement"))), lambda s: s["statement"])
    return kept.groupBy("source").agg(F.count("*").alias("statements"), F.md5(F.encode(F.array_join(ordered, "\n"), "UTF-8")).alias("digest"))


@query(f"""with l as ({LINES}), f as (select doc_id, i, [doc_id % 3, doc_id % 5] as ids, statement from l where statement <> '') select doc_id, ids, min(i)::int as first, count(*) as n from f group by doc_id, ids""")
def facts_by_documents(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).select("doc_id", "ord", T.strip(F.col("line")).alias("statement")).where("statement <> ''")
    grouped = facts.group_by_documents(flat.withColumn("doc_ids", F.expr("array(doc_id % 3, doc_id % 5)")), "doc_id")
    return grouped.select("doc_id", F.col("doc_ids").alias("ids"), "first", F.size("statements").cast("long").alias("n"))


@query("""with s as (select l.doc_id, d.source, toxic from labels l join documents d using (doc_id)), r as (select source, list_sort(list(doc_id)) as ids, list_sort(list(doc_id) filter (doc_id % 2 = 0)) as even, list_sort(list(doc_id) filter (doc_id % 2 = 1 or toxic = 1)) as rest from s group by source)
select source, len(ids)::int as n, len(ids) < 3 as few, len(list_filter(ids, lambda x: not list_contains(coalesce(even, []), x) and not list_contains(coalesce(rest, []), x))) = 0 as is_union, len(list_filter(coalesce(even, []), lambda x: list_contains(coalesce(rest, []), x)))::int as shared from r""")
def doc_id_set_rules(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    r = s.groupBy("source").agg(F.collect_list("doc_id").alias("ids"), F.collect_list(F.expr("case when doc_id % 2 = 0 then doc_id end")).alias("even"), F.collect_list(F.expr("case when doc_id % 2 = 1 or toxic = 1 then doc_id end")).alias("rest"))
    rubric = F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(n).alias("doc_ids")) for n in ("even", "rest")])
    errors = P.rubric_errors(F.lit("e"), F.lit("q"), rubric, F.col("ids"))
    return r.select("source", F.size("ids").alias("n"), F.array_contains(errors, "few_documents").alias("few"), (~F.array_contains(errors, "union")).alias("is_union"), F.size(F.array_intersect("even", "rest")).alias("shared"))


# entities

NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
NAMES = f"""w as (select item_id, string_split({NORMAL.format('text')}, ' ') as w from benchmark), raw as (select item_id as position, array_to_string(w[2:3], ' ') as name from w where len(w) > 3 union all select item_id, w[4] from w where len(w) > 3 and length(w[4]) > 3),
names as (select name, min(position) as position from raw group by name)"""
FOUND = f"""p as (select doc_id, string_split({NORMAL.format('text')}, ' ') as w from documents),
g as (select distinct doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as name from p), found as (select doc_id, name, position from g join names using (name))"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select("item_id", F.split(matching.sql_normalize(F.col("text")), " ").alias("w")).where("size(w) > 3")
    two = w.select("item_id", F.array_join(F.slice("w", 2, 2), " ").alias("name"))
    one = w.select("item_id", F.col("w")[3].alias("name")).where("length(name) > 3")
    return matching.dictionary(two.unionByName(one), "name", "item_id", matching.sql_normalize)


@query(f"with {NAMES}, {FOUND} select doc_id, name, rank::int as rank from (select doc_id, name, row_number() over (partition by doc_id order by length(name) desc, name) as rank from found) where rank <= 50")
def entity_match_exact(spark: SparkSession, d: str) -> DataFrame:
    found = matching.exact(table(spark, d, "documents"), _names(spark, d), "doc_id", "text", matching.sql_normalize, 2)
    return matching.longest_first(found, "doc_id").select("doc_id", "name", "rank")


@query()
def entity_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    names = matching.dictionary(table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(_names(spark, d).select("name")))
    return matching.match(table(spark, d, "documents"), names, "doc_id", "text")


@query(f"""with {NAMES}, {FOUND}, i as (select doc_id, source, (row_number() over (partition by source order by doc_id) - 1) // 5 as group_index from documents)
select source, group_index::bigint as group_index, list(name order by position, name) as linked from (select distinct source, group_index, name, position from i join found using (doc_id)) where name <> source group by source, group_index""")
def linked_entities_grouped(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    names = _names(spark, d)
    groups = matching.chunk_groups(docs.select("doc_id", "source"), "source", "doc_id", 5)
    found = matching.exact(docs, names, "doc_id", "text", matching.sql_normalize, 2).join(groups, "doc_id")
    return matching.linked(found, names, ["source", "group_index"], "source")


# sources, tasks and prompts


@query("select doc_id, source from documents where source in ('src1', 'src3', 'src17')")
def allow_list_sources(spark: SparkSession, d: str) -> DataFrame:
    return corpora.allow_list(table(spark, d, "documents"), "source", ["src1", "src3", "src17"]).select("doc_id", "source")


@query("select c_custkey, c_name from customer order by c_custkey limit 100")
def persona_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpora.personas(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100)


@query("select doc_id as id, case when doc_id % 3 = 0 then 'own' else doc_id::varchar end as document_id, case when doc_id % 2 = 0 then doc_id / 8 when doc_id % 5 = 0 then n_chars::double else 0 end as score, coalesce(text, '') as content from documents")
def result_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("doc_id id", "source title", "text content", "case when doc_id % 3 = 0 then map('document_id', 'own') end metadata", "doc_id document_id", "case when doc_id % 2 = 0 then doc_id / 8 end _relevance_score", "case when doc_id % 5 = 0 then double(n_chars) end `$dist`")
    return retrieval.project_results(rows).select("id", F.col("metadata")["document_id"].alias("document_id"), "score", "content")


@query("select (row_number() over (order by doc_id) - 1)::bigint as idx, text as prompt, source as table_name, [doc_id] as doc_ids, lang as complexity from documents order by doc_id limit 100")
def task_projection(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "documents").select("doc_id", F.col("text").alias("question"), F.lit("r").alias("rubric"), F.col("source").alias("data_source"), F.array("doc_id").alias("doc_ids"), F.col("lang").alias("question_type"))
    return tasks.project(data, "doc_id", 100).select("idx", "prompt", "table_name", "doc_ids", "complexity")


QUERY_PROMPT = "'" + prompts.TEMPLATES["query"].replace("'", "''").replace("{text}", "' || text || '") + "' || chr(10) || chr(10) || 'About these documents: Invented prose.'"


@query(f"select doc_id, {QUERY_PROMPT.replace(chr(10), "' || chr(10) || '")} as prompt from documents")
def query_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", prompts.described(prompts.render(prompts.TEMPLATES["query"], text=F.col("text")), " Invented prose. ").alias("prompt"))


@query("""select doc_id, case when doc_id % 7 = 0 then 6 when doc_id % 3 = 0 then 2 when doc_id % 5 = 0 then 3 else 1 end::int as attempts, doc_id % 7 <> 0 as accepted, case when doc_id % 7 <> 0 then (quality + 1) / 2.0::double end as score,
case when doc_id % 7 = 0 then 6 when doc_id % 3 = 0 then 1 when doc_id % 5 = 0 then 2 else 0 end::int as refused from labels""")
def judge_with_retries(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in judge that answers some rows in no or another form, or about another criterion, at first or always."""
    calls = table(spark, d, "labels").select("doc_id", "quality", F.array(F.lit("first"), F.lit("second")).alias("criteria"))

    def ask(left: DataFrame, k: int) -> DataFrame:
        verdict = F.when(F.col("quality") > 0, "yes").otherwise(" No ")
        one = "<criterion><name>{0}</name><reason>1 &lt; 2</reason><verdict>"
        fine = F.concat(F.lit("So: <criteria>" + one.format("first")), F.lit("yes"), F.lit("</verdict></criterion>" + one.format("second")), verdict, F.lit("</verdict></criterion></criteria>"))
        bad = F.expr(f"case when doc_id % 7 = 0 then 'none' when doc_id % 3 = 0 and {k} < 1 then '<criteria></criteria>' when doc_id % 5 = 0 and doc_id % 3 <> 0 and {k} < 2 then 'other' end")
        return left.withColumn("response", F.when(bad == "other", F.replace(fine, F.lit("first"), F.lit("third"))).otherwise(F.coalesce(bad, fine))).withColumn("v", P.verdicts(F.col("response")))

    got = tasks.attempts(calls, ask, tasks.names_differ(F.col("v"), F.col("criteria")))
    score = F.aggregate("v.verdicts", F.lit(0.0), lambda a, v: a + P.verdict_value(v["verdict"]), lambda a: a / 2)
    return got.select("doc_id", "attempts", "accepted", F.when(F.col("accepted"), score).alias("score"), F.size("errors").alias("refused"))


# model responses

VERDICT_TEXTS = [
    "<criteria><criterion><name>a</name><reason>r</reason><verdict>yes</verdict></criterion></criteria>",
    "x <criteria><criterion><name>a</name><reason>1 < 2 & 3</reason><verdict>No</verdict></criterion></criteria> y",
    "<criteria><criterion><name>a</name><reason>r</reason><verdict>no</verdict></criterion></criteria><criteria><criterion><name>b</name><reason><b>q</b></reason><verdict>yes</verdict></criterion></criteria>",
    "nothing",
]


@query()
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(VERDICT_TEXTS)), "id int, text string")
    return rows.select("id", P.verdicts(F.col("text")).alias("v")).select("id", "v.error", F.explode_outer("v.verdicts").alias("x")).select("id", "error", "x.name", P.verdict_value(F.col("x.verdict")).alias("score"))


RUBRIC_TEXT = "# Question rubric\nEntity: E\nType: t\n## Question\nWhich?\n## Criteria\n1. First\nDocs: 1, 2\n2. Second\nDocs: 3\n## Docs\n1, 2, 3\n"


@query()
def rubric_markdown_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(0, RUBRIC_TEXT), (1, RUBRIC_TEXT.replace("2. ", "3. ")), (2, RUBRIC_TEXT.replace("1, 2, 3", "1, 2"))], "id int, text string")
    r = rows.select("id", P.rubric_markdown(F.col("text")).alias("r")).select("id", "r.*")
    return r.withColumn("broken", F.when(F.col("error").isNull(), P.rubric_errors(F.col("entity"), F.col("question"), F.col("rubric"), F.col("doc_ids"))))


@query()
def qa_quota_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.col("text").alias("question"), F.expr("case when doc_id % 3 = 0 then 'complex' else 'simple' end").alias("complexity"))
    return facts.accept(rows, "source", "doc_id", "question", "complexity", 10, 0.7)


FACT = "'<fact><statement> S' || (doc_id % 4) || ' </statement><doc_ids>' || doc_id || ', 3,' || doc_id || '</doc_ids><fact_id>7</fact_id><mentioned_entities>A, a, ' || source || ',B</mentioned_entities></fact>'"


@query(
    "with e as (select source, doc_id, 's' || (doc_id % 4)::varchar as key, row_number() over (partition by source, doc_id % 4 order by doc_id) as n from documents) select source as entity_name, count(*) filter (n = 1)::int as n_facts, count(*)::int as n_docs from e group by source"
)
def entity_fact_memory(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    answered = docs.select(F.col("source").alias("entity_name"), F.lit("x").alias("data_source"), F.array("doc_id").alias("doc_ids"), F.expr(FACT).alias("content"), "doc_id")
    memory = facts.entity_memory(answered, [F.col("doc_id")])
    return memory.select("entity_name", F.size("facts").alias("n_facts"), F.size("entity_doc_ids").alias("n_docs"))


@query("select p_partkey, array_to_string(list_transform(regexp_extract_all(p_type, '[A-Z]+'), lambda x: lower(x)), '-') as key, regexp_extract_all(p_name || ' ' || p_partkey::varchar, '\\d+') as numbers from part")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    parts = F.regexp_extract_all("p_type", F.lit("[A-Z]+"), F.lit(0))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(parts, F.lower), "-").alias("key"), F.regexp_extract_all(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")), F.lit(r"\d+"), F.lit(0)).alias("numbers"))
