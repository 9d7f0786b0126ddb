"""Registered queries of the operators over the sample tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftledger.llm.best_fit_packing import pack
from shiftledger.llm.common import table
from shiftledger.llm.decontaminate import contamination_table
from shiftledger.llm.embedding_whitening import whiten
from shiftledger.llm.hilbert_shards import shard_documents
from shiftledger.llm.jaccard_join import jaccard_table
from shiftledger.llm.language_id import language_table
from shiftledger.llm.lexical_search import search_table
from shiftledger.llm.pii_boosting import pii_table
from shiftledger.llm.quality_neighbours import quality_table
from shiftledger.llm.sentence_spans import span_table
from shiftledger.llm.suffix_dedup import suffix_table
from shiftledger.llm.token_counts import token_table
from shiftledger.llm.topk_search import top_k, whole_vectors


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_table(table(spark, folder, "documents"))


def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


def op3_pii_boosting(spark: SparkSession, folder: str) -> DataFrame:
    return pii_table(table(spark, folder, "documents"))


def op4_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return span_table(table(spark, folder, "documents"))


def op5_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return quality_table(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = whole_vectors(table(spark, folder, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_table(table(spark, folder, "documents"))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_table(table(spark, folder, "documents"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contamination_table(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_table(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search_table(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_hilbert_shards,
        op3_pii_boosting,
        op4_sentence_spans,
        op5_quality_neighbours,
        op6_topk_search,
        op7_best_fit_packing,
        op8_suffix_dedup,
        op9_jaccard_join,
        op10_decontaminate,
        op11_token_counts,
        op12_embedding_whitening,
        op13_lexical_search,
    )
}

STATEMENTS = {
    "op6_topk_search": """
with parts as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from parts q join parts c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, "rank", vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as "rank"
  from scores) where "rank" <= 5""",
    "op10_decontaminate": r"""
with doc_words as (
  select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws
  from documents),
item_words as (
  select item_id::varchar as item,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws
  from benchmark),
item_windows as (
  select distinct item, least(len(ws), 10) as length, list_slice(ws, i, i + least(len(ws), 10) - 1) as w
  from (select item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as i from item_words where len(ws) > 0)),
lengths as (select distinct length from item_windows),
doc_windows as (
  select r, i, length, list_slice(ws, i, i + length - 1) as w from (
    select r, ws, length, unnest(range(1, len(ws) - length + 2)) as i
    from doc_words, lengths where len(ws) >= length)),
found as (select d.r, d.i, d.length, b.item from doc_windows d join item_windows b using (length, w)),
hit as (select r, count(*) as n_hit from (
    select distinct r, unnest(range(i, i + length)) as at from found) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item from found where item is not null) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit using (r) left join named using (r)""",
    "op13_lexical_search": r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
items as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from (select distinct item_id, text from benchmark)),
totals as (select count(*)::bigint as n_docs, sum(len(ts))::bigint as n_words from docs where len(ts) > 0),
asked as (select q, item_id, term, count(*)::bigint as times
  from (select q, item_id, unnest(ts) as term from items) group by all),
found as (select r, doc_id, n, term, count(*)::bigint as tf
  from (select r, doc_id, len(ts)::bigint as n, unnest(ts) as term from docs)
  where term in (select term from asked) group by all),
weights as (select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2 * df + 1)))::bigint as w
  from (select term, count(*) as df from found group by term), totals),
scores as (
  select q, item_id, r, doc_id, sum(w * times * ((1000000000 * tf)
    // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))))::bigint as score
  from asked join found using (term) join weights using (term), totals group by q, item_id, r, doc_id)
select item_id, "rank", doc_id, score from (
  select *, row_number() over (partition by q order by score desc, doc_id)::int as "rank"
  from scores where score > 0) where "rank" <= 10""",
}
