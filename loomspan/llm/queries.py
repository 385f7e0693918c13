"""Queries of this subpackage: opN_<name>(spark, sf_dir), each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, mixing, progressive_jpeg, quality_gam, secrets, simhash, token_store, url_filter, warc, wu_manber
from .common import load


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media_round_trip(load(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(load(spark, sf_dir, "documents"))


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(load(spark, sf_dir, "documents"))


def op4_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"))


def op6_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(load(spark, sf_dir, "documents"))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(load(spark, sf_dir, "pages"))


QUERIES = {
    "op1_progressive_jpeg": op1_progressive_jpeg,
    "op2_token_store": op2_token_store,
    "op3_attention_lm": op3_attention_lm,
    "op4_simhash_anchors": op4_simhash_anchors,
    "op5_url_filter": op5_url_filter,
    "op6_secret_automaton": op6_secret_automaton,
    "op7_quality_gam": op7_quality_gam,
    "op8_entropy_mix": op8_entropy_mix,
    "op9_wu_manber": op9_wu_manber,
    "op10_warc_chunks": op10_warc_chunks,
}

ORACLE: dict[str, str] = {
    "op9_wu_manber": r"""
        with dw as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
        ), iw as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
        ), ib as (
            select item_id, w, least(13, len(w)) as m from iw where len(w) > 0
        ), ip as (
            select item_id, m, unnest(range(1, len(w) - m + 2)) as i, w from ib
        ), pats as (
            select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as gram from ip
        ), lens as (
            select distinct m from pats
        ), dp as (
            select doc_id, m, unnest(range(1, greatest(1, len(w) - m + 2))) as i, w from dw, lens where len(w) >= m
        ), dg as (
            select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') as gram from dp
        ), hits as (
            select distinct doc_id, item_id, m, i from dg join pats using (m, gram)
        ), hitwords as (
            select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + m)) as k from hits) group by doc_id
        ), hititems as (
            select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id
        )
        select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from dw left join hitwords using (doc_id) left join hititems using (doc_id)
    """,
    "op10_warc_chunks": """
        with p as (
            select page_id, encode(coalesce(html, '')) as payload from pages
        ), d as (
            select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p
        ), g as (
            select *, max(page_id) over (partition by payload_digest) as leader from d
        )
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id is distinct from leader and leader is not null then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id is distinct from leader and leader is not null then leader end as refers_to
        from g
    """,
}
