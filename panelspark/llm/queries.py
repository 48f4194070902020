"""The ``opN_<name>`` queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import (bytebpe, chunkcode, conversations, embeddings, lexical, lm, packing, quality, sharding, simhash,
                            substrings, suffixdedup, urlrules)
from panelspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@register("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


@register("op2_embedding_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op3_bpe_encoding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkcode.encode_decode(table(spark, sf_dir, "documents"))


@register("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.ctw_scores(table(spark, sf_dir, "documents"))


@register("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_table(docs, field)


@register("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_table(table(spark, sf_dir, "documents"))


@register("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_table(table(spark, sf_dir, "documents"))


@register("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@register("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlrules.RULES)


@register("op10_url_filters", f"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_VALUES}),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path
                            ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC) AS place
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host))
                                    AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urlrules.RULES), "host string, path string, verdict string")
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), rules)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"unnest(regexp_extract_all({_LOWERED}, '{lexical.PATTERN}'))"


@register("op11_ranked_lexical_search", f"""
WITH occurrences AS (SELECT row_number() OVER () AS doc, doc_id, text FROM documents),
words AS (SELECT doc, doc_id, {_TERMS} AS term FROM occurrences),
docs AS (SELECT doc, doc_id, count(*) AS n FROM words GROUP BY 1, 2),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
postings AS (SELECT doc, term, count(*) AS tf FROM words GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings, corpus GROUP BY term),
asked AS (SELECT item_id, {_TERMS} AS term FROM benchmark),
scored AS (
  SELECT a.item_id, d.doc, d.doc_id,
         CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * d.n * c.n_docs) // c.n_terms)))) AS BIGINT)
           AS score
  FROM asked a JOIN weights w ON a.term = w.term JOIN postings p ON p.term = a.term JOIN docs d ON d.doc = p.doc, corpus c
  GROUP BY 1, 2, 3),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


@register("op12_byte_level_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_decode(table(spark, sf_dir, "documents"))


@register("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))
