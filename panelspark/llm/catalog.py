"""The registered queries of the operators, over the whole tables they are meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import decontaminate, filter_audit, hard_negatives, html_text, language, packing, quality, secrets, sentence_spans, simhash, statements, token_files, toxicity, url_filter
from panelspark.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(statements.quality_rules())
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(statements.secret_scans())
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, model)
    return found.withColumn("held_out", language.held_out(F.col("doc_id")))


# Fixed rules (host, path, verdict) and the hosts whose crawled pages make up the list of URLs.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_HOSTS = r"(^|\.)(spam-farm|adult-x)\."

_CANONICAL = r"""CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+\z', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END"""


@query(rf"""
WITH parsed AS (
  SELECT page_id, coalesce(url, '') AS u, instr(coalesce(url, ''), '://') AS mark FROM pages),
cut AS (
  SELECT page_id, u, CASE WHEN mark > 0 THEN substr(u, mark + 3) ELSE '' END AS rest FROM parsed),
split AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
         list_sort([p FOR p IN string_split(regexp_extract(u, '(?s)^[^?#]*\?([^#]*)', 1), '&')
           IF p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|ref)(=|\z)')]) AS kept
  FROM cut),
canon AS (SELECT page_id, host, path, {_CANONICAL} AS canonical FROM split),
list AS (SELECT DISTINCT canonical FROM canon WHERE canonical <> '' AND regexp_matches(host, '(^|\.)(spam-farm|adult-x)\.')),
ruled AS (
  SELECT page_id, host, path, canonical IN (SELECT canonical FROM list) AS listed,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM canon)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.host_and_path(F.col("url"))[0].rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge(pages, listed, URL_RULES)


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    keys = spark.read.parquet(f"{folder}/documents")
    return token_files.read_keys(keys, folder, TOKENIZER).drop("nth")


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query()
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents")).drop("text_hash")


@query()
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query(statements.filter_audit())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(statements.hard_negatives())
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


@query()
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
