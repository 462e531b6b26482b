"""The queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnosia.llm import bpe, fingerprint, langid, licenses, packing, quality, sharding, simhash, tokencount, urls
from gnosia.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, vocabulary("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.rules(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_sum", "n_grams")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "documents"))
    pages = urls.url_parts(table(spark, sf_dir, "pages"))
    src = pages.select(
        "page_id", "host", langid.visible(F.col("html")).alias("body"), langid.markup_language(F.col("html")).alias("declared"),
        langid.suffix_language(F.col("host"), F.col("path")).alias("suffix"),
    )
    out = langid.identify(src, model, "body", "declared", "suffix", "host", keep=["page_id", "host", "declared", "suffix"])
    return out.select("page_id", "host", "declared", "suffix", "text_language", "language", F.round("posterior", 6).alias("posterior"))


#: The rules of op8: host and path, verdict.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokencount.pieces(vocabulary("piece_bpe_32k.model")), keep=["doc_id"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe, "op2_fingerprint": op2_fingerprint, "op3_licenses": op3_licenses, "op4_simhash": op4_simhash, "op5_quality": op5_quality,
    "op6_language": op6_language, "op7_tokens": op7_tokens, "op8_urls": op8_urls, "op9_sharding": op9_sharding, "op10_packing": op10_packing,
}
#: DuckDB SQL with the same result, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op3_licenses": licenses.oracle(),
    "op5_quality": quality.oracle(),
    "op8_urls": r"""
WITH rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
split AS (SELECT rule, verdict, rule[1:instr(rule, '/') - 1] AS rhost, rule[instr(rule, '/'):] AS rpath FROM rules),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest),
best AS (SELECT page_id, rule, verdict, rhost FROM parts JOIN split ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rhost) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)""",
}
