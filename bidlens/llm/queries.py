"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, decontamination, html_text, language_id, licences, ngram_join, toxicity, url_rules, warc

try:
    import public_tokenizers

    BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
except ModuleNotFoundError:
    BPE_FILE = os.environ.get("BIDLENS_BPE_FILE", "/opt/tokenizers/byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(n: int, rest: int):
    """Is crc32(doc_id as text) mod n the rest? False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == rest, F.lit(False))


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a replica of the pages' WARC records that are damaged, missing or surplus, as ``warc.audit`` gives them."""
    pages = table(spark, sf_dir, "pages")
    return warc.audit(warc.digests(pages), warc.digests(warc.damaged(pages)))


def op2_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and digests of every document's text stored as an AVI motion-JPEG file and read back."""
    return avi.with_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.with_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE_FILE).drop("text")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, sentence_ids and licences (joined by spaces) of every document."""
    found = licences.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.with_language(docs.select("doc_id", "text"), model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_text.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: The given url rules: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, edits, end_byte: the benchmark items found in documents."""
    return decontamination.found(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_fixity, op2_avi, op3_bpe, op4_licences, op5_language_id, op6_html_text, op7_url_rules, op8_ngram_jaccard, op9_decontamination, op10_toxicity)
}

ORACLES: dict[str, str] = {
    "op4_licences": licences.oracle(),
    "op1_warc_fixity": f"""
WITH replica AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN chr(7) || substr(html, 2) WHEN page_id % 97 = 41 THEN coalesce(html, '') || 'more' ELSE html END AS html
  FROM pages WHERE coalesce(page_id % 97, 0) <> 29
  UNION ALL SELECT page_id, url, html FROM pages WHERE page_id % 97 = 53
  UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % 97 = 67),
either AS (SELECT 1 AS side, * FROM (SELECT page_id, url, html FROM pages) UNION ALL SELECT 2, * FROM replica),
texts AS (
  SELECT side, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS a FROM either),
sums AS (SELECT page_id, CAST(strlen(a) AS BIGINT) AS length, sha256(a) AS digest, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2 FROM texts GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, digest) - 1 AS place FROM sums WHERE n1 > 0),
files AS (SELECT *, place // {warc.PER_FILE} AS file FROM placed),
manifest AS (SELECT *, CAST(coalesce(sum(length * n1) OVER (PARTITION BY file ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM files),
lost AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY digest) AS k FROM (SELECT *, unnest(range(n1 - n2)) FROM manifest WHERE n1 > n2)),
more AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY digest) AS k FROM (SELECT *, unnest(range(n2 - n1)) FROM sums WHERE n2 > n1))
SELECT CASE WHEN more.k IS NULL THEN 'missing' WHEN lost.k IS NULL THEN 'surplus' ELSE 'damaged' END AS kind, coalesce(lost.page_id, more.page_id) AS page_id,
  place, file, "offset", lost.length AS length, lost.digest AS digest, more.length AS replica_length, more.digest AS replica_digest
FROM lost FULL JOIN more ON lost.page_id IS NOT DISTINCT FROM more.page_id AND lost.k = more.k""",
}
