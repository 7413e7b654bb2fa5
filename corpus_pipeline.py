"""The corpus pipeline: five stages over ``documents``, each one an operator of ``bidlens.llm``.

A stage is a function of (spark, docs, sf_dir); what it returns is written and read again as the
next stage's ``docs``. All but the last return the columns of documents, whatever further columns
there are and whatever their names; columns that a stage adds on its way have names free in its input.

Rows with null or empty texts, null ids, repeated ids and repeated rows go through all stages:
toxicity scores each row by its text (an empty one by the model's bias), language ID rejects texts
without letters, and of rows alike in id and text, wherever they stand, the n-gram join keeps one.
Texts are judged whole. An empty table stays empty. Where no language
can be learnt, that stage keeps every row. Near copies are told by their words only, so ties
are settled by the smallest id (null last) and then by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm import bpe, decontamination, language_id, ngram_join, toxicity
from bidlens.llm.batches import free_name, remove, written
from bidlens.llm.queries import BPE_FILE, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; without labels the lexicon alone votes."""
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.with_toxicity(docs, weights, score).where(F.col(score) < 0.5).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is predicted with a probability of at least one half; all where no language can be learnt."""
    model = language_id.train(docs)
    if model is None:
        return docs
    lang, score = free_name(docs, "language"), free_name(docs, "language_score")
    return language_id.with_language(docs, model, lang, score).where((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id. Rows without words stay."""
    whole = F.xxhash64(F.col("text").cast("string"))
    rows = ngram_join.jaccard_components(docs, whole).where("group is not null").groupBy("group", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    least = rows.groupBy("group").agg(best.alias("best")).select("group", F.col("best.doc_id").alias("id"), F.col("best.key").alias("least"))
    # rows of an id and text: none of them stays, or of many only one
    stays = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("least"))
    odd = written(rows.join(least, "group").where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("id_of"), F.col("key").alias("text_of"), stays.alias("stays")), "odd")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id_of")) & (whole == F.col("text_of"))
    # only rows that may be meant go through a join, so that most texts are not dealt out
    meant = ngram_join.in_table(docs, ngram_join.bit_table(odd.select(F.xxhash64("id_of", "text_of"))), F.xxhash64(F.col("doc_id").cast("long"), whole))
    some = docs.where(meant)
    rest = docs.where(~meant).union(some.join(odd, same, "left_anti"))
    many = odd.where("stays")
    if not many.limit(1).count():
        return rest
    key = free_name(docs, "text_key")
    once = some.join(many, same, "left_semi").withColumn(key, whole).dropDuplicates(["doc_id", key]).drop(key)
    return rest.unionByName(once)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their number of tokens and digests of the ids and of the decoded text (columns of those names give way)."""
    return bpe.with_digests(docs, BPE_FILE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("language_id", known_language),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", no_benchmark),
    ("bpe", tokens),
]

#: No SQL expresses trained models and byte-pair merges; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
