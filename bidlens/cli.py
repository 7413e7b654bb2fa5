"""Command line: extract, info, eval, providers, package and review. Exit codes: 1 for wrong use or failure, 2 for a score below the gate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.operators import consolidate, evaluation, packages, review, structure
from bidlens.plans import pipeline
from bidlens.sources import files, providers, sinks


def session() -> SparkSession:
    spark = SparkSession.builder.appName("bidlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _run(spark: SparkSession, docs: DataFrame, a: argparse.Namespace) -> tuple[files.Settings, pipeline.Extraction]:
    p = providers.provider(getattr(a, "llm", None))
    s = files.settings(files.yaml_file(a.config) if a.config else {}, llm_provider=p.id if p.id != "none" else None, llm_model=getattr(a, "model", None), use_ner=getattr(a, "use_ner", None) or None, include_pii=getattr(a, "include_pii", None) or None)
    p = providers.provider(s.llm_provider)
    return s, pipeline.run(docs, s, providers.client(p, s.llm_model, s.llm_base_url))


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = files.documents(spark, a.input, a.pattern)
    _, out = _run(spark, docs.where("error is null").select("doc_id", "content"), a)
    sinks.write_results(sinks.result_documents(out.fields, consolidate.values(out.spans), out.people, out.certificates), a.out)
    out.fields.select("doc_id", "field_name", "primary_value", "confidence").orderBy("doc_id", "field_name").show(50, truncate=60)
    failed = docs.where("error is not null")
    failed.select("filename", "error").show(20, truncate=80)
    return 1 if failed.limit(1).count() else 0


def info(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = files.documents(spark, a.input).where("error is null").select("doc_id", "content")
    structure.content_stats(docs).show(truncate=False)
    structure.headings(docs).select("doc_id", "line_no", "level", "title").show(100, truncate=False)
    structure.key_sections(docs).select("doc_id", "title", "line_no", "end_line").show(truncate=False)
    return 0


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    import os

    gold = files.gold(spark, a.dataset).withColumn("path", F.when(F.col("document").startswith("/"), F.col("document")).otherwise(F.concat(F.lit(os.path.dirname(os.path.abspath(a.dataset)) + "/"), "document")))
    paths = [r["path"] for r in gold.select("path").distinct().collect()]
    body = None
    for p in paths:
        one = files.documents(spark, p).select(F.lit(p).alias("doc_id"), "content")
        body = one if body is None else body.unionByName(one)
    _, out = _run(spark, body, a)
    predicted = out.spans.select(F.col("doc_id").alias("path"), "field_name", F.coalesce("normalized_value", "value").alias("value"))
    cases = gold.select("case_id", "path").distinct()
    scores = evaluation.scored(gold.select("case_id", "field_name", "expected"), predicted.join(cases, "path").select("case_id", "field_name", "value"))
    report = evaluation.report(scores)
    report.show(truncate=False)
    evaluation.failures(scores).show(20, truncate=False)
    if a.report:
        sinks.write_lines(report.select(F.to_json(F.struct(*report.columns)).alias("value")), a.report)
    return 2 if a.fail_under is not None and not evaluation.passes(report, a.fail_under) else 0


def list_providers(spark: SparkSession, a: argparse.Namespace) -> int:
    for p in providers.listed():
        print(f"{p.id:15s} {p.name:20s} {p.model:40s} {p.key_env}")
    return 0


def package(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = files.manifest(spark, a.manifest)
    wrong = packages.problems(docs)
    if wrong.limit(1).count():
        wrong.show(truncate=False)
        return 1
    packages.resolutions(docs).show(truncate=False)
    if a.action == "inspect":
        docs.where("bidder is not null").select("bidder").distinct().show(truncate=False)
    if a.action == "extract":
        body = None
        for r in docs.select("id", "path").collect():  # a manifest's documents
            one = files.documents(spark, r["path"]).select(F.lit(r["id"]).alias("doc_id"), "content")
            body = one if body is None else body.unionByName(one)
        _, out = _run(spark, body, a)
        listed = consolidate.values(out.spans).select("doc_id", "field_name", F.transform("values", lambda v: F.coalesce(v["normalized_value"], v["value"])).alias("values"))
        fields = out.fields.join(listed, ["doc_id", "field_name"]).select("doc_id", "field_name", "primary_value", "confidence", "values")
        result = packages.effective(docs, fields)
        sinks.write_lines(result.select(F.to_json(F.struct(*result.columns)).alias("value")), a.out)
    return 0


def reviews(spark: SparkSession, a: argparse.Namespace) -> int:
    queue = files.review_queue(spark, a.queue)
    if a.action == "list":
        review.listed(queue, a.status).show(100, truncate=60)
        return 0
    if a.action == "export":
        sinks.write_lines(review.gold_lines(queue), a.out)
        return 0
    decision = spark.createDataFrame([(a.item, a.decision, a.value or [])], "id string, action string, values array<string>")
    wrong = review.invalid(queue, decision)
    if wrong.limit(1).count():
        wrong.show(truncate=False)
        return 1
    print(sinks.write_snapshot(review.resolved(queue, decision, a.at), a.out))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bidlens", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, f, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for p in positional:
            c.add_argument(p)
        c.add_argument("--config")
        c.add_argument("--llm")
        c.add_argument("--model")
        c.set_defaults(run=f)
        return c

    for name in ("extract", "extract-v2", "test"):
        c = command(name, extract, "input")
        c.add_argument("--out", default="out")
        c.add_argument("--pattern", default="*")
        c.add_argument("--use-ner", action="store_true")
        c.add_argument("--include-pii", action="store_true")
    command("info", info, "input")
    c = command("eval", evaluate, "dataset")
    c.add_argument("--report")
    c.add_argument("--fail-under", type=float)
    command("providers", list_providers)
    c = command("package", package, "action", "manifest")
    c.add_argument("--out", default="package-out")
    c = command("review", reviews, "action", "queue")
    c.add_argument("--status", default="pending")
    c.add_argument("--item")
    c.add_argument("--decision", choices=("accept", "correct", "reject"))
    c.add_argument("--value", action="append")
    c.add_argument("--at", default="")
    c.add_argument("--out", default="review-out")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())
