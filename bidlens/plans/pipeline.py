"""The whole extraction as DataFrames: chunks, routes, candidates, fields, people, certificates, results."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.functions.lineage import written
from bidlens.operators import consolidate, evidence, extract, model_review, people, privacy, route, similar, structure
from bidlens.operators.rules import bank
from bidlens.sources.files import Settings


@dataclass
class Extraction:
    """Lazy results; each field is a DataFrame keyed by doc_id."""

    chunks: DataFrame
    routes: DataFrame
    spans: DataFrame
    fields: DataFrame
    people: DataFrame
    certificates: DataFrame
    missing: DataFrame


def chunk_spans(docs: DataFrame, chunks: DataFrame, routes: DataFrame, rules: list[tuple]) -> DataFrame:
    """Candidates from chunks, of the fields of their modules only, with offsets in the whole document.

    A chunk is looked for from its first line on, then anywhere; where it can't be found (its text was
    cleaned) its candidates keep no place.
    """
    wanted = route.rule_fields_of_routes(routes)
    raw = extract.cleaned(extract.raw_spans(chunks.select("doc_id", "chunk_no", "content"), rules)).join(wanted, ["doc_id", "chunk_no", "field_name"], "left_semi")
    body = chunks.select("doc_id", "chunk_no", F.col("content").alias("_piece"), F.col("start_line").alias("_line"))
    at = body.join(docs.select("doc_id", F.col("content").alias("_c")), "doc_id")
    head = F.array_join(F.slice(F.split("_c", "\n"), 1, F.greatest(F.col("_line") - 1, F.lit(0))), "\n")
    anchor = F.when(F.col("_line") > 1, F.length(head) + 2).otherwise(F.lit(1))
    place = F.expr("locate(_piece, _c, _anchor)")
    at = at.withColumn("_anchor", anchor.cast("int")).withColumn("_at", F.when(place > 0, place).otherwise(F.position("_piece", "_c")) - 1).select("doc_id", "chunk_no", "_at")
    lifted = raw.join(at, ["doc_id", "chunk_no"])
    known = F.col("_at") >= 0
    return lifted.withColumns({"start": F.when(known, F.col("start") + F.col("_at")).otherwise(-1), "end": F.when(known, F.col("end") + F.col("_at")).otherwise(-1)}).withColumn("ord", F.col("chunk_no") * 10_000 + F.col("ord")).drop("chunk_no", "_at")


def run(docs: DataFrame, settings: Settings | None = None, client: Callable[[str, str], str | None] | None = None, cache: DataFrame | None = None, as_of: datetime.date = consolidate.AS_OF) -> Extraction:
    """Extraction of ``docs`` (doc_id, content): rules over whole texts, over routed chunks, then entities and a model as set."""
    s = settings or Settings()
    rules = bank(s.custom_patterns)
    chunks = structure.chunks(docs, s.max_chunk_tokens, s.overlap_tokens)
    if s.enable_dedupe:
        chunks = similar.kept(chunks)
    # what several results below start from is written once
    chunks = written(chunks, "chunks")
    routes = written(route.routes(chunks), "routes")
    spans = consolidate.dedupe(extract.spans(docs, rules))
    if s.use_modules:
        spans = consolidate.merged(spans, consolidate.dedupe(chunk_spans(docs, chunks, routes, rules)).select(spans.columns))
    if s.use_ner:
        found = people.entities(docs).withColumns({"unit": F.lit(None).cast("string"), "normalized_value": F.lit(None).cast("string"), "ref": F.lit(None).cast("string")})
        spans = consolidate.merged(spans, found.select(spans.columns))
    spans = written(spans, "spans")
    fields = written(consolidate.fields(spans, as_of), "fields")
    missing = route.missing_fields(routes, fields)
    if client is not None and s.llm_provider != "none":
        weak = consolidate.low_confidence(fields, s.confidence_threshold).select("doc_id", "field_name", F.coalesce("ref", F.lit("")).alias("chunk_text"), F.array("primary_value").alias("existing_values"))
        if s.recover_missing:
            context = route.missing_context(missing, routes, chunks, docs)
            weak = weak.unionByName(context.select("doc_id", "field_name", F.col("context").alias("chunk_text"), F.array().cast("array<string>").alias("existing_values")))
        responses, _ = model_review.answered(model_review.requests(weak, s.llm_provider, s.llm_model, local=s.llm_provider == "ollama"), client, cache)
        spans = model_review.merged(spans, fields, responses, f"{s.llm_provider}:{s.llm_model}").select(spans.columns)
        spans = written(spans, "spans")
        fields = written(consolidate.fields(spans, as_of), "fields")
    spans = evidence.located(spans, docs)
    persons = people.people(docs)
    if not s.include_pii:
        spans, fields, persons = privacy.masked_spans(spans), privacy.masked_spans(fields), privacy.masked_people(persons)
    return Extraction(chunks, routes, spans, fields, persons, people.certificates(docs), missing)
