"""The queue of fields for human review: items, upserts, decisions, and their export as gold cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import text

QUEUE = "id string, document string, field_name string, candidate_values array<string>, primary_value string, confidence double, reasons array<string>, status string, action string, values array<string>, created_at string, updated_at string"


def unique(values: Column) -> Column:
    """Trimmed values without blanks, one of each folded spelling, in order."""
    trimmed = F.filter(F.transform(values, lambda v: text.utrim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    folded = F.transform(trimmed, text.casefold)
    return F.filter(trimmed, lambda v, i: F.array_position(folded, text.casefold(v)) == i + 1)


def _json_string(c: Column) -> Column:
    """A JSON string with only what must be escaped escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([\\\"])", r"\\$1"), "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t"), F.lit('"'))


def item_id(document: Column, field: Column, candidates: Column) -> Column:
    """The first 20 hex digits of the SHA-256 of the item's JSON with sorted keys."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(candidates, _json_string), ", "), F.lit("]"))
    raw = F.concat(F.lit('{"candidates": '), listed, F.lit(', "document": '), _json_string(document), F.lit(', "field": '), _json_string(field), F.lit("}"))
    return F.substring(F.sha2(raw, 256), 1, 20)


def items(fields: DataFrame, at: str, threshold: float = 0.7) -> DataFrame:
    """Review items of fields (document, field_name, primary_value, confidence, kind, values, source of the surest)."""
    reasons = F.array_compact(F.array(F.when(F.col("confidence") < threshold, "low_confidence"), F.when(F.col("kind").isNotNull(), "conflict"), F.when(F.col("source") == "llm", "llm_recovered")))
    candidates = unique(F.concat("values", F.when(F.col("primary_value").isNotNull(), F.array("primary_value")).otherwise(F.array().cast("array<string>"))))
    df = fields.withColumns({"reasons": reasons, "candidate_values": candidates}).where(F.size("reasons") > 0)
    return df.select(
        item_id(F.col("document"), F.col("field_name"), F.col("candidate_values")).alias("id"), "document", "field_name", "candidate_values", "primary_value", "confidence", "reasons",
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("array<string>").alias("values"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"),
    )


def upsert(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """The queue with ``incoming``: new items come in, decided ones stay, pending ones are replaced and keep their time of creation."""
    names = queue.columns
    old, new = queue.select(F.struct(*names).alias("o"), F.col("id")), incoming.dropDuplicates(["id"]).select(F.struct(*names).alias("n"), F.col("id"))
    both = old.join(new, "id", "full_outer")
    keep = F.col("n").isNull() | (F.col("o.status") == "resolved")
    pick = lambda c: F.when(keep, F.col(f"o.{c}")).otherwise(F.coalesce(F.col("o.created_at"), F.col("n.created_at")) if c == "created_at" else F.col(f"n.{c}"))
    return both.select(*(pick(c).alias(c) for c in names))


def added(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.join(queue.select("id"), "id", "left_anti")


def listed(queue: DataFrame, status: str = "pending") -> DataFrame:
    if status not in ("pending", "resolved", "all"):
        raise ValueError("status must be pending, resolved, or all")
    return queue if status == "all" else queue.where(F.col("status") == status)


def resolved(queue: DataFrame, decisions: DataFrame, at: str) -> DataFrame:
    """The queue with ``decisions`` (id, action, values): accept takes given values, the primary value or the first candidate; correct the given; reject none.

    Corrections without values and decisions on unknown items are errors of ``invalid``; here they change nothing.
    """
    d = decisions.select("id", F.col("action").alias("_a"), unique(F.coalesce("values", F.array().cast("array<string>"))).alias("_v"))
    df = queue.join(d, "id", "left")
    none = F.array().cast("array<string>")
    fallback = F.when(F.coalesce("primary_value", F.lit("")) != "", F.array("primary_value")).otherwise(F.slice("candidate_values", 1, 1))
    final = F.when(F.col("_a") == "reject", none).when(F.size("_v") > 0, F.col("_v")).when(F.col("_a") == "accept", fallback)
    done = F.coalesce((F.col("_a") == "reject") | (F.size(final) > 0), F.lit(False)) & F.col("_a").isin("accept", "correct", "reject")
    return df.select(*(
        F.when(done, v).otherwise(F.col(c)).alias(c) if (v := {"status": F.lit("resolved"), "action": F.col("_a"), "values": final, "updated_at": F.lit(at)}.get(c)) is not None else F.col(c)
        for c in queue.columns
    ))


def invalid(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that can't be applied: id, problem."""
    d = decisions.join(queue.select("id", "primary_value", "candidate_values"), "id", "left")
    nothing = F.size(F.coalesce("values", F.array().cast("array<string>"))) == 0
    problem = F.when(F.col("candidate_values").isNull(), "unknown item").when(~F.col("action").isin("accept", "correct", "reject"), "unknown action").when((F.col("action") == "correct") & nothing, "no corrected value").when((F.col("action") == "accept") & nothing & F.col("primary_value").isNull() & (F.size("candidate_values") == 0), "no candidate")
    return d.select("id", problem.alias("problem")).where("problem is not null")


def gold(queue: DataFrame) -> DataFrame:
    """id, document, field_name, expected: the latest decision of each document and field."""
    last = W.partitionBy("document", "field_name").orderBy(F.desc("updated_at"), F.desc("id"))
    df = queue.where("status = 'resolved' and action is not null").withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
    return df.select(F.concat(F.lit("review-"), F.substring(F.sha2("document", 256), 1, 12)).alias("id"), "document", "field_name", F.col("values").alias("expected"))


def gold_lines(queue: DataFrame) -> DataFrame:
    """One JSON line per document, for a text sink."""
    fields = F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", "expected"))))
    return gold(queue).groupBy("id", "document").agg(fields.alias("expected")).select(F.to_json(F.struct("document", "expected", "id", F.array(F.lit("human-reviewed")).alias("tags"))).alias("value"))
