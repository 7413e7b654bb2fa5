"""Scores of predicted field values against annotated ones.

Only annotated fields count. ``gold``: case_id, field_name, expected (array, may be empty).
``predicted``: case_id, field_name, value (a row per candidate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import text


def _normal(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, text.normal_value), lambda v: v != ""))


def scored(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """case_id, field_name, tp, fp, fn."""
    got = predicted.groupBy("case_id", "field_name").agg(F.collect_set("value").alias("_p"))
    df = gold.join(got, ["case_id", "field_name"], "left")
    e, p = _normal(F.coalesce("expected", F.array().cast("array<string>"))), _normal(F.coalesce("_p", F.array().cast("array<string>")))
    return df.select("case_id", "field_name", F.size(F.array_intersect(e, p)).cast("long").alias("tp"), F.size(F.array_except(p, e)).cast("long").alias("fp"), F.size(F.array_except(e, p)).cast("long").alias("fn"))


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    """Precision, recall and F1; 0 where a denominator is."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return {"precision": safe(t, t + p), "recall": safe(t, t + n), "f1": safe(2 * t, 2 * t + p + n)}


def totals(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))).withColumns(rates())


def per_field(scores: DataFrame) -> DataFrame:
    return totals(scores, "field_name")


def report(scores: DataFrame) -> DataFrame:
    """One row: cases, exact cases and their share, micro rates, macro F1."""
    cases = scores.groupBy("case_id").agg(F.max(F.col("fp") + F.col("fn")).alias("_bad")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("_bad") == 0).alias("exact_cases"))
    macro = per_field(scores).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    exact = F.when(F.col("cases") == 0, 0.0).otherwise(F.col("exact_cases") / F.col("cases"))
    return cases.crossJoin(totals(scores)).crossJoin(macro).withColumn("exact_case_accuracy", exact)  # one row each


def failures(scores: DataFrame) -> DataFrame:
    return scores.where("fp > 0 or fn > 0")


def passes(report_: DataFrame, least_f1: float) -> bool:
    return report_.first()["f1"] >= least_f1
