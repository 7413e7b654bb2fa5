"""Packages of documents: revisions, replacements, and the effective value of each field.

Documents are rows of (package_id, id, role, bidder, logical_name, revision, supersedes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions.passes import by_key

#: Which role's value wins.
ROLE_PRIORITY = {"other": 0, "attachment": 100, "tender": 200, "clarification": 300, "amendment": 400, "bid": 500}


def scope() -> Column:
    return F.when(F.col("bidder").isNotNull() & (F.col("bidder") != ""), F.concat(F.lit("bidder:"), "bidder")).otherwise(F.lit("tender"))


def edges(docs: DataFrame) -> DataFrame:
    """package_id, id, target of every replacement."""
    return docs.select("package_id", "id", F.explode("supersedes").alias("target"))


def problems(docs: DataFrame) -> DataFrame:
    """package_id, id, problem: what makes a package invalid, a row each; empty for valid ones."""
    other = docs.select("package_id", F.col("id").alias("target"), scope().alias("_target_scope")).distinct()
    e = edges(docs).join(docs.select("package_id", "id", scope().alias("_scope")), ["package_id", "id"])
    linked = e.join(other, ["package_id", "target"], "left")
    named = docs.where(F.coalesce("logical_name", F.lit("")) != "")
    row = lambda df, what: df.select("package_id", "id", F.lit(what).alias("problem")).distinct()
    out = row(docs.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("package_id", "id"))).where("_n > 1"), "duplicate id")
    out = out.union(row(docs.where((F.col("role") == "bid") & (F.trim(F.coalesce("bidder", F.lit(""))) == "")), "bid without bidder"))
    out = out.union(row(e.where("id = target"), "supersedes itself")).union(row(linked.where("_target_scope is null"), "unknown target"))
    out = out.union(row(linked.where("_target_scope is not null and _scope <> _target_scope"), "target of another scope"))
    same = W.partitionBy("package_id", "role", F.coalesce("bidder", F.lit("")), "logical_name", "revision")
    out = out.union(row(named.withColumn("_n", F.count(F.lit(1)).over(same)).where("_n > 1"), "duplicate revision"))
    return out.union(row(cycles(docs), "cycle"))


def rings(edges_: list[tuple[str, str]]) -> list[tuple[str]]:
    """What is left of a package when documents that replace nothing left, or that nothing left replaces, are taken away."""
    after: dict[str, set[str]] = {}
    before: dict[str, set[str]] = {}
    for a, b in edges_:
        after.setdefault(a, set()).add(b)
        before.setdefault(b, set()).add(a)
    gone = [x for x in after.keys() | before.keys() if x not in after or x not in before]
    for x in gone:  # grows as it goes
        for ways, back in ((after, before), (before, after)):
            for y in ways.pop(x, ()):
                if y in back:
                    back[y].discard(x)
                    if not back[y]:
                        del back[y]
                        gone.append(y)
    return [(x,) for x in sorted(after)]


def cycles(docs: DataFrame) -> DataFrame:
    """package_id, id of documents on a ring of replacements, found package by package (a package is one manifest)."""
    return by_key(edges(docs).where("id <> target"), "package_id", [], rings, f"id {docs.schema['id'].dataType.simpleString()}")


def resolutions(docs: DataFrame) -> DataFrame:
    """package_id, id, active, reason, superseded_by.

    A document that another one names is ``superseded``; of the rest of a logical document the
    highest revision stays and the others have a ``newer_revision``.
    """
    by = edges(docs).groupBy("package_id", F.col("target").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("_by"))
    df = docs.join(by, ["package_id", "id"], "left")
    group = W.partitionBy("package_id", "role", F.coalesce("bidder", F.lit("")), "logical_name")
    open_ = F.col("_by").isNull() & (F.coalesce("logical_name", F.lit("")) != "")
    latest = F.max(F.when(open_, F.struct("revision", "id"))).over(group)
    old = open_ & (F.col("revision") < latest["revision"])
    none = F.array().cast("array<string>")
    return df.select(
        "package_id", "id", (F.col("_by").isNull() & ~old).alias("active"), F.when(F.col("_by").isNotNull(), "superseded").when(old, "newer_revision").alias("reason"),
        F.when(F.col("_by").isNotNull(), F.col("_by")).when(old, F.array(latest["id"])).otherwise(none).alias("superseded_by"),
    )


def source_scope() -> Column:
    """Where a document's fields count: with its bidder, or for the tender."""
    return F.when(F.col("role") == "bid", F.concat(F.lit("bidder:"), F.coalesce("bidder", F.lit("__unscoped__")))).when((F.col("role") == "attachment") & F.col("bidder").isNotNull(), F.concat(F.lit("bidder:"), "bidder")).otherwise(F.lit("tender"))


def effective(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """package_id, scope, field_name, primary_value, confidence, selected_from, values, conflicts.

    ``fields``: doc_id, field_name, primary_value, confidence, values (array). Only active documents
    count; the source with the highest role, revision, confidence and id is taken, every other value kept.
    """
    rank = F.create_map(*(F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv))
    active = docs.join(resolutions(docs).where("active").select("package_id", "id"), ["package_id", "id"]).withColumn("scope", source_scope())
    source = active.join(fields.withColumnRenamed("doc_id", "id"), "id").withColumn("_rank", F.coalesce(rank[F.col("role")], F.lit(0)))
    order = F.struct(F.col("_rank"), F.col("revision"), F.col("confidence"), F.col("id"))
    rows = F.sort_array(F.collect_list(F.struct(order.alias("k"), "values", "primary_value", "confidence", "id")), asc=False)
    df = source.groupBy("package_id", "scope", "field_name").agg(rows.alias("s"))
    best = F.element_at("s", 1)
    everything = F.array_distinct(F.flatten(F.transform("s", lambda x: F.concat(x["values"], F.when(x["primary_value"].isNotNull(), F.array(x["primary_value"])).otherwise(F.array().cast("array<string>"))))))
    df = df.withColumn("values", F.filter(everything, lambda v: F.trim(v) != "")).withColumn("primary_value", F.coalesce(best["primary_value"], F.try_element_at(best["values"], F.lit(1))))
    return df.select("package_id", "scope", "field_name", "primary_value", best["confidence"].alias("confidence"), best["id"].alias("selected_from"), "values", F.filter("values", lambda v: ~v.eqNullSafe(F.col("primary_value"))).alias("conflicts"))
