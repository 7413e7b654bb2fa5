"""Writers: result documents, reports, queues and caches. All are Spark writes to any store it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_documents(fields: DataFrame, values: DataFrame, people: DataFrame, certificates: DataFrame) -> DataFrame:
    """doc_id and a JSON document each, with fields by name, people and certificates."""
    listed = values.select("doc_id", "field_name", F.transform("values", lambda v: v.dropFields("k", "ord")).alias("values"))
    rows = fields.join(listed, ["doc_id", "field_name"]).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", F.struct("primary_value", "normalized_value", "confidence", "kind", "values").alias("v"))))).alias("fields"))
    group = lambda df, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"]))).alias(name))
    out = rows.join(group(people, "personnel"), "doc_id", "left").join(group(certificates, "certificates"), "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct("fields", "personnel", "certificates")).alias("value"))


def write_results(documents: DataFrame, path: str) -> None:
    """Lines of JSON, in folders by a hash of the document so that none grows with the corpus."""
    documents.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.mode("overwrite").partitionBy("part").json(path)


def write_snapshot(queue: DataFrame, path: str) -> str:
    """A queue as a new snapshot folder under ``path``; its name is the result, to be pointed to once the write is done."""
    import uuid

    name = f"{path.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    queue.orderBy("document", "field_name", "id").write.json(name)
    return name


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def append_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
