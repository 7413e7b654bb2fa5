"""Extraction over a stream of documents, an addition to the batch plans: stateless per document, with upserts per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bidlens.operators import extract
from bidlens.operators.rules import bank


def spans(stream: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Cleaned candidates of a stream of (doc_id, content)."""
    return extract.spans(stream, bank(), fields)


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, content string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def into_fields(stream: DataFrame, target: str, checkpoint: str, fields: list[str] | None = None) -> StreamingQuery:
    """Consolidated fields of each batch appended under ``target``; a batch that is run again replaces its own folder."""
    from bidlens.operators import consolidate

    def sink(batch: DataFrame, number: int) -> None:
        consolidate.fields(extract.spans(batch, bank(), fields)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
