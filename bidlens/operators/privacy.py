"""Personal data in results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.functions import text


def masked_spans(spans: DataFrame) -> DataFrame:
    """Identity numbers hidden in values, contexts and source texts."""
    return spans.withColumns({c: text.mask_text(F.col(c)) for c in ("value", "primary_value", "ref", "source_text") if c in spans.columns})


def masked_people(people: DataFrame) -> DataFrame:
    return people.withColumn("id_card", text.mask_id(F.col("id_card")))


def redacted(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as they may be sent to a model outside."""
    return df.withColumns({c: text.redacted(F.col(c)) for c in columns})
