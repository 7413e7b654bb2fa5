"""Cutting long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share (spark.checkpoint.dir; a local one where it is unset in a local session) and read again."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/bidlens-shared"
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
