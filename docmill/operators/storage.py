"""Intermediate tables: written once to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side below this many rows is broadcast; any larger one is shuffled.
SMALL_ROWS = 100_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; a local one only on a local master that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/docmill-scratch"
    return f"{folder.rstrip('/')}/docmill/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, computed once: lineage ends here, and what a lost executor had made is read again."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if a count shows at most so many rows; the count runs df, so stage what is dear."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
