"""What the training-data operators share: tables, scratch storage, row keys and result columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side smaller than this many rows of a few longs is broadcast; any larger one is shuffled.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"file://{tempfile.gettempdir()}/docmill-scratch").rstrip("/")


def staged(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends here and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/docmill/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores in front as long as df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_result(df: DataFrame, name: str, **fields: Column) -> DataFrame:
    """df's own columns and one struct column with the operator's figures."""
    return df.withColumn(free_name(df, name), F.struct(*[c.alias(k) for k, c in fields.items()]))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged; lower() where the text is pure ASCII, which is the same and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """With the id it identifies a document, also where ids are null or repeat; rows equal in both have equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count shows at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined_back(docs: DataFrame, figures: DataFrame, id_col: str, text_col: str, how: str = "inner") -> tuple[DataFrame, str]:
    """docs with one struct column that holds the columns of figures, and that column's name, which docs has not.

    figures has one row for each (id, th). The text's key is a column before the join, so a text that nobody asks for is
    not shuffled.
    """
    key, name = free_name(docs, "__dm_key"), free_name(docs, "__dm_figures")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    packed = figures.select(F.struct(*figures.columns).alias(name))
    return keyed.join(packed, F.col(id_col).eqNullSafe(F.col(f"{name}.id")) & (F.col(key) == F.col(f"{name}.th")), how), name
