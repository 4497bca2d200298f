"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 30


def held_out(id_: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether an id (as text; null: the empty text) belongs to the fold whose labels are never learnt from."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """(th, text, y): about `bound` labelled training texts at most, each text once; chosen by a hash of the id.

    labels with a null id or label teach nothing; of several labels for an id the mean counts, a half as 1. The ids are
    broadcast, their number being bounded.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("lid")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "lid"), F.lit(SLOTS)) < int(SLOTS * bound / n))
    texts = docs.select(F.col(id_col).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = texts.join(F.broadcast(known), F.col("did") == F.col("lid")).select(F.xxhash64("text").alias("th"), "text", "y")
    return both.groupBy("th").agg(F.first("text").alias("text"), F.max("y").alias("y"))
