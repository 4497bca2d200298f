"""From raw documents to a training mix: five operators of docmill.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written to the shared folder and read again as the
next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm import decontamination, line_dedup, minhash, mixing, toxicity
from docmill.llm.common import free_name, staged, table, text_key


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return scored.where(F.col(f"{scored.columns[-1]}.predicted") == 0).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go from all of them; documents that lose all their words go too."""
    d = line_dedup.dedup_lines(docs, min_docs=10)
    r = d.columns[-1]
    text, changed = F.col(f"{r}.kept_text"), F.col(f"{r}.n_dropped") > 0
    empty = changed & ~F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    replaced = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.where(~empty).select(*[replaced.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, Jaccard similarity of 0.8 or more.

    It is the one with the smallest id; of rows that share that id, or where no row has one, that of the lowest text key.
    Documents without words are in no group and stay.
    """
    d = minhash.near_duplicates(docs, shingle=5, threshold_percent=80, group=True)
    r = d.columns[-1]
    kept, group = d.where(F.col(f"{r}.kept")), F.col(f"{r}.group")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # only then can a group have two rows left
        order = F.row_number().over(W.partitionBy(group).orderBy(F.col("doc_id").asc_nulls_last(), text_key(F.col("text"))))
        place = free_name(d, "__dm_place")
        kept = kept.where(group.isNull()).unionByName(kept.where(group.isNotNull()).withColumn(place, order).where(F.col(place) == 1).drop(place))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    d = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return d.where(~F.col(f"{d.columns[-1]}.contaminated")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, so that the sources meet their weights 5, 2, 1, repeating."""
    d = mixing.mix_sources(docs, weights=(5, 2, 1), share=1.0, most=3)
    r = d.columns[-1]
    return d.select("doc_id", "source", *[f"{r}.{c}" for c in ("size", "source_size", "target", "copies", "taken")])


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the first stage; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
