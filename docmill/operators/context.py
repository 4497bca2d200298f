"""What goes into an answer: budgets of characters and turns, grades of context, source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.text import is_file_name, snippet

UP_TO = (W.unboundedPreceding, W.currentRow)


def context_budget(results: DataFrame, most_chunks: int = 10, budget: int = 8000, least_rest: int = 200) -> DataFrame:
    """(query_id, rank, content) cut to a budget of characters.

    The first chunk that does not fit is cut to what is left, and kept only if that is more than least_rest.
    """
    w = W.partitionBy("query_id").orderBy("rank")
    r = results.where(F.col("rank") <= most_chunks).withColumn("before", F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - F.col("before")
    r = r.where((left > 0) & ((F.length("content") <= left) | (left > least_rest)))
    return r.withColumn("content", F.substr("content", F.lit(1), left.cast("int"))).drop("before")


def history_window(turns_: DataFrame, turns: int = 5, budget: int = 4000, overhead: int = 2) -> DataFrame:
    """E5: the last turns of each conversation, as many from the first on as fit into the budget."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(*UP_TO)
    kept = turns_.withColumn("back", back).where(F.col("back") <= turns)
    return kept.withColumn("used", F.sum(F.length("text") + overhead).over(w)).where(F.col("used") <= budget).drop("back")


def answered(turns_: DataFrame) -> DataFrame:
    """Each user turn with the assistant's answer right after it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = turns_.where("role <> 'system'").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return t.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def pass_budget(length: Column) -> Column:
    """Passes that a text of this length deserves."""
    return F.when(length < 500, 1).when(length <= 2000, 2).otherwise(3)


def worthwhile_passes(passes: DataFrame, key: str, most: Column, least_gain: float = 0.1) -> DataFrame:
    """(key, pass, fresh) up to the first pass that is over its budget or adds less than a tenth."""
    w = W.partitionBy(key).orderBy("pass")
    p = passes.withColumn("prior", F.sum("fresh").over(w.rowsBetween(*UP_TO)) - F.col("fresh"))
    bad = (F.col("pass") > most) | ((F.col("prior") > 0) & (F.try_divide(F.col("fresh"), F.col("prior")) < least_gain))
    p = p.withColumn("stop", F.min(F.when(bad, F.col("pass"))).over(W.partitionBy(key)))
    return p.where(F.col("stop").isNull() | (F.col("pass") < F.col("stop"))).drop("stop", "prior")


def context_quality(queries: DataFrame, results: DataFrame, high: float = 0.1, cutoff: float = 0.005, high_count: int = 1) -> DataFrame:
    """A grade per query; scores below the cutoff count only where nothing is above it."""
    s, kept = F.col("score"), F.col("score") >= cutoff
    g = results.groupBy("query_id").agg(
        F.count_if(s >= high).alias("n_high"), F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("dropped"),
        F.coalesce(F.max(F.when(kept, s)), F.max(s)).alias("max_score"), F.coalesce(F.avg(F.when(kept, s)), F.avg(s)).alias("avg_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    grade = F.when(zero(F.col("n_high")) >= high_count, "HIGH").when(zero(F.col("n_kept")) > 0, "PARTIAL").otherwise("NONE")
    return queries.join(g, "query_id", "left").select("query_id", grade.alias("grade"), zero(F.col("n_high")).alias("n_high"), zero(F.col("n_kept")).alias("n_kept"), zero(F.col("dropped")).alias("dropped"), F.round(zero(F.col("max_score")), 6).alias("max_score"), F.round(zero(F.col("avg_score")), 6).alias("avg_score"))


def source_table(results: DataFrame, most_chars: int = 200) -> DataFrame:
    """Numbered sources with snippets; the first of each document is the primary one; entities without file names."""
    first = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy("rank")) == 1
    names = F.filter("entities", lambda e: ~is_file_name(e)) if "entities" in results.columns else F.array().cast("array<string>")
    return results.select("query_id", F.col("rank").alias("source_no"), "document_id", "chunk_id", snippet(F.col("content"), most_chars).alias("snippet"), first.alias("is_primary"), names.alias("names"))


def carried_headings(pieces: DataFrame, key: str = "document_id") -> DataFrame:
    """The last heading line before or at each piece."""
    w = W.partitionBy(key).orderBy("chunk_index").rowsBetween(*UP_TO)
    return pieces.withColumn("heading", F.last(F.nullif(F.regexp_extract("content", "^#{1,6}\\s+(.+)$", 1), F.lit("")), ignorenulls=True).over(w))
