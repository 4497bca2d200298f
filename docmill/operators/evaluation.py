"""Answer metrics by word overlap, rank-aware precision, and comparisons of two search variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.text import words


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(F.coalesce(c, F.lit("")))))


def covered(part: Column, whole: Column, empty: Column) -> Column:
    """Share of part's words that whole has."""
    return F.when(F.size(part) == 0, empty).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def answer_metrics(samples: DataFrame) -> DataFrame:
    """(question, answer, contexts, ground_truth) with the four metrics; recall is null without ground truth."""
    ctx = F.array_distinct(F.flatten(F.transform(F.coalesce("contexts", F.array().cast("array<string>")), word_set)))
    q, a = word_set(F.col("question")), word_set(F.col("answer"))
    useful = F.size(F.filter("contexts", lambda c: F.arrays_overlap(word_set(c), q)))
    return samples.withColumns({
        "faithfulness": covered(a, ctx, F.lit(0.0)),
        "answer_relevancy": covered(q, a, F.lit(0.5)),
        "context_precision": F.when(F.size("contexts") > 0, useful / F.size("contexts")).otherwise(F.lit(0.0)),
        "context_recall": F.when(F.coalesce("ground_truth", F.lit("")) != "", covered(word_set(F.col("ground_truth")), ctx, F.lit(0.0))),
    })


def validated(samples: DataFrame, least: float = 0.7) -> DataFrame:
    """Whether an answer is faithful and relevant, and why not; no words in the query make relevance 0."""
    a = word_set(F.col("answer"))
    d = samples.withColumns({"faithfulness": F.round(covered(a, word_set(F.col("context")), F.lit(0.0)), 4), "relevance": F.round(covered(word_set(F.col("question")), a, F.lit(0.0)), 4)})
    low = lambda c, name: F.when(F.col(c) < least, F.lit(f"{name} below {least}"))
    ok = (F.col("faithfulness") >= least) & (F.col("relevance") >= least)
    return d.withColumns({"is_valid": ok, "feedback": F.coalesce(F.nullif(F.concat_ws("; ", low("faithfulness", "faithfulness"), low("relevance", "relevance")), F.lit("")), F.lit("passed"))})


def rank_precision(verdicts: DataFrame, span: int = 1024) -> DataFrame:
    """(query_id, rank, relevant) to the mean of precision at the relevant ranks, and the relevant share.

    Running sums are taken over spans of ranks, then within them, so a long list is never in one task.
    """
    v = verdicts.select("query_id", "rank", "relevant", F.floor(F.col("rank") / span).alias("span"), F.col("relevant").cast("int").alias("hit"))
    sums = v.groupBy("query_id", "span").agg(F.sum("hit").alias("h"), F.count("*").alias("c"))
    before = W.partitionBy("query_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("query_id").alias("q"), F.col("span").alias("s"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    w = W.partitionBy("query_id", "span").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    p = v.withColumns({"h": F.sum("hit").over(w), "c": F.count("*").over(w)}).join(sums, F.col("query_id").eqNullSafe(F.col("q")) & (F.col("span") == F.col("s")))
    p = p.withColumn("p", (F.col("h") + F.col("h0")) / (F.col("c") + F.col("c0")))
    return p.groupBy("query_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("p"))), F.lit(0.0)), 6).alias("average_precision"), F.round(F.avg("hit"), 6).alias("supported_share"))


def evaluation_samples(answers: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """Answers (query_id, question, answer, failed, ground_truth) that did not fail, with their contexts in order of rank."""
    c = results.where(F.col("rank") <= most).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    return answers.where(~F.col("failed")).join(c, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def compared(a: DataFrame, b: DataFrame, most: int = 10) -> DataFrame:
    """Per query the overlap of two result lists (query_id, chunk_id, rank, score), what each has alone, whether the first agree."""
    side = lambda df, s: df.where(F.col("rank") <= most).select("query_id", "chunk_id", F.col("rank").alias(f"rank_{s}"), F.col("score").alias(f"score_{s}"))
    j = side(a, "a").join(side(b, "b"), ["query_id", "chunk_id"], "full_outer")
    in_a, in_b = F.col("rank_a").isNotNull(), F.col("rank_b").isNotNull()
    mean5 = lambda s: F.round(F.coalesce(F.avg(F.when(F.col(f"rank_{s}") <= 5, F.col(f"score_{s}"))), F.lit(0.0)), 6).alias(f"top5_{s}")
    return j.groupBy("query_id").agg(F.count_if(in_a & in_b).alias("overlap"), F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_b & ~in_a).alias("only_b"), (F.count_if((F.col("rank_a") == 1) & (F.col("rank_b") == 1)) > 0).alias("same_first"), mean5("a"), mean5("b"))


def variant_winners(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, sources, latency) of two variants to wins, ties, errors, mean latencies and the overall winner."""
    s = lambda df, x: df.select("query_id", F.col("sources").alias(f"s_{x}"), F.col("latency").alias(f"l_{x}"))
    j = s(a, "a").join(s(b, "b"), "query_id", "full_outer")
    w = F.when(F.col("s_a").isNull() | F.col("s_b").isNull(), "error").when(F.col("s_a") > F.col("s_b"), "a").when(F.col("s_b") > F.col("s_a"), "b").otherwise("tie")
    g = j.withColumn("w", w).agg(*[F.count_if(F.col("w") == x).alias(n) for x, n in (("a", "wins_a"), ("b", "wins_b"), ("tie", "ties"), ("error", "errors"))], F.round(F.avg("l_a"), 4).alias("latency_a"), F.round(F.avg("l_b"), 4).alias("latency_b"))
    return g.withColumn("winner", F.when(F.col("wins_a") > F.col("wins_b"), "a").when(F.col("wins_b") > F.col("wins_a"), "b").otherwise("tie"))
