"""Reports over documents, searches, audits, costs and evaluations: grouped counts, rates, percentiles, spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import small, staged


def rate(part: Column, whole: Column) -> Column:
    """A share, 0 where there is nothing to share."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def popular(df: DataFrame, key: str, most: int) -> DataFrame:
    """D3: the commonest values; equal counts in the order of the key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def daily(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Counts per day in [start, end)."""
    kept = df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    return kept.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def with_all_days(counts: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each day from start to end, 0 where nothing happened."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def type_shares(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Counts and shares of some kinds among all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 4)).where(F.col(column).isin(kinds))


def missing_counts(df: DataFrame, column: str, missing: str = "none") -> DataFrame:
    """Counts per value with a bucket for nulls, and shares."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 4))


def load_summary(runs: DataFrame) -> DataFrame:
    """(status, chunk_count, entity_count) rows to one summary; totals are of successes only."""
    ok = F.col("status") == "success"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long")
    return runs.agg(
        F.count("*").alias("files"), F.count_if(ok).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        total("chunk_count").alias("chunks"), total("entity_count").alias("entities"), F.round(rate(F.count_if(ok), F.count("*")), 6).alias("success_rate"),
    )


def ranked_percentiles(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99), limit: float | None = None) -> DataFrame:
    """The value at place floor(n * p / 100), the last one at most, of the sorted values; with mean, ends and a verdict.

    Exact: values are counted first, so one that a third of all rows have is one row; the counts are dealt by ranges of
    (keys, value), the ranges' sums tell which of them hold a place, and only those are summed value by value. What meets
    in one task is one sum for each range of a group, or one range's distinct values. Null values count for nothing, null
    keys are a group.
    """
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__x")).agg(F.count("*").alias("__m")), "value-counts")
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("__x").asc()]
    dealt = staged(counts.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "value-ranges")
    sums = [F.sum("__m").alias("__m"), F.sum(F.col("__x").cast("double") * F.col("__m")).alias("__s"), F.min("__x").alias("__low"), F.max("__x").alias("__high")]
    parts = staged(dealt.groupBy(*keys, "__part").agg(*sums), "range-sums")
    w = W.partitionBy(*keys)
    placed = parts.withColumns({"__n": F.sum("__m").over(w), "__before": F.sum("__m").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__m")})
    place = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("__n") * p / 100), F.col("__n") - 1).alias("i")) for p in percents]))
    wanted = placed.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__range"), "__before", "__m", place.alias("__t"))
    wanted = wanted.where((F.col("__t.i") >= F.col("__before")) & (F.col("__t.i") < F.col("__before") + F.col("__m"))).drop("__m")
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"__{other}{i}")) for i, k in enumerate(keys)]
    wanted = wanted.groupBy(*[c for c in wanted.columns if c != "__t"]).agg(F.collect_list("__t").alias("__wanted"))
    near = dealt.join(small(wanted), [*same("k"), F.col("__part") == F.col("__range")])
    near = near.withColumn("__up", F.col("__before") + F.sum("__m").over(W.partitionBy(*keys, "__part").orderBy("__x").rowsBetween(W.unboundedPreceding, 0)))
    hit = near.select(*keys, "__x", "__m", "__up", F.explode("__wanted").alias("__t")).where((F.col("__t.i") < F.col("__up")) & (F.col("__t.i") >= F.col("__up") - F.col("__m")))
    places = hit.groupBy(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)]).agg(*[F.max(F.when(F.col("__t.p") == p, F.col("__x"))).alias(f"p{p}") for p in percents])
    out = parts.groupBy(*keys).agg(F.sum("__m").alias("n"), F.round(F.sum("__s") / F.sum("__m"), 4).alias("avg"), F.min("__low").alias("min"), F.max("__high").alias("max"))
    out = out.join(places, same("p")).select(*keys, "n", "avg", "min", "max", *[f"p{p}" for p in percents])
    return out if limit is None else out.withColumn("passed", F.col("avg") < limit)


def bucket_quantile(buckets: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """(keys, le, n) cumulative-bucket counts to a quantile, linear inside its bucket; le are upper bounds."""
    w = W.partitionBy(*keys).orderBy("le")
    b = buckets.withColumns({"cum": F.sum("n").over(w), "low": F.coalesce(F.lag("le").over(w), F.lit(0.0))}).withColumn("total", F.max("cum").over(W.partitionBy(*keys)))
    hit = b.where((F.col("cum") >= q * F.col("total")) & (F.col("cum") - F.col("n") < q * F.col("total")))
    return hit.select(*keys, F.round(F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - (F.col("cum") - F.col("n"))) / F.col("n"), 6).alias("quantile"))


def error_budget(df: DataFrame, failed: Column, keys: list, objective: float = 0.999) -> DataFrame:
    """Error ratio, availability and the share of the error budget that is spent."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))
    ratio = rate(F.col("errors"), F.col("n"))
    return g.withColumns({"error_ratio": F.round(ratio, 6), "availability": F.round(1 - ratio, 6), "budget_spent": F.round(ratio / (1 - objective), 4)})


def metric_means(samples: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Means of the metrics that are not null, samples that meet all their targets, and whether means do."""
    met = F.lit(True)
    for m, t in targets.items():
        met = met & F.coalesce(F.col(m) >= t, F.lit(True))
    some = F.coalesce(*[F.col(m) for m in targets]).isNotNull()
    out = samples.agg(F.count("*").alias("samples"), F.count_if(met & some).alias("passed"), *[F.round(F.avg(m), 6).alias(m) for m in targets])
    out = out.withColumn("pass_rate", F.round(rate(F.col("passed"), F.col("samples")), 6))
    return out.withColumns({f"{m}_met": F.coalesce(F.col(m) >= t, F.lit(False)) for m, t in targets.items()})


def metric_spread(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Least, largest and mean of each metric."""
    long = samples.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*").where("v is not null")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"), F.round(F.avg("v"), 6).alias("avg"))


def cost_report(log: DataFrame, keys: list[str], price: Column, discount: Column) -> DataFrame:
    """Decimal sums of tokens and cost; a discount is the share of the price that a cache saves."""
    d = "decimal(38,10)"
    cost = (F.col("tokens").cast("decimal(18,2)") * price.cast("decimal(12,6)") / F.lit(1000)).cast(d)
    return log.groupBy(*keys).agg(F.sum("tokens").cast("long").alias("tokens"), F.sum(cost).cast("decimal(38,6)").alias("cost"), F.sum((cost * discount.cast("decimal(12,6)")).cast(d)).cast("decimal(38,6)").alias("saved"), F.count("*").alias("calls"))


def document_outcome(chunks: DataFrame, ok: Column, key: str = "document_id") -> DataFrame:
    """Failed if all chunks of a document failed, else completed."""
    g = chunks.groupBy(key).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return g.withColumn("status", F.when((F.col("succeeded") == 0) & (F.col("failed") > 0), "failed").otherwise("completed"))
