"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a token constraint: the sizes of its documents, times their rates, sum to its target. Among all rates
that meet it, bounded by `most`, the mix takes those closest in relative entropy to the corpus, where a document counts
as its size and as one document of its source's mean size: sum of (size + mean) * (rate * log(rate) - rate) is least.
The solution is a tilt, rate = min(most, exp(lambda * x)) with x = size / (size + mean), so lambda, one number for each
source, is all that is unknown. The convex dual is solved by Newton iterations: each is one aggregation over the cluster
of documents' weighted sums, taken over counts of (source, size), and updates all sources' lambdas; a step that leaves
the bracket around the root is replaced by its middle. Rates become whole copies by systematic rounding: along the
sizes of a source, copies of the first n documents differ from their summed rates by less than one. Rates are rounded
to millionths and summed as whole numbers, so reruns agree whatever the order in which sums were formed.

Ranks within a source are built from counts of (source, size), then of (source, size, hash bucket), so a source that
holds a third of all rows, or one text copied into it many times, is never ordered in one task. Targets are a function
of one row for each source, ordered in one task.

Defined results: null texts and texts without words have size 0, rate 0 and take nothing; texts may be of any length;
null is a source, the last one; repeated rows are rows of their own; rows with null or repeated ids are told apart by
their texts, and rows equal in both share their copies in any way; other columns pass through, whatever their names;
an empty table gives an empty result; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name, staged, text_key

#: Rates are whole millionths; the rounding starts off the simple fractions.
UNIT, OFFSET = 1_000_000, 414_200


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sources (source, source_size, ...), one row each, with target; `most` times a source's size bounds its target."""
    everything = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_room = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    before = F.sum("cap").over(by_room.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")
    behind = F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (total - before) / behind)
    s = s.withColumn("target", F.least(F.col("cap"), F.max("level").over(W.partitionBy()) * F.col("weight")))
    return s.drop("weight", "cap", "level")


def tilt(size: Column, mean: Column) -> Column:
    return size / (size + mean)


def balanced(cells: DataFrame, sources: DataFrame, most: float, iterations: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """sources (source, source_size, mean, least, target) with lambda; cells: (source, size, m) with m documents of a size.

    A source whose target is all that it can give, or nothing, has no lambda. Each iteration is one job; the loop ends
    when every source's constraint holds.
    """
    log_ratio = F.log(F.col("target") / F.col("source_size"))
    # Where the smallest documents are tilted by log_ratio, no rate is nearer to 1; at log(most) all rates are at the bound.
    far = F.when(log_ratio < 0, log_ratio).otherwise(F.log(F.lit(float(most)))) / tilt(F.col("least"), F.col("mean"))
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12))
    state = sources.where(free).select("source", "target", "mean", F.least(far, F.lit(0.0)).alias("low"), F.greatest(far, F.lit(0.0)).alias("high"), (log_ratio * 2).alias("at"))
    state = staged(state.withColumn("at", F.greatest("low", F.least("high", "at"))), "dual")
    for _ in range(iterations):
        rate = F.exp(F.col("at") * tilt(F.col("size"), F.col("mean")))
        words = F.col("m") * F.col("size") * F.least(rate, F.lit(float(most)))
        slope = F.when(rate < most, words * tilt(F.col("size"), F.col("mean"))).otherwise(0.0)
        step = cells.join(state.withColumn("__key", F.col("source")).drop("source"), F.col("source").eqNullSafe(F.col("__key")))
        sums = step.groupBy("source").agg((F.sum(words) - F.first("target")).alias("over"), F.sum(slope).alias("slope"), *[F.first(c).alias(c) for c in ("target", "mean", "low", "high", "at")])
        sums = sums.withColumn("low", F.when(F.col("over") < 0, F.col("at")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("over") >= 0, F.col("at")).otherwise(F.col("high")))
        newton = F.col("at") - F.col("over") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        done = F.abs(F.col("over")) <= F.col("target") * tolerance
        next_ = F.when(done, F.col("at")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        moved = F.abs(next_ - F.col("at")) > F.abs(F.col("at")) * 1e-15
        state = staged(sums.select("source", "target", "mean", "low", "high", next_.alias("at"), (moved & ~done).alias("open")), "dual")
        if state.where("open").isEmpty():
            break
        state = state.drop("open")
    else:
        raise RuntimeError(f"the dual did not settle in {iterations} Newton steps")
    solved = state.select(F.col("source").alias("__key"), F.col("at").alias("lambda"))
    return sources.join(solved, F.col("source").eqNullSafe(F.col("__key")), "left").drop("__key")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, size: Column | None = None
) -> DataFrame:
    """docs with a struct column mix: size, source_size, target, rate, copies, taken."""
    c = {k: free_name(docs, f"__dm_{k}") for k in ("size", "src", "hash", "sub", "key", "rank", "plan")}
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    own = word_count(F.col(text_col)) if size is None else size
    d = docs.withColumns({c["size"]: own, c["src"]: F.col(source_col).cast("string"), c["hash"]: order, c["key"]: text_key(F.col(text_col))})
    # Null ids have one hash; their texts deal them to buckets.
    sub = F.when(F.col(id_col).isNull(), F.concat(F.lit("~"), F.lpad(F.hex(F.pmod(F.col(c["key"]), F.lit(256))), 2, "0"))).otherwise(F.substring(c["hash"], 1, 2))
    d = d.withColumn(c["sub"], sub)
    cells = d.groupBy(F.col(c["src"]).alias("source"), F.col(c["size"]).alias("size"), F.col(c["sub"]).alias("sub")).agg(F.count("*").alias("n"))
    cells = staged(cells, "mix-cells")
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("m"))
    some = F.col("size") > 0
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), (F.sum(F.col("size") * F.col("m")) / F.sum(F.when(some, F.col("m")))).alias("mean"), F.min(F.when(some, F.col("size"))).alias("least"))
    plan = balanced(sizes.where(some), staged(targets(sources, weights, share, most), "mix-targets"), most)
    rated = sizes.join(plan.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rate = F.least(F.lit(float(most)), F.exp(F.col("lambda") * tilt(F.col("size"), F.col("mean"))))
    full = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    millionths = F.when(some, F.round(F.coalesce(rate, full) * UNIT)).otherwise(0).cast("long")
    rated = rated.withColumn("rate", millionths)
    before_size = F.sum(F.col("m") * F.col("rate")).over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)) - F.col("m") * F.col("rate")
    rated = rated.select(F.col("source").alias("r_source"), F.col("size").alias("r_size"), "rate", before_size.alias("skip"), "source_size", "target")
    before_sub = F.sum("n").over(W.partitionBy("source", "size").orderBy("sub").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    skips = cells.withColumn("before", before_sub).join(rated, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")))
    skips = skips.select(F.struct("source", "size", "sub", (F.col("skip") + F.col("before") * F.col("rate")).alias("skip"), "rate", "source_size", "target").alias(c["plan"]))
    at = lambda k: F.col(f"{c['plan']}.{k}")
    d = d.withColumn(c["rank"], F.row_number().over(W.partitionBy(c["src"], c["size"], c["sub"]).orderBy(c["hash"], id_col, c["key"])))
    d = d.join(skips, F.col(c["src"]).eqNullSafe(at("source")) & (F.col(c["size"]) == at("size")) & (F.col(c["sub"]) == at("sub")))
    summed = at("skip") + F.col(c["rank"]) * at("rate") + OFFSET
    whole = lambda x: (x - F.pmod(x, F.lit(UNIT))) / UNIT  # noqa: E731  exact: what is divided is a multiple
    copies = (whole(summed) - whole(summed - at("rate"))).cast("long")
    figures = F.struct(F.col(c["size"]).alias("size"), at("source_size").alias("source_size"), at("target").alias("target"), (at("rate") / UNIT).alias("rate"), copies.alias("copies"), (copies * F.col(c["size"])).alias("taken"))
    return d.select(*[F.col(x) for x in docs.columns], figures.alias(free_name(docs, "mix")))
