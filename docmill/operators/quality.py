"""Checks of what was loaded: reconciliation of stores, constraints, schema drift, graded load validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reconciled(left: DataFrame, right: DataFrame, key: str = "document_id") -> DataFrame:
    """Two tables of (key, n) to what only one has and where counts differ."""
    j = left.select(key, F.col("n").alias("n_left")).join(right.select(key, F.col("n").alias("n_right")), key, "full_outer")
    kind = F.when(F.col("n_right").isNull(), "only_left").when(F.col("n_left").isNull(), "only_right").when(F.col("n_left") != F.col("n_right"), "count_differs").otherwise("same")
    return j.withColumns({"kind": kind, "diff": F.coalesce("n_left", F.lit(0)) - F.coalesce("n_right", F.lit(0))})


def consistency(rows: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return rows.agg(*[count(k) for k in ("only_left", "only_right", "count_differs", "same")]).withColumn("consistent", (F.col("only_left") + F.col("only_right") + F.col("count_differs")) == 0)


def duplicate_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many key values occur more than once."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def broken_rows(df: DataFrame, broken: Column, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.count_if(broken).alias("violations"))


def schema_drift(spark, expected: T.StructType, actual: T.StructType) -> DataFrame:
    """Fields that are missing, unexpected or of another type."""
    e, a = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (expected, actual))
    rows = [(n, e.get(n), a.get(n), "missing" if n not in a else "unexpected" if n not in e else "type") for n in sorted(e.keys() | a.keys()) if e.get(n) != a.get(n)]
    return spark.createDataFrame(rows, "field string, expected string, actual string, problem string")


# The checks of a load, with the bounds of PASS and WARNING.
CHECKS = {"documents": (10, 5), "failure_rate": (0.1, 0.3), "without_chunks": (0.0, 0.05), "orphan_rate": (0.01, 0.05), "sample_queries": (1.0, 0.0), "seconds_per_file": (60.0, None), "entities": (5, None)}


def at_least(value: Column, good: float, fair: float | None) -> Column:
    return F.when(value.isNull(), "SKIP").when(value >= good, "PASS").when(F.lit(True) if fair is None else value >= fair, "WARNING").otherwise("FAIL")


def at_most(value: Column, good: float, fair: float | None, strict: bool = False) -> Column:
    under = (lambda b: value < b) if strict else (lambda b: value <= b)
    return F.when(value.isNull(), "SKIP").when(under(good), "PASS").when(F.lit(True) if fair is None else under(fair), "WARNING").otherwise("FAIL")


def load_validation(facts: DataFrame) -> DataFrame:
    """One row of facts to graded checks (check, value, level).

    facts: documents, chunks, entities, failed, files, without_chunks, orphans, queries, answered, seconds; a
    denominator of 0 skips its check.
    """
    c = F.col
    share = lambda a, b: F.try_divide(c(a).cast("double"), c(b))
    mean = share("chunks", "documents")
    some = share("answered", "queries")
    checks = {
        "documents": (c("documents").cast("double"), at_least(c("documents"), *CHECKS["documents"])),
        "chunks": (c("chunks").cast("double"), F.when(c("chunks") >= 2 * c("documents"), "PASS").when(c("chunks") > 0, "WARNING").otherwise("FAIL")),
        "entities": (c("entities").cast("double"), at_least(c("entities"), *CHECKS["entities"])),
        "mean_chunks": (mean, F.when(mean.isNull(), "SKIP").when(mean.between(2, 100), "PASS").otherwise("WARNING")),
        "failure_rate": (share("failed", "files"), at_most(share("failed", "files"), *CHECKS["failure_rate"], strict=True)),
        "seconds_per_file": (share("seconds", "files"), at_most(share("seconds", "files"), *CHECKS["seconds_per_file"], strict=True)),
        "without_chunks": (share("without_chunks", "documents"), at_most(share("without_chunks", "documents"), *CHECKS["without_chunks"])),
        "sample_queries": (some, F.when(some.isNull(), "SKIP").when(some >= 1, "PASS").when(some > 0, "WARNING").otherwise("FAIL")),
        "orphan_rate": (share("orphans", "entities"), at_most(share("orphans", "entities"), *CHECKS["orphan_rate"])),
    }
    rows = [F.struct(F.lit(k).alias("check"), F.round(v, 6).alias("value"), level.alias("level")) for k, (v, level) in checks.items()]
    return facts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def overall(checks: DataFrame) -> DataFrame:
    """The worst level, and whether the load is valid: no check fails."""
    severity = F.max(F.when(F.col("level") == "FAIL", 2).when(F.col("level") == "WARNING", 1).otherwise(0)).alias("s")
    return checks.agg(severity).select(F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), F.col("s") + 1).alias("overall"), (F.col("s") < 2).alias("is_valid"))
