"""Upserts, deletes and exports as rewrites of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """L1: new rows replace those of the same key; the last of several new ones should be chosen before."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def validated(new: DataFrame, key: str, rules: dict[str, Column], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """L1: (rows to write, errors): what breaks a rule goes to the errors with the first rule's name as reason.

    rules say what must hold; null counts as broken. A row without a key breaks "key". Of several rows of a key that break
    none the last by order is written, the others are errors with the reason "superseded"; of rows equal in order any one.
    """
    reason = F.when(F.col(key).isNull(), "key")
    for name, holds in rules.items():
        reason = reason.when(~F.coalesce(holds, F.lit(False)), name)
    judged = new.withColumn("reason", reason)
    sound = judged.where(F.col("reason").isNull())
    # The last row of a key is an aggregate, so a key with very many new rows is combined before it is shuffled.
    best = F.max_by(F.struct(*new.columns), F.struct(*order, F.xxhash64(*new.columns))).alias("row")
    last = sound.groupBy(F.col(key).alias("__key")).agg(best, F.count("*").alias("n")).select("row.*", "n")
    older = last.where("n > 1").select(F.col(key).alias("__key"), F.struct(*order, F.xxhash64(*new.columns)).alias("__last"))
    superseded = sound.join(older, F.col(key) == F.col("__key")).where(F.struct(*order, F.xxhash64(*new.columns)) < F.col("__last")).drop("__key", "__last")
    errors = judged.where(F.col("reason").isNotNull()).unionByName(superseded.withColumn("reason", F.lit("superseded")))
    return last.drop("n"), errors


def upserted_checked(base: DataFrame, new: DataFrame, key: str, rules: dict[str, Column], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """L1: base with the sound new rows, and the error rows (all columns of new, reason); broken rows stop nothing."""
    sound, errors = validated(new, key, rules, order)
    return upserted(base, sound, key), errors


def insert_or_update(base: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """L2: rows of base keep the columns `keep`, the others take new values where there are any."""
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns])
    j = base.join(n, F.col(key) == F.col(f"__n_{key}"), "full_outer")
    pick = lambda c: F.coalesce(c, F.col(f"__n_{c}")) if c == key or c in keep else F.coalesce(f"__n_{c}", c)
    return j.select(*[pick(c).alias(c) if f"__n_{c}" in n.columns else F.col(c) for c in base.columns])


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those that go."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are still there."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def status_updated(df: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns take the update's values where they are not null."""
    u = updates.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__u_{c}") for c in columns])
    return df.join(u, F.col(key) == F.col("__k"), "left").withColumns({c: F.coalesce(f"__u_{c}", c) for c in columns}).drop("__k", *[f"__u_{c}" for c in columns])


def exported(chunks: DataFrame, glue: str = "\n\n") -> DataFrame:
    """Each document's chunks in order, as one text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return chunks.groupBy("document_id").agg(F.array_join(ordered, glue).alias("body"), F.count("*").alias("n_chunks"))


def csv_field(c: Column) -> Column:
    """Quoted if it has to be."""
    return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def report_json(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def report_csv(df: DataFrame) -> DataFrame:
    """Report rows as CSV lines (line), in the rows' order of their first column."""
    fields = [csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    return df.orderBy(df.columns[0]).select(F.concat_ws(",", *fields).alias("line"))


def pending_export(chunks: DataFrame, path: str) -> None:
    """A10: the chunks that still need a vector, as JSON lines."""
    from .filters import to_embed

    to_embed(chunks).select("chunk_id", "document_id", "content").write.mode("overwrite").json(path)


def report_markdown(df: DataFrame) -> DataFrame:
    """Report rows as Markdown table lines (line), in the rows' order of their first column."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.orderBy(df.columns[0]).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
