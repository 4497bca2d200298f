"""Event-time reports and stateful replays; each function takes a batch or a streaming DataFrame alike unless it says so.

Late rows: minute windows wait for one hour, day windows for one day; later rows are dropped and counted by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmill.operators.ranks import ranked
from docmill.operators.storage import staged


def timed(df: DataFrame, ts: str = "ts", wait: str = "1 day") -> DataFrame:
    """Zoned event time, with a watermark on streams."""
    d = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return d.withWatermark(ts, wait) if df.isStreaming else d


def tumbling_counts(df: DataFrame, width: str, keys: list[str]) -> DataFrame:
    """K2."""
    g = timed(df).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *keys, "n")


def sliding_errors(df: DataFrame, width: str, step: str, failed: Column, value: str = "value") -> DataFrame:
    """Error ratio, 95th percentile, largest value and error-budget spending of sliding windows.

    The percentile is the value of the window at the place n * 0.95, rounded up, exact for any number of rows: a window's
    distinct values are counted, so its state grows with these, not with its rows.
    """
    p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)")
    g = timed(df).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.max(value).alias("slowest"), p95.alias("p95"))
    ratio = F.col("errors") / F.col("n")
    return g.select(F.col("w.start").alias("start"), "n", "errors", F.round(ratio, 6).alias("error_ratio"), F.round(ratio / 0.001, 4).alias("budget_spent"), "slowest", "p95")


def sustained(rows: DataFrame, firing: Column, at_least: int, step_seconds: int) -> DataFrame:
    """K4, batch: runs of evaluations one step apart that fire, if they are long enough: (start, end, n).

    A run starts where the evaluation before does not fire and ends where the next one does not; the runs' starts and
    ends, in order, belong together. Places in that order are found over the cluster.
    """
    no = F.floor(F.unix_timestamp("start").cast("long") / step_seconds).cast("long")
    r = staged(rows.where(firing).select("start", no.alias("no")), "firing")
    beside = lambda step: r.select((F.col("no") + step).alias("no"))
    starts = ranked(r.join(beside(1), "no", "left_anti"), [F.asc("no")], "run")
    ends = ranked(r.join(beside(-1), "no", "left_anti"), [F.asc("no")], "run").select("run", F.col("start").alias("end"), F.col("no").alias("last"))
    return starts.join(ends, "run").select("start", "end", (F.col("last") - F.col("no") + 1).alias("n")).where(F.col("n") >= at_least)


def rates_over(df: DataFrame, width: str, key: str, most: int) -> DataFrame:
    """K5: windows in which a key has more than so many rows."""
    return tumbling_counts(df, width, [key]).where(F.col("n") > most)


def sessions(df: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """K6."""
    g = timed(df).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_by_hash(df: DataFrame, key: str = "hash") -> DataFrame:
    """K7: each content once; on streams within the watermark."""
    d = timed(df)
    if d.isStreaming:
        return d.dropDuplicatesWithinWatermark([key])
    return d.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("ts", "event_id"))).where("r = 1").drop("r")


def once_by_hash(seen_table: str, write: Callable[[DataFrame, int], None], key: str = "hash", order: Sequence[str] = ("ts", "event_id"), buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """K7, unbounded: a foreachBatch function that hands to write only rows whose content no earlier batch has had.

    Hashes that were seen are kept for good in a table bucketed by them, with the number of the batch that brought them:
    a batch meets the table bucket by bucket, the table is not shuffled. A batch that is run again looks at earlier
    batches only, so it finds the same rows and adds nothing that changes an answer; write, given the batch's number, has
    to be as repeatable. Of a content's rows in a batch the first by order counts; rows without a hash always pass.
    """

    def run(df: DataFrame, no: int) -> None:
        spark = df.sparkSession
        first = df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where((F.col("__r") == 1) | F.col(key).isNull()).drop("__r")
        if spark.catalog.tableExists(seen_table):
            known = spark.table(seen_table).where(F.col("batch") < no).select(key)
            first = first.join(known, key, "left_anti")
        new = staged(first, "fresh")
        fresh = new.where(F.col(key).isNotNull()).select(key, F.lit(no).cast("long").alias("batch"))
        fresh.repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(seen_table)
        write(new, no)

    return run


def cache_replay(df: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """K8, batch: is a look-up a hit, the same key having been written within the time to live? A hit does not renew it.

    After a pause longer than the time to live a key starts anew, so its rows are dealt by such runs; pauses are found
    among the first and last times of slots of that length. Rows come sorted by time, and the state is one time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, written = None, 0.0
        for batch in batches:
            hits = []
            for *k, t in zip(batch[key], batch["run"], batch["at"], strict=True):
                hit = k == now and t - written <= ttl_seconds
                if not hit:
                    now, written = k, t
                hits.append(hit)
            yield batch[["event_id", key]].assign(hit=hits)

    d = df.select("event_id", key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("slot", F.floor(F.col("us") / (ttl_seconds * 1_000_000)))
    w = W.partitionBy(key).orderBy("slot")
    slots = d.groupBy(key, "slot").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    fresh = F.coalesce(F.col("first") - F.lag("last").over(w) > ttl_seconds * 1_000_000, F.lit(True))
    runs = slots.withColumn("fresh", fresh.cast("int")).select(F.col(key).alias("__k"), F.col("slot").alias("__s"), F.sum("fresh").over(W.partitionBy(key).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)).alias("run"))
    d = d.join(runs, F.col(key).eqNullSafe(F.col("__k")) & (F.col("slot") == F.col("__s"))).withColumn("at", F.col("us") / 1e6)
    ordered = d.repartition(key, "run").sortWithinPartitions(key, "run", "us", "event_id").select("event_id", key, "run", "at")
    return ordered.mapInPandas(run, f"event_id long, {key} {df.schema[key].dataType.simpleString()}, hit boolean")


def cache_stream(df: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """K8, stream: (key, hits, misses) per batch, with the last write as state."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        written = state.get[0] if state.exists else None
        hits = misses = 0
        for t in sorted(t for b in batches for t in b["at"]):
            if written is not None and t - written <= ttl_seconds:
                hits += 1
            else:
                written, misses = t, misses + 1
        state.update((written,))
        yield pd.DataFrame({key: [k[0]], "hits": [hits], "misses": [misses]})

    kind = df.schema[key].dataType.simpleString()
    d = df.select(key, F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at")).withColumn("at", F.col("at") / 1e6)
    return d.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, hits long, misses long", "written double", "append", GroupStateTimeout.NoTimeout)


# How far a document is at each stage, in percent.
PROGRESS = {"processing": 5, "parsing": 10, "chunking": 30, "embedding": 50, "storing": 70, "extracting": 85, "completed": 100}


def latest_status(df: DataFrame, key: str, as_of: str | None = None, timeout_seconds: int = 300) -> DataFrame:
    """K9: the last status per document, its percentage, and whether it has been silent for too long."""
    pct = F.element_at(F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv]), F.col("status"))
    g = df.groupBy(key).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))
    open_ = ~F.col("status").isin("completed", "failed")
    late = open_ & (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")) > timeout_seconds) if as_of else F.lit(False)
    return g.select(key, "status", F.coalesce(pct, F.lit(0)).alias("percent"), late.alias("timed_out"))


def ingest(stream: DataFrame, step: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs step on each batch of pending rows and hands the result to write, once for each batch number."""
    return stream.writeStream.foreachBatch(lambda df, no: write(step(df), no)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
