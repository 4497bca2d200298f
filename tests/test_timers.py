"""Streams with timers and persistent state against their batch forms: late rows, missing rows, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docmill.streaming import jobs, timers

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def files(spark, path, parts, schema):
    """One file for each part, read one at a time."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield timers.with_state_store(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_sustained_alert_stream_equals_batch(store, tmp_path):
    r = random.Random(1)
    bad = {m for m in range(90) if 10 <= m < 17 or 30 <= m < 32 or 50 <= m < 61 or m == 80}
    rows = [(at(60 * m + r.random() * 59), m in bad and k < 8) for m in range(90) if m not in (70, 71) for k in range(10)]
    parts = [[x for x in rows if 15 * i <= (x[0] - T0).total_seconds() / 60 < 15 * (i + 1)] for i in range(6)]
    schema = "ts timestamp, failed boolean"
    stream = files(store, tmp_path / "in", [*parts, [(at(60 * 600), False)], [(at(60 * 1200), False)], [(at(60 * 1800), False)]], schema)
    minutes = lambda d: jobs.timed(d, wait="2 minutes").groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"))
    firing = F.col("errors") / F.col("n") > 0.5
    evaluations = minutes(stream).select(F.lit("errors").alias("alert"), F.col("w.start").alias("start"), "n", "errors")
    q = run(timers.sustained_alerts(evaluations, firing, 3, 60, 60), "alerts", tmp_path)
    got = store.table("alerts").collect()
    batch = jobs.sustained(minutes(store.createDataFrame(rows, schema)).select(F.col("w.start").alias("start"), "n", "errors"), firing, 3, 60).collect()
    want = sorted((x.start, x.end, x.n) for x in batch)
    assert want == [(at(600), at(960), 7), (at(3000), at(3600), 11)]
    assert sorted((x.start, x.end, x.n) for x in got if x.kind == "resolved") == want
    assert sorted((x.start, x.n) for x in got if x.kind == "firing") == [(at(600), 3), (at(3000), 3)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # nothing is kept of alerts that are over


def test_status_stream_times_out_without_a_row(store, tmp_path):
    steps = [
        [("a", at(0), 1, "processing"), ("b", at(5), 2, "parsing"), ("d", at(6), 3, "processing")],
        [("a", at(100), 4, "embedding"), ("c", at(110), 5, "completed"), ("a", at(50), 6, "parsing")],  # the last one is older than what is known
        [("b", at(200), 7, "chunking"), ("d", at(250), 8, "failed")],
        [("x", at(1000), 9, "processing")],
        [("x", at(1100), 10, "completed"), ("a", at(20), 11, "parsing")],  # later than the watermark: dropped
        [("y", at(3000), 12, "completed")],
        [("z", at(9000), 13, "completed")],
    ]
    schema = "doc string, ts timestamp, event_id long, status string"
    run(timers.status_progress(files(store, tmp_path / "in", steps, schema), "doc", 300), "status", tmp_path)
    got = [(x.doc, x.status, x.percent, x.timed_out) for x in store.table("status").collect()]
    late = {x[0] for x in got if x[3]}
    assert late == {"a", "b"} and len([x for x in got if x[3]]) == 2
    assert ("a", "embedding", 50, True) in got and ("b", "chunking", 30, True) in got
    assert [x[1] for x in got if x[0] == "a" and not x[3]] == ["processing", "embedding"]
    rows = store.createDataFrame([x for s in steps for x in s], schema)
    batch = {x.doc: x.status for x in jobs.latest_status(rows, "doc", "2024-01-01 03:00:00", 300).collect()}
    last = {}
    for doc, status, _, _ in got:
        last[doc] = status
    assert last == batch


def test_contents_once_for_good(spark, tmp_path):
    table = f"seen_{random.randrange(1 << 40)}"
    out = {}
    sink = lambda df, no: out.__setitem__(no, sorted(r.event_id for r in df.collect()))
    once = jobs.once_by_hash(table, sink, buckets=4)
    schema = "event_id long, ts timestamp, hash string"
    batches = [[(1, at(0), "a"), (2, at(1), "a"), (3, at(2), "b"), (4, at(3), None)], [(5, at(90_000), "a"), (6, at(1), "c"), (7, at(2), None)], [(8, at(10**7), "b"), (9, at(10**7), "d")]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    for no, d in enumerate(frames):
        once(d, no)
    want = {0: [1, 3, 4], 1: [6, 7], 2: [9]}
    assert out == want
    out.clear()
    for no in (1, 2, 2):  # a restart runs batches again
        once(frames[no], no)
    assert out == {1: [6, 7], 2: [9]}
    once(spark.createDataFrame([(10, at(0), "d"), (11, at(0), "e")], schema), 3)
    assert out[3] == [11]
    plan = spark.table(table).where("batch < 9").groupBy("hash").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql(f"DROP TABLE {table}")
