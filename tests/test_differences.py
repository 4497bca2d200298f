"""Queries that differed from their SQL on larger tables."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from docmill.plans.stream_queries import A3_SQL
from docmill.sources import readers as rd
from docmill.streaming import jobs


def test_entities_without_semicolon(spark):
    """a title that is cut within an entity."""
    pages = [(1, "<title>this &amp; that&amp</title><p>a &lt; b &copy c</p>"), (2, "<p>&amp;lt; &amp;amp</p>"), (3, "<p>&quot;x&quot&middot</p>")]
    got = {tuple(r) for r in rd.html_texts(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html").collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    assert got == set(db.execute(A3_SQL).fetchall())


def test_percentile_of_large_windows_is_exact(spark):
    """windows of more than 10,000 rows."""
    rng, rows = np.random.default_rng(3), []
    for hour, n in enumerate((20, 19, 40_003, 52_340, 61_111)):
        rows.append((hour, n, float(np.sort(v := np.round(rng.exponential(50, n), 4))[math.ceil(0.95 * n) - 1]), v.tolist()))
    df = spark.createDataFrame([(f"2024-01-01 {h:02}:30:00", v) for h, _, _, v in rows], "t string, v array<double>")
    df = df.select(F.col("t").cast("timestamp").alias("ts"), F.explode("v").alias("value"))
    got = jobs.sliding_errors(df, "1 hour", "1 hour", F.col("value") < 0).orderBy("start").collect()
    assert [(r.n, r.p95) for r in got] == [(n, p) for _, n, p, _ in rows]
