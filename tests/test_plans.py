"""Registered queries on small fixtures, against figures counted by hand or plain versions."""

import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docmill.operators import fusion as fu, retrieval as rt
from docmill.plans import search_queries as search, views


def run(spark, name, d):
    return entry.queries()[name](spark, str(d)).collect()


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Customers 1 and 2 bought in orders whose keys do not end in 0, customer 3 in one whose key does, customer 4 nothing."""
    d = tmp_path_factory.mktemp("shop")
    tables = {
        "region": ([(0, "R")], "r_regionkey long, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(i, f"c{i}", 0) for i in range(1, 5)], "c_custkey long, c_name string, c_nationkey long"),
        "supplier": ([(1, "s1", 0)], "s_suppkey long, s_name string, s_nationkey long"),
        "part": ([(1, "Brand#11"), (2, "Brand#12"), (3, "Brand#2")], "p_partkey long, p_brand string"),
        "orders": ([(1, 1), (3, 1), (7, 2), (20, 3)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(1, 1, 1), (1, 2, 1), (3, 1, 1), (7, 3, 1), (20, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_every_order_ties_its_customer_to_brands(spark, shop):
    assert [r.id for r in run(spark, "c15_orphans", shop)] == ["Person:4"]
    assert [tuple(r) for r in run(spark, "c8_topic_experts", shop)] == [("Person:1", "c1", 2, 2, 0.3), ("Person:3", "c3", 1, 1, 0.15)]
    # 3 brands of the supplier; 2, 1 and 1 of the customers.
    assert {(r.kind, r.name): r.n for r in run(spark, "d10_graph_statistics", shop)}["edges", "RELATED_TO"] == 7
    assert [tuple(r) for r in run(spark, "l8_delete_orphans", shop)] == [(7, 7)]


def plain_bm25(terms, docs):
    """{document: sum over (term, weight)} in one field of {document: words}."""
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for t, w in terms:
        df = sum(t in ws for ws in docs.values())
        for i, ws in docs.items():
            if n := ws.count(t):
                out[i] = out.get(i, 0) + w * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    return out


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """Query 1 matches 30 texts alike; one of the last names Kafka, which stands beside the query's Spark in a title. Query 2 matches no name."""
    d = tmp_path_factory.mktemp("library")
    texts = [f"note\nspark text number n{i}" for i in range(29)] + ["note\nspark text kafka n29", "Spark Kafka\nother words", "Sparkle Ox\nother words", "Lone\nzeta words"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(900, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label long").write.parquet(f"{d}/embeddings.parquet")
    asked = spark.createDataFrame([("1", "spark?", None), ("2", "zeta", None)], "query_id string, query string, vector array<float>")
    return str(d), dict(enumerate(texts)), asked


def plain_graph_scores(texts, own_terms):
    """Of texts that match the query: its score plus that of the names Spark, Sparkle, Kafka and Ox."""
    words = lambda t: re.findall(r"\w+", t.lower())
    body, title = {i: words(t) for i, t in texts.items()}, {i: words(t.split("\n")[0]) for i, t in texts.items()}
    # The names Spark and Sparkle match; beside them stand Kafka and Ox.
    names = plain_bm25([(n, 1.5) for n in ("spark", "sparkle", "kafka", "ox")], body)
    own, head = plain_bm25([(t, 1.0) for t in own_terms], body), plain_bm25([(t, 1.0) for t in own_terms], title)
    return {i: round(max(3 * own[i], 2 * head.get(i, 0)) + names.get(i, 0), 6) for i in own}


def test_graph_channel_matches_plain_version(spark, library):
    d, texts, asked = library
    score = plain_graph_scores(texts, ["spark"])
    want = [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:10]]
    found = rt.graph_search(asked, rt.graph_names(asked, views.mentions(spark, d)), search.docs_of(spark, d), search.FIELDS, "content", 10, 6)
    got = sorted(found.collect(), key=lambda r: r.rank)
    assert {r.query_id for r in got} == {"1"}
    assert [(r.chunk_id, pytest.approx(r.score, abs=2e-6)) for r in got] == want


def channels_of(spark, library, **more):
    d, _, asked = library
    return rt.search_channels(asked, search.docs_of(spark, d), search.vectors_of(spark, d), views.mentions(spark, d), search.FIELDS, **more)


def test_fusion_holds_what_only_the_graph_finds(spark, library):
    got = {(r.query_id, r.chunk_id): r for r in fu.fused(fu.contributions(channels_of(spark, library))).collect()}
    only = got["1", 29]
    assert only.sources == "graph" and only.score == round(0.8 / (60 + 2), 6)
    assert got["1", 0].sources == "keyword,sparse,graph"


def test_filters_hold_in_all_channels_and_types_route(spark, library):
    kept = channels_of(spark, library, keep=F.col("chunk_id") < 5)
    assert {r.chunk_id for r in kept.collect()} <= set(range(5)) and kept.count() > 0
    _, _, asked = library
    assert {r.channel for r in rt.routed(channels_of(spark, library), asked).where("query_id = '2'").collect()} == {"keyword"}
