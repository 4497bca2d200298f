"""Mentions by automaton, bounded hops, centres chosen by name, scorers that fail: against plain versions."""

import random
import time
from collections import deque

import pandas as pd
from pyspark.sql import functions as F

from docmill.operators import fusion as fu, graph as gr, retrieval as rt, subgraph as sg


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string").withColumns({"rel_type": F.lit("X"), "weight": F.lit(1.0)})


def plain_hops(pairs, centre, depth, limit):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hop, todo = {centre: 0}, deque([centre])
    while todo:
        a = todo.popleft()
        for b in near.get(a, ()) if hop[a] < depth else ():
            if b not in hop:
                hop[b] = hop[a] + 1
                todo.append(b)
    return {(i, h) for h, i in sorted((h, i) for i, h in hop.items())[:limit]}


def test_bounded_hops_equal_whole_ones(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(70)] + [("hub", f"n{i:02}") for i in range(60)] + [("n00", "n00")]
    centres = spark.createDataFrame([("hub",), ("n07",), ("n07",), ("lone",), (None,)], "id string")
    for depth, limit in [(1, 5), (2, 7), (3, 20), (5, 500)]:
        got = {}
        for r in gr.k_hop(edge_table(spark, pairs), centres, depth, limit).collect():
            got.setdefault(r.centre, []).append((r.id, r.hop))
        assert set(got) == {"hub", "n07", "lone"}
        for centre, rows in got.items():
            assert len(rows) == len(set(rows)) and set(rows) == plain_hops(pairs, centre, depth, limit)


def test_mentions_equal_plain_ones(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abA ") for _ in range(rng.randrange(4)))
    chunks = [(rng.randrange(4), f"c{i}", "".join(rng.choice("abB é") for _ in range(rng.randrange(30)))) for i in range(60)]
    chunks += [(1, "c1", "ab again"), (1, "c1", "ab again"), (None, "x", "ab"), (2, "y", None), (2, None, "ab"), (9, "z", "no names")]
    names = [(rng.randrange(4), word()) for _ in range(30)] + [(3, "É"), (None, "a"), (1, None), (8, "a"), (0, "")]
    c = spark.createDataFrame(chunks, "document_id long, chunk_id string, content string").withColumn("name", F.lit("clash"))
    n = spark.createDataFrame(names, "document_id int, name string").withColumn("chunk_id", F.lit(1))
    want = sorted({(str(i), d, w) for d, i, t in chunks for e, w in names if None not in (d, t, w) and d == e and w.lower() in t.lower()})
    for sizes in [(100, 100), (5, 3)]:  # whole documents; all dealt in parts and blocks
        got = gr.mention_edges(c, n, *sizes)
        assert sorted((str(r.chunk_id), r.document_id, r.name) for r in got.collect()) == want
    assert gr.mention_edges(c.limit(0), n).isEmpty() and gr.mention_edges(c, n.limit(0)).isEmpty()


def test_centres_by_score_part_and_title(spark):
    nodes = spark.createDataFrame([("1", "Apache Spark"), ("2", "Apache Kafka"), ("3", "Kubernetes"), ("4", "Spark"), ("5", ""), ("6", None), ("7", "Kube")], "id string, name string")
    edges = edge_table(spark, [("1", "2"), ("2", "3"), ("7", "1")])  # 4 has no edge, so it is no centre
    asked = spark.createDataFrame([("a", "spark"), ("b", "ubernet"), ("c", "xKubernetesx"), ("d", "quarterly"), ("e", "nothing at all"), ("f", ""), ("g", None), ("h", "spark")], "query_id string, asked string")
    titles = spark.createDataFrame([(12, "quarterly plans"), (11, "quarterly figures"), (13, None)], "document_id long, title string")
    mentions = spark.createDataFrame([(11, "Kube"), (11, "Kubernetes"), (11, "unknown name that is long"), (12, "Apache Spark")], "document_id long, name string")
    got = {r.query_id: (r.id, r.found_by) for r in sg.centres(asked, nodes, edges, titles, mentions).collect()}
    assert got == {"a": ("1", "score"), "h": ("1", "score"), "b": ("3", "part"), "c": ("3", "part"), "d": ("3", "title")}
    assert {r.query_id for r in sg.centres(asked, nodes, edges).collect()} == {"a", "h", "b", "c"}
    near, among = sg.subgraph(asked, nodes, edges, 1, 50)
    assert {(r.id, r.hop) for r in near.where("query_id = 'b'").collect()} == {("3", 0), ("2", 1)}
    assert {(r.a, r.b) for r in among.where("query_id = 'a'").collect()} == {("1", "2"), ("1", "7")}
    assert sg.centres(asked.limit(0), nodes, edges).isEmpty() and sg.centres(asked, nodes.limit(0), edges).isEmpty()


def test_scorers_that_fail_or_are_late_leave_the_order(spark):
    d = spark.createDataFrame([("q", "x", c, c, i, 1.0 / i) for i, c in enumerate("abc", 1)] + [("r", "bad", c, c, i, 1.0 / i) for i, c in enumerate("abc", 1)], "query_id string, query string, chunk_id string, content string, rank int, score double")

    def partly(query: pd.Series, content: pd.Series) -> pd.Series:
        return content.map({"a": 1.0, "b": 2.0, "c": 3.0}).where((query != "bad") | (content != "b"))

    def broken(query: pd.Series, content: pd.Series) -> pd.Series:
        raise RuntimeError("no model")

    def late(query: pd.Series, content: pd.Series) -> pd.Series:
        time.sleep(5)
        return content.map(ord)

    def order(scorer):
        rows = fu.reranked(d, 3, scorer).orderBy("query_id", "rerank").collect()
        return ["".join(r.chunk_id for r in rows if r.query_id == q) for q in "qr"], rows

    assert order(fu.guarded(partly))[0] == ["cba", "abc"]
    for scorer in (fu.guarded(broken), fu.guarded(late, 0.2), fu.guarded(lambda q, c: c.map(ord).head(1))):
        found, rows = order(scorer)
        assert found == ["abc", "abc"] and all(r.score == r.original_score for r in rows)


def test_hits_with_entities_and_counts(spark):
    hits = spark.createDataFrame([("q", "a"), ("r", "a"), ("q", "b")], "query_id string, chunk_id string")
    names = spark.createDataFrame([("a", n) for n in ["Zed", "Ann", "x", "Bob", "Cid", "Dan", "Eve", "Ann"]] + [("c", "Far"), (None, "Nul")], "chunk_id string, name string")
    got = {(r.query_id, r.chunk_id): r.entities for r in rt.with_entities(hits, names).collect()}
    assert got == {("q", "a"): ["Ann", "Bob", "Cid", "Dan", "Eve"], ("r", "a"): ["Ann", "Bob", "Cid", "Dan", "Eve"], ("q", "b"): []}
    assert rt.with_entities(hits.limit(0), names).isEmpty() and rt.with_entities(hits, names.limit(0)).count() == 3
    channels = spark.createDataFrame([("q", "vector"), ("q", "vector"), ("q", "graph"), ("r", "keyword")], "query_id string, channel string")
    assert sorted(tuple(r) for r in rt.channel_counts(channels).collect()) == [("q", 2, 0, 0, 1), ("r", 0, 1, 0, 0)]
