"""Keyword scores by document blocks, inverted vector lists, fuzzy words and checked upserts against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import graph as gr, keyword as kw, retrieval as rt, sinks as si, vector_index as vi


def words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def plain_bm25(docs, terms, boosts):
    """docs: id to a dict of fields; terms: query to a dict of weights."""
    out = defaultdict(dict)
    for f, boost in boosts.items():
        own = {d: words(x[f]) for d, x in docs.items() if words(x[f])}
        df = Counter(w for t in own.values() for w in set(t))
        mean = sum(map(len, own.values())) / max(1, len(own))
        for q, weights in terms.items():
            for d, t in own.items():
                tf = Counter(t)
                s = sum(g * math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w, g in weights.items() if w in tf)
                if s:
                    out[q][d] = max(out[q].get(d, 0), s * boost)
    return out


def best(scores, k):
    return [(d, round(s, 6)) for d, s in sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_keyword_and_name_scores(spark, block):
    r = random.Random(7)
    vocabulary = ["the"] * 60 + [f"w{i}" for i in range(80)]
    docs = {f"d{i:03}": {"content": " ".join(r.choices(vocabulary, k=r.randint(0, 60))) if i % 11 else None, "title": " ".join(r.choices(vocabulary, k=3))} for i in range(150)}
    docs["d200"] = {"content": "the " * 9000, "title": ""}
    queries = {f"q{i}": {w: 1.0 for w in {*r.choices(vocabulary, k=20), "unknown"}} for i in range(12)}
    extra = {q: {w: 1.5 for w in r.choices(vocabulary, k=3)} for q in list(queries)[:5]}
    d = spark.createDataFrame([(k, x["content"], x["title"]) for k, x in docs.items()], "chunk_id string, content string, title string").repartition(3)
    rows = lambda t: spark.createDataFrame([(q, w, g) for q, ws in t.items() for w, g in ws.items()], "query_id string, term string, weight double")
    boosts = {"content": 3.0, "title": 2.0}
    got = kw.keyword_top(rows(queries), kw.text_index(d, ["content", "title"]), boosts, 7, 6, rows(extra), "content", 4, block_terms=block).collect()
    found = defaultdict(list)
    for x in sorted(got, key=lambda x: x["rank"]):
        found[x.channel, x.query_id].append((x.chunk_id, x.score))
    base, more = plain_bm25(docs, queries, boosts), plain_bm25(docs, extra, {"content": 1.0})
    for q in queries:
        assert found[0, q] == best(base[q], 7)
        both = {d: s + more[q].get(d, 0) for d, s in base[q].items()} if q in extra else {}
        assert found[1, q] == best(both, 4)


def test_fuzzy_words_and_channel_switches(spark):
    d = spark.createDataFrame([(1, "elephant in the garden", "x"), (2, "elefant garden", "x"), (3, "nothing here", "x")], "chunk_id long, content string, title string")
    q = spark.createDataFrame([("q", "elephant")], "query_id string, query string")
    assert [r.chunk_id for r in rt.keyword_search(q, d, {"content": 1.0}, 5).collect()] == [1]
    fuzzy = {r.chunk_id: r.score for r in rt.keyword_search(q, d, {"content": 1.0}, 5, fuzzy=True).collect()}
    assert set(fuzzy) == {1, 2}
    weights = {r.term: round(r.weight, 4) for r in rt.fuzzy_weights(rt.query_terms(q), kw.text_index(d, ["content"])).collect()}
    assert weights == {"elephant": 1.0, "elefant": round(1 - 2 / 7, 4)}
    asked = q.withColumn("vector", F.lit(None).cast("array<double>"))
    none = spark.createDataFrame([], "chunk_id long, vector array<double>")
    mentions = spark.createDataFrame([(1, "garden"), (2, "elephants")], "document_id long, name string")
    only = rt.search_channels(asked, d, none, mentions, {"content": 1.0}, use=("keyword",))
    assert {r.channel for r in only.collect()} == {"keyword"}
    graph = rt.search_channels(asked, d, none, mentions, {"content": 1.0}, use=("graph",), keep=F.col("chunk_id") == 3)
    wide = rt.search_channels(asked, d, none, mentions, {"content": 1.0}, use=("graph",), keep=F.col("chunk_id") == 3, keep_in_graph=False)
    assert graph.count() == 0 and {r.chunk_id for r in wide.collect()} == {1}
    with pytest.raises(ValueError):
        rt.search_channels(asked, d, none, mentions, {"content": 1.0}, use=("other",))


def test_inverted_lists(spark):
    r = np.random.default_rng(1)
    middle = r.normal(size=(40, 16))
    x = middle[r.integers(0, 40, 4000)] + 0.35 * r.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, [float(y) for y in a]) for i, a in enumerate(x)] + [(9000, None), (9001, [1.0])], "chunk_id long, vector array<double>").repartition(4)
    q = v.where("chunk_id % 50 = 0 AND chunk_id < 9000").select(F.col("chunk_id").cast("string").alias("query_id"), "vector")
    index = vi.vector_index(v)
    assert index.sizes.sum() == 4000 and index.lists.count() == 4000
    as_set = lambda df: {(a.query_id, a.chunk_id) for a in df.collect()}
    exact = as_set(rt.dense_search(q, v, 10, 6))
    for size in (32 << 20, 3000):
        near = as_set(vi.indexed_search(q, index, 10, 400, 6, block_bytes=size))
        assert len(near & exact) >= 0.95 * len(exact) == 0.95 * 800
        assert as_set(vi.indexed_search(q, index, 10, 5000, 6, block_bytes=size)) == exact
    assert sum(len(w) for w in vi.probes(index, x[:50], 400).values()) < 0.3 * 50 * len(index.centroids)  # few lists are read
    small = vi.vector_index(v, sample_rows=500)
    assert len(as_set(vi.indexed_search(q, small, 10, 400, 6)) & exact) >= 0.9 * len(exact)
    empty = vi.vector_index(v.where("chunk_id < 0"))
    assert vi.indexed_search(q, empty).count() == 0 and vi.indexed_search(q.where("query_id = 'no'"), index).count() == 0


def test_names_by_their_rarest_part(spark):
    r = random.Random(3)
    names = ["".join(r.choices("abc", k=r.randint(1, 7))) for _ in range(300)] + ["Abc", "ABC"]
    asked = [(f"q{i % 20}", "".join(r.choices("abcC", k=r.randint(1, 5)))) for i in range(60)]
    for gram in (2, 3):
        got = {(x.query_id, x.name): (x.kind, x.r) for x in gr.name_matches(spark.createDataFrame(asked, "query_id string, word string"), spark.createDataFrame([(n,) for n in set(names)], "name string"), gram=gram).collect()}
        want = {}
        for q in {q for q, _ in asked}:
            own = {w.lower() for k, w in asked if k == q}
            kind = {n: 0 if n.lower() in own else 1 for n in set(names) if n.lower() in own or any(w in n.lower() and len(w) >= gram for w in own)}
            part = sorted(n for n, k in kind.items() if k)[:15]
            rank = sorted([(0, n) for n, k in kind.items() if not k] + [(1, n) for n in part])[:20]
            want |= {(q, n): (k, i) for i, (k, n) in enumerate(rank, 1)}
        assert got == want


def test_checked_upsert(spark):
    base = spark.createDataFrame([(1, 10, 0), (2, 20, 0)], "id long, size long, version long")
    new = spark.createDataFrame([(1, 11, 1), (1, 12, 3), (1, 13, 2), (3, 30, 1), (None, 5, 1), (2, None, 9), (2, -1, 8)] + [(4, i, i) for i in range(500)], "id long, size long, version long").repartition(5)
    rows, errors = si.upserted_checked(base, new, "id", {"size": F.col("size") >= 0}, [F.col("version")])
    assert sorted(map(tuple, rows.collect())) == [(1, 12, 3), (2, 20, 0), (3, 30, 1), (4, 499, 499)]
    assert Counter(r.reason for r in errors.collect()) == {"superseded": 501, "key": 1, "size": 2}
