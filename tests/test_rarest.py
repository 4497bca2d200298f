"""names with a word of nearly all of them, and hops that are cut before they are shuffled."""

import numpy as np
import pytest

from docmill.operators import graph as gr, keyword as kw, rarest as ra, retrieval as rt, subgraph as sg


@pytest.mark.parametrize("most,k", [(1000, 1), (3, 1), (1000, 4), (0, 2)])
def test_the_rarest_term_first_finds_what_all_documents_give(spark, most, k):
    rng = np.random.default_rng(13)
    names = [(f"id{i}", f"Customer {rng.integers(60)}" + " x" * int(rng.integers(3)) + (" Customer" if i % 9 == 0 else ""), "east" if i % 4 else None) for i in range(150)]
    names += [("a", "MIDDLE EAST", "east"), ("b", "FAR EAST", ""), ("c", "", None), ("d", None, "MIDDLE")]
    index = kw.text_index(spark.createDataFrame(names, "chunk_id string, name string, title string"), ["name", "title"])
    asked = [*[f"Customer {i}" for i in range(0, 60, 7)], "MIDDLE EAST region", "customer", "x x customer", "unknown", "", "east far"]
    terms = rt.query_terms(spark.createDataFrame([(a, a) for a in asked], "query_id string, query string"))
    boosts = {"name": 2.0, "title": 1.5}
    row = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in df.collect())
    assert row(ra.rarest_first(terms, index, boosts, k, 6, most=most)) == row(kw.keyword_top(terms, index, boosts, k, 6))


def test_centres_by_number_meet_few_names(spark, monkeypatch):
    """Every name has one word in common; no query of a known number meets all names."""
    left = []
    monkeypatch.setattr(ra, "keyword_top", lambda terms, *a, **o: left.extend(r.query_id for r in terms.collect()) or kw.keyword_top(terms, *a, **o))
    nodes = spark.createDataFrame([(f"Person:{i}", f"Customer#{i:09d}") for i in range(300)], "id string, name string")
    edges = spark.createDataFrame([(f"Person:{i}", "Person:0", "RELATED_TO", 1.0) for i in range(300)], "src string, dst string, rel_type string, weight double")
    asked = spark.createDataFrame([(f"q{i}", f"Customer#{i:09d}") for i in range(0, 300, 5)] + [("none", "Nobody"), ("part", "omer#00000029")], "query_id string, asked string")
    found = {r.query_id: (r.id, r.found_by) for r in sg.centres(asked, nodes, edges).collect()}
    assert found == {f"q{i}": (f"Person:{i}", "score") for i in range(0, 300, 5)} | {"part": ("Person:290", "part")}
    assert not left


def test_few_strings_overlap_as_many_do(spark, monkeypatch):
    asked = spark.createDataFrame([(w,) for w in ("ALGE", "ALGERIAese", "x", "none of it")], "w string")
    texts = spark.createDataFrame([(w,) for w in ("ALGERIA", "x", "ax", "ALG")], "t string")
    few = sorted(map(tuple, sg.overlapping(asked, texts).collect()))
    monkeypatch.setattr(sg, "FEW", 0)
    assert few == sorted(map(tuple, sg.overlapping(asked, texts).collect())) and ("ALGERIAese", "ALG") in few


def test_hops_look_up_neighbours_of_the_frontier_only(spark, monkeypatch):
    rows, staged = [], gr.staged

    def counted(df, label):
        out = staged(df, label)
        rows.extend(r.node for r in out.collect()) if label == "neighbours" else None
        return out

    monkeypatch.setattr(gr, "staged", counted)
    edges = [("c", f"n{i:03d}") for i in range(40)] * 2 + [(f"n{i:03d}", f"m{j:03d}") for i in range(40) for j in range(60)] + [("far", f"z{j}") for j in range(60)]
    e = spark.createDataFrame([(a, b, "R", 1.0) for a, b in edges], "src string, dst string, rel_type string, weight double")
    got = {(r.centre, r.id, r.hop) for r in gr.k_hop(e, spark.createDataFrame([("c",), ("m000",)], "id string"), 2, 50).collect()}
    hop1 = [f"n{i:03d}" for i in range(40)]
    want = {("c", "c", 0)} | {("c", n, 1) for n in hop1} | {("c", f"m{j:03d}", 2) for j in range(9)}
    want |= {("m000", "m000", 0)} | {("m000", n, 1) for n in hop1} | {("m000", x, 2) for x in ["c", *[f"m{j:03d}" for j in range(1, 9)]]}
    assert got == want
    assert set(rows) == {"c", "m000", *hop1} and max(rows.count(n) for n in set(rows)) <= 50
