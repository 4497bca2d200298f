import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.operators import best as bs, graph as gr, keyword as kw, retrieval as rt, vector_index as vi


@pytest.mark.parametrize("digits", [None, 1])
def test_best_of_batches_is_the_sorted_whole(digits):
    rng = np.random.default_rng(5)
    score, ids = rng.normal(size=(6, 300)), rng.permutation(300)
    score[1, :295], score[2], score[3, ::2] = -np.inf, 0.25, np.nan
    held = bs.Best(6, 7, digits)
    for at in range(0, 300, 43):
        held.take(score[:, at : at + 43], ids[at : at + 43])
    query, found, value = held.rows()
    whole = score if digits is None else np.round(score, digits)
    for q in range(6):
        want = sorted((-s, i) for s, i in zip(whole[q], ids, strict=True) if s > -np.inf)[:7]
        assert [(-v, i) for v, i in zip(value[query == q], found[query == q], strict=True)] == want


def test_best_keeps_longer_ids_whole():
    held = bs.Best(1, 2)
    held.take(np.array([[1.0]]), np.array(["a"]))
    held.take(np.array([[2.0]]), np.array(["a-longer-one"]))
    assert held.rows()[1].tolist() == ["a-longer-one", "a"]


@pytest.mark.parametrize("dense", [0.0, 0.02, 2.0])
def test_terms_as_columns_or_lists_score_alike(dense, monkeypatch):
    monkeypatch.setattr(kw, "DENSE", dense)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    asked = [(f"q{q}", w, float(rng.random())) for q in range(9) for w in words if rng.random() < (0.9 if w < "w2" else 0.1)]
    rows = pa.table({"query_id": [a[0] for a in asked], "term": [a[1] for a in asked], "gain": [a[2] for a in asked], "share": pa.array([0.5] * len(asked))})
    queries = pa.array([f"q{q}" for q in range(9)])
    table = kw.Table(rows, queries)
    assert table.common == {0.0: len(table.words), 2.0: 0}.get(dense, table.common)
    docs = [[str(w) for w in rng.choice(words, n)] for n in (0, 1, 5, 30)] + [None]
    got = np.zeros((9, 5))
    table.add(got, pa.array(docs), 9.0, 1.2, 0.75)
    for q in range(9):
        for d, text in enumerate(docs):
            want = sum(g * text.count(w) * 2.2 / (text.count(w) + 1.2 * (0.25 + 0.75 * len(text) / 9.0)) for name, w, g in asked if text and name == f"q{q}")
            assert got[q, d] == pytest.approx(want)


def test_neighbours_are_chosen_once_a_node(spark):
    """a hub that many queries name gives three rows a query; a repeated seed takes no neighbour's place."""
    nodes = spark.createDataFrame([(f"n{i:03}", f"name{i:03}") for i in range(60)], "id string, name string")
    edges = spark.createDataFrame([("n000", f"n{i:03}", "RELATED_TO", float(i)) for i in range(1, 60)], "src string, dst string, rel_type string, weight double")
    seeds = spark.createDataFrame([(f"q{q}", "n000") for q in range(30)] * 2, "query_id string, id string")
    got = gr.expanded_names(seeds, nodes, edges)
    assert {tuple(r) for r in got.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("id")), " ")).collect()} == {(f"q{q}", "n000 n057 n058 n059") for q in range(30)}


def unit_rows(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 6))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_indexed_search_is_exact_beyond_its_candidates(spark):
    """more vectors than candidates."""
    x = unit_rows(900, 7)
    x[5], x[6] = 3 * x[5], -0.2 * x[6]  # not all are unit vectors
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, vector array<double>")
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").cast("string").alias("query_id"), "vector")
    got = {(r.query_id, r.chunk_id, r.rank) for r in vi.indexed_search(q, vi.vector_index(v), 8, 60, 6, block_bytes=500, exact=True).collect()}
    want = {(r.query_id, r.chunk_id, r.rank) for r in rt.dense_search(q, v, 8, 6).collect()}
    assert got == want and len(got) == 18 * 8


def test_dense_scores_are_held_in_bounded_pieces(monkeypatch):
    """a task's scores are no more than CELLS, however many queries a block has."""
    seen = []

    class Watched(bs.Best):
        def take(self, score, ids):
            seen.append(score.size)
            super().take(score, ids)

    monkeypatch.setattr(rt, "Best", Watched)
    monkeypatch.setattr(rt, "CELLS", 1000)
    x = unit_rows(300, 8)
    rows = [type("Row", (), {"query_id": str(i), "vector": x[i]})() for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(x.tolist())], names=["chunk_id", "vector"])
    schema = rt.T.StructType([rt.T.StructField(c, rt.T.StringType()) for c in ("query_id", "chunk_id", "score")])
    out = list(rt.best_of(rows, 5, 6, schema)(iter([batch])))
    assert max(seen) <= 1000 and out[0].num_rows == 500 and out[0].column(1)[:1].to_pylist() == [0]


def test_name_matches_of_short_words_and_of_queries_with_many_names(spark):
    """as by hand, with words that most names hold and a query whose own names fill its list."""
    names = sorted({f"{a}{b}{c}" for a in ("in", "an", "Er") for b in "abcdefgh" for c in ("nd", "TH", "x")} | {"in", "IN", "In", "and", "nd"})
    asked = {"short": ["in", "nd", "x", "an"], "full": [n for n in names[:30]] + ["er"], "some": ["in", "INAND", "erax", "anhnd", "hnd"], "none": ["zz", "q"]}
    rows = [(q, w) for q, ws in asked.items() for w in ws]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r.query_id, r["name"], r.kind, r.r) for r in gr.name_matches(spark.createDataFrame(rows, "query_id string, word string"), n, gram=2).collect()}
    want = set()
    for q, ws in asked.items():
        ws = {w.lower() for w in ws}
        same = sorted(x for x in names if x.lower() in ws)
        part = sorted(x for x in names if x not in same and any(len(w) >= 2 and w in x.lower() for w in ws))[:15]
        want |= {(q, x, int(i >= len(same)), i + 1) for i, x in enumerate((same + part)[:20])}
    assert got == want
