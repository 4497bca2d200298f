"""The BM25 kernel by documents: slices in any memory order, few cells at a time, the same scores and the same best."""

import numpy as np
import pyarrow as pa
import pytest

from docmill.operators import best as bs, keyword as kw


@pytest.mark.parametrize("gains,cached", [(200_000, 400_000), (3, 20), (1, 1)])
def test_slices_score_as_the_whole(gains, cached, monkeypatch):
    monkeypatch.setattr(kw, "GAINS", gains)
    monkeypatch.setattr(kw, "CACHED", cached)
    monkeypatch.setattr(kw, "DENSE", 0.5)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    asked = [(f"q{q}", w, float(rng.random())) for q in range(8) for w in words if rng.random() < 0.4]
    rows = pa.table({"query_id": [a[0] for a in asked], "term": [a[1] for a in asked], "gain": [a[2] for a in asked], "share": pa.array([0.9 if a[1] < "w15" else 0.1 for a in asked])})
    table = kw.Table(rows, pa.array([f"q{q}" for q in range(8)]))
    docs = [[str(w) for w in rng.choice([*words, "x"], n)] for n in (0, 7, 1, 0, 30, 2)]
    weights = table.weights(pa.array(docs, pa.list_(pa.string())), 6.0, 1.2, 0.75)
    got = np.vstack([table.scores(weights, a, b) for a, b in ((0, 1), (1, 4), (4, 6))])
    for d, text in enumerate(docs):
        for q in range(8):
            want = sum(g * text.count(w) * 2.2 / (text.count(w) + 1.2 * (0.25 + 0.75 * len(text) / 6.0)) for name, w, g in asked if name == f"q{q}")
            assert got[d, q] == pytest.approx(want)


def test_best_of_either_memory_order_above_a_bound():
    rng = np.random.default_rng(8)
    score = np.round(rng.normal(size=(5, 200)), 1)
    score[3] = -1.0
    score[4, 3:] = 0.0
    score[0, 7] = np.nan
    ids = np.arange(200)
    plain, turned = bs.Best(5, 6, 6, 0.0), bs.Best(5, 6, 6, 0.0)
    for a in range(0, 200, 40):
        plain.take(score[:, a : a + 40], ids[a : a + 40])
        turned.take(np.asfortranarray(score)[:, a : a + 40], ids[a : a + 40])
    want = {(q, i, score[q, i]) for q in range(5) for i in sorted((i for i in ids if score[q, i] > 0), key=lambda i: (-score[q, i], i))[:6]}
    assert set(zip(*plain.rows(), strict=True)) == set(zip(*turned.rows(), strict=True)) == want


def test_chunks_leave_a_worker_before_a_batch_is_done(spark):
    """a batch's chunks come in several pieces, and are the same as in one; null and empty texts have none."""
    from docmill.operators import chunking as ck

    text = "A sentence of some words stands here. " * 200
    docs = spark.createDataFrame([(i, text + str(i)) for i in range(6)] + [(6, None), (7, "")], "doc_id long, text string").coalesce(1)
    sizes = lambda df: [r.n for r in df.select("chunk_id").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()]
    whole, parts = ck.chunk_corpus(docs), ck.chunk_corpus(docs, held_chars=3000)
    assert parts.orderBy("document_id", "chunk_index").collect() == whole.orderBy("document_id", "chunk_index").collect()
    assert whole.select("document_id").distinct().count() == 6 and sum(sizes(parts)) == whole.count()
    want = [(str(i), n, p.content, p.start, p.end) for i in range(6) for n, p in enumerate(ck.document_chunks(text + str(i), ck.Sizes()))]
    assert sorted(want) == sorted((r.document_id, r.chunk_index, r.content, r.start_char, r.end_char) for r in parts.collect())


@pytest.mark.parametrize("words", [3, 100_000])
def test_sparse_weights_of_frequent_and_rare_words(spark, monkeypatch, words):
    """Words whose df tasks know and words that are shuffled to theirs give the same weights and the same heaviest."""
    from collections import Counter

    from docmill.operators import retrieval as rt

    monkeypatch.setattr(kw, "SMALL_ROWS", words)
    rng = np.random.default_rng(9)
    texts = {i: " ".join(f"w{x}" for x in rng.zipf(1.4, 60) if x < 90) for i in range(40)} | {40: "", 41: None}
    index = kw.text_index(spark.createDataFrame(list(texts.items()), "chunk_id long, content string"), ["content"])
    df = Counter(w for t in texts.values() for w in set((t or "").split()))
    want = set()
    for i, t in texts.items():
        own = Counter((t or "").split())
        weights = sorted((-round(n / own.total() * np.log(42 / df[w]), 6), w) for w, n in own.items())
        want |= {(i, w, -x) for x, w in weights[:7] if -x >= 0.01}
    got = rt.sparse_weights(index, "content", 42, 0.01, 7)
    assert {(r.chunk_id, r.token, pytest.approx(r.weight)) == (r.chunk_id, r.token, r.weight) and (r.chunk_id, r.token, round(r.weight, 6)) for r in got.collect()} == {(i, w, round(x, 6)) for i, w, x in want}
    assert index.term_counts("content", n_docs=42, least=0.01, most=7).count() < index.term_counts("content").count()


def test_highlights_look_only_where_the_term_is(spark):
    """texts without the term skip the fragments' pattern; null stays null, none is an empty array."""
    from docmill.functions import text as tx

    d = spark.createDataFrame([(0, None), (1, ""), (2, "no such word"), (3, "at C++ and c++ end"), (4, "other")], "i long, t string")
    c = tx.highlighted(tx.F.col("t"), "c++")
    assert "CASE WHEN" in d.select(c)._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r.f for r in d.select("i", c.alias("f")).collect()}
    assert got[0] is None and got[1] == got[2] == got[4] == [] and "<em>C++</em>" in got[3][0]


def test_a_pass_over_the_documents_takes_several_blocks(spark, monkeypatch):
    """Queries in many blocks give what one block gives, and the documents are read once a pass, not once a block."""
    from docmill.operators import retrieval as rt

    rng = np.random.default_rng(11)
    texts = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 30) if x < 400)) for i in range(80)] + [(80, ""), (81, None)]
    index = kw.text_index(spark.createDataFrame(texts, "chunk_id long, content string"), ["content"])
    terms = rt.query_terms(spark.createDataFrame([(str(i), t) for i, t in texts if i % 2 == 0], "query_id string, query string")).cache()
    extra = terms.where("query_id < '5'").withColumn("weight", terms["query_id"].cast("double") / 9)
    labels, staged = [], kw.staged
    monkeypatch.setattr(kw, "staged", lambda df, label: (labels.append(label), staged(df, label))[1])
    monkeypatch.setattr(kw, "PASS_BLOCKS", 4)
    monkeypatch.setattr(kw, "COUNTED", 7)
    many = kw.keyword_top(terms, index, {"content": 2.0}, 5, 6, extra, "content", 3, block_terms=100)
    passes, blocks = labels.count("block-best"), -(-(terms.count() + extra.count()) // 100)
    one = kw.keyword_top(terms, index, {"content": 2.0}, 5, 6, extra, "content", 3)
    assert blocks > 4 and passes == -(-blocks // 4)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
