import math
import zlib
from collections import Counter

import numpy as np
import pytest

from docmill.llm import lm


def test_elias_fano_holds_and_finds():
    r = np.random.default_rng(1)
    for top in (10, 5000, 1 << 40):
        x = np.sort(r.integers(0, top, 3000)).astype(np.uint64)
        ef = lm.EliasFano(x, None)
        assert (ef[np.arange(3000)] == x).all()
        q = r.integers(0, top, 500).astype(np.uint64)
        low, high = r.integers(0, 1500, 500), r.integers(1500, 3001, 500)
        want = [lo + np.searchsorted(x[lo:hi], v) for lo, hi, v in zip(low, high, q)]
        assert (ef.successor(low, high, q) == want).all()
    assert lm.EliasFano(np.zeros(0, np.uint64), None).n == 0


def brute(rows, back, prior):
    toks = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, w in toks:
        if not held(i):
            uni.update(w)
            bi.update(zip(["^", *w[:-1]], w))
            tri.update(zip(["^", "^", *w[:-2]], ["^", *w[:-1]], w))
    bi["^", "^"] = uni["^"] = uni[None]  # every text opens with two marks
    n, v = sum(uni.values()) - uni["^"], len([x for x in uni if x != "^"])
    out = []
    for i, w in toks:
        base = [(uni[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        model = [math.log10((tri[g, h, x] + back * bi[h, x] + prior * b) / (bi[g, h] + back * uni[h] + prior)) for g, h, x, b in zip(["^", "^", *w[:-2]], ["^", *w[:-1]], w, base)]
        out.append((held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(model)))
    return out


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def check(d, rows, back=0.001, prior=3.0, field="lm"):
    """Every field of every row; rows with equal id and text have equal figures."""
    want = sorted(zip(rows, brute(rows, back, prior)), key=lambda x: str(x))
    got = sorted((((x.doc_id, x.text), tuple(x[field])) for x in d.collect()), key=lambda x: str(x))
    assert len(got) == len(want)
    for (key, g), (row, w) in zip(got, want):
        assert key == tuple(row) and g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], abs=1e-3 * w[1])


@pytest.mark.parametrize("shard_bytes, block_bytes", [(1 << 30, 1 << 20), (3000, 2000)])
def test_scores_match_brute_force(spark, shard_bytes, block_bytes):
    r = np.random.default_rng(2)
    words = ["the", "a", "É", "Fox", "dog.", "x9"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words, r.integers(0, 60), p=[0.3, 0.1] + [0.6 / 64] * 64))) for i in range(200)] + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "The THE the")]
    d = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=shard_bytes, block_bytes=block_bytes, back=0.2, prior=2.0)
    check(d, rows, 0.2, 2.0)


def test_model_sums_to_one():
    """Over the words of one context, by the trie's own figures."""
    back, prior = 0.3, 2.0
    words = np.arange(1, 6, dtype=np.uint64)
    pairs = np.array([(int(w) - 1) << lm.V_BITS | v for w in words for v in (7, 9)], np.uint64)  # v = 7, 9 before each word
    n_pair = np.arange(1.0, 11)
    triples = np.array([p << lm.U_BITS | 3 for p in range(10)], np.uint64)
    n_triple = n_pair / 2
    n_word = n_pair.reshape(5, 2).sum(1)
    total = n_word.sum()
    base = (n_word + 0.1) / (total + 0.1 * 6)
    t = lm.Trie(words, n_word, pairs, n_pair, triples, n_triple, base, back, prior)
    word = t.find_words(words)
    pair = t.child(t.pairs, t.to_pairs, word, lm.V_BITS, np.full(5, 7, np.uint64))
    triple = t.child(t.triples, t.to_triples, pair, lm.U_BITS, np.full(5, 3, np.uint64))
    mass = (10 ** t.numerators(word, pair, triple, 0.0)).sum() + prior * 0.1 / (total + 0.6)
    assert mass == pytest.approx(n_triple[::2].sum() + back * n_pair[::2].sum() + prior, rel=1e-4)


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, "a b", 1, 2), (None, "a b", 1, 2), (2, None, 3, 2)]
    d = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lm int, __dm_figures int"))
    assert d.columns == ["doc_id", "text", "lm", "__dm_figures", "_lm"]
    check(d, [r[:2] for r in rows], field="_lm")
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_blocks_in_several_partitions(spark):
    """Blocks of equal content stay apart: one row for each partition, with repeats, long texts and long words."""
    long = " ".join(f"w{i % 300}" for i in range(30_000)) + " " + "q" * 100_000
    rows = [(1, "a b a b c"), (1, "a b a b c"), (1, "a b a b c"), (2, "c b a"), (3, long), (3, long), (None, "")]
    table = spark.sparkContext.parallelize(rows, len(rows)).toDF("doc_id long, text string")
    for shard_bytes in (1 << 30, 5_000):
        check(lm.score_texts(table, shard_bytes=shard_bytes), rows)
