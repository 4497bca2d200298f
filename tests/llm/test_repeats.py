import random

import numpy as np
import pytest

from docmill.llm import phrase_dedup, suffix_dedup
from docmill.llm.suffix_dedup import Suffixes

from . import brute


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["a", "bb", "é", "Ccc", "dd.", "e", "ff"]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(4, 40))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(f"{r.choice(words)}{r.randint(0, 9)}" for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 4))]
        docs.append((i, r.choice([" ", "\n", "  \t"]).join(parts)))
    docs += [(900, None), (901, ""), (902, "   "), (903, docs[5][1]), (904, docs[5][1]), (905, "x " * 500), (906, "short"), (907, "ab" * 300)]
    return docs


@pytest.mark.parametrize("hot", [3000, 2])
def test_phrases_match_brute_force(spark, hot):
    docs = corpus(1)
    d = phrase_dedup.remove_phrases(spark.createDataFrame(docs, "doc_id long, text string"), window=7, gram=3, shard_contexts=20, hot_contexts=hot)
    got = {r.doc_id: (r.phrase_dedup.n_units, r.phrase_dedup.n_removed, r.phrase_dedup.kept_sha256) for r in d.collect()}
    assert got == brute.phrases(docs, 7)


@pytest.mark.parametrize("hot", [20000, 2])
def test_suffixes_match_brute_force(spark, hot):
    docs = corpus(2)
    d = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=20, gram=6, shard_contexts=50, hot_contexts=hot)
    got = {r.doc_id: (r.suffix_dedup.n_units, r.suffix_dedup.n_removed, r.suffix_dedup.n_spans, r.suffix_dedup.kept_sha256) for r in d.collect()}
    assert got == brute.suffixes(docs, 20)


@pytest.mark.parametrize("op, name", [(phrase_dedup.remove_phrases, "phrase_dedup"), (suffix_dedup.remove_repeats, "suffix_dedup")])
def test_nulls_clashes_and_empty_tables(spark, op, name):
    text = "one two three four five six seven eight nine ten " * 8
    rows = [(None, text, 1), (None, text, 1), (7, None, None), (8, "", 2)]
    d = op(spark.createDataFrame(rows, f"doc_id long, text string, {name} int"))
    assert d.columns == ["doc_id", "text", name, f"_{name}"]
    got = sorted((r.doc_id is None, r[f"_{name}"].n_removed > 0) for r in d.collect())
    assert got == [(False, False), (False, False), (True, True), (True, True)]
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order_matches_sorting():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 400).astype(np.uint8)
    start = r.integers(0, 400, 300)
    length = np.minimum(r.integers(0, 60, 300), 400 - start)
    group = r.integers(0, 4, 300)
    s = Suffixes(data, start, length, group)
    key = [(group[i], data[start[i] : start[i] + length[i]].tobytes()) for i in s.order()]
    assert key == sorted(key)
    order, common = s.neighbours(s.order())
    for at in range(1, 300):
        a, b = (data[start[k] : start[k] + length[k]].tobytes() for k in (order[at - 1], order[at]))
        if group[order[at]] == group[order[at - 1]]:
            assert a[: common[at]] == b[: common[at]] and (common[at] == min(len(a), len(b)) or a[common[at]] != b[common[at]])
