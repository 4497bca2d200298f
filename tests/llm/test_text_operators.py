import random

import numpy as np
import pytest

from docmill.llm import decontamination, line_dedup, minhash, mixing, quality, toxicity
from docmill.llm.common import small

from . import brute


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


def test_lines_match_brute_force(spark):
    r = random.Random(1)
    common = ["Cookie notice", " cookie NOTICE\t", "É share", "é share", "  ", "x"]
    docs = [(i, "\n".join(r.choice(common) if r.random() < 0.5 else f"line {r.randint(0, 300)}" for _ in range(r.randint(0, 6)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n")]
    d = line_dedup.dedup_lines(table(spark, docs), min_docs=4, batches=3)
    assert {x.doc_id: tuple(x.line_dedup)[1:] for x in d.collect()} == brute.lines(docs, 4)


def test_line_edge_cases(spark):
    d = line_dedup.dedup_lines(table(spark, [(None, "a\nb", 1)] * 3 + [(5, "a", 2)], ", line_dedup int"), min_docs=3)
    assert sorted((x.doc_id is None, x._line_dedup.kept_text) for x in d.collect()) == [(False, ""), (True, ""), (True, ""), (True, "")]
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def near_corpus(seed, n=90):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            w = docs[r.randrange(len(docs))][1].split()
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(r.randint(1, 80))]
        docs.append((i, " ".join(w)))
    return docs + [(500, None), (501, ""), (502, "one"), (503, "One"), (504, "  "), (505, docs[0][1].upper())]


@pytest.mark.parametrize("seed, k, crowd", [(1, 2, 64), (2, 5, 2)])
def test_near_duplicates_match_brute_force(spark, seed, k, crowd):
    docs = near_corpus(seed)
    d = minhash.near_duplicates(table(spark, docs), shingle=k, crowd=crowd)
    assert {x.doc_id: tuple(x.near_dup) for x in d.collect()} == brute.near(docs, k, 80)


def test_near_duplicate_edge_cases(spark):
    d = minhash.near_duplicates(table(spark, [(None, "a b c", 1), (4, "a b c", 1), (4, "a b c", 1), (5, None, 1)], ", near_dup int"), shingle=2)
    assert sorted((x.doc_id or 0, x._near_dup.component_id, x._near_dup.kept) for x in d.collect()) == [(0, 4, False), (4, 4, True), (4, 4, True), (5, 5, True)]
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_contamination_matches_brute_force(spark):
    r = random.Random(3)
    words = ["the", "a", "Éa", "x1", "dog", "cat"] + [f"w{i}" for i in range(30)]
    items = [(f"i{i}", " ".join(r.choice(words) for _ in range(r.choice([1, 3, 8, 14])))) for i in range(12)] + [("none", None), ("empty", " . ")]
    docs = [(i, " ".join([*(r.choice(words) for _ in range(r.randint(0, 20))), *r.choice(items[:12])[1].split(), "tail,", *(r.choice(words) for _ in range(5))]).upper()) for i in range(40)] + [(900, None), (901, "")]
    got = decontamination.find_contamination(table(spark, docs), spark.createDataFrame(items, "item_id string, text string"), window=4)
    assert {x.doc_id: (x.contamination.n_words, x.contamination.n_hit, x.contamination.n_items, x.contamination.items_sha256, x.contamination.contaminated) for x in got.collect()} == brute.hits(docs, items, 4)
    none = decontamination.find_contamination(table(spark, docs), spark.createDataFrame([], "item_id string, text string"))
    assert none.where("contamination.contaminated").count() == 0 and none.count() == len(docs)
    assert decontamination.find_contamination(table(spark, []), spark.createDataFrame(items, "item_id string, text string")).count() == 0


def test_mix_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "b", "b", "b", "c", None])) for i in range(3000)] + [(i, "same text here", "b") for i in range(5000, 6500)] + [(9000, None, "d"), (None, "x y", "a"), (None, "x y", "a")]
    d = mixing.mix_sources(table(spark, rows, ", source string")).cache()
    got = d.select("source", "mix.*").toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), biggest=("size", "max"))
    assert (abs(per.taken - per.target) <= per.biggest + 1).all()
    assert per.target.sum() == pytest.approx(per["size"].sum())
    assert per.target["b"] < per["size"]["b"] and mixing.mix_sources(table(spark, [], ", source string")).count() == 0
    again = mixing.mix_sources(table(spark, rows, ", source string").repartition(7)).select("doc_id", "mix.taken").toPandas().sort_values(["doc_id", "taken"])
    assert again.taken.tolist() == d.select("doc_id", "mix.taken").toPandas().sort_values(["doc_id", "taken"]).taken.tolist()


@pytest.fixture(scope="module")
def toxic_corpus():
    r = random.Random(5)
    clean = [a + b for a in ("ta", "re", "lo", "mi", "sun") for b in ("ner", "ble", "sting", "ran", "ow", "ed")]
    bad = ["idiot", "stupid", "moron"]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(clean) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(30)] = r.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    return docs, labels


def test_disguised_words_are_restored_and_scored(spark, toxic_corpus):
    docs, labels = toxic_corpus
    r = random.Random(6)
    disguises = ["1d10t", "stup1d", "stuuuupid", "i d i o t", "m.o.r.o.n", "M0RON!!", "$tup1d", "idiooooot"]
    hard = [(10_000 + k, "taner loow mible sunran taed " * 3 + d + " rener loble " + d + " miow " + d) for k, d in enumerate(disguises)]
    safe = [(20_000, "taner 12 sunran!! loble $$$ rener 4026083977531332 misting|"), (20_001, None), (20_002, ""), (20_003, "a b c rener loble")]
    d = toxicity.score_toxicity(table(spark, docs + hard + safe), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x.toxicity for x in d.collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.98 * len(held)
    assert [x for i, x in hard if not got[i].predicted] == []
    assert [i for i, _ in safe if got[i].predicted] == []
    assert "idiot" in got[10_000].restored


def test_toxicity_edge_cases(spark):
    d = toxicity.score_toxicity(table(spark, [(None, "a", 1), (None, "a", 1)], ", toxicity int"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x._toxicity.score for x in d.collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(table(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_quality_learns_form(spark):
    r = random.Random(7)
    words = [a + b for a in ("ta", "re", "lo", "mi") for b in ("ner", "ble", "sting", "ran")]
    docs, labels = [], []
    for i in range(500):
        w = [r.choice(words) for _ in range(30)]
        good = i % 3 > 0
        docs.append((i, " ".join(w) if good else " | ".join(w[:10])))
        labels.append((i, int(good)))
    d = quality.score_quality(table(spark, docs + [(1000, None), (1001, ""), (None, "x")]), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = [(x.doc_id, x.quality) for x in d.collect()]
    assert all(0 <= q.score <= 1 for _, q in got) and len(got) == 503
    want = dict(labels)
    held = [(q.predicted, want[i]) for i, q in got if i in want and q.held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert quality.score_quality(table(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int")).first().quality.score == 0.5
    assert quality.score_quality(table(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_votes_are_exact_nearest_neighbours():
    r = np.random.default_rng(8)
    x, known = r.standard_normal((20, 6)), r.standard_normal((50, 6))
    x, known = x / np.linalg.norm(x, axis=1, keepdims=True), known / np.linalg.norm(known, axis=1, keepdims=True)
    y = r.integers(0, 2, 50).astype(float)
    for row, got in zip(x, quality.votes(x, known, y, 5, 2.0)):
        near = sorted(range(50), key=lambda k: -(row @ known[k]))[:5]
        w = [max(row @ known[k], 1e-3) ** 2 for k in near]
        assert got == pytest.approx(sum(a * y[k] for a, k in zip(w, near)) / sum(w))


def test_small_only_broadcasts_small_sides(spark):
    assert "broadcast" in small(spark.range(5), 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(spark.range(50), 10)._jdf.queryExecution().logical().toString().lower()
