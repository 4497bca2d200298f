"""Large groups of near copies: crowds, blocks and short lists must find what brute force finds."""

import random

import numpy as np
import pytest

from docmill.llm import minhash

from . import brute


def edited(seed, n, most, length=60):
    """n edits of one text, many of them just below the threshold from each other."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(length)] = r.choice(words)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("crowd, block, shingles", [(4, 8, 400_000), (2, 1024, 300), (64, 1024, 400_000)])
def test_group_of_near_copies(spark, crowd, block, shingles):
    docs = edited(3, 120, 9) + [(1000 + i, t) for i, t in edited(4, 30, 12)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    d = minhash.near_duplicates(table, shingle=2, crowd=crowd, block=block, block_shingles=shingles)
    assert {x.doc_id: tuple(x.near_dup) for x in d.collect()} == brute.near(docs, 2, 80)


def test_clashing_columns_long_texts_and_repeated_rows(spark):
    long = " ".join(f"x{i % 5000}y{i % 977}" for i in range(60_000))
    rows = [(1, long, 7, 7, 7), (2, long + " tail", 7, 7, 7), (3, "z" * 200_000 + " b", 7, 7, 7), (3, "z" * 200_000 + " b", 7, 7, 7), (None, None, 7, 7, 7), (None, long, 7, 7, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __dm_id int, __dm_key int, __dm_figures int").repartition(4)
    got = sorted(((x.doc_id or 0, tuple(x.near_dup)[1:]) for x in minhash.near_duplicates(table, shingle=2).collect()), key=str)
    assert got == [(0, (1, False)), (0, (None, True)), (1, (1, True)), (2, (1, False)), (3, (3, True)), (3, (3, True))]


def test_recall_at_the_threshold():
    """Measured, not computed: pairs of similarity 0.8 to 0.85 that share a prefix posting and enough collisions."""
    r = np.random.default_rng(5)
    k, pairs = 64, 400
    need = minhash.least_matches(k, 0.8)
    found = 0
    for _ in range(pairs):
        both, each = 160, 20  # 160 of 200: similarity 0.8
        x = r.integers(0, 1 << 63, both + 2 * each).astype(np.uint64)
        h = np.concatenate([np.sort(x[: both + each]), np.sort(np.concatenate([x[:both], x[both + each :]]))])
        sig = minhash.signatures(np.repeat([0, 1], both + each), h, 2, k)
        found += minhash.collisions(sig[:1], sig[1:])[0, 0] >= need
    assert found / pairs >= 0.99


def test_overlaps_and_labels():
    x = [np.array([1, 2, 3], np.uint64), np.array([5], np.uint64)]
    y = [np.array([2, 3, 4, 9], np.uint64), np.array([7], np.uint64), np.array([5, 6], np.uint64)]
    assert minhash.overlaps(x, y, step=2).tolist() == [[2, 0, 0], [0, 0, 1]]
    a, b = minhash.joined_labels(np.array([1, 1, 2, 2]), np.array([2, 3, 3, 3]))
    assert len(a) == 2 and {*a, *b} == {1, 2, 3}
