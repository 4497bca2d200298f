"""Every operator on one awkward table: clashing names, very long texts and words, nulls, ties, repeated rows, several partitions."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.llm import decontamination, embedding_dedup, line_dedup, lm, minhash, mixing, phrase_dedup, quality, quality_rules, suffix_dedup, toxicity

CLASHES = ["__dm_id", "__dm_th", "__dm_key", "__dm_figures", "__dm_hits", "__dm_ranges", "__dm_held", "__dm_size", "__dm_src", "__dm_hash", "__dm_sub", "__dm_rank", "__dm_plan", "__dm_cid", "id", "th", "text_", "class", "token", "a", "c", "n", "at", "h1", "lid", "did", "y", "held", "batch", "w", "spots", "k_src"]


def awkward():
    r = random.Random(9)
    words = [f"w{i}" for i in range(50)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = [(i, f"{passage} {i % 3}\nsame line\n" + " ".join(r.choice(words) for _ in range(i % 7))) for i in range(12)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (54, "One")] + [(55, passage)] * 3 + [(None, passage), (None, passage), (None, None), (None, "other text here")]
    return rows + [(60, " ".join(r.choice(words) for _ in range(6_000))), (61, "q" * 50_000 + " tail " + "é" * 20_000), (62, "i" * 300 + " d.i.o.t " + "x " * 200)]


SCHEMA = "doc_id long, text string, source string"
ROWS = [(i, t, None if n % 5 == 0 else f"s{n % 2}") for n, (i, t) in enumerate(awkward())]


def labels_of(spark, column):
    return spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (53, None)], f"doc_id long, {column} int").withColumn("id", F.lit(1))


def bench_of(spark):
    return spark.createDataFrame([("b1", ROWS[0][1]), ("b2", "one"), ("b3", None), ("b4", ""), ("b1", ROWS[0][1])], "item_id string, text string")


OPERATORS = {
    "line": lambda s, d: line_dedup.dedup_lines(d, min_docs=4),
    "lm": lambda s, d: lm.score_texts(d, shard_bytes=100_000, block_bytes=30_000),
    "mix": lambda s, d: mixing.mix_sources(d),
    "phrase": lambda s, d: phrase_dedup.remove_phrases(d, window=10, gram=4),
    "bench": lambda s, d: decontamination.find_contamination(d, bench_of(s)),
    "minhash": lambda s, d: minhash.near_duplicates(d, shingle=2),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels_of(s, "toxic")),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d, window=50, gram=20),
    "rules": lambda s, d: quality_rules.clean_lines(d, slice_bytes=20_000),
    "quality": lambda s, d: quality.score_quality(d, labels_of(s, "quality")),
}


def comparable(x):
    return tuple(comparable(v) for v in x) if isinstance(x, (tuple, list)) else round(x, 4) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x


def figures(d, field):
    return sorted((str((r.doc_id, hash(r.text), comparable(tuple(r[field])))) for r in d.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    op = OPERATORS[name]
    plain = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    wide = plain.withColumns({c: F.lit(7) for c in CLASHES}).repartition(6, F.rand(3))
    a, b = op(spark, plain), op(spark, wide)
    assert b.columns[:-1] == wide.columns and a.columns[:-1] == plain.columns
    got, again = figures(a, a.columns[-1]), figures(b, b.columns[-1])
    if name == "mix":  # equal rows share their copies in any way
        assert len(got) == len(again) == len(ROWS) and {(r.source, r.mix.target) for r in a.collect()} == {(r.source, r.mix.target) for r in b.collect()}
    else:
        assert got == again and len(got) == len(ROWS)
    named = wide.withColumn(a.columns[-1], F.lit("taken")).limit(0)
    none = op(spark, named)
    assert none.columns == [*named.columns, f"_{a.columns[-1]}"] and none.count() == 0


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, float("nan")], 1), (6, [1.0, None], 1), (7, [1.0], 1), (8, [1.0, 0.0], None), (9, [], 1), (10, [1.0, 0.0], 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").withColumns({c: F.lit(7) for c in CLASHES}).repartition(5)
    out = embedding_dedup.near_vectors(d)
    got = sorted((r.vec_id or 0, r.near_vec.n_links, r.near_vec.component_id) for r in out.collect() if r.vec_id is None or r.vec_id < 8)
    assert out.columns[:-1] == d.columns
    assert got == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7)]


def test_recall_of_the_shipped_settings(spark):
    """Pairs just above the threshold, at the settings of the query."""
    import numpy as np

    r = np.random.default_rng(8)
    x = r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=(400, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.935 * x + np.sqrt(1 - 0.935**2) * y
    rows = [(i, [float(v) for v in a], 1) for i, a in enumerate(np.concatenate([x, near]))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(4)
    linked = sum(r.near_vec.n_links > 0 for r in embedding_dedup.near_vectors(d).collect())
    assert linked >= 0.98 * 800
