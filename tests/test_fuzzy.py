"""Fuzzy terms on both paths against plain edit distances, and joins that pass no vocabulary through the driver."""

import random

from docmill.operators import keyword as kw, retrieval as rt


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def allowed(term):
    return 0 if len(term) < 3 else 1 if len(term) <= 5 else 2


def tables(spark, words):
    asked = [(str(i % 7), w) for i, w in enumerate(words) if i % 3 == 0]
    return asked, spark.createDataFrame(asked, "query_id string, term string"), spark.createDataFrame([(w,) for w in words], "term string")


def test_fuzzy_terms_of_all_lengths(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abß1é") for _ in range(draw.randint(1, 8))) for _ in range(400)} | {"a" * n for n in range(1, 17)} | {"ab" * n for n in range(1, 9)}
    words = sorted(words | {"b" + "".join(draw.choice("ab") for _ in range(draw.randint(9, 16))) for _ in range(200)} | {""})
    asked, terms, vocabulary = tables(spark, words)
    want = {(q, t, w) for q, t in asked for w in words if t and w and t[0] == w[0] and abs(len(t) - len(w)) <= 2 and edits(t, w) <= allowed(t)}
    got = [tuple(r) for r in rt.fuzzy_terms(terms, vocabulary).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_words_meet_on_rests_that_few_share(spark):
    """Words that share most of their parts, but differ in three places or more, are hardly ever candidates."""
    rests = lambda w: {r.h for r in spark.createDataFrame([(w,)], "w string").selectExpr("w").select(rt.F.explode(rt.variants(rt.F.col("w"), rt.F.lit(2))).alias("h")).collect()}
    assert rests("abcdefgh") & rests("abcxefyh") and not rests("abcdefgh") & rests("abcxyzgh")
    assert len(rests("abcdefgh")) == 1 + 7 + 21


def test_no_vocabulary_is_broadcast(spark):
    _, terms, vocabulary = tables(spark, ["carbon", "carbons", "cab", "internationally"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(rt.fuzzy_terms(terms, vocabulary))
    index = kw.text_index(spark.createDataFrame([("1", "carbon carbons"), ("2", "cab")], "chunk_id string, content string"), ["content"])
    assert plan(kw.term_gains(terms, index, {"content": 1.0})).count("BroadcastExchange") == 1  # a row for each field
