"""The pipeline's stages, each against a plain version on its own input, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import toxicity

from . import brute


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    r = random.Random(11)
    words = [a + b for a in ("ta", "re", "lo", "mi", "sun", "ve") for b in ("ner", "ble", "sting", "ran", "ow", "ed")]
    items = [(f"i{i}", " ".join(r.choice(words) for _ in range(14))) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        w = [r.choice(words) for _ in range(r.randint(20, 60))]
        toxic = i % 10 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["idiot", "moron"])
        text = " ".join(w)
        if i % 7 == 1:
            text += "\nAll rights reserved"
        if i % 17 == 3:
            text += " " + items[i % 5][1]
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + k, docs[k * 3 + 2][1] + " extra", "en", None, 10) for k in range(20)]
    docs += [(2000, None, None, "s1", None), (2001, "", "en", "s1", 0), (2002, "ALL rights reserved ", "en", "s1", 20)]
    docs += [(3000 + k, f"All rights reserved\n{r.random()}", "en", "s2", 30) for k in range(3)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_match_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]

    kept = stages["toxicity"](spark, docs, corpus).cache()
    assert kept.columns == columns
    scores = toxicity.score_toxicity(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    assert {d for d, _ in rows(kept)} == {r.doc_id for r in scores.where("toxicity.predicted = 0").collect()}
    bad = {d for d, t in rows(docs) if t and ("idiot" in t or "moron" in t)}
    assert not bad & {d for d, _ in rows(kept)} and len(rows(kept)) == len(rows(docs)) - len(bad)

    before = rows(kept)
    lined = stages["line_dedup"](spark, kept, corpus).cache()
    want = brute.lines(before, 10)
    got = dict(rows(lined))
    assert lined.columns == columns
    for d, t in before:
        if want[d][1] == 0:
            assert got[d] == t
        elif d in got:
            assert brute.sha(got[d].encode()) == want[d][2]
    assert 2002 not in got and 2000 in got and 2001 in got

    before = rows(lined)
    near = stages["near_dedup"](spark, lined, corpus).cache()
    assert near.columns == columns and {d for d, _ in rows(near)} == {d for d, v in brute.near(before, 5, 80).items() if v[2]}

    before = rows(near)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, near, corpus).cache()
    assert clean.columns == columns and {d for d, _ in rows(clean)} == {d for d, v in brute.hits(before, items, 10).items() if not v[4]}

    mixed = stages["mixing"](spark, clean, corpus)
    per = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert mixed.count() == clean.count() and all(abs(r.taken - r.target) <= r.most + 1 for r in per)


def test_run_is_the_stages_in_order(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.count() > 100 and out.where("taken > 3 * size").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_one_row_of_each_group_stays(spark, corpus):
    """Repeated rows, null ids and extra columns; and an empty table through every stage."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, 7)] * 3 + [(2, text + " end", 7), (None, "x " + text[:150], 7), (None, "lone other words stand here", 7), (None, "lone other words stand here", 7), (None, None, 7), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_dup int").repartition(4)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, corpus)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "")[:4]) for r in kept.collect())
    assert got == [("1", "word"), ("9", ""), ("None", ""), ("None", "lone"), ("None", "x wo")]
    empty = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, corpus).count() == 0
