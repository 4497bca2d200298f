"""Literal rows for what the synthetic tables cannot show, and invariants."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import files, text as tx
from docmill.operators import analytics as an, chunking as ck, context as cx, evaluation as ev, filters as fl, fusion as fu, graph as gr, quality as qu, ranks as rk, retrieval as rt, sinks as si
from docmill.sources import readers as rd
from docmill.streaming import jobs, latest as lt


def values(spark, rows, f, kind="string"):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in d.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_query_types(spark):
    q = ["쿠버네티스란?", "스프링과 자바의 관계", "spring boot", "how do I set up a cluster with many nodes", "", "  ", "도커를 설명해줘", "what?"]
    assert values(spark, q, tx.query_type) == ["factual", "relational", "keyword", "complex", "complex", "complex", "factual", "complex"]


def test_words_names_and_types(spark):
    assert values(spark, ["스프링은 무엇?", "a b"], tx.query_words) == [["스프링", "스프링은", "무엇"], ["a b"]]
    assert values(spark, ["people", "Org", " framework ", "banana", "Date"], tx.entity_type) == ["Person", "Organization", "Technology", "Concept", "Date"]
    assert values(spark, ["/a", "x", "main.py", "readme.md", "Spark", None, "None"], tx.is_junk_name) == [True, True, True, True, False, True, True]
    assert values(spark, ["AI_Guide_2024_Spring-Cloud", "plan.pdf", "", "서버 설정 the"], tx.title_keywords) == [["AI", "Spring", "Cloud"], [], [], ["서버", "설정"]]


def test_tokens_text_and_json(spark):
    assert values(spark, ["안녕하세요", "one two three", "", None], tx.estimated_tokens) == [1, 3, 0, 0]
    assert values(spark, ['x ```json\n{"a": 1}\n``` y', 'so {"b": {"c": 2}} end'], tx.json_part) == ['{"a": 1}', '{"b": {"c": 2}}']
    assert values(spark, ["the Fox ran and the fox hid"], lambda c: tx.highlighted(c, "fox"))[0][0].count("<em>") >= 1
    assert values(spark, [{"a": 0.05, "b": 0.5, "c": 0.2}], lambda c: tx.pruned_sparse(c, 0.1, 1), "map<string,double>") == [{"b": 0.5}]


def test_file_names_and_addresses(spark):
    assert values(spark, ["../a/b.pdf", "한글 문서.md", "", None, "a?b*c.txt", "가.txt", "n" * 300 + ".pdf"], files.safe_file_name) == ["a_b.pdf", "한글 문서.md", "unnamed_document", "unnamed_document", "a_b_c.txt", "가.txt", "n" * 251 + ".pdf"]
    assert values(spark, ["10.0.0.1", "999.1.1.1", "::1", None], files.is_address) == [True, False, True, False]
    assert values(spark, ['a"b,c', "x", None], si.csv_field) == ['"a""b,c"', "x", ""]


def test_quality_gate(spark):
    good = "word " * 40
    rows = [("ok", good, 52, None), ("few", good, 49, None), ("code", "x" * 40, 20, "code"), ("small", "x" * 20, 30, "table"), ("symbols", "-+ " * 30 + "ab", 60, None), ("rule", "-" * 40, 60, None), ("empty", "  ", 60, None)]
    d = spark.createDataFrame(rows, "k string, content string, token_count int, block_type string")
    got = {r.k: r.why for r in d.select("k", fl.reject_reason(F.col("content"), F.col("token_count"), F.col("block_type")).alias("why")).collect()}
    assert got == {"ok": None, "few": "few_tokens", "code": None, "small": "small_block", "symbols": "symbols", "rule": "noise", "empty": "empty"}


def test_admission_and_order(spark):
    limits = spark.createDataFrame([("pdf", 100), ("md", 10)], "format string, max_bytes long")
    d = fl.admission(spark.createDataFrame([("a", "pdf", 50), ("b", "pdf", 500), ("c", "exe", 5), ("d", "md", 0)], "k string, format string, size long"), limits)
    assert {r.k: r.reason for r in d.collect()} == {"a": None, "b": "too_large", "c": "unsupported", "d": "empty"}
    w = fl.work_order(spark.createDataFrame([("a", "pdf", 1), ("b", "md", 9), ("c", "md", 2)], "k string, ext string, size int"), "ext", "size", "k", {"md": 0, "pdf": 5})
    assert [r.k for r in w.collect()] == ["c", "b", "a"]


def test_sentences_keep_their_ends():
    assert ck.sentence_list("One. Two!\nThree\n\nFour\n# Head") == ["One. ", "Two!\n", "Three\n\n", "Four\n", "# Head"]


def test_chunks_respect_sizes_and_offsets():
    s = ck.Sizes(200, 40, 20, 500)
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    got = ck.pieces(text, s)
    assert len(got) > 3 and all(len(p.content) <= 200 for p in got[:-1])
    assert [p.start for p in got] == sorted(p.start for p in got)
    assert all(p.content == text[p.start : p.end].strip() for p in got[:-1])
    assert all(b.content.startswith(ck.sentence_list(a.content)[-1].strip()) for a, b in zip(got, got[1:-1]))


def test_blocks_stay_whole_and_small_chunks_merge():
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n"
    code = "```py\nprint(1)\n```"
    kinds = [(p.kind, p.content) for p in ck.pieces(f"# Title\n{'Text here. ' * 20}\n{table}\n{code}\n", ck.Sizes())]
    assert ("table", table.strip()) in kinds and ("code", code) in kinds
    parts = [ck.Piece(x * 30, 0, 30) for x in "abc"]
    assert len(ck.merge_small(parts, ck.Sizes())) == 1
    assert ck.pieces("tiny", ck.Sizes()) == [ck.Piece("tiny", 0, 4)] and ck.pieces(" ", ck.Sizes()) == []


def test_sections_drop_the_preface():
    assert ck.sections("intro\n# A\nx\n## B\ny") == [("A", "x"), ("B", "y")]


def test_corpus_ids_are_stable(spark):
    d = spark.createDataFrame([(1, "Hello there. " * 100), (2, None), (3, "")], "doc_id long, text string")
    a, b = ck.chunk_corpus(d), ck.chunk_corpus(d.repartition(3))
    assert sorted(r.chunk_id for r in a.collect()) == sorted(r.chunk_id for r in b.collect())


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, channel string, rank int, chunk_id string")


def test_rrf_scores_ties_and_sources(spark):
    r = ranked(spark, [("q", "vector", 1, "a"), ("q", "vector", 2, "b"), ("q", "keyword", 1, "b"), ("q", "keyword", 2, "a"), ("q", "graph", 1, "c")])
    got = fu.fused(fu.contributions(r)).orderBy("rank").collect()
    assert [x.chunk_id for x in got] == ["a", "b", "c"]
    assert got[0].score == pytest.approx(round(1 / 61 + 1 / 62, 6)) and got[0].source == "vector" and got[1].source == "keyword"
    assert got[2].score == pytest.approx(round(0.8 / 61, 6)) and got[2].sources == "graph"
    assert sorted(fu.fused(fu.contributions(r.repartition(5))).collect()) == sorted(got)


def test_rrf_duplicates_accumulate(spark):
    got = fu.fused(fu.contributions(ranked(spark, [("q", "vector", 1, "a"), ("q", "vector", 3, "a")]))).first()
    assert got.score == pytest.approx(round(1 / 61 + 1 / 63, 6))


@pytest.mark.parametrize("args", [(["a"], [1.0], 0), ([], [], 60), (["a"], [1.0, 2.0], 60), (["a"], [-1.0], 60)])
def test_rrf_refuses(args):
    with pytest.raises(ValueError):
        fu.check_arguments(*args)


def test_rerank_keeps_original_scores(spark):
    d = spark.createDataFrame([("q", "spark joins", "a", "nothing", 1, 0.9), ("q", "spark joins", "b", "joins in spark", 2, 0.5)], "query_id string, query string, chunk_id string, content string, rank int, score double")
    got = fu.reranked(d, 2, fu.overlap_score).orderBy("rerank").collect()
    assert [(r.chunk_id, r.original_score) for r in got] == [("b", 0.5), ("a", 0.9)]
    assert [r.chunk_id for r in fu.reranked(d, 2).orderBy("rerank").collect()] == ["a", "b"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_terms_match_plain_version(spark):
    terms, vocabulary = ["ab", "abcd", "straße", "kitten"], ["ab", "ac", "abcx", "abd", "strasse", "straßen", "sitten", "kittens", "kit"]
    got = rt.fuzzy_terms(spark.createDataFrame([("q", t) for t in terms], "query_id string, term string"), spark.createDataFrame([(v,) for v in vocabulary], "term string"))
    want = {(t, v) for t in terms for v in vocabulary if t[0] == v[0] and edits(t, v) <= (0 if len(t) < 3 else 1 if len(t) <= 5 else 2)}
    assert {(r.term, r.word) for r in got.collect()} == want


def test_metrics_by_hand(spark):
    d = spark.createDataFrame([("what is spark", "spark is fast", ["spark is an engine", "nothing"], "an engine"), ("", "", [], None)], "question string, answer string, contexts array<string>, ground_truth string")
    a, b = ev.answer_metrics(d).collect()
    assert (round(a.faithfulness, 4), round(a.answer_relevancy, 4), a.context_precision, a.context_recall) == (0.6667, 0.6667, 0.5, 1.0)
    assert (b.faithfulness, b.answer_relevancy, b.context_precision, b.context_recall) == (0.0, 0.5, 0.0, None)


def test_percentile_rule(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double")
    r = an.ranked_percentiles(d, ["k"], "v", limit=6.0).first()
    assert (r.p50, r.p95, r.p99, r.passed) == (6.0, 10.0, 10.0, True)


def test_percentiles_of_skewed_groups(spark):
    import random

    r = random.Random(6)
    rows = [("a", float(r.choice([1, 1, 1, 2, r.random() * 100]))) for _ in range(3000)] + [("b", 7.0)] * 500 + [(None, 1.5), (None, 0.5), ("c", None)]
    got = {x.k: (x.n, x.p50, x.p95, x.p99) for x in an.ranked_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v").collect()}
    for k in ("a", "b", None):
        v = sorted(x for y, x in rows if y == k and x is not None)
        assert got[k] == (len(v), *[v[min(len(v) * p // 100, len(v) - 1)] for p in (50, 95, 99)])
    assert set(got) == {"a", "b", None}


def test_ranks_and_rank_precision(spark):
    d = spark.createDataFrame([(i, None if i % 9 == 0 else i % 3) for i in range(200)], "id long, v int")
    want = {i: n for n, (_, i) in enumerate(sorted((-1 if i % 9 == 0 else i % 3, i) for i in range(200)), 1)}
    assert {r.id: r.rank for r in rk.ranked(d, [F.asc("v"), F.asc("id")]).collect()} == want
    names = spark.createDataFrame([(f"k{i:03}", i % 2) for i in range(50)], "id string, v int")
    assert [r.id for r in rk.ranked(names, [F.asc("v"), F.asc("id")]).orderBy("rank").limit(2).collect()] == ["k000", "k002"]
    v = spark.createDataFrame([("q", i, i % 4 == 0) for i in range(1, 51)], "query_id string, rank int, relevant boolean")
    hits = [sum(j % 4 == 0 for j in range(1, i + 1)) / i for i in range(4, 51, 4)]
    assert ev.rank_precision(v, span=8).first().average_precision == round(sum(hits) / len(hits), 6)


def test_highlight_takes_terms_as_written(spark):
    shown = values(spark, ["I like C++ (really) and c++", "x" * 500 + " c++ " + "y" * 500, "nothing", "c+++"], lambda c: tx.highlighted(c, "C++"))
    assert shown[0] == ["I like <em>C++</em> (really) and <em>c++</em>"] and shown[2] == [] and shown[3] == ["<em>c++</em>+"]
    assert len(shown[1][0].replace("<em>", "").replace("</em>", "")) <= 200
    assert values(spark, ["a ( b"], lambda c: tx.highlighted(c, "(")) == [["a <em>(</em> b"]]


def test_dense_search_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(100, None), (101, [1.0])]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(3)
    q = v.where("chunk_id % 7 = 0 or chunk_id >= 100").select(F.col("chunk_id").cast("string").alias("query_id"), "vector")
    want = {(str(i), j): n for i in range(0, 60, 7) for n, j in enumerate(sorted(range(60), key=lambda j: (-round((1 + float(x[i] @ x[j])) / 2, 6), j))[:4], 1)}
    for size in (1 << 20, 100):
        assert {(r.query_id, r.chunk_id): r.rank for r in rt.dense_search(q, v, 4, 6, size).collect()} == want
    assert rt.dense_search(q.where("query_id = 'none'"), v, 4).count() == 0


def test_long_texts_by_sections(spark):
    d = spark.createDataFrame([(1, "# A\none\n# B\ntwo\n# C\nthree"), (2, "x" * 25), (3, "")], "k long, text string")
    got = {(r.k, r.part): (r.title, r.body) for r in rd.split_long(d, "k", "text", 2, 10).collect()}
    assert got[1, 0] == ("(chunk 1)", "one\ntwo") and got[1, 1] == ("(chunk 2)", "three")
    assert [got[2, i][1] for i in range(3)] == ["x" * 10, "x" * 10, "x" * 5] and got[3, 0][1] == ""


def test_parse_batch_isolates_errors(spark):
    rows = [("a", "md", "# T"), ("b", "html", "<p>Hi</p>"), ("c", "ipynb", "{broken"), ("d", "exe", "x"), ("e", "txt", None), ("f", "html", "<br>"), ("g", "ipynb", '{"cells": [{"cell_type": "code", "source": ["a=1"]}]}')]
    out, totals = rd.parse_batch(spark.createDataFrame(rows, "path string, extension string, text string"))
    assert {r.path: r.error for r in out.collect()} == {"a": None, "b": None, "c": "invalid", "d": "unsupported", "e": "unreadable", "f": "empty", "g": None}
    assert tuple(totals.first()) == (7, 3, 4)


def test_budgets(spark):
    d = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate([50, 30, 100], 1)], "query_id string, rank int, content string")
    assert [len(r.content) for r in cx.context_budget(d, 10, 120, 30).orderBy("rank").collect()] == [50, 30, 40]
    assert [len(r.content) for r in cx.context_budget(d, 10, 100, 30).orderBy("rank").collect()] == [50, 30]


def test_context_grades(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    r = spark.createDataFrame([("a", 0.2), ("b", 0.02), ("c", 0.001)], "query_id string, score double")
    assert {x.query_id: x.grade for x in cx.context_quality(q, r).collect()} == {"a": "HIGH", "b": "PARTIAL", "c": "NONE", "d": "NONE"}


def test_k_hop_and_orphans(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string").withColumns({"rel_type": F.lit("X"), "weight": F.lit(1.0)})
    n = spark.createDataFrame([(x,) for x in "abcdz"], "id string")
    assert {(r.id, r.hop) for r in gr.k_hop(e, n.where("id = 'a'"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r.id for r in gr.orphans(n, e).collect()] == ["z"]


def test_checks(spark):
    drift = qu.schema_drift(spark, T._parse_datatype_string("a int, b string"), T._parse_datatype_string("a long, c string"))
    assert {(r.field, r.problem) for r in drift.collect()} == {("a", "type"), ("b", "missing"), ("c", "unexpected")}
    facts = dict(documents=0, chunks=0, entities=0, failed=0, files=0, without_chunks=0, orphans=0, queries=0, answered=0, seconds=0.0)
    checks = qu.load_validation(spark.createDataFrame([tuple(facts.values())], list(facts)))
    assert {r.check: r.level for r in checks.collect()}["failure_rate"] == "SKIP"
    assert tuple(qu.overall(checks).first()) == ("FAIL", False)


def test_files_and_encodings(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    for name, data in {"a.md": "# 제목\nText".encode(), "b.txt": "한글".encode("cp949"), ".git/c.md": b"x", "d.exe": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    assert sorted(r.name for r in rd.discover_files(spark, str(tmp_path)).collect()) == ["a.md", "b.txt"]
    got = {r.path.rsplit("/", 1)[1]: r.text for r in rd.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.md"].startswith("# 제목") and got["b.txt"] == "한글"


def test_markup_readers(spark):
    page = "<html><head><title>no</title></head><body><p>One</p><script>x()</script><b>Two</b> tail</body></html>"
    d = spark.createDataFrame([(1, page, "![pic](a.png) and ![](b.jpg)")], "k long, html string, md string")
    assert rd.html_texts(d, "k", "html").first().text.split("\n")[-3:] == ["One", "Two", "tail"]
    assert [(r.alt, r.target) for r in rd.markdown_images(d, "k", "md").orderBy("pos").collect()] == [("pic", "a.png"), ("", "b.jpg")]
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "a = 1"}, {"cell_type": "code", "source": ""}]})
    r = rd.notebook_texts(spark.createDataFrame([(1, nb)], "k long, body string"), "k", "body").first()
    assert r.n_cells == 2 and "```python\na = 1\n```" in r.text and r.text.startswith("# T\nx")


def test_question_sets_and_vectors(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps(["plain?", {"q": "two?", "gt": "yes"}, {"question": "three?", "answer": "no"}]))
    assert [tuple(r) for r in rd.question_set(spark, str(tmp_path / "q.json")).collect()] == [("plain?", None), ("two?", "yes"), ("three?", "no")]
    (tmp_path / "v.jsonl").write_text('{"chunk_id": "a", "dense_vector": [1.0, 2.0]}\n{"chunk_id": "b"}\n')
    c = spark.createDataFrame([("a", None, "pending"), ("b", None, "pending"), ("c", [0.0], "completed")], "chunk_id string, embedding array<float>, embedding_status string")
    got = {r.chunk_id: r.embedding_status for r in rd.with_vectors(c, rd.imported_vectors(spark, str(tmp_path / "v.jsonl"))).collect()}
    assert got == {"a": "completed", "b": "pending", "c": "completed"}


def events(spark, n=200):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t + dt.timedelta(minutes=7 * i), i % 5, i % 3, "error" if i % 10 == 0 else "view", float(i % 17)) for i in range(n)], "event_id long, ts timestamp, user_id long, k int, event_type string, value double")


@pytest.mark.parametrize("job", [
    lambda d: jobs.tumbling_counts(d, "1 hour", ["event_type"]),
    lambda d: jobs.sliding_errors(d, "2 hours", "1 hour", F.col("event_type") == "error"),
    lambda d: jobs.sessions(d, "user_id", "20 minutes"),
])
def test_streams_equal_batches(spark, tmp_path, job):
    e = events(spark)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = job(stream).writeStream.outputMode("complete").format("memory").queryName("twin").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("twin").collect())) == sorted(map(tuple, job(spark.read.parquet(str(tmp_path / "in"))).collect()))


def test_cache_stream_equals_replay(spark, tmp_path):
    e = events(spark)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.cache_stream(stream, "k", 1800).writeStream.outputMode("append").format("memory").queryName("cache").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    replay = jobs.cache_replay(e, "k", 1800).groupBy("k").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    assert sorted(map(tuple, spark.table("cache").collect())) == sorted(map(tuple, replay.collect()))


def test_ingest_upserts(spark, tmp_path):
    for no, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]]):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.ingest(stream, lambda d: d.where("v <> 'x'"), lt.upsert_into(str(tmp_path / "out"), "id"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.id, r.v) for r in lt.latest(spark, str(tmp_path / "out"), "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_upserts_keep_the_last_row_in_any_order(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "id long, at int, v string")
    write = lt.upsert_into(str(tmp_path / "t"), "id", ["at"], bucket_rows=2)
    write(rows((1, 1, "first"), (1, 2, "last"), (2, 5, "b")), 0)
    write(rows((1, 1, "late"), (3, 1, "c")), 1)
    write(rows((1, 1, "late"), (3, 1, "c")), 1)  # again
    write(rows((9, 9, "x")).where("id < 0"), 2)
    assert sorted((r.id, r.v) for r in lt.latest(spark, str(tmp_path / "t"), "id", ["at"]).collect()) == [(1, "last"), (2, "b"), (3, "c")]


def test_records_from_model_answers(spark):
    from docmill.functions import records

    answer = 'Sure: ```json\n{"entities": [{"name": "Kim", "type": "person"}, {"id": "x", "name": " Spark ", "type": "gadget"}, {"name": ""}], "relationships": [{"source": "e1", "target": "x", "type": "uses"}, {"source": "e1"}]}\n```'
    d = spark.createDataFrame([("d1", answer), ("d2", "no json")], "k string, a string")
    assert {(r.id, r.name, r.type) for r in records.entities(d, "k", "a").collect()} == {("d1:e1", "Kim", "Person"), ("d1:x", "Spark", "Concept")}
    assert [(r.src, r.dst, r.rel_type) for r in records.relationships(d, "k", "a").collect()] == [("d1:e1", "d1:x", "USES")]
    assert {r.k: r.document_type for r in records.metadata(d, "k", "a").collect()} == {"d1": "unknown", "d2": "unknown"}


def test_exports(spark, tmp_path):
    c = spark.createDataFrame([("a", "d", "x", None), ("b", "d", " ", None), ("c", "d", "y", [1.0])], "chunk_id string, document_id string, content string, embedding array<float>")
    si.pending_export(c, str(tmp_path / "out"))
    assert [r.chunk_id for r in spark.read.json(str(tmp_path / "out")).collect()] == ["a"]
    assert [r.line for r in si.report_markdown(c.select("chunk_id", "content").where("chunk_id < 'c'")).collect()] == ["| a | x |", "| b |   |"]
    assert rd.parse_batch(spark.createDataFrame([("p", "x"), ("q", ""), ("r", None)], "path string, text string"))[1].first().failed == 2


def test_registry_is_consistent():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 130
