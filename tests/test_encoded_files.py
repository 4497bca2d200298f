"""files that a worker decodes whole are of bounded length, and no line is lost at the end of one."""

import hashlib
from collections import Counter

from docmill.plans import file_queries as fq


def test_lines_of_many_small_files(spark, tmp_path, monkeypatch):
    texts = ["one\n\ntwo\n", "\n\n\n", "", "last", "a\nb\n\n", "x\n\n"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((i % 2, hashlib.sha256(line.encode()).hexdigest()) for i, t in enumerate(texts * 2) for line in ("é" + t).split("\n"))
    lengths, read = [], fq.rd.read_texts

    def watched(session, path):
        t = read(session, path)
        lengths.extend(r.n for r in t.selectExpr("size(split(text, '\n')) - 1 AS n").collect())
        return t

    monkeypatch.setattr(fq.rd, "read_texts", watched)
    for lines in (1, 2, 50_000):
        monkeypatch.setattr(fq, "LINES_PER_FILE", lines)
        lengths.clear()
        assert {(r.odd, r.line_hash): r.n for r in fq.a2_other(spark, str(tmp_path)).collect()} == want
        assert max(lengths) <= lines
