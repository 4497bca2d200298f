"""The table of last rows by batches, and files in several encodings, against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docmill.sources import readers as rd
from docmill.streaming import latest as lt


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, at int, v string")


def test_many_batches_equal_one_and_buckets_grow(spark, tmp_path):
    rng, path, want, seen = random.Random(2), str(tmp_path / "t"), {}, []
    write = lt.upsert_into(path, "id", ["at"], bucket_rows=20, share=0.5, keep=3)
    for no in range(8):
        rows = [(rng.choice([None, *range(60)]), 10 * no + i, f"{no}-{i}") for i in range(1, 12)]
        write(rows_of(spark, rows), no)
        for i, at, v in rows:
            want[i] = max(want.get(i, (0, "")), (at, v))
        seen.append(lt.Snapshots(spark, path).newest())
        if no % 3 == 2:
            write(rows_of(spark, rows), no)  # run again
        assert {r.id: (r.at, r.v) for r in lt.latest(spark, path, "id", ["at"]).collect()} == want
    buckets = [s["buckets"] for s in seen]
    assert buckets == sorted(buckets) and buckets[0] == 1 and buckets[-1] >= 2
    assert any(len(parts) > 1 for s in seen for parts in s["parts"].values())  # some batches are written beside the rest
    at = lt.Snapshots(spark, path)
    assert len(at.numbers()) == 3
    assert set(at.names("rows")) == {f for n in at.numbers() for parts in at.read(n)["parts"].values() for f, _ in parts}


def test_readers_see_whole_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lt.upsert_into(path, "id", ["at"])
    with pytest.raises(ValueError):
        lt.latest(spark, path, "id")
    write(rows_of(spark, []), 0)
    with pytest.raises(ValueError):
        lt.latest(spark, path, "id")
    write(rows_of(spark, [(1, 1, "a"), (2, 1, "b")]), 1)
    before = lt.latest(spark, path, "id", ["at"])
    write(rows_of(spark, [(1, 2, "c"), (3, 1, "d")]), 2)
    assert sorted(r.v for r in before.collect()) == ["a", "b"]  # began before the second batch
    assert sorted(r.v for r in lt.latest(spark, path, "id", ["at"]).collect()) == ["b", "c", "d"]
    at = lt.Snapshots(spark, path)
    newest = at.newest()
    with pytest.raises(RuntimeError):
        at.publish(newest)  # somebody else's number
    assert at.newest() == newest
    # What a batch that died has left is no part of the table, and goes with the next one.
    rows_of(spark, [(9, 9, "dead")]).write.parquet(f"{path}/rows/dead/bucket=0")
    assert "dead" not in {r.v for r in lt.latest(spark, path, "id", ["at"]).collect()}
    write(rows_of(spark, [(4, 1, "e")]), 3)
    assert "dead" not in at.names("rows")


def test_files_found_and_decoded(spark, tmp_path):
    texts = {"a.md": ("plain", "utf-8"), "b.txt": ("한글 é", "utf-8"), "c.TXT": ("한글 문서", "cp949"), "deep/d.txt": ("똠방각하", "cp949"), "deep/e.txt": ("café\n", "latin-1")}
    for name, (text, encoding) in {**texts, ".git/f.txt": ("x", "utf-8"), "node_modules/g.txt": ("x", "utf-8"), "h.exe": ("x", "utf-8"), "empty.txt": ("", "utf-8")}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(text.encode(encoding))
        os.utime(f, (1_700_000_000, 1_700_000_000))
    found = {r.path.split(str(tmp_path) + "/")[1]: r for r in rd.discover_files(spark, str(tmp_path)).collect()}
    assert set(found) == set(texts)
    assert {(r.name, r.extension, r["size"]) for r in found.values()} == {(n.split("/")[-1], n.split(".")[-1].lower(), len(t.encode(e))) for n, (t, e) in texts.items()}
    assert {r.modified for r in rd.discover_files(spark, str(tmp_path)).select(F.unix_timestamp("modified").alias("modified")).collect()} == {1_700_000_000}
    got = {r.path.split(str(tmp_path) + "/")[1]: r.text for r in rd.read_texts(spark, str(tmp_path)).collect()}
    assert {n: got[n] for n in texts} == {n: t for n, (t, _) in texts.items()}
