"""Line deduplication over levelled sorted runs of line hashes.

Each batch of documents becomes a sorted run of (line hash, number of documents), kept as a table bucketed and sorted by
hash, so runs meet bucket by bucket without another shuffle. A new batch first merge-anti-joins the runs: lines that
the runs already hold in enough documents are settled and are not counted again; the rest is added as a run of level 0.
When a level holds `fan_in` runs, they are merged, sorted bucket with sorted bucket, into one run of the next level. At
the end the runs' frequent lines are joined to the documents' lines and dropped. A corpus is cut into batches of
`batch_bytes` of text at most, three at least, by a hash of the texts; `LineRuns` takes arriving batches one by one.

Defined results: a null or empty text is one empty line and stays as it is (a null text becomes empty); lines whose key
is shorter than `min_length` are never dropped; each row counts as one document, repeated rows and null ids included;
texts and lines may be of any length; columns beside id and text pass through unchanged, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, free_name, joined_back, shared_folder, staged, text_key


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE_BYTES) for line in text.lower().split(b"\n")]


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits of hash, as two signed longs."""
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


class LineRuns:
    """The levelled runs: tables of (h1, h2, n_docs), bucketed and sorted by hash, in the shared folder."""

    def __init__(self, min_docs: int, fan_in: int = 4):
        self.min_docs, self.fan_in, self.levels, self.names = min_docs, fan_in, [[]], []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def new_run(self, counts: DataFrame) -> DataFrame:
        self.names.append(sorted_run(counts))
        return counts.sparkSession.table(self.names[-1])

    def close(self, spark: SparkSession) -> None:
        """Takes the runs' names out of the catalogue."""
        while self.names:
            spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()}")

    def add(self, lines: DataFrame) -> None:
        """lines: one row (h1, h2) for each document and distinct line in it."""
        fresh = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        if self.runs():
            fresh = fresh.join(merged(self.runs()).where(F.col("n_docs") >= self.min_docs), ["h1", "h2"], "left_anti")
        self.levels[0].append(self.new_run(fresh))
        self.compact()

    def compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fan_in:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self.new_run(merged(runs)))
                self.levels[level] = []

    def frequent(self) -> DataFrame:
        return merged(self.runs()).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several: sorted buckets are joined with each other, counts of equal hashes added."""
    both = lambda c, a, b: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    n = lambda x: F.coalesce(F.col(f"{x}.n_docs"), F.lit(0))
    same = (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2"))
    return reduce(lambda a, b: a.alias("x").join(b.alias("y"), same, "full_outer").select(both("h1", "x", "y"), both("h2", "x", "y"), (n("x") + n("y")).alias("n_docs")), runs)


def sorted_run(counts: DataFrame) -> str:
    """The name of a bucketed and sorted table of counts, whose files are in the shared folder."""
    spark = counts.sparkSession
    name = f"docmill_line_run_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as counted: each bucket comes from one task
    counts.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_folder(spark)}/docmill/{name}").option("compression", "zstd").saveAsTable(name)
    return name


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_length: int = 1, batches: int | None = None, fan_in: int = 2, batch_bytes: int = 1 << 40
) -> DataFrame:
    """docs with a struct column line_dedup: kept_text, n_lines, n_dropped, kept_sha256."""
    if batches is None:
        batches = max(3, math.ceil((docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) / batch_bytes))
    key, id_type = text_key(F.col(text_col)), docs.schema[id_col].dataType
    line_schema = T.StructType([T.StructField("id", id_type), T.StructField("th", T.LongType()), T.StructField("batch", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def lines_of(batches_):
        for batch in batches_:
            rows, h1, h2 = [], [], []
            texts = pc.fill_null(pc.cast(batch.column(3), pa.binary()), b"")
            for i, text in enumerate(texts.to_pylist()):
                for hashes in {key_hash(k) for k in line_keys(text) if k and (min_length <= 1 or len(k.decode("utf-8", "replace")) >= min_length)}:
                    rows.append(i)
                    h1.append(hashes[0])
                    h2.append(hashes[1])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=line_schema.names)

    batch_no = F.pmod(key, F.lit(batches)).cast("int")
    lines = staged(docs.select(F.col(id_col).alias("id"), key.alias("th"), batch_no.alias("batch"), F.col(text_col).alias("text")).mapInArrow(lines_of, line_schema), "lines", "batch")
    runs = LineRuns(min_docs, fan_in)
    try:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("h1", "h2"))
        frequent = staged(runs.frequent(), "frequent-lines")
    finally:
        runs.close(docs.sparkSession)
    hits = lines.join(frequent, ["h1", "h2"]).groupBy("id", "th").agg(F.collect_set(F.struct("h1", "h2")).alias("hits"))
    inner, name = free_name(docs, "__dm_hits"), free_name(docs, "line_dedup")
    d, f = joined_back(docs, hits, id_col, text_col, "left")
    joined = d.select(*[F.col(c) for c in docs.columns], F.col(f"{f}.hits").alias(inner))
    out = T.StructType([T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, out)])

    def dropped_lines(batches_):
        for batch in batches_:
            texts = pc.fill_null(pc.cast(batch.column(batch.schema.get_field_index(text_col)), pa.binary()), b"")
            kept, lines_, dropped, sha = [], [], [], []
            for text, hit in zip(texts.to_pylist(), batch.column(batch.schema.get_field_index(inner)).to_pylist(), strict=True):
                lines = text.split(b"\n")
                stay = lines
                if hit:
                    gone = {(x["h1"], x["h2"]) for x in hit}
                    stay = [line for line, k in zip(lines, line_keys(text), strict=True) if not k or key_hash(k) not in gone]
                body = b"\n".join(stay)
                kept.append(body.decode())
                lines_.append(len(lines))
                dropped.append(len(lines) - len(stay))
                sha.append(hashlib.sha256(body).hexdigest())
            figures = pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=out.names)
            keep = [i for i, n in enumerate(batch.schema.names) if n != inner]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), figures], names=[*(batch.schema.names[i] for i in keep), name])

    return joined.mapInArrow(dropped_lines, schema)
