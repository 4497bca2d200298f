"""A table of the last row of each key, kept by batches: small writes, whole snapshots for readers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.operators.storage import staged


class Snapshots:
    """Numbered lists of the folders that make up the table, each published by one rename; readers see all of a batch or none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.hadoop.Path("/".join([self.path, *parts]))

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def numbers(self) -> list[int]:
        return [int(n) for n in self.names("snapshots")]

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/snapshots/{number:020}").first()[0])

    def newest(self) -> dict | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def publish(self, snapshot: dict) -> None:
        """Fails, and changes nothing, if another writer has published this number."""
        draft, final = self.at("drafts", uuid.uuid4().hex), self.at("snapshots", f"{snapshot['number']:020}")
        self.fs.mkdirs(self.at("snapshots"))
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError(f"{final} was written by somebody else")

    def clean(self, keep: int) -> None:
        """Removes all but the newest snapshots, and the folders that no snapshot left holds; folders of failed batches too."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.fs.delete(self.at("snapshots", f"{n:020}"), False)
        held = {folder for n in numbers[-keep:] for parts in self.read(n)["parts"].values() for folder, _ in parts}
        for folder in self.names("rows"):
            if folder not in held:
                self.fs.delete(self.at("rows", folder), True)

    def rows(self, snapshot: dict, buckets: list[str] | None = None) -> DataFrame:
        """All versions of the rows of some buckets, or of all; (bucket) is not a column of theirs."""
        folders = [f"{self.path}/rows/{folder}/bucket={b}" for b in (snapshot["parts"] if buckets is None else buckets) for folder, _ in snapshot["parts"].get(b, [])]
        schema = T.StructType.fromJson(json.loads(snapshot["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def last_rows(df: DataFrame, key: str, order: list[str] | None) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest), F.xxhash64(*rest))).alias("__row")).select(key, "__row.*").select(df.columns)


def upsert_into(path: str, key: str, order: list[str] | None = None, bucket_rows: int = 1_000_000, share: float = 0.5, keep: int = 10) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last row of each key, by the columns of order (all others, if none is given); see latest().

    The table lies in buckets of the key's hash. A batch writes its own rows only, beside what a bucket holds; a bucket
    whose later rows come to more than a share of its first is rewritten, and when the table outgrows bucket_rows a bucket
    the number of buckets doubles and all are. So a row is rewritten a few times in all, whatever the number of batches, and
    no task holds more than a bucket. One snapshot lists what counts; it is published at the end, and the last `keep` stay
    for readers that began earlier. Of rows equal in order any one stays, the same in each run. What is older never replaces
    what is newer, so a batch that is written again, or late, changes no answer. Rows with a null key are one key; a batch
    without rows writes nothing. One writer at a time: a second one fails before it changes anything.
    """

    def write(df: DataFrame, no: int) -> None:
        spark = df.sparkSession
        at = Snapshots(spark, path)
        old = at.newest() or {"number": 0, "buckets": 1, "schema": df.schema.json(), "parts": {}}
        new = staged(last_rows(df, key, order), "upsert")
        n = new.count()
        if not n:
            return
        held, buckets = sum(rows for parts in old["parts"].values() for _, rows in parts), old["buckets"]
        while held + n > buckets * bucket_rows:
            buckets *= 2
        dealt = lambda rows: rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"))
        if buckets != old["buckets"]:
            out, kept = dealt(last_rows(at.rows(old).unionByName(new), key, order)), {}
        else:
            arrived = {r.bucket: r.n for r in dealt(new).groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket
            later = lambda b: arrived[b] + sum(rows for _, rows in old["parts"][b][1:])
            full = [b for b in arrived if b in old["parts"] and later(b) > share * old["parts"][b][0][1]]
            kept = {b: parts for b, parts in old["parts"].items() if b not in full}
            rows = dealt(new)
            out = rows.where(~F.col("bucket").isin(full)) if full else rows
            if full:
                whole = at.rows(old, full).unionByName(rows.where(F.col("bucket").isin(full)).drop("bucket"))
                out = out.unionByName(dealt(last_rows(whole, key, order)))
        folder = uuid.uuid4().hex
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{at.path}/rows/{folder}")
        schema = T.StructType([*df.schema.fields, T.StructField("bucket", T.StringType())])
        written = spark.read.schema(schema).parquet(f"{at.path}/rows/{folder}").groupBy("bucket").agg(F.count("*").alias("n")).collect()
        parts = kept | {r.bucket: [*kept.get(r.bucket, []), [folder, r.n]] for r in written}
        at.publish({"number": old["number"] + 1, "buckets": buckets, "schema": old["schema"], "parts": parts})
        at.clean(keep)

    return write


def latest(spark: SparkSession, path: str, key: str, order: list[str] | None = None) -> DataFrame:
    """The last row of each key of the newest snapshot, whatever is written meanwhile."""
    at = Snapshots(spark, path)
    snapshot = at.newest()
    if snapshot is None:
        raise ValueError(f"nothing was written to {path}")
    return last_rows(at.rows(snapshot), key, order)
