"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on random directions and the projections quantised; several such quanta make a bucket
of a table, and vectors that share a bucket in any table are compared by exact cosine in double precision, in blocks.
At cosine c the distance is sqrt(2 - 2c), for which the chance of a shared quantum is known; the number of quanta per
table follows from the largest label's size, so unrelated vectors rarely meet, and the number of tables from the
recall wanted at the threshold.

A pair that meets in several tables counts in the first of them only, which each block sees from its rows' buckets in
the earlier tables. Equal vectors are one class with a multiplicity; buckets with many classes are cut into blocks, and
pairs of blocks are tasks of their own. Blocks return figures per vector and one link per vector towards its local
component, never their pairs.

Defined results: null labels, null, empty or zero vectors and vectors with null, NaN or infinite components link with
nothing; vectors of different lengths are not compared; repeated rows link with each other; rows with a null id take
part, and name their component only if it has no other id; other columns pass through, whatever their names; an empty
table gives an empty result. Links are counted one by one, as the result asks for their number, so a label of n vectors
that are all near each other costs n * n products, in blocks; its links are never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged
from .graph import components


def meeting_chance(distance: float, width: float) -> float:
    """Chance that two points at this distance share a quantum of this width on a random Gaussian direction."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(largest: int, threshold: float, recall: float, width: float = 1.5, apart: float = 1.3) -> tuple[int, int]:
    """Quanta per table and number of tables."""
    near, far = meeting_chance(math.sqrt(2 - 2 * threshold), width), meeting_chance(apart, width)
    quanta = max(4, math.ceil(math.log(3 * max(largest, 2)) / -math.log(far)))
    return quanta, math.ceil(math.log(1 - recall) / math.log(1 - near**quanta))


def buckets(x: np.ndarray, quanta: int, tables: int, width: float, seed: int = 7) -> np.ndarray:
    """(rows, tables) 32-bit bucket numbers of normalised vectors."""
    r = np.random.default_rng([seed, x.shape[1]])
    directions, shift = r.standard_normal((x.shape[1], tables * quanta)), r.uniform(0, width, tables * quanta)
    q = np.floor((x @ directions + shift) / width).astype(np.int64).reshape(len(x), tables, quanta)
    h = np.zeros((len(x), tables), np.uint64)
    for i in range(quanta):
        h = (h ^ q[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32)


def normalised(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def local_components(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric adjacency the least row it reaches."""
    at = np.arange(len(linked))
    while True:
        now = np.where(linked, at[None, :], len(linked)).min(1, initial=len(linked))
        now = np.minimum(at, now)
        now = np.minimum(now, now[now])
        if (now == at).all():
            return at
        at = now


def compare(threshold: float, tables: int):
    """For one block, or two, of a bucket: per class its links first met here, and a link to its local component."""

    def run(group: pa.Table) -> pa.Table:
        t, half = group.column("t")[0].as_py(), group.column("half").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, tables)[:, :t]
        out = {k: np.zeros(0, np.int64) for k in ("cid", "root", "n")}
        if len(sig) > 1 and not (t and (sig == sig[0]).all(0).any()):  # else all have met in an earlier table
            x, cid = normalised(group.column("v").combine_chunks()), group.column("cid").to_numpy()
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if group.column("i")[0] != group.column("j")[0]:  # two blocks: pairs within a block belong to its own task
                linked &= half[:, None] != half[None, :]
            for k in range(t):
                if linked.any():
                    linked &= sig[:, k][:, None] != sig[:, k][None, :]
            rows = np.flatnonzero(linked.any(1))
            linked = linked[np.ix_(rows, rows)]
            weight = group.column("copies").to_numpy()[rows]
            out = {"cid": cid[rows], "root": cid[rows][local_components(linked)] if len(rows) else cid[:0], "n": linked @ weight if len(rows) else cid[:0]}
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in out.items()})

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.995, width: float = 1.5, block: int = 1024
) -> DataFrame:
    """vectors with a struct column near_vec: n_links, component_id, kept."""
    v, label = F.col(vector_col).cast("array<double>"), F.col(label_col)
    sound = F.coalesce(label.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    key = F.when(sound, F.xxhash64(label, F.size(v), v))
    rows = vectors.where(sound).select(F.col(id_col).alias("id"), key.alias("cid"), F.xxhash64(label, F.size(v)).alias("space"), v.alias("v"))
    classes = staged(rows.groupBy("cid").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("space").alias("space"), F.first("v").alias("v")), "vector-classes")
    largest = classes.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    quanta, tables = table_plan(largest, threshold, recall, width)

    def hashed(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(3)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(lengths):
                    part = batch.filter(pa.array(lengths == d))
                    sig = buckets(normalised(part.column(3)), quanta, tables, width)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in sig], pa.binary())], names=["cid", "copies", "space", "v", "sig"])

    signed = staged(classes.select("cid", "copies", "space", "v").mapInArrow(hashed, "cid long, copies long, space long, v array<double>, sig binary"), "signed-vectors")
    each = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("t"), F.xxhash64("space", t, F.substring(F.col("sig"), t * 4 + 1, F.lit(4))).alias("bucket")))
    posts = signed.select("cid", F.explode(each).alias("p")).select("cid", "p.t", "p.bucket")
    full = posts.groupBy("t", "bucket").agg(F.count("*").alias("m")).where("m > 1")
    # Blocks of a large bucket; a row goes to the tasks of all pairs of blocks that its own is in.
    met = posts.join(full, ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cid", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("half"))
    pairs = met.join(signed.select("cid", "copies", "v", "sig"), "cid").groupBy("t", "bucket", "i", "j").applyInArrow(compare(threshold, tables), "cid long, root long, n long")
    pairs = staged(pairs, "vector-links")
    counted = pairs.groupBy("cid").agg(F.sum("n").alias("n"))
    named = components(pairs.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    member = classes.select("cid", "id", "copies").join(counted, "cid", "left").join(named, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = member.groupBy("component").agg(F.min("id").alias("least"))
    f = free_name(vectors, "__dm_figures")
    member = member.join(least, "component").select(F.struct("cid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "least").alias(f))
    component = F.coalesce(F.col(f"{f}.least"), F.col(id_col))
    figures = F.struct(F.coalesce(F.col(f"{f}.n"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))
    return vectors.join(member, key == F.col(f"{f}.cid"), "left").select(*[F.col(c) for c in vectors.columns], figures.alias(free_name(vectors, "near_vec")))
