"""Approximate nearest neighbours by inverted lists: a coarse quantiser, every vector in one list, exact scores in few lists.

Centroids are fitted by a few rounds of spherical k-means on a sample of bounded size; every vector is then put into the
list of its nearest centroid and the table is written in the order of lists, so a search reads the files of probed lists
only. A query probes its nearest lists until they hold `candidates` vectors, all of them if there are fewer, and what
it probes is scored exactly: with no more vectors than candidates the result is that of the exact search. On demand the
result is exact at any size: the lists not yet probed that can hold a vector as good as a query's k-th best, by the angle
between the query and the centroid and the list's widest angle, are scored too. Queries go to the lists in blocks of bounded bytes, one at a time, and k rows of each query and partition come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import staged

#: Vectors in the sample that the quantiser is fitted on, lists at most, vectors of a query block in bytes.
SAMPLE_ROWS, MOST_LISTS, BLOCK_BYTES = 20_000, 4096, 32 << 20


def as_matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centroids are evenly spaced rows, a centroid without vectors keeps its place."""
    c = unit(sample[np.linspace(0, len(sample) - 1, lists).astype(int)])
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        has = np.bincount(near, minlength=lists) > 0
        c[has] = unit(sums[has])
    return c


@dataclass
class VectorIndex:
    """lists (list_id, chunk_id, vector), centroids, how many vectors each list holds, its least cosine to the centroid and longest vector."""

    lists: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    longest: np.ndarray


def vector_index(vectors: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """An index of all vectors (chunk_id, vector); null vectors and those of another length than the longest are left out."""
    v = vectors.where(F.size("vector") > 0).select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    n, width = v.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return VectorIndex(v.select(F.lit(0).alias("list_id"), "chunk_id", "vector"), np.zeros((0, 1)), np.zeros(0, int), np.zeros(0), np.zeros(0))
    v = v.where(F.size("vector") == width)
    part = v if n <= sample_rows else v.where(F.pmod(F.xxhash64(F.lit("sample"), "chunk_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    sample = unit(np.array([r.vector for r in part.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).select("vector").collect()]))
    c = centroids_of(sample, max(1, min(lists or round(n**0.5), MOST_LISTS, len(sample))))
    schema = T.StructType([T.StructField("list_id", T.IntegerType()), *v.schema.fields, T.StructField("near", T.DoubleType()), T.StructField("norm", T.DoubleType())])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = as_matrix(b.column(1))
                scores = x @ c.T
                near, norm = np.argmax(scores, axis=1), np.linalg.norm(x, axis=1)
                cosine = scores[np.arange(len(x)), near] / np.maximum(norm, 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns, pa.array(cosine), pa.array(norm)], names=schema.names)

    put = staged(v.mapInArrow(assigned, schema).repartitionByRange("list_id", "chunk_id").sortWithinPartitions("list_id"), "vector-lists")
    sizes, least, longest = np.zeros(len(c), int), np.ones(len(c)), np.zeros(len(c))
    for r in put.groupBy("list_id").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("norm").alias("norm")).collect():  # a row for each list
        sizes[r.list_id], least[r.list_id], longest[r.list_id] = r.n, r.near, r.norm
    return VectorIndex(put.drop("near", "norm"), c, sizes, least, longest)


def probes(index: VectorIndex, matrix: np.ndarray, candidates: int) -> dict[int, np.ndarray]:
    """For each list the rows of matrix that probe it."""
    order = np.argsort(-(matrix @ index.centroids.T), axis=1, kind="stable")
    before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
    query, place = np.nonzero(before < candidates)
    asked = order[query, place]
    return {int(k): query[asked == k] for k in np.unique(asked)}


def open_lists(index: VectorIndex, matrix: np.ndarray, asked: dict[int, np.ndarray], worst: np.ndarray) -> dict[int, np.ndarray]:
    """For each list the rows of matrix that have not probed it and whose score worst a vector of it may reach."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    angle = np.arccos(np.clip(matrix @ index.centroids.T / np.maximum(norm, 1e-12), -1, 1)) - np.arccos(np.clip(index.least, -1, 1))
    cosine = np.cos(np.maximum(angle, 0.0))
    may = (1 + norm * np.where(cosine > 0, cosine * index.longest, 0.0)) / 2 + 1e-6 >= worst[:, None]  # shorter vectors only come nearer to 0
    may &= index.sizes > 0
    for one, who in asked.items():
        may[who, one] = False
    return {int(one): np.flatnonzero(may[:, one]) for one in np.flatnonzero(may.any(0))}


def indexed_search(queries: DataFrame, index: VectorIndex, k: int = 10, candidates: int | None = None, digits: int | None = None, block_bytes: int = BLOCK_BYTES, exact: bool = False) -> DataFrame:
    """H1: (query_id, chunk_id, score, rank), scored (1 + cosine) / 2 among `candidates` vectors at least, 10 k by default.

    With exact, whatever can be among the k best is scored after them, so that the result is that of the exact search.
    """
    width = index.centroids.shape[1]
    q = queries.where(F.size("vector") == width).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([queries.schema["query_id"], index.lists.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    blocks = max(1, -(-q.count() * width * 8 // block_bytes))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    found = None
    for no in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == no)).collect()
        if rows:
            matrix = np.array([r.vector for r in rows])
            asked = probes(index, matrix, 10 * k if candidates is None else candidates)
            names = [r.query_id for r in rows]

            def scored(asked: dict[int, np.ndarray], names: list = names, matrix: np.ndarray = matrix) -> DataFrame:
                near = index.lists.where(F.col("list_id").isin(sorted(asked))) if len(asked) < len(index.centroids) else index.lists
                return near.mapInArrow(best_of_lists(names, matrix, asked, k, digits, schema), schema)

            part = scored(asked).withColumn("rank", best).where(F.col("rank") <= k)
            if exact:
                part = staged(part, "probed")
                reached = {r.query_id: r.score for r in part.where(F.col("rank") == k).select("query_id", "score").collect()}  # a row for each query of the block
                more = open_lists(index, matrix, asked, np.array([reached.get(n, -np.inf) for n in names]))
                if more:
                    part = part.drop("rank").unionByName(scored(more)).withColumn("rank", best).where(F.col("rank") <= k)
            part = part if blocks == 1 else staged(part, "block-best")
            found = part if found is None else found.unionByName(part)
    return found if found is not None else queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))


def best_of_lists(ids: list, matrix: np.ndarray, asked: dict[int, np.ndarray], k: int, digits: int | None, schema: T.StructType):
    """For each query its k best vectors among a partition's rows of the lists that it probes, lower ids first among equals."""

    def cut(query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> np.ndarray:
        order = np.lexsort((chunk, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        return order[np.arange(len(query)) - first < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, int), None, np.zeros(0))
        for b in batches:
            lists, chunk, x = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), as_matrix(b.column(2)) if b.num_rows else None
            chunk = chunk.astype(str) if chunk.dtype == object else chunk
            for one in np.unique(lists):
                who, at = asked.get(int(one), np.zeros(0, int)), np.flatnonzero(lists == one)
                if len(who):
                    score = (1 + x[at] @ matrix[who].T) / 2
                    score = score if digits is None else np.round(score, digits)
                    query = np.concatenate([held[0], np.tile(who, len(at))])
                    near = np.repeat(chunk[at], len(who))
                    ids_ = near if held[1] is None else np.concatenate([held[1], near])
                    all_ = np.concatenate([held[2], score.ravel()])
                    stay = cut(query, ids_, all_)
                    held = (query[stay], ids_[stay], all_[stay])
        if held[1] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in held[0]]), pa.array(held[1]), pa.array(held[2])], names=schema.names)

    return run
