"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its hashed byte trigrams and a few signs of form: repeated neighbouring words, words without
letters, words that mix letters with signs. They are weighted by log counts and rarity over the whole corpus and
projected on the leading singular directions of a bounded labelled sample. The sample's vectors are broadcast, their
number and width being bounded parameters; every document is compared with all of them by exact cosine, in blocks, and
its nearest ones vote with weights that grow with similarity.

Defined results: null and empty texts have no terms; they get the share of good texts in the sample; repeated rows
agree; of equally near labelled texts those with the lower text key count; texts and words may be of any length, and
very short ones are taken in blocks of bounded rows; other columns pass through, whatever their names; without labels
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import TO_LOWER, slices, word_hashes, word_spans
from .common import free_name, staged
from .training import held_out, labelled_sample

GRAMS, FORMS = 4088, 8
TERMS = GRAMS + FORMS
#: Rows whose terms are counted and compared at once.
BLOCK_ROWS = 512
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, TERMS) counts."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 2:
        low = TO_LOWER[data].astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        code = (low[:-2] * 961 + low[1:-1] * 31337 + low[2:] * 7919 + low[:-2] * low[2:]) % GRAMS
        whole = owner[:-2] == owner[2:]
        out[:, :GRAMS] = np.bincount(owner[:-2][whole] * GRAMS + code[whole], minlength=n * GRAMS).reshape(n, GRAMS)
    starts, ends, owner = word_spans(data, offsets)
    if len(starts):
        h = word_hashes(data, starts, ends)
        letters = np.add.reduceat(LETTER[data].astype(np.int64), starts)
        length = ends - starts
        signs = length - np.minimum(letters, length)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        for k, flag in enumerate((same, letters == 0, signs >= 3, (signs >= 2) & (letters > 0), length == 1, length > 30)):
            out[:, GRAMS + k] = np.bincount(owner[flag], minlength=n)
    return out


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * rarity
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def directions(x: np.ndarray, width: int, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors, by randomised subspace iteration."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], width + 8)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :width].astype(np.float32)


def latent(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    y = x @ basis
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def votes(x: np.ndarray, known: np.ndarray, y: np.ndarray, neighbours: int, power: float) -> np.ndarray:
    """Share of the nearest known vectors' labels, weighted by similarity; of equally near ones the first known come first."""
    k = min(neighbours, len(known))
    sim = x @ known.T
    least = np.partition(sim, len(known) - k, axis=1)[:, len(known) - k, None]
    near, level = sim > least, sim == least
    near |= level & (np.cumsum(level, axis=1) <= k - near.sum(1, keepdims=True))
    at = np.nonzero(near)[1].reshape(-1, k)
    w = np.maximum(np.take_along_axis(sim, at, 1), 1e-3).astype(np.float64) ** power
    return (w * y[at]).sum(1) / w.sum(1)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, train_rows: int = 4000, width: int = 48, neighbours: int = 9, power: float = 12.0) -> DataFrame:
    """docs with a struct column quality: held_out, score, predicted."""

    def spread(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 20, BLOCK_ROWS):
                total += (term_counts(data, offsets) > 0).sum(0)
                n += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(TERMS), -1)), pa.array(np.append(total, n))], names=["k", "n"])

    counts = {r.k: r.n for r in docs.select(F.col(text_col).alias("text")).mapInArrow(spread, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(-1, 0)
    rarity = np.array([np.log((n + 1) / (counts.get(k, 0) + 1)) + 0.1 for k in range(TERMS)], np.float32)
    rarity[GRAMS:] = max(3.0, float(rarity[GRAMS:].max()))

    def vectors(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 20, BLOCK_ROWS):
                x = weighted(term_counts(data, offsets), rarity).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), rows.column(1), rows.column(2)], names=["x", "y", "th"])

    sample = staged(labelled_sample(docs, labels, id_col, text_col, label_col, train_rows), "quality-sample")
    rows = sample.select("text", "y", "th").where("text <> ''").mapInArrow(vectors, "x binary, y int, th long").collect()
    rows.sort(key=lambda r: r.th)  # one order, which also settles ties
    y = np.array([float(r.y) for r in rows])
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32) if rows else np.zeros((0, TERMS), np.float32)
    del rows
    basis = directions(x, width) if len(x) > width else np.eye(TERMS, width, dtype=np.float32)
    known, prior = latent(x, basis) if len(x) else None, float(y.mean()) if len(y) else 0.5
    del x
    name, flag = free_name(docs, "quality"), free_name(docs, "__dm_held")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string("held_out boolean, score double, predicted int"))])

    def run(batches):
        for batch in batches:
            for part, data, offsets in slices(batch, text_col, 1 << 20, BLOCK_ROWS):
                p = np.full(part.num_rows, prior)
                if known is not None and len(data):
                    some = np.flatnonzero(np.diff(offsets) > 0)
                    p[some] = votes(latent(weighted(term_counts(data, offsets)[some], rarity), basis), known, y, neighbours, power)
                p = np.clip(p, 0.0, 1.0)
                figures = pa.StructArray.from_arrays([part.column(part.num_columns - 1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["held_out", "score", "predicted"])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], figures], names=[*part.schema.names[:-1], name])

    return docs.withColumn(flag, held_out(F.col(id_col))).mapInArrow(run, schema)
