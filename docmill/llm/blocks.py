"""Numpy views of Arrow text batches: whole texts as one byte array, word spans, word hashes, rolling anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others spread evenly."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def as_binary(column: pa.Array) -> pa.Array:
    """A text column as large binary without nulls, with offsets from zero."""
    return pa.concat_arrays([pc.fill_null(pc.cast(column, pa.large_binary()), b"")])


def slices(batch: pa.RecordBatch, text: str, limit: int, most_rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about limit bytes of text, most_rows at most (one row at least): rows, bytes, offsets of the rows' texts."""
    column = as_binary(batch.column(batch.schema.get_field_index(text)))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, at + most_rows)
        own = offsets[at : to + 1]
        yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the text that each is in; no word crosses texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial, then finalised. Works on some words at a time, to stay in cache."""
    out = np.zeros(len(starts), U)
    lengths = ends - starts
    up = powers(int(lengths.max(initial=0)))
    for at in range(0, len(starts), step):
        own = lengths[at : at + step]
        begin = np.zeros(len(own), np.int64)
        np.cumsum(own[:-1], out=begin[1:])
        inside = np.arange(int(own.sum())) - np.repeat(begin, own)
        values = (data[inside + np.repeat(starts[at : at + step], own)].astype(U) + U(1)) * up[inside]
        out[at : at + step] = mixed(np.add.reduceat(values, begin) + own.astype(U))
    return out


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Finalised hashes of every k consecutive values, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    part, width, done, out = values, 1, 0, None
    while True:
        if k & width:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * U(pow(int(BASE), width, 1 << 64)) + piece
            done += width
        if done == k:
            return mixed(out)
        part = part[:-width] * U(pow(int(BASE), width, 1 << 64)) + part[width:]
        width *= 2


def sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """Minimum or maximum (pick) of every w consecutive values."""
    if len(values) < w:
        return values[:0]
    part, width = values, 1
    while width * 2 <= w:
        part = pick(part[:-width], part[width:])
        width *= 2
    n = len(values) - w + 1
    return pick(part[:n], part[w - width : w - width + n])
