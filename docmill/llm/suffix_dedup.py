"""Suffix-array deduplication by a hash-compared suffix sort.

In each shard the suffixes at the anchors (see anchors.py), and the reversed texts left of them, are put in order by
a bottom-up mergesort. Two suffixes are compared by their longest common extension, found by binary search over prefix
polynomial hashes, so a comparison takes logarithmic time. Common extensions of neighbours in the finished order are
verified byte by byte; where a hash collision shows, the shard is sorted again by bytes. A window that starts o bytes
left of an anchor equals another if both agree in o bytes to the left and length - o to the right, which the two
orders and the extensions of neighbours answer for all offsets at once.

Two kinds of windows do not meet in a sort and are not verified by bytes: surroundings of an anchor that occur more
than once as a whole are told by a 64-bit hash, within their anchor's; and anchors with more than `hot_contexts`
different surroundings have their windows counted by 64-bit hashes over the cluster.

Defined results: null or empty texts have no bytes and lose none; texts may be of any length; repeated rows are
occurrences of their own, so each loses all windows; rows equal in id and text lose the same; removal may cut inside a
UTF-8 sequence, so what is kept is binary; other columns pass through, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BYTE_VALUES, Windows, ladder, removed, repeated_ranges
from .blocks import BASE, U, as_binary
from .common import text_key


class Suffixes:
    """Suffixes of one byte buffer, each with a length, in groups; ordered within their group."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray):
        self.data, self.start, self.length, self.group = data, start, length, group
        self.up = ladder(BASE, len(data))
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_VALUES[data] * self.up[:-1])])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes i and j: binary search over equal prefix hashes."""
        x, y = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        px, py, sx, sy = self.up[x], self.up[y], self.sums[x], self.sums[y]
        for _ in range(int(high.max(initial=0)).bit_length() + 1):
            mid = (low + high + 1) >> 1
            same = (self.sums[x + mid] - sx) * py == (self.sums[y + mid] - sy) * px
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix i sorts before j; a proper prefix sorts first."""
        n = self.common(i, j)
        li, lj = self.length[i], self.length[j]
        ended = (n == li) | (n == lj)
        last = max(0, len(self.data) - 1)
        bytes_ = self.data[np.minimum(self.start[i] + n, last)] < self.data[np.minimum(self.start[j] + n, last)]
        return np.where(ended, li <= lj if or_equal else li < lj, bytes_)

    def order(self) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: each suffix finds its rank in the neighbouring run."""
        order = np.argsort(self.group, kind="stable")
        group = self.group[order]
        _, first, count = np.unique(group, return_index=True, return_counts=True)
        base, size = np.repeat(first, count), np.repeat(count, count)
        place = np.arange(len(order)) - base
        width = 1
        while width < int(size.max(initial=0)):
            live = np.flatnonzero(size > width)
            p, b, s = place[live], base[live], size[live]
            run = p // width
            other = run ^ 1
            low, high = np.minimum(other * width, s), np.minimum((other + 1) * width, s)
            begin, left = low.copy(), run & 1 == 0
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                them, me = order[b[open_] + mid], order[live[open_]]
                # A suffix of the left run goes before its equals in the right run.
                first_ = np.where(left[open_], self.before(them, me, False), self.before(them, me, True))
                low[open_] = np.where(first_, mid + 1, low[open_])
                high[open_] = np.where(first_, high[open_], mid)
            target = b + np.minimum(run, other) * width + p % width + (low - begin)
            moved = order.copy()
            moved[target] = order[live]
            order = moved
            width *= 2
        return order

    def neighbours(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The verified order, and the common extension of each suffix with the one before it in its group (-1: none)."""
        n = np.full(len(order), -1, np.int64)
        same = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1
        n[same] = self.common(order[same - 1], order[same])
        total = int(n[same].sum())
        if total:
            lengths = n[same]
            inside = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            a, b = (np.repeat(self.start[order[k]], lengths) + inside for k in (same - 1, same))
            if (self.data[a] != self.data[b]).any():  # a hash collision: order by bytes
                key = lambda k: (self.group[k], self.data[self.start[k] : self.start[k] + self.length[k]].tobytes())
                order = np.array(sorted(range(len(order)), key=key))
                for at in np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1:
                    p, q = key(order[at - 1])[1], key(order[at])[1]
                    n[at] = next((k for k, (s, t) in enumerate(zip(p, q, strict=False)) if s != t), min(len(p), len(q)))
        return order, n


def sort_and_mark(window: int, gram: int):
    """A resolver for anchors.repeated_ranges."""

    def resolve(shard: pa.Table) -> pa.Table:
        keys = np.stack([shard.column(k).to_numpy() for k in ("a", "c")], 1)
        _, rows = np.unique(keys, axis=0, return_index=True)
        shard = shard.take(pa.array(rows))
        group, n, pos, left = (shard.column(k).to_numpy() for k in ("a", "n", "pos", "left"))
        left = left.astype(np.int64)
        body = as_binary(shard.column("body").combine_chunks())
        offsets = np.frombuffer(body.buffers()[1], np.int64)[: len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)[: offsets[-1]]
        right = np.diff(offsets) - left
        ahead = Suffixes(data, offsets[:-1] + left, right, group)
        back = Suffixes(data[::-1], len(data) - offsets[:-1] - left, left, group)
        order_a, common_a = ahead.neighbours(ahead.order())
        order_b, common_b = back.neighbours(back.order())
        size = len(rows)
        most, least = np.full(size, -1), np.full(size, window)
        class_a, class_b = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for o in range(window - gram + 1):
            ok = np.flatnonzero((left >= o) & (right >= window - o))
            if not len(ok):
                continue
            class_a[order_a] = np.cumsum(common_a < window - o)
            class_b[order_b] = np.cumsum(common_b < o)
            _, which = np.unique(class_a[ok] * (size + 1) + class_b[ok], return_inverse=True)
            again = ok[np.bincount(which, weights=n[ok])[which] > 1.5]
            most[again] = o
            least[again] = np.minimum(least[again], o)
        hit = np.flatnonzero((most >= 0) & (n == 1))
        take, none = pa.array(hit), pa.nulls(len(hit), pa.int64())
        return pa.table([shard.column("id").take(take), shard.column("th").take(take), pa.array((pos[hit] - most[hit]).astype(np.int32)), pa.array((pos[hit] + window - least[hit]).astype(np.int32)), none, none], names=["id", "th", "lo", "hi", "a", "c"])

    return resolve


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 50, shard_contexts: int = 20_000, hot_contexts: int = 20_000, keep_text: bool = True) -> DataFrame:
    """docs with a struct column suffix_dedup: n_units (bytes), n_removed, n_spans, kept_sha256, spans, kept."""
    w = Windows(window, min(gram, window), False)
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(texts, w, sort_and_mark(window, w.gram), shard_contexts, hot_contexts, False)
    return removed(docs, ranges, id_col, text_col, "suffix_dedup", w, keep_text)
