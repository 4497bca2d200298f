"""Finding every repeated window of fixed length, in words or bytes, without shuffling every position.

Each window picks an anchor, the gram in it with the least hash, by its own content; equal windows pick equal anchors
at equal offsets. Only anchors are shuffled, and of these only the ones that occur twice go on, each with its context:
all that the windows around it can reach. Contexts go, grouped by anchor, to a resolver that finds which windows in them
recur; a context that occurs more than once goes there once, for all its places, or is settled by its 64-bit hash, as
the caller says. Anchors with more distinct contexts than one task should hold are resolved by counting 64-bit window
hashes over the cluster instead, so no group is ever gathered whole; both ways find the same windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BASE, U, as_binary, grams, mixed, slices, sliding, word_hashes, word_spans
from .common import free_name, joined_back, small, staged

BLOCK_BYTES = 1 << 20
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * BASE)


@dataclass(frozen=True)
class Windows:
    """What a window is: so many words or bytes, anchored by grams of `gram` of them."""

    length: int
    gram: int
    words: bool

    @property
    def most_left(self) -> int:
        return self.length - self.gram

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and text number of each unit."""
        if self.words:
            starts, ends, owner = word_spans(data, offsets)
            return word_hashes(data, starts, ends), owner
        return BYTE_VALUES[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ladder(base: U, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors_in(w: Windows, values: np.ndarray, owner: np.ndarray, texts: int) -> dict[str, np.ndarray]:
    """All anchors: text number, position in it, gram hash, context hash, context units left of and from the position."""
    counts = np.bincount(owner, minlength=texts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    g = grams(values, w.gram) | U(1)
    per = w.length - w.gram + 1
    at = np.zeros(0, np.int64)
    if len(g) >= per:
        least = sliding(g, per, np.minimum)
        least[owner[: len(least)] != owner[w.length - 1 :]] = 0
        edge = np.zeros(per - 1, U)
        at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), per, np.maximum) == g)
    text = owner[at]
    pos = at - first[text]
    left, right = np.minimum(pos, w.most_left), np.minimum(counts[text] - pos, w.length)
    up, down = ladder(BASE, len(values)), ladder(INVERSE, len(values))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(values * up[:-1])])
    context = mixed((sums[at + right] - sums[at - left]) * down[at - left] + (left * 1_000_003 + right).astype(U))
    return {"text": text, "pos": pos, "a": g[at], "c": context, "left": left, "right": right}


def anchor_table(docs: DataFrame, w: Windows) -> DataFrame:
    """docs (id, th, text) -> (id, th, pos, a, c, left, right)."""
    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("th long, pos int, a long, c long, left short, right short").fields])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", BLOCK_BYTES):
                values, owner = w.units(data, offsets)
                x = anchors_in(w, values, owner, rows.num_rows)
                at = pa.array(x["text"])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(x["pos"].astype(np.int32)), pa.array(x["a"].view(np.int64)), pa.array(x["c"].view(np.int64)), pa.array(x["left"].astype(np.int16)), pa.array(x["right"].astype(np.int16))], names=schema.names)

    return docs.mapInArrow(run, schema)


CONTEXT = "a long, c long, n long, th long, pos int, left int, body binary"


def contexts_of(docs: DataFrame, requests: DataFrame, w: Windows) -> DataFrame:
    """The contexts' bytes: words joined by one space, or the bytes as they are. requests: (id, th, a, c, n, pos, left, right)."""
    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string(CONTEXT).fields])
    asked = requests.groupBy("id", "th").agg(F.collect_list(F.struct("a", "c", "n", "pos", "left", "right")).alias("asked")).withColumnsRenamed({"id": "rid", "th": "rth"})
    both = docs.join(asked, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("id", "th", "text", "asked")

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            f = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("a", "c", "n", "pos", "left", "right")}
            texts, bodies, current, words = as_binary(batch.column(2)), [], -1, None
            for i, pos, left, right in zip(owner, f["pos"], f["left"], f["right"], strict=True):
                if i != current:
                    current, words = i, texts[int(i)].as_py()
                    words = words.split() if w.words else words
                part = words[pos - left : pos + right]
                bodies.append(b" ".join(part) if w.words else part)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(f["a"]), pa.array(f["c"]), pa.array(f["n"]), batch.column(1).take(at), pa.array(f["pos"].astype(np.int32)), pa.array(f["left"].astype(np.int32)), pa.array(bodies, pa.binary())], names=schema.names)

    return both.mapInArrow(run, schema)


def hot_ranges(contexts: DataFrame, w: Windows) -> DataFrame:
    """(id, th, lo, hi) of contexts whose anchor has very many: window hashes are counted over the cluster.

    Rows of windows are narrow: a hash of anchor and offset, one of the window, and the context's number.
    """
    contexts = contexts.withColumn("cid", F.xxhash64("a", "c"))

    def run(batches):
        for batch in batches:
            body = as_binary(batch.column(3))
            cid, left, a = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(U)
            offsets = np.frombuffer(body.buffers()[1], np.int64)[: len(body) + 1]
            values, owner = w.units(np.frombuffer(body.buffers()[2] or b"", np.uint8), offsets)
            h = grams(values, w.length)
            if not len(h):
                continue
            own = owner[: len(h)]
            counts = np.bincount(owner, minlength=len(body))
            o = left[own] - (np.arange(len(h)) - np.concatenate([[0], np.cumsum(counts)[:-1]])[own])
            ok = np.flatnonzero((own == owner[w.length - 1 :]) & (o >= 0) & (o <= w.most_left))
            at = pa.array(own[ok])
            place = mixed(a[own[ok]] + o[ok].astype(U))
            yield pa.RecordBatch.from_arrays([cid.take(at), pa.array(o[ok].astype(np.int16)), batch.column(4).take(at), pa.array(place.view(np.int64)), pa.array(h[ok].view(np.int64))], names=["cid", "o", "n", "k", "h"])

    windows = contexts.select("cid", "left", "a", "body", F.least("n", F.lit(2)).cast("short").alias("n")).mapInArrow(run, "cid long, o short, n short, k long, h long")
    again = windows.groupBy("k", "h").agg(F.sum("n").alias("m")).where("m > 1").select("k", "h")
    found = windows.where("n = 1").drop("n").join(again, ["k", "h"]).groupBy("cid").agg(F.max("o").alias("most"), F.min("o").alias("least"))
    return contexts.select("cid", "id", "th", "pos").join(found, "cid").select("id", "th", (F.col("pos") - F.col("most")).alias("lo"), (F.col("pos") + w.length - F.col("least")).alias("hi"))


def repeated_ranges(docs: DataFrame, w: Windows, resolve: Callable[[pa.Table], pa.Table], shard_contexts: int, hot_contexts: int, resolve_repeats: bool) -> DataFrame:
    """(id, th, lo, hi): ranges of units of documents (id, th, text) that some repeated window covers.

    resolve takes the contexts of some anchors (CONTEXT and id) and returns (id, th, lo, hi, a, c): ranges of a context
    that occurs once, or, without an id, of one that occurs more often, relative to its anchor. With resolve_repeats the
    latter go through it as well, one representative each; else their equal hashes settle them.
    """
    anchors = staged(anchor_table(docs, w), "anchors")
    twice = anchors.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    occurrences = staged(anchors.join(twice, "a"), "occurrences")
    contexts = staged(occurrences.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("th", "pos", "left", "right", "id")).alias("at")), "contexts")
    by_anchor = contexts.groupBy("a").agg(F.count("*").alias("distinct"), F.min("n").alias("least"), F.max("n").alias("most"))
    wanted = "distinct > 1 or most > 1" if resolve_repeats else "distinct > 1 and least = 1"
    open_ = staged(contexts.join(by_anchor.where(wanted).select("a", "distinct"), "a").select("a", "c", "n", "at.*", "distinct"), "open-contexts")
    crowded = small(open_.where(F.col("distinct") > hot_contexts).select("a").distinct().withColumn("hot", F.lit(True)))
    bodies = staged(contexts_of(docs, open_, w).join(crowded, "a", "left"), "context-bodies")
    shards = max(1, -(-bodies.count() // shard_contexts))
    sharded = bodies.where("hot is null").drop("hot").withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("th long, lo int, hi int, a long, c long").fields])
    found = staged(sharded.groupBy("shard").applyInArrow(resolve, schema), "found")
    ranges = found.where("a is null").select("id", "th", "lo", "hi")
    at = lambda c: (F.col("pos") + F.col(c)).cast("int").alias(c)
    ranges = ranges.unionByName(occurrences.join(found.where("a is not null").select("a", "c", "lo", "hi"), ["a", "c"]).select("id", "th", at("lo"), at("hi")))
    whole = contexts.where("n > 1").select("a", "c")
    if resolve_repeats:
        whole = whole.join(crowded, "a", "left_semi")
    whole = occurrences.join(whole, ["a", "c"]).where(F.col("left") + F.col("right") >= w.length)
    ranges = ranges.unionByName(whole.select("id", "th", (F.col("pos") - F.col("left")).cast("int").alias("lo"), (F.col("pos") + F.col("right")).cast("int").alias("hi")))
    hot = bodies.where("hot").drop("hot")
    if not hot.isEmpty():
        ranges = ranges.unionByName(hot_ranges(hot.dropDuplicates(["a", "c"]), w).select("id", "th", F.col("lo").cast("int"), F.col("hi").cast("int")))
    return ranges


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Ranges united; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str, name: str, w: Windows, keep_text: bool) -> DataFrame:
    """docs with the struct column `name`: n_units, n_removed, n_spans, kept_sha256, spans, kept (null without keep_text)."""
    per = ranges.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    inner, name = free_name(docs, "__dm_ranges"), free_name(docs, name)
    d, f = joined_back(docs, per, id_col, text_col, "left")
    joined = d.select(*[F.col(c) for c in docs.columns], F.col(f"{f}.r").alias(inner))
    out = T._parse_datatype_string(f"n_units long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>, kept {'string' if w.words else 'binary'}")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, out)])
    kind = pa.struct([("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), ("kept", pa.string() if w.words else pa.binary())])

    def run(batches):
        for batch in batches:
            texts, rows = as_binary(batch.column(batch.schema.get_field_index(text_col))), []
            lists = batch.column(batch.schema.get_field_index(inner))
            for text, hit in zip(texts, lists, strict=True):
                units = text.as_py().split() if w.words else text.as_py()
                spans = merged(hit.values.field("lo").to_numpy(), hit.values.field("hi").to_numpy()) if hit.is_valid else []
                n = len(units)
                if spans:
                    edges = [0, *(x for s in spans for x in s), n]
                    parts = [units[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    units = [x for p in parts for x in p] if w.words else b"".join(parts)
                body = b" ".join(units) if w.words else units
                rows.append((n, n - len(units), len(spans), hashlib.sha256(body).hexdigest(), [{"lo": a, "hi": b} for a, b in spans], (body.decode() if w.words else body) if keep_text else None))
            figures = pa.array([dict(zip(out.names, r, strict=True)) for r in rows], kind)
            keep = [i for i, n in enumerate(batch.schema.names) if n != inner]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), figures], names=[*(batch.schema.names[i] for i in keep), name])

    return joined.mapInArrow(run, schema)
