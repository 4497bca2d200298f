"""MinHash near-duplicates by an inverted join over signature coordinates.

Texts with equal shingle sets form one class. Each class has a signature of `coordinates` minima. A pair with Jaccard
similarity of `threshold` or more agrees in at least `matches` coordinates, but for one pair in about thirty thousand
at the threshold itself. Classes are posted under their (coordinate, value) pairs. Two signatures with that many
agreements share one of the coordinates - matches + 1 rarest postings of either, so only those prefixes are merged and
the long lists are skipped. Collisions are then counted over all coordinates, and pairs with enough of them are confirmed
on their full shingle sets.

Pairs stay few in large groups. First every member of a list is compared with the list's hub only, the member whose
postings are shared most: of near copies, the one closest to all. Lists of up to `crowd` members are then joined with
themselves for pairs of different components. The members of longer lists meet, once for all lists that have a hub in
common, in tasks of bounded blocks: those outside the group's largest component against everyone. Such a task counts
collisions and full overlaps for its whole block and returns links between components, never pairs. So no link between
components is lost, and only components, not all links, are returned. Sketches of four bits per coordinate, which agree
wherever signatures do, keep pairs that cannot pass out of the joins.

Defined results: null and empty texts have no shingles and are linked with nothing; a text of fewer words than a
shingle is one shingle; equal texts, repeated rows included, are one class; texts and words may be of any length;
component_id is the smallest id of the component; rows with a null id take part, and stand for their component only if
it has no other id; other columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import TO_LOWER, U, mixed, slices, word_hashes, word_spans
from .common import free_name, joined_back, small, staged, text_key
from .graph import components

BLOCK_BYTES = 1 << 20


def least_matches(coordinates: int, threshold: float, miss: float = 3e-5) -> int:
    """The most agreements that a pair at the threshold reaches but for a share `miss` of such pairs."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * threshold**t * (1 - threshold) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def shingle_hashes(words: np.ndarray, owner: np.ndarray, k: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, shingle hash) pairs; a text of 1 to k - 1 words has one shingle."""
    n = len(words)
    counts = np.bincount(owner, minlength=texts)
    if n >= k:
        h = words[: n - k + 1].copy()
        for j in range(1, k):
            h = mixed(h) + words[j : n - k + 1 + j]
        whole = owner[: n - k + 1] == owner[k - 1 :]
        h, own = mixed(h[whole]), owner[: n - k + 1][whole]
    else:
        h, own = np.zeros(0, U), np.zeros(0, owner.dtype)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = []
        for at, c in zip(first, counts[short], strict=True):
            x = U(c)
            for w in words[at : at + c]:
                x = mixed(np.array([x + w], U))[0]
            extra.append(x)
        h, own = np.concatenate([h, np.array(extra, U)]), np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return own[fresh], h[fresh]


def signatures(own: np.ndarray, h: np.ndarray, texts: int, coordinates: int) -> np.ndarray:
    """Per text and coordinate the upper 32 bits of the least permuted shingle hash."""
    out = np.zeros((texts, coordinates), np.uint32)
    have, starts = np.unique(own, return_index=True)
    if len(have):
        for c in range(coordinates):
            turned = (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * c & (1 << 64) - 1 | 1) + U(c * 0xDA942042E4DD58B5 & (1 << 64) - 1)
            turned ^= turned >> U(32)
            turned *= U(0xD6E8FEB86659FD93)
            out[have, c] = np.minimum.reduceat(turned, starts) >> U(32)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """(texts, coordinates / 16) words that hold four bits of each coordinate."""
    bits = (sig & np.uint32(15)).astype(U).reshape(len(sig), -1, 16)
    return (bits << (U(4) * np.arange(16, dtype=U))).sum(2, dtype=U)


def differing(a: Column, b: Column) -> Column:
    """Coordinates whose four bits differ, in two sketch words."""
    x = a.bitwiseXOR(b)
    any_ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.bit_count(any_.bitwiseAND(F.lit(0x1111111111111111)))


def signature_table(docs: DataFrame, id_col: str, text_col: str, shingle: int, coordinates: int) -> DataFrame:
    """(id, th, s1, s2, n_shingles, sig): s1, s2 hash the whole set; null for texts without words."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("th long, s1 long, s2 long, n_shingles long, sig binary, sketch array<long>").fields])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", BLOCK_BYTES):
                texts = rows.num_rows
                low = TO_LOWER[data]
                starts, ends, owner = word_spans(low, offsets)
                own, h = shingle_hashes(word_hashes(low, starts, ends), owner, shingle, texts)
                sig = signatures(own, h, texts, coordinates)
                n = np.bincount(own, minlength=texts)
                edges = np.concatenate([[0], np.cumsum(n)])
                s1, s2 = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
                for i in np.flatnonzero(n):
                    digest = hashlib.blake2b(h[edges[i] : edges[i + 1]].tobytes(), digest_size=16).digest()
                    s1[i], s2[i] = np.frombuffer(digest, np.int64)
                none = n == 0
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(s1, mask=none), pa.array(s2, mask=none), pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(list(sketches(sig).view(np.int64)), pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(class, h): the sorted shingle hashes of texts (class, text)."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", BLOCK_BYTES):
                low = TO_LOWER[data]
                starts, ends, owner = word_spans(low, offsets)
                own, h = shingle_hashes(word_hashes(low, starts, ends), owner, shingle, rows.num_rows)
                cuts = np.searchsorted(own, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["class", "h"])

    return texts.select("class", "text").mapInArrow(run, "class long, h binary")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole shingle sets are similar enough; sets: (class, h)."""

    def similar(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, U), np.frombuffer(b, U)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= threshold_percent * (len(x) + len(y) - shared)

    def run(batches):
        for batch in batches:
            good = pa.array([similar(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(good)

    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("class").alias("b"), F.col("h").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def collisions(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Agreeing coordinates of every signature of x with every one of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for c in range(x.shape[1]):
        out += x[:, c][:, None] == y[:, c][None, :]
    return out


def overlaps(x: list[np.ndarray], y: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Exact intersection sizes of every set of x with every one of y, as products of membership matrices."""
    a, b = np.concatenate(x), np.concatenate(y)
    in_a, in_b = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    both = np.intersect1d(a, b)
    out = np.zeros((len(x), len(y)), np.float64)
    for at in range(0, len(both), step):
        part = both[at : at + step]
        sides = []
        for values, owner, n in ((a, in_a, len(x)), (b, in_b, len(y))):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            m = np.zeros((n, len(part)), np.float32)
            m[owner[hit], place[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def joined_labels(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links between labels a and b those that are needed to connect what they connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
        if (p := find(x)) != (q := find(y)):
            root[p] = q
            out[0].append(x)
            out[1].append(y)
    return out


def compare_blocks(matches: int, threshold_percent: int, coordinates: int):
    """For one block of a crowd's open members against one block of all its members: links between components."""

    def run(group: pa.Table) -> pa.Table:
        at, n = group.column("at").to_numpy(), group.column("n").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, coordinates)
        i, j = (np.flatnonzero(np.asarray(group.column(c).to_numpy(zero_copy_only=False), bool)) for c in ("open", "member"))
        a: list[int] = []
        b: list[int] = []
        if len(i) and len(j):
            fits = (at[i][:, None] != at[j][None, :]) & (collisions(sig[i], sig[j]) >= matches)
            fits &= (n[i][:, None] * threshold_percent <= n[j][None, :] * 100) & (n[j][None, :] * threshold_percent <= n[i][:, None] * 100)
            i, j, fits = i[fits.any(1)], j[fits.any(0)], fits[fits.any(1)][:, fits.any(0)]
            if len(i):
                h = group.column("h")
                shared = overlaps([np.frombuffer(h[int(k)].as_py(), U) for k in i], [np.frombuffer(h[int(k)].as_py(), U) for k in j])
                p, q = np.nonzero(fits & (100 * shared >= threshold_percent * (n[i][:, None] + n[j][None, :] - shared)))
                if len(p):
                    a, b = joined_labels(at[i][p], at[j][q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def crowd_links(members: DataFrame, payload: DataFrame, matches: int, threshold_percent: int, coordinates: int, block: int, block_shingles: int) -> DataFrame:
    """(a, b): links between the components of crowds. members: (crowd, class, at, n); payload: (class, sig, h)."""
    by_label = members.groupBy("crowd", "at").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    crowds = by_label.groupBy("crowd").agg(F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "at", "s")).alias("most")).where("labels > 1")

    def blocks(count: Column, shingles: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(count / block), F.ceil(shingles / block_shingles)).cast("int")

    crowds = crowds.select("crowd", F.col("most.at").alias("settled"), blocks(F.col("c"), F.col("s")).alias("all_blocks"), blocks(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("open_blocks"))
    m = members.join(crowds, "crowd").join(payload, "class").withColumn("is_open", F.col("at") != F.col("settled"))
    m = m.withColumn("i0", F.pmod(F.xxhash64("class"), "open_blocks").cast("int")).withColumn("j0", F.pmod(F.xxhash64("class", F.lit(1)), "all_blocks").cast("int"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("open_blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("j0").alias("j")))
    as_open = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda j: F.struct(F.col("i0").alias("i"), j.alias("j")))
    m = m.withColumn("task", F.explode(F.when(F.col("is_open"), F.array_union(as_open, as_member)).otherwise(as_member)))
    m = m.select("crowd", "task.i", "task.j", "at", "n", "sig", "h", (F.col("is_open") & (F.col("task.i") == F.col("i0"))).alias("open"), (F.col("task.j") == F.col("j0")).alias("member"))
    return m.groupBy("crowd", "i", "j").applyInArrow(compare_blocks(matches, threshold_percent, coordinates), "a long, b long")


def agreeing(pairs: DataFrame, sigs: DataFrame, matches: int, coordinates: int) -> DataFrame:
    """Of pairs (a, b) those that agree in enough coordinates: the counts that the merged prefixes left open."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, coordinates) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((a == b).sum(1) >= matches))

    both = pairs.join(sigs.select(F.col("class").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("class").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold_percent: int = 80, coordinates: int = 64, crowd: int = 64, block: int = 1024, block_shingles: int = 400_000, group: bool = False
) -> DataFrame:
    """docs with a struct column near_dup: n_shingles, component_id, kept and, if asked for, group, a number that all rows of a component share, null where nothing can be linked."""
    matches = least_matches(coordinates, threshold_percent / 100)
    prefix = coordinates - matches + 1
    rows = staged(signature_table(docs, id_col, text_col, shingle, coordinates), "signatures")
    # A class is a distinct set; the least of its texts' keys stands for it.
    classes = rows.where(F.col("s1").isNotNull()).groupBy("s1", "s2").agg(F.min("id").alias("id"), F.min("th").alias("class"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = staged(classes, "classes")
    words = F.transform(F.sequence(F.lit(0), F.lit(coordinates - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * 4 + 1, F.lit(4))))
    posts = classes.select("class", F.explode(words).alias("token"))
    lists = posts.groupBy("token").agg(F.count("*").alias("n_list")).where("n_list > 1")
    shared = posts.join(lists, "token")
    # A class with u unshared postings has u of its prefix slots taken by them.
    order = F.array_sort(F.collect_list(F.struct("n_list", "token")))
    posted = shared.groupBy("class").agg(order.alias("p"), F.round(F.sum(F.log("n_list")), 6).alias("central")).withColumn("p", F.slice("p", 1, F.greatest(F.lit(0), F.lit(prefix - coordinates) + F.size("p"))))
    posted = posted.where(F.size("p") > 0).join(classes.select("class", "n", "sketch"), "class")
    words_of = [f"k{i}" for i in range(coordinates // 16)]
    posted = staged(posted.select("class", "central", "n", *[F.get("sketch", i).alias(k) for i, k in enumerate(words_of)], F.explode("p.token").alias("token")), "postings")
    source = docs.select(text_key(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(class, h): any text of the class will do, its key being the class's name."""
        hit = source.join(small(wanted.select(F.col("class").alias("th")).distinct()), "th", "left_semi")
        return staged(shingle_sets(hit.groupBy("th").agg(F.first("text").alias("text")).withColumnRenamed("th", "class"), shingle), "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))

    def fits(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        unlike = sum((differing(F.col(f"{x}.{k}"), F.col(f"{y}.{k}")) for k in words_of), F.lit(0))
        return (n * threshold_percent <= m * 100) & (m * threshold_percent <= n * 100) & (unlike <= coordinates - matches)

    def paired(joined: DataFrame, x: str, y: str) -> DataFrame:
        pairs = joined.select(F.least(f"{x}.class", f"{y}.class").alias("a"), F.greatest(f"{x}.class", f"{y}.class").alias("b")).distinct()
        return staged(agreeing(pairs, classes, matches, coordinates), "pairs")

    # Every member against its lists' hubs.
    hub = F.max_by(F.struct("class", "n", *words_of), F.struct("central", "class"))
    hubs = staged(posted.groupBy("token").agg(hub.alias("hub"), F.count("*").alias("m")).where("m > 1").select("token", "m", "hub.*"), "hubs")
    near = posted.alias("x").join(hubs.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.class") != F.col("y.class")) & fits("x", "y"))
    near = paired(near, "x", "y")
    links = staged(confirmed(near, sets_of(ends(near)), threshold_percent), "hub-links")
    labels = staged(components(links), "labels")

    # Members of long lists, once for all lists with the same hub.
    at = F.coalesce("component", "class").alias("at")
    crowded = hubs.where(F.col("m") > crowd).select("token", F.col("class").alias("crowd"))
    members = posted.join(crowded, "token").select("crowd", "class", "n").distinct()
    members = staged(members.join(labels, members["class"] == labels["node"], "left").select("crowd", "class", "n", at), "crowds")
    # Pairs of short lists that have not met in a crowd.
    met = members.groupBy("class").agg(F.collect_set("crowd").alias("met"))
    short = hubs.where((F.col("m") > 2) & (F.col("m") <= crowd)).select("token", F.col("class").alias("hub"))
    here = posted.join(short, "token").where("class <> hub").join(met, "class", "left")
    here = here.join(labels, here["class"] == labels["node"], "left").select("token", "class", "n", *words_of, "met", at)
    apart = (F.col("x.class") < F.col("y.class")) & (F.col("x.at") != F.col("y.at")) & ~F.coalesce(F.arrays_overlap("x.met", "y.met"), F.lit(False))
    rest = paired(here.alias("x").join(here.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & fits("x", "y")), "x", "y")
    several = members.groupBy("crowd").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high").select("crowd")
    members = members.join(several, "crowd")
    sets = sets_of(ends(rest).unionByName(members.select("class")))
    more = crowd_links(members, classes.select("class", "sig").join(sets, "class"), matches, threshold_percent, coordinates, block, block_shingles)
    links = staged(links.unionByName(confirmed(rest, sets, threshold_percent)).unionByName(more), "links")
    labels = components(links)

    member = classes.join(labels, classes["class"] == labels["node"], "left").select("s1", "s2", "id", F.coalesce("component", "class").alias("component"))
    least = member.groupBy("component").agg(F.min("id").alias("least"))
    member = member.join(least, "component").select("s1", "s2", "least", "component")
    out = rows.join(member, ["s1", "s2"], "left").groupBy("id", "th").agg(F.first("n_shingles").alias("n"), F.first("least").alias("least"), F.first("component").alias("component"))
    d, f = joined_back(docs, out, id_col, text_col)
    component = F.coalesce(F.col(f"{f}.least"), F.col(id_col))
    figures = F.struct(F.col(f"{f}.n").alias("n_shingles"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"), *([F.col(f"{f}.component").alias("group")] if group else []))
    return d.select(*[F.col(x) for x in docs.columns], figures.alias(free_name(docs, "near_dup")))
