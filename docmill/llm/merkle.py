"""A Merkle manifest of a dataset: leaves, subtree roots for each group, one root, and a proof for every row.

A leaf is the hash of its row's columns. Leaves of a group are numbered in order, by ranges over the cluster, never in
one task; `arity` consecutive nodes of a level, fewer at its end, make one of the next. Every level is an equijoin of its
nodes with themselves at computed sibling numbers, `number XOR 1` for two, `slot + offset` within the run otherwise; the
row in slot zero emits the parent. A level is written to the shared folder before the next, each a fraction of the one
before, so the jobs grow with the logarithm of the largest group. The groups' subtree roots are the leaves of one more
tree, numbered and joined in the same way, however many groups there are.

Proofs come down the other way: from the root, every level joins its nodes with their parents' paths, so a path is
moved once for each node, not once for each row and level. A path is a text, `left.right;` for each level from the leaf
to the root, where left and right are the digests of the siblings on either side; without the signs it is what proofs
hash, and folding it over a claimed leaf gives the root that the claim leads to.

Defined results: a null in any column is hashed as `-`; texts may be empty or of any length; null is a group, the first
one; rows with a null id come first; rows that share an id are ordered by their leaves, and rows equal in all columns
share their leaves, so which of them comes first makes no difference to any digest of the tree; a group of one row is its
own subtree; extra columns take no part, whatever their names, and are not in the manifest; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.ranks import ranked

from .common import staged

#: Nodes of a level that one task joins and writes.
TASK_NODES = 50_000


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the texts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def with_siblings(level: DataFrame, arity: int) -> DataFrame:
    """level (g, i, n, h, ...), nodes in runs of `arity`, with left and right: the digests of the run's others."""
    key = (F.col("g") == F.col("sg")) & (F.col("i") == F.col("si"))
    none = F.lit("")
    if arity == 2:
        sibling = level.select(F.col("g").alias("sg"), F.col("i").bitwiseXOR(F.lit(1)).alias("si"), F.col("h").alias("sh"))
        first = F.col("i").bitwiseAND(F.lit(1)) == 0
        joined = level.join(sibling, key, "left").withColumns({"left": F.when(first, none).otherwise(F.col("sh")), "right": F.when(first, F.coalesce("sh", none)).otherwise(none)})
        return joined.drop("sg", "si", "sh")
    slot, left, right = F.col("i") % arity, [none], []
    joined = level
    for offset in range(1, arity):
        at = F.col("i") - F.col("i") % arity + (F.col("i") + offset) % arity
        sibling = level.select(F.col("g").alias("sg"), at.alias("si"), F.col("h").alias("sh"))
        joined = joined.join(sibling, key, "left").withColumnRenamed("sh", f"h{offset}").drop("sg", "si")
    # A sibling that was shifted by `offset` into this slot stood at slot - offset, or arity more.
    for offset in range(arity - 1, 0, -1):
        h = F.coalesce(f"h{offset}", none)
        left.append(F.when(slot >= offset, h).otherwise(none))
        right.append(F.when(slot < offset, h).otherwise(none))
    return joined.withColumns({"left": F.concat(*left), "right": F.concat(*right, none)}).drop(*[f"h{o}" for o in range(1, arity)])


def climbed(leaves: DataFrame, arity: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the trees over leaves (g, i, n, h), from the leaves up, and their tops (g, height, h), one for each group.

    i counts from 0, n is the number of the group's nodes. A level holds the nodes of groups that go on, with siblings.
    """
    tops, levels = leaves.where("n = 1").select("g", F.lit(0).alias("height"), "h"), []
    open_ = leaves.where("n > 1")
    for total in level_sizes(leaves, arity):
        level = with_siblings(open_, arity).coalesce(-(-total // TASK_NODES))
        levels.append(staged(level, f"{label}-level"))
        up = levels[-1].where(F.col("i") % arity == 0)
        up = up.select("g", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), digest("left", "h", "right").alias("h"))
        tops = tops.unionByName(up.where("n = 1").select("g", F.lit(len(levels)).alias("height"), "h"))
        open_ = up.where("n > 1")
    return levels, tops


def level_sizes(leaves: DataFrame, arity: int) -> list[int]:
    """Nodes of each level in groups that go on, from the leaves up; as many numbers as levels."""
    n = F.col("n")
    largest = leaves.agg(F.max(n)).first()[0] or 1
    at, widths = 0, []
    while arity**at < largest:
        nodes = F.expr(f"(n + {arity**at - 1}) div {arity**at}")
        widths.append(F.sum(F.when(nodes > 1, nodes).otherwise(0)))
        at += 1
    return [int(x) for x in leaves.where("i = 0").agg(*widths).first()] if widths else []


def descended(levels: list[DataFrame], tops: DataFrame, arity: int, label: str, stage_every: int = 6) -> DataFrame:
    """(g, i, path) of the leaves; tops (g, height, path) say what follows above each group's top."""
    at = lambda k: tops.where(F.col("height") == k).select("g", F.lit(0).cast("long").alias("i"), "path")
    paths = at(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        up = paths.select(F.col("g").alias("pg"), F.col("i").alias("pi"), F.col("path").alias("above"))
        own = F.concat("left", F.lit("."), "right", F.lit(";"))
        joined = levels[k].join(up, (F.col("g") == F.col("pg")) & (F.expr(f"i div {arity}") == F.col("pi")))
        paths = joined.select("g", "i", F.concat(own, "above").alias("path")).unionByName(at(k))
        if k and k % stage_every == 0:
            paths = staged(paths, f"{label}-paths")
    return paths


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to along a path."""
    steps = F.filter(F.split(path, ";"), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda h, s: digest(F.substring_index(s, ".", 1), h, F.substring_index(s, ".", -1)))


def proof_digests(path: Column) -> Column:
    """A path's sibling digests in a row: level by level, left to right."""
    return F.translate(path, ".;", "")


def build_manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    id_col: str = "doc_id",
    claims: Mapping[str, Column] | None = None,
    arity: int = 2,
) -> DataFrame:
    """One row for each row of docs: id_col, leaf, subroot, root, path, folded_root, verified.

    claims are columns whose values someone else states; verified says whether the row with these values leads to the
    root. Without claims every row is verified.
    """
    leaf = digest(*[field(F.col(c)) for c in columns])
    claimed = digest(*[field((claims or {}).get(c, F.col(c))) for c in columns])
    group = F.when(F.col(group_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    thin = staged(docs.select(group.alias("g"), F.col(id_col).alias("id"), leaf.alias("h"), claimed.alias("claimed")), "leaves")
    sizes = staged(thin.groupBy("g").agg(F.count("*").alias("n")), "leaf-groups")
    placed = ranked(thin, [F.asc_nulls_first("id"), F.asc("h")], "place", ["g"])
    counts = sizes.withColumnRenamed("g", "cg")
    counts = F.broadcast(counts) if counts.limit(TASK_NODES + 1).count() <= TASK_NODES else counts
    leaves = staged(placed.join(counts, F.col("g") == F.col("cg")).select("g", (F.col("place") - 1).alias("i"), "n", "h", "id", "claimed"), "leaves")
    levels, tops = climbed(leaves.select("g", "i", "n", "h"), arity, "tree")
    tops = staged(tops, "subroots")

    roots = ranked(tops, [F.asc("g")], "place").select(F.lit("").alias("g"), (F.col("place") - 1).alias("i"), F.lit(tops.count()).alias("n"), "h", F.col("g").alias("name"))
    roots = staged(roots, "roots")
    upper, top = climbed(roots.select("g", "i", "n", "h"), arity, "root")
    upper_paths = descended(upper, top.withColumn("path", F.lit("")), arity, "root").drop("g").withColumnRenamed("i", "at")
    named = roots.join(upper_paths, F.col("i") == F.col("at")).select(F.col("name").alias("tg"), "path", F.col("h").alias("subroot"))
    crowned = staged(tops.join(named, F.col("g") == F.col("tg")).select("g", "height", "path", "subroot"), "crowned")
    root = F.lit(getattr(top.first(), "h", None))

    paths = descended(levels, crowned, arity, "tree").select(F.col("g").alias("pg"), F.col("i").alias("pi"), "path")
    subroots = crowned.select(F.col("g").alias("sg"), "subroot")
    subroots = F.broadcast(subroots) if subroots.limit(TASK_NODES + 1).count() <= TASK_NODES else subroots
    all_ = leaves.join(paths, (F.col("g") == F.col("pg")) & (F.col("i") == F.col("pi"))).join(subroots, F.col("g") == F.col("sg")).withColumn("root", root)
    all_ = all_.withColumn("folded_root", folded(F.col("path"), F.col("claimed")))
    return all_.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
