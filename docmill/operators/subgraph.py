"""The part of a graph around whatever a query names: choice of a centre, bounded hops, the edges inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import holders, k_hop, undirected
from .keyword import text_index
from .rarest import rarest_first
from .retrieval import query_terms
from .storage import staged


#: Strings that are compared with every text.
FEW = 200


def overlapping(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(asked, text) of distinct non-empty strings where either contains the other, case counting; both one column.

    A few strings are compared with each text where it lies; more of them meet texts on parts.
    """
    a, t = asked.toDF("word"), texts.toDF("low")
    if a.limit(FEW + 1).count() <= FEW:
        return t.join(F.broadcast(a), F.contains("low", "word") | F.contains("word", "low")).select(F.col("word").alias("asked"), F.col("low").alias("text")).distinct()
    holds = holders(a, t, 1)
    held = holders(t.select(F.col("low").alias("word")), a.select(F.col("word").alias("low")), 1)
    return holds.toDF("asked", "text").unionByName(held.toDF("text", "asked")).distinct()


def centres(asked: DataFrame, nodes: DataFrame, edges: DataFrame, titles: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """(query_id, id, found_by): the node (id, name) that each row of asked (query_id, asked) is about, if there is one.

    1. "score": of the nodes with edges, the best by BM25 of the names' words; equal scores (six digits) by the lowest id.
    2. "part": else the longest name that is part of what was asked, or holds it; equal lengths by the lowest id.
    3. "title": else the lowest document of titles (document_id, title) whose title is part of what was asked or holds it,
       and the longest of the names that it mentions (document_id, name).

    What was asked is looked up once, however many queries ask it. Null or empty questions and names find nothing.
    """
    linked = staged(nodes.where("id IS NOT NULL AND name <> ''").select("id", "name").join(undirected(edges).select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "linked-nodes")
    q = staged(asked.where("query_id IS NOT NULL AND asked <> ''").select("query_id", "asked").distinct(), "asked")
    each = q.select("asked").distinct()
    words = query_terms(each.select(F.col("asked").alias("query_id"), F.col("asked").alias("query")))
    scored = rarest_first(words, text_index(linked.select(F.col("id").alias("chunk_id"), "name"), ["name"]), {"name": 1.0}, 1, 6)
    found = staged(scored.select(F.col("query_id").alias("asked"), F.col("chunk_id").alias("id"), F.lit("score").alias("found_by")), "centres")
    # The lowest id of a name first, so that what is left for each name is one row.
    of_name = linked.groupBy("name").agg(F.min("id").alias("id"))
    first = lambda df: df.withColumn("r", F.row_number().over(W.partitionBy("asked").orderBy(F.desc(F.length("name")), "id"))).where(F.col("r") <= 1)
    left = staged(each.join(found, "asked", "left_anti"), "asked-still")
    part = first(overlapping(left, of_name.select("name")).withColumnRenamed("text", "name").join(of_name, "name"))
    found = found.unionByName(staged(part.select("asked", "id", F.lit("part").alias("found_by")), "centres"))
    if titles is not None and mentions is not None:
        left = staged(each.join(found, "asked", "left_anti"), "asked-still")
        document = titles.where("title <> ''").groupBy("title").agg(F.min("document_id").alias("document_id"))
        hit = overlapping(left, document.select("title")).withColumnRenamed("text", "title").join(document, "title").groupBy("asked").agg(F.min("document_id").alias("document_id"))
        named = first(hit.join(mentions.select("document_id", "name").distinct(), "document_id").join(of_name, "name"))
        found = found.unionByName(named.select("asked", "id", F.lit("title").alias("found_by")))
    return q.join(found, "asked").select("query_id", "id", "found_by")


def subgraph(asked: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 50, titles: DataFrame | None = None, mentions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, centre, found_by, id, hop) around what was asked, and the edges (query_id, a, b, rel_type) among them.

    Each centre is walked once, whatever asks for it. Edges are first cut to those with both ends in any answer.
    """
    edges = staged(edges, "edges")  # as they may be joins and sums, and are read for centres, for hops and for what is inside
    c = staged(centres(asked, nodes, edges, titles, mentions), "query-centres")
    near = staged(k_hop(edges, c.select("id").distinct(), depth, limit), "near")
    found = c.withColumnRenamed("id", "centre").join(near, "centre").select("query_id", "centre", "found_by", "id", "hop")
    any_ = near.select("id").distinct()
    inside = edges.join(any_.select(F.col("id").alias("src")), "src", "left_semi").join(any_.select(F.col("id").alias("dst")), "dst", "left_semi")
    inside = staged(inside.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type").where("a <> b").distinct(), "inside")
    end = lambda name: near.select("centre", F.col("id").alias(name))
    among = inside.join(end("a"), "a").join(end("b"), ["centre", "b"])
    return found, c.select("query_id", F.col("id").alias("centre")).join(among, "centre").select("query_id", "a", "b", "rel_type")
