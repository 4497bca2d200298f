"""Entity graphs as node and edge tables: building, merging, traversing, cleaning."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import is_junk_name

from .storage import small, staged

# The relation types that are kept; any other becomes the last.
RELATIONS = ["USES", "IMPLEMENTS", "BELONGS_TO", "DEPENDS_ON", "CREATED_BY", "PART_OF", "RELATED_TO"]


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge seen from both its ends: (node, other, rel_type, weight)."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel_type", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return there.unionByName(there.select(F.col("other").alias("node"), F.col("node").alias("other"), "rel_type", "weight"))


def chunk_entities(chunks: DataFrame, mentions: DataFrame, most: int = 5) -> DataFrame:
    """Up to five names per chunk, in order of name; mentions are (chunk_id, name)."""
    m = mentions.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").where(~is_junk_name(F.col("name"), documents=False)).distinct()
    r = F.row_number().over(W.partitionBy("chunk_id").orderBy("name"))
    return m.withColumn("r", r).where(F.col("r") <= most).groupBy("chunk_id").agg(F.array_sort(F.collect_list("name")).alias("entities"))


def resolved_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose two ends are known, with a known type."""
    kind = F.upper(F.coalesce("rel_type", F.lit("RELATED_TO")))
    ends = entities.select("id", "name")
    j = relations.join(ends.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(ends.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return j.withColumn("rel_type", F.when(kind.isin(RELATIONS), kind).otherwise("RELATED_TO"))


def cooccurrences(mentions: DataFrame) -> DataFrame:
    """C4: (document_id, name1, name2) for names in the same document, name1 < name2; a document's names are few."""
    m = mentions.select("document_id", "name").distinct()
    return m.select("document_id", F.col("name").alias("name1")).join(m.select("document_id", F.col("name").alias("name2")), "document_id").where("name1 < name2")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id), each pair once."""
    inside = edges.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return inside.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type").distinct()


def expanded_names(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, neighbours: int = 3, most: int = 20) -> DataFrame:
    """Names of the seeds (query_id, id) and of their three nearest neighbours, twenty per query.

    A node's nearest are the same for every query, so they are chosen once a node: no row for a query and a neighbour that
    is not shown, however many neighbours a name has and however many queries ask for it.
    """
    both = undirected(edges).join(seeds.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "other", "weight")
    near = both.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("weight"), "other"))).where(F.col("r") <= neighbours)
    near = seeds.select("query_id", F.col("id").alias("node")).distinct().join(near, "node").select("query_id", "other")
    all_ = seeds.select("query_id", "id", F.lit(0).alias("hop")).unionByName(near.select("query_id", F.col("other").alias("id"), F.lit(1).alias("hop")))
    named = all_.groupBy("query_id", "id").agg(F.min("hop").alias("hop")).join(nodes.select("id", "name"), "id").where(~is_junk_name(F.col("name")))
    r = F.row_number().over(W.partitionBy("query_id").orderBy("hop", "name", "id"))
    return named.withColumn("r", r).where(F.col("r") <= most).drop("r")


def k_hop(edges: DataFrame, centres: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """(centre, id, hop) of the nodes within so many hops, nearest first, the centre included; depth is held within 1 and 5.

    Each hop joins the frontier alone and leaves out what was visited; frontiers are written, so no hop is run twice. A
    centre takes the lowest ids of a hop until it has `limit` nodes and then stops. A centre that has seen n nodes takes
    limit - n more at most, so the `limit` lowest ids are enough, of a node's neighbours and of a hop's: a hub makes no
    hop wider, and both are cut before they are shuffled. Only neighbours of the frontier are looked up. Centres that are
    null or repeated count once, or not at all.
    """
    ends = staged(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "ends")
    both = ends.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(ends.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    lowest = lambda df, key, value: df.withColumn("r", F.dense_rank().over(W.partitionBy(key).orderBy(value))).where(F.col("r") <= limit).select(key, value).distinct()
    seen = staged(centres.where("id IS NOT NULL").select(F.col("id").alias("centre"), "id", F.lit(0).alias("hop")).distinct(), "centres")
    frontier, place = seen, F.row_number().over(W.partitionBy("centre").orderBy("id"))
    for hop in range(1, max(1, min(depth, 5)) + 1):
        room = seen.groupBy("centre").agg((F.lit(limit) - F.count("*")).alias("room")).where("room > 0")
        reached = frontier.join(room.select("centre"), "centre", "left_semi").select("centre", F.col("id").alias("node"))
        near = staged(lowest(both.join(small(reached.select("node").distinct()), "node", "left_semi"), "node", "other"), "neighbours")
        step = lowest(reached.join(near, "node").select("centre", F.col("other").alias("id")), "centre", "id")
        new = step.join(seen, ["centre", "id"], "left_anti").join(room, "centre").withColumn("r", place).where((F.col("r") <= limit) & (F.col("r") <= F.col("room")))
        frontier = staged(new.select("centre", "id", F.lit(hop).alias("hop")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def topic_experts(nodes: DataFrame, edges: DataFrame, word: str, most: int, most_topics: int = 10, most_projects: int = 5) -> DataFrame:
    """Persons tied to topics whose names contain a word, by (relations + half the topics) / 10, 1 at most."""
    name = lambda label: nodes.where(F.col("label") == label)
    topics = name("Topic").where(F.contains(F.lower("name"), F.lit(word.lower()))).select(F.col("id").alias("topic"), F.col("name").alias("topic_name"))
    both = undirected(edges)
    hits = topics.join(both, F.col("topic") == F.col("node")).join(name("Person").select(F.col("id").alias("person"), F.col("name").alias("person_name")), F.col("other") == F.col("person"))
    g = hits.groupBy("person", "person_name").agg(F.count("*").alias("relations"), F.count_distinct("topic").alias("n_topics"), F.slice(F.array_sort(F.collect_set("topic_name")), 1, most_topics).alias("topics"))
    g = g.withColumn("score", F.round(F.least(F.lit(1.0), (F.col("relations") + 0.5 * F.col("n_topics")) / 10), 6)).orderBy(F.desc("score"), F.desc("relations"), "person").limit(most)
    projects = both.join(name("Project").select(F.col("id").alias("pid"), F.col("name").alias("project")), F.col("other") == F.col("pid")).groupBy("node").agg(F.slice(F.array_sort(F.collect_set("project")), 1, most_projects).alias("projects"))
    return g.join(projects, F.col("person") == F.col("node"), "left").drop("node").withColumn("projects", F.coalesce("projects", F.array().cast("array<string>")))


def grams_of(text: Column, least: int, most: int = 3) -> Column:
    """The distinct substrings of least to most characters."""
    sizes = F.array(*[F.lit(n) for n in range(least, most + 1)])
    parts = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substr(text, i, n)))
    return F.array_distinct(F.flatten(parts))


def holders(words: DataFrame, texts: DataFrame, least: int = 3) -> DataFrame:
    """(word, low): the distinct texts (low) that contain each distinct word (word) of `least` characters or more.

    A word meets texts on the rarest of its parts of three characters (fewer, if it is shorter) only, by the number of
    texts that hold each; a word with a part that no text holds meets none. What meets is compared.
    """
    grams = staged(texts.select("low").distinct().select("low", F.explode(grams_of(F.col("low"), min(least, 3))).alias("g")), "grams")
    held = grams.groupBy("g").agg(F.count("*").alias("df"))
    size = F.least(F.length("word"), F.lit(3))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - size + 1), lambda i: F.substr("word", i, size)))
    asked = words.where(F.length("word") >= least).select("word", F.explode(own).alias("g")).join(held, "g", "left")
    rarest = asked.groupBy("word").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("x")).where("x.df > 0").select("word", F.col("x.g").alias("g"))
    return rarest.join(grams, "g").where(F.contains("low", "word")).select("word", "low")


def name_matches(words: DataFrame, names: DataFrame, partial: int = 15, most: int = 20, gram: int = 3) -> DataFrame:
    """Names equal to a word of a query, then names that contain one; (query_id, word) against distinct (name).

    A word meets names on the rarest of its parts of three characters (fewer, if it is shorter) only, by the number of
    names that hold each; a word with a part that no name holds meets none. What meets is compared, so a dictionary of any
    size is never crossed with the words, and no list is longer than that of a word's rarest part. Words shorter than
    `gram` only match whole names. A word that many queries share is looked up once, and of what it is part of only as
    many names go on as any query can show.
    """
    low = names.select("name", F.lower("name").alias("low"))
    w = staged(words.select("query_id", F.lower("word").alias("word")).distinct(), "query-words")
    each = w.select("word").distinct()
    exact = staged(each.join(low, F.col("word") == F.col("low")).select("word", "name", F.lit(0).alias("kind")), "same-names")
    # A query with `most` names that equal its words shows no other. For the rest, names that equal another word of the
    # query stand elsewhere; so many more have to be at hand.
    counts = staged(w.join(exact, "word").groupBy("query_id").agg(F.count_distinct("name").alias("n")), "same-counts")
    shown = partial + (counts.where(F.col("n") < most).agg(F.max("n")).first()[0] or 0)
    still = staged(w.join(counts.where(F.col("n") >= most), "query_id", "left_anti").select("query_id", "word"), "words-still")
    each = staged(still.select("word").distinct(), "each-word")
    first = lambda df: df.withColumn("r", F.row_number().over(W.partitionBy("word").orderBy("name"))).where(F.col("r") <= shown).select("word", "name", F.lit(1).alias("kind"))
    # A word of three characters or fewer is itself a part of the names that hold it: one pass over the names' parts.
    brief = each.where((F.length("word") >= gram) & (F.length("word") <= 3))
    held = low.select("name", "low", F.explode(grams_of(F.col("low"), min(gram, 3))).alias("word")).where("low <> word").join(brief, "word", "left_semi")
    part = holders(each.where(F.length("word") > 3), low, gram).where(F.col("low") != F.col("word")).join(low, "low")
    part = still.join(first(held.select("word", "name")).unionByName(first(part.select("word", "name"))), "word")
    best = w.join(exact, "word").unionByName(part).groupBy("query_id", "name").agg(F.min("kind").alias("kind"))
    r = best.withColumn("r", F.row_number().over(W.partitionBy("query_id", "kind").orderBy("name"))).where((F.col("kind") == 0) | (F.col("r") <= partial))
    return r.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("kind", "name"))).where(F.col("r") <= most)


def looked_up(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each row of wanted (wanted, ...) the nodes of that id or that name: two equi-joins, not one with an "or"."""
    by_id = wanted.join(nodes, F.col("wanted") == F.col("id"))
    by_name = wanted.join(nodes.where(F.col("name") != F.col("id")), F.col("wanted") == F.col("name"))
    return by_id.unionByName(by_name)


def orphans(nodes: DataFrame, edges: DataFrame, incoming: str | None = None) -> DataFrame:
    """Nodes without edges, or without incoming edges of a type."""
    ends = undirected(edges).select(F.col("node").alias("id")) if incoming is None else edges.where(F.col("rel_type") == incoming).select(F.col("dst").alias("id"))
    return nodes.join(ends.distinct(), "id", "left_anti")


def found_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (document_id, part, block, name, chunk_id, low), sorted: a document's names first, then its chunks, each read once."""
    now, names, machine, seen, chunk = None, {}, None, set(), None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at, out = [], []
        for i, (*group, name, chunk_id, low) in enumerate(zip(*columns, strict=True)):
            if group != now:
                now, names, machine, chunk = group, {}, None, None
            if name is not None:
                names.setdefault(low, []).append(name)
                continue
            if machine is None:
                machine = ahocorasick.Automaton()
                for word in names:
                    if word:
                        machine.add_word(word, word)
                machine.make_automaton()
            if chunk is None or chunk != (chunk_id,):
                chunk, seen = (chunk_id,), set()
            hits = {word for _, word in machine.iter(low)} if len(machine) else set()
            for word in (hits | ({""} & names.keys())) - seen:  # every text contains the empty name
                seen.add(word)
                at.extend([i] * len(names[word]))
                out.extend(names[word])
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["chunk_id"].take(rows), batch["document_id"].take(rows), pa.array(out, batch["name"].type)], names=["chunk_id", "document_id", "name"])


def mention_edges(chunks: DataFrame, entities: DataFrame, part_chunks: int = 100_000, block_names: int = 200_000) -> DataFrame:
    """C20: a chunk mentions the entities (document_id, name) of its own document that its text contains, upper and lower case alike.

    Each chunk is read once, by an automaton of its document's names; chunks and names meet in one shuffle, sorted, and no
    text is copied for a name. A document with more chunks than part_chunks is dealt in parts, each with its names; one with
    more names than block_names in blocks of names, each with its chunks, so a task holds block_names or so at a time.
    Rows that are null in document_id, name or text mention nothing; repeated rows count once.
    """
    c = chunks.select("document_id", "chunk_id", F.lower("content").alias("low")).where("document_id IS NOT NULL AND low IS NOT NULL")
    n = entities.select(F.col("document_id").cast(chunks.schema["document_id"].dataType), "name").where("document_id IS NOT NULL AND name IS NOT NULL").distinct()
    sizes = c.groupBy("document_id").agg(F.count("*").alias("c"), F.lit(0).cast("long").alias("n")).unionByName(n.groupBy("document_id").agg(F.lit(0).cast("long").alias("c"), F.count("*").alias("n")))
    sizes = sizes.groupBy("document_id").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).where((F.col("c") > part_chunks) | (F.col("n") > block_names))
    large = small(staged(sizes.select("document_id", F.ceil(F.greatest("c", F.lit(1)) / part_chunks).cast("int").alias("parts"), F.ceil(F.greatest("n", F.lit(1)) / block_names).cast("int").alias("blocks")), "large-documents"))
    parts, blocks = F.coalesce("parts", F.lit(1)), F.coalesce("blocks", F.lit(1))
    each = lambda size: F.explode(F.sequence(F.lit(0), size - 1))
    c = c.join(large, "document_id", "left").withColumns({"part": F.pmod(F.xxhash64("chunk_id"), parts).cast("int"), "block": each(blocks)})
    n = n.join(large, "document_id", "left").withColumns({"block": F.pmod(F.xxhash64("name"), blocks).cast("int"), "part": each(parts), "chunk_id": F.lit(None).cast(chunks.schema["chunk_id"].dataType), "low": F.lower("name")})
    columns = ["document_id", "part", "block", "name", "chunk_id", "low"]
    rows = n.select(columns).unionByName(c.withColumn("name", F.lit(None).cast(entities.schema["name"].dataType)).select(columns))
    rows = rows.repartition("document_id", "part", "block").sortWithinPartitions("document_id", "part", "block", F.col("name").isNull(), "chunk_id")
    return rows.mapInArrow(found_names, T.StructType([chunks.schema["chunk_id"], chunks.schema["document_id"], entities.schema["name"]]))


def category_tree(rows: DataFrame, levels: int = 3) -> DataFrame:
    """(id, parent, name) with level and path; rows whose parent is unknown are roots."""
    known = rows.select(F.col("id").alias("pid"))
    top = rows.join(known, F.col("parent") == F.col("pid"), "left_anti").withColumns({"parent": F.lit(None).cast("string"), "level": F.lit(1), "path": F.col("name")})
    out, layer = top, top
    for level in range(2, levels + 1):
        up = layer.select(F.col("id").alias("pid"), F.col("path").alias("ppath"))
        layer = rows.join(up, F.col("parent") == F.col("pid")).select("id", "parent", "name", F.lit(level).alias("level"), F.concat_ws(" > ", "ppath", "name").alias("path"))
        out = out.unionByName(layer)
    return out


def merged_nodes(rows: DataFrame, first_description: bool = False) -> DataFrame:
    """L3, L4: one node per label and name; the latest values win, or the first description that is not null."""
    pick = F.min_by if first_description else F.max_by
    described = F.when(F.col("description").isNotNull(), F.col("ts")) if first_description else F.col("ts")
    return rows.groupBy("label", "name").agg(pick("description", described).alias("description"), F.max("ts").alias("ts"))


def merged_edges(rows: DataFrame, first_description: bool = False) -> DataFrame:
    """One edge per ends and type."""
    pick = F.min_by if first_description else F.max_by
    return rows.groupBy("src", "dst", "rel_type").agg(pick("description", "ts").alias("description"), F.count("*").alias("seen"))


def document_graph(docs: DataFrame, chunks: DataFrame, mentions: DataFrame, most_chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents, chunks and entities."""
    doc = lambda c: F.concat(F.lit("doc:"), c)
    chunk, entity = F.concat(F.lit("chunk:"), "chunk_id"), F.concat(F.lit("entity:"), F.col("name"))
    nodes = docs.select(doc(F.col("doc_id")).alias("id"), F.lit("Document").alias("label"), F.substring_index("text", "\n", 1).alias("name"))
    nodes = nodes.unionByName(chunks.select(chunk.alias("id"), F.lit("Chunk").alias("label"), F.substring("content", 1, most_chars).alias("name")))
    nodes = nodes.unionByName(mentions.select(entity.alias("id"), F.lit("Entity").alias("label"), "name").distinct())
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("rel_type"))
    d = doc(F.col("document_id"))
    edges = edge(chunks, d, chunk, "CONTAINS").unionByName(edge(chunks, chunk, d, "PART_OF")).unionByName(edge(mentions, chunk, entity, "MENTIONS")).unionByName(edge(mentions, entity, chunk, "MENTIONED_IN"))
    return nodes, edges.unionByName(edge(mentions.select("document_id", "name").distinct(), d, entity, "HAS_ENTITY"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label, edges by type, orphans."""
    row = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    lonely = orphans(nodes, edges).agg(F.lit("orphans").alias("kind"), F.lit("all").alias("name"), F.count("*").alias("n"))
    return row(nodes, "nodes", "label").unionByName(row(edges, "edges", "rel_type")).unionByName(lonely)
