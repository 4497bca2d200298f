"""Retrieval for a whole table of queries: dense, BM25, fuzzy, sparse and graph-expanded channels, alone and as hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as tx
from docmill.functions.text import tokens

from . import fusion as fu, graph as gr
from .best import CELLS, Best
from .keyword import TextIndex, keyword_top, text_index
from .storage import SMALL_ROWS, small, staged  # noqa: F401

#: Vectors of queries are held by tasks in blocks of so many bytes.
BLOCK_BYTES = 32 << 20
#: Fuzzy terms of more characters meet words on parts, others on what is left without a few characters.
LONG = 12


def top(df: DataFrame, k: int, partition: list[str], key: str, score: str = "score") -> DataFrame:
    """The k best rows of each group, ties by key; cut within partitions before the shuffle."""
    r = F.row_number().over(W.partitionBy(*partition).orderBy(F.desc(score), key))
    return df.withColumn("rank", r).where(F.col("rank") <= k)


def as_matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10, digits: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """H1: (query_id, vector) against unit (chunk_id, vector): the k best by cosine, scored (1 + cosine) / 2.

    Exact: every query, a stated set, meets every vector as a matrix product per batch; queries are held in blocks of
    bounded bytes, and only k rows of each query and partition are shuffled. A pre-filter is a filter of vectors. Null
    vectors and those of another length than the queries' find nothing and are not found. With digits, scores are
    rounded before they are ranked.
    """
    q = queries.where(F.size("vector") > 0).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    n, width = q.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    out = queries.sparkSession.createDataFrame([], schema)
    blocks = -(-n * (width or 0) * 8 // block_bytes)
    for b in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).where(F.size("vector") == width).collect()
        if rows:
            part = vectors.where(F.size("vector") == width).select("chunk_id", "vector").mapInArrow(best_of(rows, k, digits, schema), schema)
            part = part if blocks == 1 else staged(top(part, k, ["query_id"], "chunk_id").drop("rank"), "block-best")  # one block is held at a time
            out = out.unionByName(part) if blocks > 1 else part
    return top(out, k, ["query_id"], "chunk_id")


def best_of(rows: list, k: int, digits: int | None, schema: T.StructType) -> Callable:
    """For each query of a block its k best vectors of a partition, lower ids first among equal scores."""
    ids, matrix = pa.array([r.query_id for r in rows]), np.array([r.vector for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(len(ids), k, digits), max(1, CELLS // len(ids))  # however many queries a block has
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                chunk = part.column(0).to_numpy(zero_copy_only=False)
                best.take((1 + matrix @ as_matrix(part.column(1)).T) / 2, chunk.astype(str) if chunk.dtype == object else chunk)
        query, chunk, score = best.rows()
        if len(query):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(chunk), pa.array(score)], names=schema.names)

    return run


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def asked_once(queries: DataFrame) -> tuple[DataFrame, Callable]:
    """queries (query_id, query), one of all that have the same text, and what gives rows (query_id, ...) found for these to the others."""
    each = staged(queries.select("query_id", F.coalesce(F.sha2("query", 256), F.lit("")).alias("h")).distinct(), "query-hashes")
    first = each.groupBy("h").agg(F.min("query_id").alias("same_as"))
    same = staged(each.join(first, "h").select("query_id", "same_as"), "same-queries")
    if same.where("query_id <> same_as").isEmpty():
        return queries, lambda found: found
    spread = lambda found: found.withColumnRenamed("query_id", "same_as").join(same, "same_as").select(found.columns)
    return queries.join(same.where("query_id = same_as").select("query_id"), "query_id", "left_semi"), spread


def rounded(scores: DataFrame, digits: int | None) -> DataFrame:
    return scores if digits is None else scores.withColumn("score", F.round("score", digits))


def keyword_search(queries: DataFrame, docs: DataFrame | TextIndex, boosts: dict[str, float], k: int = 10, digits: int | None = None, fuzzy: bool = False) -> DataFrame:
    """H2: (query_id, chunk_id, score, rank), the best field's BM25 with boosts; with fuzzy also for words like the query's."""
    index = docs if isinstance(docs, TextIndex) else text_index(docs, list(boosts), once=True)
    queries, spread = asked_once(queries)
    terms = query_terms(queries)
    return spread(keyword_top(fuzzy_weights(terms, index) if fuzzy else terms, index, boosts, k, digits).drop("channel"))


def fuzzy_weights(terms: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, term, weight): what stands for a query's terms in the documents, exact ones with weight 1.

    A word e edits away weighs 1 - e / length of the shorter of both; of several terms that a word is like the nearest counts.
    """
    like = fuzzy_terms(terms, index.frequencies.select("term"))
    near = 1 - F.levenshtein("term", "word") / F.least(F.length("term"), F.length("word"))
    return like.groupBy("query_id", F.col("word").alias("term")).agg(F.max(near).alias("weight")).where("weight > 0")


def pieces(word: Column, length: Column, edits: Column, shifts: bool) -> Column:
    """The edits + 1 parts of a word of that length, each (part number, text), also shifted by up to edits places."""
    start = lambda j: F.floor(j * length / (edits + 1)).cast("int")
    move = F.sequence(-edits, edits) if shifts else F.array(F.lit(0))
    one = lambda j: F.transform(move, lambda s: F.struct(j.alias("j"), F.substr(word, F.greatest(F.lit(0), start(j) + s) + 1, start(j + 1) - start(j)).alias("piece")))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), edits), one)))


def allowed_edits(length: Column) -> Column:
    return F.when(length < 3, 0).when(length <= 5, 1).otherwise(2)


def variants(word: Column, edits: Column) -> Column:
    """Hashes of the word and of what is left of it without up to `edits` of its characters, the first one always kept."""
    less = lambda w: F.transform(F.sequence(F.lit(2), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    none = F.array().cast("array<string>")
    one = F.when((edits > 0) & (F.length(word) > 1), less(word)).otherwise(none)
    two = F.when(edits > 1, F.flatten(F.transform(F.filter(one, lambda w: F.length(w) > 1), less))).otherwise(none)
    return F.transform(F.array_distinct(F.concat(F.array(word), one, two)), lambda w: F.xxhash64(w))


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """H3: (query_id, term, word) with the same first letter, within 0, 1 or 2 edits by the term's length.

    Words within e edits have a common rest once up to e characters are left out of each; candidates meet on whole rests,
    which few words share, and the first letter stays, as that of both is the same. Terms longer than LONG, with many
    rests, meet on parts: a word within e edits keeps one of the term's e + 1 parts, at most e places away. Candidates
    are compared where they meet, and only like words are shuffled.
    """
    t = staged(terms.select("term").distinct().where(F.length("term") > 0).withColumn("size", F.length("term")).withColumn("edits", allowed_edits(F.col("size"))), "terms-asked")
    v = staged(vocabulary.select(F.col("term").alias("word")).distinct().where(F.length("word") > 0), "vocabulary")
    like = F.levenshtein("term", "word") <= F.col("edits")
    short = t.where(F.col("size") <= LONG).select("term", "edits", F.explode(variants(F.col("term"), F.col("edits"))).alias("rest"))
    # What a term two characters longer may differ in, at most.
    most = allowed_edits(F.length("word") + 2)
    rests = v.where(F.length("word") <= LONG + 2).select("word", F.explode(variants(F.col("word"), most)).alias("rest"))
    # Rows are exploded after their size is estimated, so a join left to choose might broadcast them through the driver.
    pairs = short.join(rests.hint("merge"), "rest").where(like).select("term", "word").distinct()
    t = t.where(F.col("size") > LONG).withColumn("lead", F.substring("term", 1, 1))
    if not t.isEmpty():
        t = t.select("term", "edits", "lead", "size", F.explode(pieces(F.col("term"), F.col("size"), F.col("edits"), False)).alias("p")).select("term", "edits", "lead", "size", "p.*")
        sizes = F.sequence(F.greatest(F.lit(LONG + 1), F.length("word") - 2), F.length("word") + 2)
        w = v.where(F.length("word") >= LONG - 1).select("word", F.substring("word", 1, 1).alias("lead"), F.explode(sizes).alias("size")).withColumn("e", allowed_edits(F.col("size")))
        w = w.select("word", "lead", "size", F.explode(pieces(F.col("word"), F.col("size"), F.col("e"), True)).alias("p")).select("word", "lead", "size", "p.*")
        pairs = pairs.unionByName(t.join(w.hint("merge"), ["lead", "size", "j", "piece"]).where(like).select("term", "word").distinct())
    return terms.select("query_id", "term").distinct().join(staged(pairs, "like-words").hint("merge"), "term").select("query_id", "term", "word")


def sparse_weights(index: TextIndex, field: str, n_docs: int, least: float = 0.01, most: int = 50, digits: int = 6, only: DataFrame | None = None) -> DataFrame:
    """(chunk_id, token, weight): tf * idf of the heaviest tokens of each document, or of those of only (chunk_id)."""
    w = index.term_counts(field, only, n_docs, least, most, 2 * 10.0**-digits)
    w = w.select("chunk_id", F.col("term").alias("token"), F.round(F.col("tf") / F.col("len") * F.log(F.lit(n_docs) / F.col("df")), digits).alias("weight"))
    return top(w.where(F.col("weight") >= least), most, ["chunk_id"], "token", "weight").drop("rank")


def sparse_search(queries: DataFrame, weights: DataFrame, candidates: DataFrame, k: int = 10, digits: int | None = None) -> DataFrame:
    """H4: dot products of (query_id, token, weight) with (chunk_id, token, weight) over candidate (query_id, chunk_id)."""
    q = queries.select("query_id", "token", F.col("weight").alias("qw"))
    # Candidates are few for each query: they meet the weights of their own chunks, then their query's tokens.
    s = weights.join(small(candidates.select("query_id", "chunk_id").distinct()), "chunk_id").join(small(q), ["query_id", "token"])
    s = rounded(s.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score")), digits)
    return top(s.where("score > 0"), k, ["query_id"], "chunk_id")


def graph_names(queries: DataFrame, mentions: DataFrame, edges: DataFrame | None = None, gram: int = 2) -> DataFrame:
    """(query_id, name, r), names that a query's words match, then their nearest neighbours.

    mentions: (document_id, name); edges (src, dst, rel_type, weight) between names, else names of one document are tied.
    """
    m = mentions.where(~tx.is_junk_name(F.col("name")))
    words = queries.select("query_id", F.explode(tx.query_words(F.col("query"))).alias("word"))
    nodes = staged(m.select(F.col("name").alias("id"), "name").distinct(), "names")
    seeds = staged(gr.name_matches(words, nodes.select("name"), gram=gram).select("query_id", F.col("name").alias("id")), "seeds")
    if edges is None:
        edges = gr.cooccurrences(m).groupBy(F.col("name1").alias("src"), F.col("name2").alias("dst")).agg(F.count("*").cast("double").alias("weight")).withColumn("rel_type", F.lit("RELATED_TO"))
    e = gr.expanded_names(seeds, nodes, edges)
    return e.select("query_id", "name", F.row_number().over(W.partitionBy("query_id").orderBy("hop", "name")).alias("r"))


def name_terms(names: DataFrame, boost: float = 1.5, most_names: int = 10) -> DataFrame:
    """(query_id, term, weight) of a query's first names (query_id, name, r).

    Each name is a clause of its own, so a term counts once for each name that holds it.
    """
    first = names.where(F.col("r") <= most_names).select("query_id", "name")
    return first.select("query_id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("term")).groupBy("query_id", "term").agg((F.count("*") * boost).alias("weight"))


def graph_search(queries: DataFrame, names: DataFrame, docs: DataFrame | TextIndex, boosts: dict[str, float], field: str, k: int = 10, digits: int | None = None) -> DataFrame:
    """H5: keyword scores plus 1.5 times the score in a field of each expanded name (query_id, name, r), for the texts that match the query.

    Queries without a name find nothing. docs holds the rows that the query may see, so filters hold here as in the
    other channels.
    """
    index = docs if isinstance(docs, TextIndex) else text_index(docs, list(boosts), once=True)
    # Names are given by query, so queries of the same text may have other names, and are not put together here.
    both = keyword_top(query_terms(queries), index, boosts, 1, digits, name_terms(names), field, k)
    return both.where("channel = 1").drop("channel")


CHANNELS = ("vector", "keyword", "sparse", "graph")


def search_channels(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, mentions: DataFrame, boosts: dict[str, float], k: int = 20, graph_k: int = 10, keep: Column | None = None, field: str = "content", digits: int = 6, index: TextIndex | None = None,
    use: Sequence[str] = CHANNELS, fuzzy: bool = False, keep_in_graph: bool = True
) -> DataFrame:
    """(query_id, channel, chunk_id, rank, score) of the channels in use for queries (query_id, query, vector), computed once.

    docs: (chunk_id, *boosts, ...); keep filters what all channels may find, the graph channel unless keep_in_graph is
    false. Sparse vectors score what the dense and keyword channels found. The keyword and graph channels are one pass
    over the documents.
    """
    if unknown := set(use) - set(CHANNELS):
        raise ValueError(f"no such channel: {', '.join(sorted(unknown))}")
    everything = docs
    if keep is not None:
        docs = docs.where(keep)
        vectors = vectors.join(docs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    index = index or text_index(docs, list(boosts), once=True)
    mark = lambda df, name: df.select("query_id", "chunk_id", "rank", "score", F.lit(name).alias("channel"))
    found = []
    if {"vector", "sparse"} & set(use):
        found.append(mark(staged(dense_search(queries.select("query_id", "vector"), vectors, k, digits), "vector-channel"), "vector"))
    if {"keyword", "graph", "sparse"} & set(use):
        distinct, spread = asked_once(queries.select("query_id", "query"))
        terms = query_terms(distinct)
        names = name_terms(graph_names(distinct, mentions)) if "graph" in use else None
        apart = names is not None and keep is not None and not keep_in_graph
        best = staged(spread(keyword_top(fuzzy_weights(terms, index) if fuzzy else terms, index, boosts, k, digits, None if apart else names, field, graph_k)), "text-channels")
        found.append(mark(best.where("channel = 0"), "keyword"))
        if names is not None:
            best = spread(keyword_top(terms, text_index(everything, list(boosts), once=True), boosts, 1, digits, names, field, graph_k)) if apart else best
            found.append(mark(best.where("channel = 1"), "graph"))
    if "sparse" in use:
        both = found[0].unionByName(found[1]).select("query_id", "chunk_id").distinct()
        asked = query_terms(queries).select("query_id", F.col("term").alias("token"), F.lit(1.0).alias("weight"))
        weights = sparse_weights(index, field, docs.count(), digits=digits, only=both.select("chunk_id").distinct())
        found.append(mark(sparse_search(asked, weights, both, k, digits), "sparse"))
    return staged(reduce(DataFrame.unionByName, found).where(F.col("channel").isin(list(use))), "channels")


def routed(channels: DataFrame, queries: DataFrame) -> DataFrame:
    """Of each query's channels those that its type asks for; a hybrid takes all."""
    plan = queries.select("query_id", tx.search_strategy(tx.query_type(F.col("query"))).alias("strategy"))
    return channels.join(small(plan), "query_id").where((F.col("strategy") == "hybrid") | (F.col("strategy") == F.col("channel"))).drop("strategy")


def channel_counts(channels: DataFrame, use: Sequence[str] = CHANNELS) -> DataFrame:
    """(query_id, vector, keyword, sparse, graph): how many rows each channel in use gave a query that has any."""
    return channels.groupBy("query_id").agg(*[F.count_if(F.col("channel") == c).alias(c) for c in use])


def with_entities(results: DataFrame, mentions: DataFrame, most: int = 5) -> DataFrame:
    """Results with entities, the first names of each chunk by mentions (chunk_id, name); none is an empty array."""
    names = gr.chunk_entities(results, mentions, most)
    return results.join(names, "chunk_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def hybrid_search(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, mentions: DataFrame, boosts: dict[str, float], k: int = 10, keep: Column | None = None, weights: dict[str, float] = fu.WEIGHTS, by_type: bool = False, scorer: Callable = fu.overlap_score, channels: DataFrame | None = None,
    use: Sequence[str] = CHANNELS, fuzzy: bool = False, keep_in_graph: bool = True, chunk_mentions: DataFrame | None = None
) -> DataFrame:
    """The channels in use, fused by weighted reciprocal ranks and reranked, with the texts; by_type routes queries.

    Channels give 2 * k rows each, the graph channel k; with chunk_mentions (chunk_id, name) results carry their entities.
    """
    found = channels if channels is not None else search_channels(queries, docs, vectors, mentions, boosts, 2 * k, k, keep, use=use, fuzzy=fuzzy, keep_in_graph=keep_in_graph)
    found = routed(found, queries) if by_type else found
    best = staged(fu.fused(fu.contributions(found, weights)).where(F.col("rank") <= min(3 * k, 50)), "fused")
    # Documents that were found are few for each query; queries are a stated set of whole texts and are shuffled.
    pool = docs.select("chunk_id", "document_id", "content").join(small(best), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    out = fu.reranked(pool, k, scorer)
    return out if chunk_mentions is None else with_entities(staged(out, "results"), chunk_mentions)


def suggestions(history: DataFrame, part: str, most: int) -> DataFrame:
    """Distinct past queries that contain what was typed, else the popular ones."""
    hit = history.where(F.contains(F.lower("query"), F.lit(part.lower()))).groupBy("query").agg(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    popular = history.groupBy("query").agg(F.lit(1).alias("kind"), (-F.count("*")).alias("n"))
    # Either list is cut to what can be shown before the choice between them.
    best = hit.orderBy("query").limit(most).unionByName(popular.orderBy("n", "query").limit(most))
    best = best.withColumn("best", F.min("kind").over(W.partitionBy()))
    return best.where(F.col("kind") == F.col("best")).orderBy("n", "query").select(F.col("query").alias("suggestion"))
