"""The library's concepts over the given tables: chunks, titles, queries, entities, graph, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_of(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per line, with the text's first line as title."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return d.select(
        F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").alias("document_id"), "chunk_index", "content", title_of(F.col("text")).alias("title"), "lang", "source", tx.estimated_tokens(F.col("content")).alias("token_count"),
    )


#: DuckDB twin of chunks(), as the start of a WITH clause.
CHUNKS_SQL = r"""WITH lines AS (SELECT doc_id, lang, source, text, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM documents),
chunks AS (SELECT doc_id || '-' || chunk_index AS chunk_id, doc_id AS document_id, chunk_index::INT AS chunk_index, content, string_split(text, chr(10))[1] AS title, lang, source,
  CASE WHEN content = '' THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(content, '[\x{ac00}-\x{d7af}]')) / 3.0 + len(list_filter(string_split_regex(regexp_replace(content, '[\x{ac00}-\x{d7af}]', ' ', 'g'), '\s+'), lambda x: x <> '')) * 1.3::DOUBLE))::BIGINT END AS token_count FROM lines)
"""


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the stated query set, the whole texts of all documents whose number is divisible by 50."""
    return table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


QUERIES_SQL = r"""queries AS (SELECT doc_id::VARCHAR AS query_id, coalesce(text, '') AS query FROM documents WHERE doc_id % 50 = 0)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with a zoned time, the query key and flags."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("int"), "failed": F.col("event_type") == "error"})


EVENTS_SQL = """WITH e AS (SELECT *, (props::JSON ->> '$.k')::INT AS k, event_type = 'error' AS failed FROM events)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, name): names in the documents' titles."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.explode(F.array_distinct(tx.title_keywords(title_of(F.col("text"))))).alias("name"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
KEYWORDS_SQL = rf"""(CASE WHEN {{t}} = '' OR regexp_matches({{t}}, '\.[\p{{{{L}}}}\p{{{{N}}}}_]{{{{2,5}}}}$') THEN [] ELSE list_filter(string_split_regex({{t}}, '[_\-\s]+'), lambda p: length(p) >= 2 AND NOT regexp_full_match(p, '[0-9]+') AND lower(p) NOT IN ({_STOP}))[1:5] END)"""
MENTIONS_SQL = "m AS (SELECT DISTINCT doc_id AS document_id, unnest(list_distinct(" + KEYWORDS_SQL.format(t="string_split(text, chr(10))[1]") + ")) AS name FROM documents)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A small clean graph: regions, nations, customers and suppliers, who supplies and who bought which brand."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, label, key, name: df.select(F.concat(F.lit(label + ":"), F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))
    brands = t("part").select("p_brand").distinct()
    nodes = node(t("region"), "Region", "r_regionkey", "r_name").unionByName(node(t("nation"), "Nation", "n_nationkey", "n_name")).unionByName(node(t("customer"), "Person", "c_custkey", "c_name")).unionByName(node(t("supplier"), "Project", "s_suppkey", "s_name")).unionByName(node(brands, "Topic", "p_brand", "p_brand"))
    edge = lambda df, a, ka, b, kb, kind, w: df.select(F.concat(F.lit(a + ":"), F.col(ka)).alias("src"), F.concat(F.lit(b + ":"), F.col(kb)).alias("dst"), F.lit(kind).alias("rel_type"), w.cast("double").alias("weight"))
    supplied = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
    bought = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey", "p_brand").agg(F.count("*").alias("n"))
    one = F.lit(1.0)
    edges = edge(t("nation"), "Region", "n_regionkey", "Nation", "n_nationkey", "PART_OF", one).unionByName(edge(t("customer"), "Nation", "c_nationkey", "Person", "c_custkey", "CONTAINS", one)).unionByName(edge(t("supplier"), "Nation", "s_nationkey", "Project", "s_suppkey", "CONTAINS", one)).unionByName(edge(supplied, "Project", "l_suppkey", "Topic", "p_brand", "RELATED_TO", F.col("n"))).unionByName(edge(bought, "Person", "o_custkey", "Topic", "p_brand", "RELATED_TO", F.col("n")))
    return nodes, edges


GRAPH_SQL = """WITH RECURSIVE nodes AS (
  SELECT 'Region:' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'Person:' || c_custkey, 'Person', c_name FROM customer UNION ALL SELECT 'Project:' || s_suppkey, 'Project', s_name FROM supplier
  UNION ALL SELECT DISTINCT 'Topic:' || p_brand, 'Topic', p_brand FROM part),
edges AS (
  SELECT 'Region:' || n_regionkey AS src, 'Nation:' || n_nationkey AS dst, 'PART_OF' AS rel_type, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'Nation:' || c_nationkey, 'Person:' || c_custkey, 'CONTAINS', 1.0 FROM customer
  UNION ALL SELECT 'Nation:' || s_nationkey, 'Project:' || s_suppkey, 'CONTAINS', 1.0 FROM supplier
  UNION ALL SELECT 'Project:' || l_suppkey, 'Topic:' || p_brand, 'RELATED_TO', count(*)::DOUBLE FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand
  UNION ALL SELECT 'Person:' || o_custkey, 'Topic:' || p_brand, 'RELATED_TO', count(*)::DOUBLE FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand)
"""
