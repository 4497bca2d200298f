"""Registered queries: graphs, merges, deletes, reconciliation and checks (C, D10, E3, J10, J12, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators import graph as gr, quality as qu, retrieval as rt, sinks as si, subgraph as sg
from docmill.operators.storage import staged

from .registry import query
from .search_queries import ALL_SQL, BM25_SQL, DENSE_SQL, FIELDS, RERANK_SQL, WITH, docs_of, searched, tok, vectors_of
from .views import CHUNKS_SQL, GRAPH_SQL, MENTIONS_SQL, chunks, graph, mentions, table

UND = "u AS (SELECT src AS node, dst AS other, rel_type, weight FROM edges UNION ALL SELECT dst, src, rel_type, weight FROM edges)"
M = "WITH " + MENTIONS_SQL
CM = CHUNKS_SQL + ", " + MENTIONS_SQL + ", l AS (SELECT DISTINCT chunk_id, c.document_id, name FROM chunks c JOIN m USING (document_id) WHERE contains(lower(content), lower(name)))"
JUNK = "length(name) < 2 OR name = 'None' OR starts_with(name, '/') OR starts_with(name, '.') OR " + " OR ".join(f"contains(name, '{p}')" for p in tx.JUNK_PARTS)
JUNK_ALL = JUNK + "".join(f" OR contains(name, '{p}')" for p in tx.JUNK_DOCS)


def linked(spark, d):
    return gr.mention_edges(chunks(spark, d), mentions(spark, d))


@query("c20_mention_links", CM + " SELECT chunk_id, document_id, name FROM l")
def c20(spark, d):
    return linked(spark, d)


@query("c2_chunk_entities", CM + f", r AS (SELECT chunk_id, name FROM l WHERE NOT ({JUNK}) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY name) <= 5) SELECT chunk_id, string_agg(name, '|' ORDER BY name) AS entities FROM r GROUP BY chunk_id")
def c2(spark, d):
    e = gr.chunk_entities(chunks(spark, d), linked(spark, d).select("chunk_id", "name"))
    return e.select("chunk_id", F.array_join("entities", "|").alias("entities"))


# Two channels of ten rows, fused, the best fifteen reranked to five.
TWO_SQL = WITH + DENSE_SQL + ", " + BM25_SQL + ", " + MENTIONS_SQL + """,
ch AS (SELECT query_id, chunk_id, rank, 'vector' AS channel, 0 AS no, 1.0::DOUBLE AS w FROM dense WHERE rank <= 10 AND query_id IN (SELECT query_id FROM queries) UNION ALL SELECT query_id, chunk_id, rank, 'keyword', 1, 1.0 FROM keyword WHERE rank <= 10),
fu AS (""" + ALL_SQL.split("fu AS (")[1] + RERANK_SQL.removeprefix(ALL_SQL).replace("rank <= 30", "rank <= 15").replace("rerank <= 10", "rerank <= 5")


@query("h10_entities_and_counts", TWO_SQL + f""", en AS (SELECT document_id AS chunk_id, string_agg(name, '|' ORDER BY name) AS entities FROM (SELECT document_id, name FROM m WHERE NOT ({JUNK}) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY name) <= 5) GROUP BY 1),
nc AS (SELECT query_id, count(*) FILTER (channel = 'vector')::BIGINT AS n_vector, count(*) FILTER (channel = 'keyword')::BIGINT AS n_keyword FROM ch GROUP BY 1)
SELECT query_id, chunk_id, score, rerank, coalesce(entities, '') AS entities, n_vector, n_keyword FROM rk JOIN nc USING (query_id) LEFT JOIN en USING (chunk_id)""")
def h10_parts(spark, d):
    use, names = ("vector", "keyword"), mentions(spark, d)
    asked, docs, vectors = searched(spark, d), docs_of(spark, d), vectors_of(spark, d)
    found = rt.search_channels(asked, docs, vectors, names, FIELDS, 10, 5, use=use)
    best = rt.hybrid_search(asked, docs, vectors, names, FIELDS, 5, channels=found, chunk_mentions=names.withColumnRenamed("document_id", "chunk_id"))
    n = rt.channel_counts(found, use).withColumnsRenamed({"vector": "n_vector", "keyword": "n_keyword"})
    return best.join(n, "query_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rerank").cast("long").alias("rerank"), F.array_join("entities", "|").alias("entities"), "n_vector", "n_keyword")


@query("c3_resolved_relations", GRAPH_SQL + "SELECT e.src, e.dst, a.name AS src_name, b.name AS dst_name, CASE WHEN upper(e.rel_type) IN ('PART_OF', 'RELATED_TO') THEN upper(e.rel_type) ELSE 'RELATED_TO' END AS rel_type FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.label <> 'Topic' AND b.label <> 'Topic'")
def c3(spark, d):
    nodes, edges = graph(spark, d)
    return gr.resolved_relations(edges, nodes.where("label <> 'Topic'")).select("src", "dst", "src_name", "dst_name", "rel_type")


@query("c4_cooccurrences", M + " SELECT a.document_id, a.name AS name1, b.name AS name2 FROM m a JOIN m b ON a.document_id = b.document_id AND a.name < b.name")
def c4(spark, d):
    return gr.cooccurrences(mentions(spark, d))


@query("c5_induced_edges", GRAPH_SQL + ", n AS (SELECT id FROM nodes WHERE label IN ('Region', 'Nation', 'Project')) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, rel_type FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def c5(spark, d):
    nodes, edges = graph(spark, d)
    return gr.induced_edges(edges, nodes.where(F.col("label").isin("Region", "Nation", "Project")))


@query("c6_expanded_names", GRAPH_SQL + ", " + UND + f""", s AS (SELECT name AS query_id, id FROM nodes WHERE label = 'Nation'),
near AS (SELECT query_id, s.id, other FROM s JOIN u ON s.id = u.node QUALIFY row_number() OVER (PARTITION BY query_id, s.id ORDER BY weight DESC, other) <= 3),
a AS (SELECT query_id, id, min(hop) AS hop FROM (SELECT query_id, id, 0 AS hop FROM s UNION ALL SELECT query_id, other, 1 FROM near) GROUP BY ALL)
SELECT query_id, a.id, name, hop FROM a JOIN nodes USING (id) WHERE NOT ({JUNK_ALL}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, name, a.id) <= 20""")
def c6(spark, d):
    nodes, edges = graph(spark, d)
    seeds = nodes.where("label = 'Nation'").select(F.col("name").alias("query_id"), "id")
    return gr.expanded_names(seeds, nodes, edges).select("query_id", "id", "name", "hop")


@query("c7_k_hop", GRAPH_SQL + ", " + UND + """, d AS (SELECT DISTINCT node, other FROM u),
h AS (SELECT id AS centre, id, 0 AS hop FROM nodes WHERE label = 'Region' UNION SELECT centre, other, hop + 1 FROM h JOIN d ON d.node = h.id WHERE hop < 2),
b AS (SELECT centre, id, min(hop) AS hop FROM h GROUP BY ALL)
SELECT centre, id, hop FROM b QUALIFY row_number() OVER (PARTITION BY centre ORDER BY hop, id) <= 50""")
def c7(spark, d):
    nodes, edges = graph(spark, d)
    return gr.k_hop(edges, nodes.where("label = 'Region'"), 2, 50)


def asked_names(spark, d):
    """(query_id, asked): regions by name, customers whose number is divisible by 50, nations by a part of the name or by more than it."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    ask = lambda df, kind, key, asked: df.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("query_id"), asked.alias("asked"))
    out = ask(region, "whole:", "r_regionkey", F.concat("r_name", F.lit(" region"))).unionByName(ask(table(spark, d, "customer").where("c_custkey % 50 = 0"), "customer:", "c_custkey", F.col("c_name")))
    return out.unionByName(ask(nation, "start:", "n_nationkey", F.substring("n_name", 1, 4))).unionByName(ask(nation, "long:", "n_nationkey", F.concat("n_name", F.lit("ese"))))


NEAR_SQL = GRAPH_SQL + ", " + UND + f""", d AS (SELECT DISTINCT node, other FROM u), linked AS (SELECT id, name FROM nodes WHERE id IN (SELECT node FROM u)),
asked AS (SELECT 'whole:' || r_regionkey AS query_id, r_name || ' region' AS asked FROM region UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'start:' || n_nationkey, n_name[1:4] FROM nation UNION ALL SELECT 'long:' || n_nationkey, n_name || 'ese' FROM nation),
nt AS (SELECT id, {tok('name')} AS t FROM linked), p AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM nt) GROUP BY ALL), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM nt WHERE len(t) > 0), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT DISTINCT query_id, unnest({tok('asked')}) AS term FROM asked),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS s FROM qt JOIN p USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
c1 AS (SELECT query_id, id, 'score' AS found_by FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) = 1),
c2 AS (SELECT query_id, id, 'part' AS found_by FROM asked JOIN linked ON contains(name, asked) OR contains(asked, name) WHERE query_id NOT IN (SELECT query_id FROM c1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, id) = 1),
c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
h AS (SELECT DISTINCT id AS centre, id, 0 AS hop FROM c UNION SELECT centre, other, hop + 1 FROM h JOIN d ON d.node = h.id WHERE hop < 2),
b AS (SELECT centre, id, min(hop) AS hop FROM h GROUP BY ALL), near AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY centre ORDER BY hop, id) <= 50)"""


@query("c7_subgraph_nodes", NEAR_SQL + " SELECT query_id, c.id AS centre, found_by, near.id AS id, hop FROM c JOIN near ON near.centre = c.id")
def c7_nodes(spark, d):
    return sg.subgraph(asked_names(spark, d), *graph(spark, d))[0].select("query_id", "centre", "found_by", "id", "hop")


@query("c7_subgraph_edges", NEAR_SQL + " SELECT DISTINCT query_id, least(src, dst) AS a, greatest(src, dst) AS b, rel_type FROM c JOIN near x ON x.centre = c.id JOIN edges ON src = x.id JOIN near y ON y.centre = c.id AND y.id = dst WHERE src <> dst")
def c7_edges(spark, d):
    return sg.subgraph(asked_names(spark, d), *graph(spark, d))[1].select("query_id", "a", "b", "rel_type")


@query("c8_topic_experts", GRAPH_SQL + ", " + UND + """, h AS (SELECT p.id AS person, p.name AS person_name, t.id AS topic FROM nodes t JOIN u ON u.node = t.id JOIN nodes p ON p.id = u.other WHERE t.label = 'Topic' AND p.label = 'Person' AND contains(lower(t.name), 'brand#1'))
SELECT person, person_name, count(*)::BIGINT AS relations, count(DISTINCT topic)::BIGINT AS n_topics, round(least(1.0, (count(*) + 0.5::DOUBLE * count(DISTINCT topic)) / 10), 6) AS score FROM h GROUP BY ALL ORDER BY score DESC, relations DESC, person LIMIT 25""")
def c8(spark, d):
    return gr.topic_experts(*graph(spark, d), "Brand#1", 25).select("person", "person_name", "relations", "n_topics", "score")


@query("c10_reconciliation", """WITH l AS (SELECT o_orderkey AS document_id, 1 + o_orderkey % 7 AS n FROM orders WHERE o_orderkey % 10 <> 3), r AS (SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 4 GROUP BY 1)
SELECT coalesce(l.document_id, r.document_id) AS document_id, CASE WHEN r.n IS NULL THEN 'only_left' WHEN l.n IS NULL THEN 'only_right' WHEN l.n <> r.n THEN 'count_differs' ELSE 'same' END AS kind, (coalesce(l.n, 0) - coalesce(r.n, 0))::BIGINT AS diff FROM l FULL JOIN r ON l.document_id = r.document_id""")
def c10(spark, d):
    left = table(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("document_id"), (1 + F.col("o_orderkey") % 7).alias("n"))
    right = table(spark, d, "lineitem").where("l_orderkey % 10 <> 4").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count("*").alias("n"))
    return qu.reconciled(left, right).select("document_id", "kind", "diff")


@query("c12_name_matches", """WITH w AS (SELECT DISTINCT item_id::VARCHAR AS query_id, lower(unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) >= 3))) AS word FROM benchmark), """ + MENTIONS_SQL + """, n AS (SELECT DISTINCT name FROM m),
b AS (SELECT query_id, name, min(CASE WHEN lower(name) = word THEN 0 ELSE 1 END) AS kind FROM w JOIN n ON contains(lower(name), word) GROUP BY ALL),
r AS (SELECT * FROM b QUALIFY kind = 0 OR row_number() OVER (PARTITION BY query_id, kind ORDER BY name) <= 15)
SELECT query_id, name, kind FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY kind, name) <= 20""")
def c12(spark, d):
    b = table(spark, d, "benchmark")
    w = b.select(F.col("item_id").cast("string").alias("query_id"), F.explode(F.filter(tx.words(F.col("text")), lambda x: F.length(x) >= 3)).alias("word"))
    return gr.name_matches(w, mentions(spark, d).select("name").distinct()).select("query_id", "name", "kind")


@query("c15_orphans", GRAPH_SQL + "SELECT id FROM nodes WHERE label = 'Person' AND id NOT IN (SELECT dst FROM edges WHERE rel_type = 'RELATED_TO') AND id NOT IN (SELECT src FROM edges WHERE rel_type = 'RELATED_TO')")
def c15(spark, d):
    nodes, edges = graph(spark, d)
    return gr.orphans(nodes.where("label = 'Person'"), edges.where("rel_type = 'RELATED_TO'")).select("id")


@query("d10_graph_statistics", GRAPH_SQL + "SELECT 'nodes' AS kind, label AS name, count(*)::BIGINT AS n FROM nodes GROUP BY label UNION ALL SELECT 'edges', rel_type, count(*)::BIGINT FROM edges GROUP BY rel_type UNION ALL SELECT 'orphans', 'all', count(*)::BIGINT FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)")
def d10(spark, d):
    return gr.graph_statistics(*graph(spark, d))


@query("e3_first_occurrences", "SELECT event_type, k, min(event_id) AS first_id FROM (SELECT lower(trim(event_type)) AS event_type, (props::JSON ->> '$.k')::INT AS k, event_id FROM events) GROUP BY ALL")
def e3(spark, d):
    from docmill.operators.filters import numbered

    e = table(spark, d, "events").select(F.lower(F.trim("event_type")).alias("event_type"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id")
    return numbered(e, ["event_type", "k"], ["event_id"]).where("rank = 1").select("event_type", "k", F.col("event_id").alias("first_id"))


@query("h17_entity_lookup", GRAPH_SQL + ", w AS (SELECT l_orderkey, l_linenumber, 'Project:' || l_suppkey AS wanted FROM lineitem UNION ALL SELECT o_orderkey, 0, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') FROM orders) SELECT l_orderkey AS k, l_linenumber::BIGINT AS no, id, label FROM w JOIN nodes ON wanted = nodes.id OR wanted = nodes.name")
def h17(spark, d):
    by_id = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("no"), F.concat(F.lit("Project:"), "l_suppkey").alias("wanted"))
    by_name = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("no"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("wanted"))
    return gr.looked_up(by_id.unionByName(by_name), graph(spark, d)[0]).select("k", "no", "id", "label")


@query("i5_candidate_union", M + " SELECT DISTINCT document_id FROM m UNION SELECT doc_id FROM labels WHERE toxic = 1")
def i5(spark, d):
    t = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return mentions(spark, d).select("document_id").unionByName(t).dropDuplicates()


@query("j10_load_validation", CHUNKS_SQL + """, f AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS failed, (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM documents WHERE text = '') AS without_chunks, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS orphans, 0 AS queries)
SELECT 'documents' AS "check", documents::DOUBLE AS value, CASE WHEN documents >= 10 THEN 'PASS' WHEN documents >= 5 THEN 'WARNING' ELSE 'FAIL' END AS level FROM f
UNION ALL SELECT 'chunks', chunks, CASE WHEN chunks >= 2 * documents THEN 'PASS' WHEN chunks > 0 THEN 'WARNING' ELSE 'FAIL' END FROM f
UNION ALL SELECT 'entities', entities, CASE WHEN entities >= 5 THEN 'PASS' ELSE 'WARNING' END FROM f
UNION ALL SELECT 'mean_chunks', round(chunks / documents::DOUBLE, 6), CASE WHEN chunks / documents::DOUBLE BETWEEN 2 AND 100 THEN 'PASS' ELSE 'WARNING' END FROM f
UNION ALL SELECT 'failure_rate', round(failed / files::DOUBLE, 6), CASE WHEN failed / files::DOUBLE < 0.1 THEN 'PASS' WHEN failed / files::DOUBLE < 0.3 THEN 'WARNING' ELSE 'FAIL' END FROM f
UNION ALL SELECT 'seconds_per_file', 2.0, 'PASS' FROM f
UNION ALL SELECT 'without_chunks', round(without_chunks / documents::DOUBLE, 6), CASE WHEN without_chunks = 0 THEN 'PASS' WHEN without_chunks / documents::DOUBLE <= 0.05 THEN 'WARNING' ELSE 'FAIL' END FROM f
UNION ALL SELECT 'sample_queries', NULL, 'SKIP' FROM f
UNION ALL SELECT 'orphan_rate', round(orphans / entities::DOUBLE, 6), CASE WHEN orphans / entities::DOUBLE <= 0.01 THEN 'PASS' WHEN orphans / entities::DOUBLE <= 0.05 THEN 'WARNING' ELSE 'FAIL' END FROM f""")
def j10(spark, d):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    t = lambda x: table(spark, d, x)
    unused = t("part").join(t("lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    facts = n(t("documents"), "documents")
    for df in (n(chunks(spark, d), "chunks"), n(t("part"), "entities"), n(t("orders").where("o_orderstatus = 'O'"), "failed"), n(t("orders"), "files"), n(t("documents").where("text = ''"), "without_chunks"), n(unused, "orphans")):
        facts = facts.join(F.broadcast(df))
    facts = facts.withColumns({"queries": F.lit(0), "answered": F.lit(0), "seconds": F.col("files") * 2.0})
    return qu.load_validation(facts)


@query("j12_constraints", "SELECT 'unique_order' AS \"check\", (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))::BIGINT AS violations UNION ALL SELECT 'unique_line', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))::BIGINT UNION ALL SELECT 'ship_after_order', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)::BIGINT UNION ALL SELECT 'rating', (SELECT count(*) FROM lineitem WHERE l_linenumber NOT BETWEEN 1 AND 5)::BIGINT")
def j12(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    dated = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    out = qu.duplicate_keys(o, ["o_orderkey"], "unique_order").unionByName(qu.duplicate_keys(li, ["l_orderkey", "l_linenumber"], "unique_line"))
    return out.unionByName(qu.broken_rows(dated, F.col("l_shipdate") < F.col("o_orderdate"), "ship_after_order")).unionByName(qu.broken_rows(li, ~F.col("l_linenumber").between(1, 5), "rating"))


@query("l1_upsert", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM documents UNION ALL SELECT doc_id + 10000000, 'new' FROM documents WHERE doc_id % 4 = 0")
def l1(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.lit("old").alias("state"))
    hit = base.where("doc_id % 4 = 0").withColumn("state", F.lit("new"))
    return si.upserted(base, hit.unionByName(hit.withColumn("doc_id", F.col("doc_id") + 10_000_000)), "doc_id")


@query("l1_checked_upsert", """WITH new AS (SELECT CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id - doc_id % 3 END AS doc_id, n_chars, lang, doc_id AS version FROM documents),
j AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'key' WHEN NOT coalesce(n_chars >= 200, false) THEN 'size' WHEN lang = 'fr' THEN 'lang' END AS reason FROM new),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS r FROM j WHERE reason IS NULL),
b AS (SELECT doc_id, n_chars, lang, -1 AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s))
SELECT 'row' AS kind, doc_id, n_chars, lang, version, NULL AS reason FROM b UNION ALL SELECT 'row', doc_id, n_chars, lang, version, NULL FROM s WHERE r = 1
UNION ALL SELECT 'error', coalesce(doc_id, -1), n_chars, lang, version, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT 'error', doc_id, n_chars, lang, version, 'superseded' FROM s WHERE r > 1""")
def l1_checked(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    new = docs.select(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") - F.col("doc_id") % 3).alias("doc_id"), "n_chars", "lang", F.col("doc_id").alias("version"))
    rules = {"size": F.col("n_chars") >= 200, "lang": F.col("lang") != "fr"}
    rows, errors = si.upserted_checked(docs.withColumn("version", F.lit(-1).cast("long")), new, "doc_id", rules, [F.col("version")])
    one = lambda df, kind, reason: df.select(F.lit(kind).alias("kind"), F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"), "n_chars", "lang", "version", reason.cast("string").alias("reason"))
    return one(rows, "row", F.lit(None)).unionByName(one(errors, "error", F.col("reason") if "reason" in errors.columns else F.lit(None)))


@query("l2_insert_or_update", "SELECT doc_id, lang AS title, CASE WHEN doc_id % 4 = 0 THEN 'done' ELSE source END AS status FROM documents")
def l2(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), F.col("source").alias("status"))
    new = base.where("doc_id % 4 = 0").select("doc_id", F.lit("other").alias("title"), F.lit("done").alias("status"))
    return si.insert_or_update(base, new, "doc_id", ["title"])


@query("l3_l4_merged_nodes", "SELECT event_type AS label, user_id::VARCHAR AS name, max_by(event_id, event_id) AS latest, min(event_id) FILTER (event_id % 3 <> 0) AS first FROM events GROUP BY ALL")
def l3(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("label"), F.col("user_id").cast("string").alias("name"), "event_id")
    latest = gr.merged_nodes(e.withColumns({"description": F.col("event_id"), "ts": F.col("event_id")})).select("label", "name", F.col("description").alias("latest"))
    first = gr.merged_nodes(e.withColumns({"description": F.when(F.col("event_id") % 3 != 0, F.col("event_id")), "ts": F.col("event_id")}), True).select("label", "name", F.col("description").alias("first"))
    return latest.join(first, ["label", "name"])


@query("l5_merged_edges", "SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel_type, max_by(l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber) AS description, count(*)::BIGINT AS seen FROM lineitem GROUP BY ALL")
def l5(spark, d):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel_type"), key.alias("description"), key.alias("ts"))
    return gr.merged_edges(e)


@query("l6_document_graph", CM + """ SELECT 'node' AS kind, 'doc:' || doc_id AS a, 'Document' AS b, md5(string_split(text, chr(10))[1]) AS c FROM documents UNION ALL SELECT 'node', 'chunk:' || chunk_id, 'Chunk', md5(substr(content, 1, 500)) FROM chunks UNION ALL SELECT DISTINCT 'node', 'entity:' || name, 'Entity', md5(name) FROM l
UNION ALL SELECT 'edge', 'doc:' || document_id, 'chunk:' || chunk_id, 'CONTAINS' FROM chunks UNION ALL SELECT 'edge', 'chunk:' || chunk_id, 'doc:' || document_id, 'PART_OF' FROM chunks UNION ALL SELECT 'edge', 'chunk:' || chunk_id, 'entity:' || name, 'MENTIONS' FROM l UNION ALL SELECT 'edge', 'entity:' || name, 'chunk:' || chunk_id, 'MENTIONED_IN' FROM l UNION ALL SELECT DISTINCT 'edge', 'doc:' || document_id, 'entity:' || name, 'HAS_ENTITY' FROM l""")
def l6(spark, d):
    nodes, edges = gr.document_graph(table(spark, d, "documents"), chunks(spark, d), linked(spark, d))
    rows = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[x.alias(n) for x, n in zip(c, "abc")])
    return rows(nodes, "node", F.col("id"), F.col("label"), F.md5(F.col("name").cast("binary"))).unionByName(rows(edges, "edge", F.col("src"), F.col("dst"), F.col("rel_type")))


@query("l7_delete_documents", CHUNKS_SQL + "SELECT document_id, count(*)::BIGINT AS n FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY document_id")
def l7(spark, d):
    gone = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"))
    return si.without(chunks(spark, d), gone, "document_id").groupBy("document_id").agg(F.count("*").alias("n"))


@query("l8_delete_orphans", GRAPH_SQL + ", k AS (SELECT id FROM nodes WHERE id IN (SELECT dst FROM edges WHERE rel_type = 'RELATED_TO') OR id IN (SELECT src FROM edges WHERE rel_type = 'RELATED_TO')) SELECT (SELECT count(*) FROM k)::BIGINT AS nodes_left, count(*)::BIGINT AS edges_left FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def l8(spark, d):
    nodes, edges = (staged(x, "graph") for x in graph(spark, d))
    kept = si.without(nodes, gr.orphans(nodes, edges.where("rel_type = 'RELATED_TO'")), "id")
    left = si.edges_within(edges, kept).agg(F.count("*").alias("edges_left"))
    return kept.agg(F.count("*").alias("nodes_left")).join(F.broadcast(left))


@query("l9_delete_unreferenced", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def l9(spark, d):
    valid = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return table(spark, d, "lineitem").join(valid, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("l10_status_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def l10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return si.status_updated(o, o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey", ["o_orderstatus"])


@query("l11_document_export", "SELECT doc_id AS document_id, sha256(replace(text, chr(10), chr(10) || chr(10))) AS body_hash, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_chunks FROM documents")
def l11(spark, d):
    return si.exported(chunks(spark, d)).select("document_id", F.sha2(F.col("body").cast("binary"), 256).alias("body_hash"), "n_chunks")
