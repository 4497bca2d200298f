"""Registered queries: retrieval channels, fusion, context, evaluation (H, E, J).

The given documents are the chunks; documents whose number is also a vector's number have that vector; the documents
whose number is divisible by 50 are the queries, with their whole texts and vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators import context as cx, evaluation as ev, filters as fl, fusion as fu, retrieval as rt, vector_index as vi

from .registry import query
from .views import MENTIONS_SQL, QUERIES_SQL, mentions, queries_of, table, title_of

FIELDS = {"content": 3.0, "title": 2.0}


def tok(c):
    return f"regexp_extract_all(translate(lower({c}), '{tx.ACCENTS}', '{tx.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


def docs_of(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), t.alias("content"), title_of(t).alias("title"), "lang")


def vectors_of(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def searched(spark, d):
    """The queries with their vectors, where they have one."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return queries_of(spark, d).join(v, "query_id", "left")


def dense(spark, d, k=20):
    # Scores are rounded before they are ranked, so that equal texts stay equal in any engine.
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return rt.dense_search(q, vectors_of(spark, d), k, 6)


def keyword(spark, d, k=20, fields=FIELDS):
    return rt.keyword_search(queries_of(spark, d), docs_of(spark, d), fields, k, 6)


DENSE_SQL = """qv AS (SELECT vec_id::VARCHAR AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT query_id, vec_id AS chunk_id, round((1 + list_inner_product(qv, embedding::DOUBLE[])) / 2, 6) AS score FROM qv, embeddings),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 20)"""
BM25_SQL = f"""f AS (SELECT doc_id AS chunk_id, 'content' AS field, {tok('text')} AS t FROM documents UNION ALL SELECT doc_id, 'title', {tok("string_split(text, chr(10))[1]")} FROM documents),
p AS (SELECT chunk_id, field, term, len, count(*) AS tf FROM (SELECT chunk_id, field, len(t) AS len, unnest(t) AS term FROM f) GROUP BY ALL),
st AS (SELECT field, count(*) AS n_docs, avg(len(t)) AS avg_len FROM f WHERE len(t) > 0 GROUP BY field),
qt AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM queries),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
bf AS (SELECT query_id, chunk_id, field, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) * CASE field WHEN 'content' THEN 3 ELSE 2 END AS s FROM qt JOIN p USING (term) JOIN st USING (field) JOIN df USING (field, term) GROUP BY query_id, chunk_id, field),
bs AS (SELECT query_id, chunk_id, round(max(s), 6) AS score FROM bf GROUP BY ALL),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs QUALIFY rank <= 20)"""
WITH = "WITH " + QUERIES_SQL + ", "


@query("h1_dense_search", WITH + DENSE_SQL + " SELECT query_id, chunk_id, score, rank FROM dense")
def h1(spark, d):
    return dense(spark, d).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("h2_bm25", WITH + BM25_SQL + " SELECT query_id, chunk_id, score, rank FROM keyword")
def h2(spark, d):
    return keyword(spark, d).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


# DuckDB counts edits in bytes; the one letter of these texts that is not folded to ASCII is put as another single byte.
_BYTE = "translate({}, 'ß', '~')"
FUZZY_SQL = WITH + BM25_SQL.split("p AS (")[0] + f"""v AS (SELECT DISTINCT unnest(t) AS word FROM f), qt AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM queries),
u AS (SELECT DISTINCT term, CASE WHEN length(term) < 3 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS edits FROM qt),
m AS (SELECT term, word FROM u JOIN v ON term[1] = word[1] AND abs(length(term) - length(word)) <= edits WHERE levenshtein({_BYTE.format('term')}, {_BYTE.format('word')}) <= edits)
SELECT query_id, term, word FROM qt JOIN m USING (term)"""


@query("h3_fuzzy_terms", FUZZY_SQL)
def h3(spark, d):
    docs = docs_of(spark, d)
    vocabulary = docs.select(F.explode(F.array_distinct(F.concat(tx.tokens(F.coalesce("content", F.lit(""))), tx.tokens(F.coalesce("title", F.lit("")))))).alias("term"))
    return rt.fuzzy_terms(rt.query_terms(queries_of(spark, d)), vocabulary)


FUZZY_BM25_SQL = BM25_SQL.split("qt AS (")[0] + f"""q0 AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM queries),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), v AS (SELECT DISTINCT term AS word FROM p),
u AS (SELECT DISTINCT term, CASE WHEN length(term) < 3 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS edits FROM q0),
m AS (SELECT term, word, levenshtein({_BYTE.format('term')}, {_BYTE.format('word')}) AS e FROM u JOIN v ON term[1] = word[1] AND abs(length(term) - length(word)) <= edits WHERE levenshtein({_BYTE.format('term')}, {_BYTE.format('word')}) <= edits),
qt AS (SELECT query_id, word AS term, max(1 - e / least(length(term), length(word))::DOUBLE) AS weight FROM q0 JOIN m USING (term) GROUP BY query_id, word HAVING max(1 - e / least(length(term), length(word))::DOUBLE) > 0),
bf AS (""" + BM25_SQL.split("bf AS (")[1].replace("sum(ln(", "sum(weight * ln(")


@query("h2_fuzzy_bm25", WITH + FUZZY_BM25_SQL + " SELECT query_id, chunk_id, score, rank FROM keyword")
def h2_fuzzy(spark, d):
    found = rt.keyword_search(queries_of(spark, d), docs_of(spark, d), FIELDS, 20, 6, fuzzy=True)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("h1_indexed_search", WITH + DENSE_SQL + " SELECT query_id, chunk_id, score, rank FROM dense")
def h1_indexed(spark, d):
    """Over inverted lists with 10,000 candidates a query, then the lists that can still hold one of its best: the exact result."""
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    found = vi.indexed_search(q, vi.vector_index(vectors_of(spark, d)), 20, 10_000, 6, exact=True)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


SPARSE_SQL = """sw AS (SELECT chunk_id, term AS token, round(tf / len::DOUBLE * ln((SELECT count(*) FROM documents) / df::DOUBLE), 6) AS weight FROM p JOIN df USING (field, term) WHERE field = 'content'),
sk AS (SELECT chunk_id, token, weight FROM sw WHERE weight >= 0.01 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, token) <= 50),
cand AS (SELECT query_id, chunk_id FROM dense UNION SELECT query_id, chunk_id FROM keyword),
ss AS (SELECT query_id, chunk_id, round(sum(weight), 6) AS score FROM qt JOIN sk ON token = term JOIN cand USING (query_id, chunk_id) GROUP BY ALL HAVING round(sum(weight), 6) > 0),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ss QUALIFY rank <= 20)"""


GRAPH_CHANNEL_SQL = MENTIONS_SQL + f""",
mj AS (SELECT * FROM m WHERE length(name) >= 2 AND name <> 'None' AND NOT starts_with(name, '/') AND NOT starts_with(name, '.') {"".join(f" AND NOT contains(name, '{x}')" for x in tx.JUNK_PARTS + tx.JUNK_DOCS)}),
nm AS (SELECT DISTINCT name FROM mj),
g0 AS (SELECT query_id, query, list_filter(string_split_regex(query, '\\s+'), lambda w: length(w) >= 2) AS raw FROM queries),
g1 AS (SELECT query_id, query, list_transform(raw, lambda w: regexp_replace(w, '[?!.。,;:]+$', '')) AS clean FROM g0),
g2 AS (SELECT query_id, query, list_filter(list_concat(clean, list_transform(clean, lambda w: regexp_replace(w, '[은는이가을를의와과에서로도만으로부터까지에게]+$', ''))), lambda w: length(w) >= 2) AS ws FROM g1),
gw AS (SELECT DISTINCT query_id, lower(unnest(CASE WHEN len(ws) = 0 THEN [query] ELSE ws END)) AS word FROM g2),
wn AS (SELECT word, name, CASE WHEN lower(name) = word THEN 0 ELSE 1 END AS kind FROM (SELECT DISTINCT word FROM gw) JOIN nm ON lower(name) = word OR (length(word) >= 2 AND contains(lower(name), word))),
gm AS (SELECT query_id, name, min(kind) AS kind FROM gw JOIN wn USING (word) GROUP BY ALL),
gp AS (SELECT * FROM gm QUALIFY kind = 0 OR row_number() OVER (PARTITION BY query_id, kind ORDER BY name) <= 15),
sd AS (SELECT query_id, name AS id FROM gp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY kind, name) <= 20),
co AS (SELECT a.name AS n1, b.name AS n2, count(*) AS weight FROM mj a JOIN mj b USING (document_id) WHERE a.name < b.name GROUP BY ALL),
un AS (SELECT n1 AS node, n2 AS other, weight FROM co UNION ALL SELECT n2, n1, weight FROM co),
nb AS (SELECT query_id, other FROM sd JOIN un ON node = id QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY weight DESC, other) <= 3),
eg AS (SELECT query_id, id, min(hop) AS hop FROM (SELECT query_id, id, 0 AS hop FROM sd UNION ALL SELECT query_id, other, 1 FROM nb) GROUP BY ALL),
ex AS (SELECT * FROM eg QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, id) <= 20),
gn AS (SELECT query_id, id AS name FROM ex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, id) <= 10),
gt AS (SELECT query_id, term, count(*) * 1.5::DOUBLE AS weight FROM (SELECT query_id, unnest(list_distinct({tok('name')})) AS term FROM gn) GROUP BY ALL),
mo AS (SELECT query_id, chunk_id, sum(weight * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS more FROM gt JOIN p USING (term) JOIN st USING (field) JOIN df USING (field, term) WHERE field = 'content' GROUP BY ALL),
gs AS (SELECT query_id, chunk_id, round(s + coalesce(more, 0), 6) AS score FROM (SELECT query_id, chunk_id, max(s) AS s FROM bf GROUP BY ALL) LEFT JOIN mo USING (query_id, chunk_id) WHERE query_id IN (SELECT query_id FROM gn)),
graph AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM gs QUALIFY rank <= 10)"""


@query("h5_graph_search", WITH + BM25_SQL + ", " + GRAPH_CHANNEL_SQL + " SELECT query_id, chunk_id, score, rank FROM graph")
def h5(spark, d):
    q, docs = queries_of(spark, d), docs_of(spark, d)
    found = rt.graph_search(q, rt.graph_names(q, mentions(spark, d)), docs, FIELDS, "content", 10, 6)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def channels(spark, d):
    return rt.search_channels(searched(spark, d), docs_of(spark, d), vectors_of(spark, d), mentions(spark, d), FIELDS)


ALL_SQL = WITH + DENSE_SQL + ", " + BM25_SQL + ", " + SPARSE_SQL + ", " + GRAPH_CHANNEL_SQL + """,
ch AS (SELECT query_id, chunk_id, rank, score, 'vector' AS channel, 0 AS no, 1.0::DOUBLE AS w FROM dense WHERE query_id IN (SELECT query_id FROM queries) UNION ALL SELECT query_id, chunk_id, rank, score, 'keyword', 1, 1.0 FROM keyword UNION ALL SELECT query_id, chunk_id, rank, score, 'sparse', 2, 0.7 FROM sparse UNION ALL SELECT query_id, chunk_id, rank, score, 'graph', 3, 0.8 FROM graph),
fu AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank) ORDER BY no), 6) AS score, arg_max(channel, w / (60 + rank) - no * 1e-9) AS source, count(*)::BIGINT AS n_sources, string_agg(channel, ',' ORDER BY no) AS sources, min(no * 1000 + rank) AS first FROM ch GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, score, source, n_sources, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fu)"""


@query("h4_sparse_search", ALL_SQL + " SELECT query_id, chunk_id, score, rank FROM sparse")
def h4(spark, d):
    return channels(spark, d).where("channel = 'sparse'").select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def fused(spark, d):
    return fu.fused(fu.contributions(channels(spark, d)))


@query("h6_e2_rrf_fusion", ALL_SQL + " SELECT query_id, chunk_id, score, source, n_sources, sources, rank FROM fused")
def h6(spark, d):
    return fused(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query("h7_fusion_explained", ALL_SQL + " SELECT ch.query_id, ch.chunk_id, channel, ch.rank, w AS weight, round(w / (60 + ch.rank), 6) AS weighted, fused.rank AS final_rank, n_sources FROM ch JOIN fused USING (query_id, chunk_id)")
def h7(spark, d):
    long = lambda c: F.col(c).cast("long").alias(c)
    return fu.explained(channels(spark, d)).select("query_id", "chunk_id", "channel", long("rank"), "weight", F.round("weighted", 6).alias("weighted"), long("final_rank"), "n_sources")


OVERLAP = f"CASE WHEN len(list_distinct({tok('query')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({tok('query')}), {tok('text')})) / len(list_distinct({tok('query')}))::DOUBLE END"
RERANK_SQL = ALL_SQL + f", rr AS (SELECT query_id, chunk_id, query, text, rank, round({OVERLAP}, 6) AS score FROM fused JOIN queries USING (query_id) JOIN documents ON doc_id = chunk_id WHERE rank <= 30), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rerank FROM rr QUALIFY rerank <= 10)"


def hybrid(spark, d, found=None):
    """The channels, fused, reranked, with the texts."""
    return rt.hybrid_search(searched(spark, d), docs_of(spark, d), vectors_of(spark, d), mentions(spark, d), FIELDS, channels=found)


@query("h9_e10_rerank", RERANK_SQL + " SELECT query_id, chunk_id, score, rank, rerank FROM rk")
def h9(spark, d):
    long = lambda c: F.col(c).cast("long").alias(c)
    return hybrid(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), long("rank"), long("rerank"))


@query("h10_hybrid_search", RERANK_SQL + " SELECT query_id, chunk_id, rk.score, source, rerank, (SELECT count(*) FROM ch WHERE ch.query_id = rk.query_id)::BIGINT AS considered FROM rk JOIN fused USING (query_id, chunk_id)")
def h10(spark, d):
    found = channels(spark, d)
    n = found.groupBy("query_id").agg(F.count("*").alias("considered"))
    return hybrid(spark, d, found).join(n, "query_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source", F.col("rerank").cast("long").alias("rerank"), "considered")


@query("h11_single_channel", WITH + BM25_SQL + " SELECT query_id, chunk_id, score FROM keyword WHERE rank <= 3")
def h11(spark, d):
    return keyword(spark, d, 3).select("query_id", "chunk_id", "score")


@query("h12_present_channels", WITH + BM25_SQL + " SELECT query_id, chunk_id, round(1 / (60 + rank)::DOUBLE, 6) AS score FROM keyword")
def h12(spark, d):
    only = keyword(spark, d).select("query_id", "chunk_id", "rank", F.lit("keyword").alias("channel"))
    return fu.fuse_present(only).select("query_id", "chunk_id", "score")


@query("h13_routed_channels", ALL_SQL + """, ro AS (SELECT query_id, CASE WHEN query <> '' AND len(list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '')) BETWEEN 1 AND 2 AND NOT regexp_matches(query, '[?？]') THEN 'keyword' ELSE 'hybrid' END AS strategy FROM queries)
SELECT query_id, channel, count(*)::BIGINT AS n FROM ch JOIN ro USING (query_id) WHERE strategy IN ('hybrid', channel) GROUP BY ALL""")
def h13(spark, d):
    return rt.routed(channels(spark, d), queries_of(spark, d)).groupBy("query_id", "channel").agg(F.count("*").alias("n"))


@query("h14_context_quality", WITH + BM25_SQL + """, r AS (SELECT query_id, score / 40 AS s FROM keyword), g AS (SELECT query_id, count(*) FILTER (s >= 0.5) AS h, count(*) FILTER (s >= 0.3) AS k, count(*) FILTER (s < 0.3) AS x, coalesce(max(s) FILTER (s >= 0.3), max(s)) AS m, coalesce(avg(s) FILTER (s >= 0.3), avg(s)) AS a FROM r GROUP BY query_id)
SELECT query_id, CASE WHEN coalesce(h, 0) >= 1 THEN 'HIGH' WHEN coalesce(k, 0) > 0 THEN 'PARTIAL' ELSE 'NONE' END AS grade, coalesce(h, 0)::BIGINT AS n_high, coalesce(k, 0)::BIGINT AS n_kept, coalesce(x, 0)::BIGINT AS dropped, round(coalesce(m, 0), 6) AS max_score, round(coalesce(a, 0), 6) AS avg_score FROM queries LEFT JOIN g USING (query_id)""")
def h14(spark, d):
    r = keyword(spark, d).withColumn("score", F.col("score") / 40)
    return cx.context_quality(queries_of(spark, d), r, 0.5, 0.3)


@query("b8_score_cutoff", WITH + BM25_SQL + " SELECT count(*) FILTER (score < 12)::BIGINT AS dropped FROM keyword")
def b8(spark, d):
    return fl.above_cutoff(keyword(spark, d), 12.0)[1]


@query("e1_channel_ranks", WITH + BM25_SQL + " SELECT query_id, chunk_id, 'keyword' AS channel, rank - 1 AS zero_rank FROM keyword")
def e1(spark, d):
    return keyword(spark, d).select("query_id", "chunk_id", F.lit("keyword").alias("channel"), (F.col("rank") - 1).cast("long").alias("zero_rank"))


@query("e4_context_budget", WITH + BM25_SQL + """, r AS (SELECT query_id, rank, text, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyword JOIN documents ON doc_id = chunk_id WHERE rank <= 10)
SELECT query_id, rank, length(substr(text, 1, (8000 - before)::INT))::BIGINT AS n FROM r WHERE 8000 - before > 0 AND (length(text) <= 8000 - before OR 8000 - before > 200)""")
def e4(spark, d):
    r = keyword(spark, d, 10).join(docs_of(spark, d).select("chunk_id", "content"), "chunk_id")
    return cx.context_budget(r).select("query_id", F.col("rank").cast("long").alias("rank"), F.length("content").cast("long").alias("n"))


@query("e7_h15_source_table", WITH + BM25_SQL + " SELECT query_id, rank AS source_no, chunk_id AS document_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet, row_number() OVER (PARTITION BY query_id, lang ORDER BY rank) = 1 AS is_primary FROM keyword JOIN documents ON doc_id = chunk_id")
def e7(spark, d):
    r = keyword(spark, d).join(docs_of(spark, d).select("chunk_id", F.col("lang").alias("document_id"), "content"), "chunk_id")
    return cx.source_table(r).select("query_id", F.col("source_no").cast("long").alias("source_no"), F.col("chunk_id").alias("document_id"), "snippet", "is_primary")


def samples(spark, d):
    """Question and answer pairs of the conversations, with the two texts before them as contexts."""
    c = table(spark, d, "conversations").where("role <> 'system'")
    pairs = cx.answered(c)
    before = c.select("conv_id", F.col("turn").alias("t"), "text")
    ctx = pairs.select("conv_id", "turn").join(before, "conv_id").where((F.col("t") < F.col("turn")) & (F.col("t") >= F.col("turn") - 2))
    ctx = ctx.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "text"))), lambda x: x["text"]).alias("contexts"))
    return pairs.join(ctx, ["conv_id", "turn"], "left").select("conv_id", "turn", "question", "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), F.when(F.col("turn") % 3 == 0, F.col("question")).alias("ground_truth"))


def wset(c):
    return f"list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> ''))"


SAMPLES_SQL = f"""WITH t AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS nr FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, text AS question, answer, CASE WHEN turn % 3 = 0 THEN text END AS ground_truth FROM t WHERE role = 'user' AND nr = 'assistant'),
s AS (SELECT q.conv_id, q.turn, any_value(q.question) AS question, any_value(q.answer) AS answer, any_value(q.ground_truth) AS ground_truth, coalesce(list(c.text ORDER BY c.turn) FILTER (c.text IS NOT NULL), []) AS contexts FROM q LEFT JOIN t c ON c.conv_id = q.conv_id AND c.turn < q.turn AND c.turn >= q.turn - 2 GROUP BY q.conv_id, q.turn),
w AS (SELECT *, {wset('question')} AS qw, {wset('answer')} AS aw, CASE WHEN ground_truth IS NOT NULL AND ground_truth <> '' THEN {wset('ground_truth')} END AS gw, {wset("array_to_string(contexts, ' ')")} AS cw FROM s),
m AS (SELECT conv_id, turn, CASE WHEN len(aw) = 0 THEN 0 ELSE len(list_intersect(aw, cw)) / len(aw)::DOUBLE END AS faithfulness, CASE WHEN len(qw) = 0 THEN 0.5 ELSE len(list_intersect(qw, aw)) / len(qw)::DOUBLE END AS answer_relevancy,
  CASE WHEN len(contexts) = 0 THEN 0 ELSE len(list_filter(contexts, lambda c: list_has_any({wset('c')}, qw))) / len(contexts)::DOUBLE END AS context_precision, CASE WHEN gw IS NULL THEN NULL WHEN len(gw) = 0 THEN 0 ELSE len(list_intersect(gw, cw)) / len(gw)::DOUBLE END AS context_recall FROM w)"""
METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


@query("j1_j4_answer_metrics", SAMPLES_SQL + " SELECT conv_id, turn, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM m")
def j1(spark, d):
    return ev.answer_metrics(samples(spark, d)).select("conv_id", "turn", *[F.round(m, 6).alias(m) for m in METRICS])


TARGETS = {"faithfulness": 0.3, "answer_relevancy": 0.1, "context_precision": 0.5, "context_recall": 0.2}
_MET = " AND ".join(f"coalesce({m} >= {t}, true)" for m, t in TARGETS.items())
@query("d11_evaluation_summary", SAMPLES_SQL + f", a AS (SELECT count(*)::BIGINT AS samples, count(*) FILTER ({_MET})::BIGINT AS passed, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM m) SELECT *, round(passed / samples::DOUBLE, 6) AS pass_rate, " + ", ".join(f"coalesce({m} >= {t}, false) AS {m}_met" for m, t in TARGETS.items()) + " FROM a")
def d11(spark, d):
    from docmill.operators.analytics import metric_means

    return metric_means(ev.answer_metrics(samples(spark, d)), TARGETS)


@query("d12_metric_spread", SAMPLES_SQL + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m})::BIGINT AS n, round(min({m}), 6) AS min, round(max({m}), 6) AS max, round(avg({m}), 6) AS avg FROM m" for m in METRICS))
def d12(spark, d):
    from docmill.operators.analytics import metric_spread

    return metric_spread(ev.answer_metrics(samples(spark, d)), METRICS)


@query("j5_rank_precision", "SELECT query_id, round(coalesce(avg(p) FILTER (rel), 0), 6) AS average_precision, round(avg(rel::INT), 6) AS supported_share FROM (SELECT source AS query_id, quality = 1 AS rel, sum((quality = 1)::INT) OVER w / count(*) OVER w::DOUBLE AS p FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) GROUP BY query_id")
def j5(spark, d):
    v = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), (F.col("quality") == 1).alias("relevant"))
    return ev.rank_precision(v)


@query("j6_answer_validation", SAMPLES_SQL + ", v AS (SELECT conv_id, turn, round(CASE WHEN len(aw) = 0 THEN 0 ELSE len(list_intersect(aw, cw)) / len(aw)::DOUBLE END, 4) AS faithfulness, round(CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, aw)) / len(qw)::DOUBLE END, 4) AS relevance FROM w) SELECT *, faithfulness >= 0.2 AND relevance >= 0.2 AS is_valid FROM v")
def j6(spark, d):
    s = samples(spark, d).withColumn("context", F.array_join("contexts", " "))
    return ev.validated(s, 0.2).select("conv_id", "turn", "faithfulness", "relevance", "is_valid")


@query("j7_evaluation_samples", WITH + BM25_SQL + " SELECT query_id, query AS question, count(text)::BIGINT AS n_contexts, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM queries LEFT JOIN (SELECT * FROM keyword JOIN documents ON doc_id = chunk_id WHERE rank <= 5) USING (query_id) WHERE query_id::INT % 7 <> 0 GROUP BY ALL")
def j7(spark, d):
    q = queries_of(spark, d)
    a = q.select("query_id", F.col("query").alias("question"), F.lit("-").alias("answer"), (F.col("query_id").cast("int") % 7 == 0).alias("failed"))
    r = keyword(spark, d, 5).join(docs_of(spark, d).select("chunk_id", "content"), "chunk_id")
    s = ev.evaluation_samples(a, r)
    return s.select("query_id", "question", F.size("contexts").cast("long").alias("n_contexts"), F.aggregate("contexts", F.lit(0).cast("long"), lambda x, c: x + F.length(c)).alias("n_chars"))


TWO_SQL = WITH + DENSE_SQL + ", " + BM25_SQL + ", a AS (SELECT * FROM keyword WHERE rank <= 10), b AS (SELECT * FROM dense WHERE rank <= 10), j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS ra, b.rank AS rb, a.score AS sa, b.score AS sb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)"


@query("j9_compare_results", TWO_SQL + " SELECT query_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL)::BIGINT AS overlap, count(*) FILTER (rb IS NULL)::BIGINT AS only_a, count(*) FILTER (ra IS NULL)::BIGINT AS only_b, count(*) FILTER (ra = 1 AND rb = 1) > 0 AS same_first, round(coalesce(avg(sa) FILTER (ra <= 5), 0), 6) AS top5_a, round(coalesce(avg(sb) FILTER (rb <= 5), 0), 6) AS top5_b FROM j GROUP BY query_id")
def j9(spark, d):
    return ev.compared(keyword(spark, d, 10), dense(spark, d, 10))


@query("j8_variant_winner", "WITH v AS (SELECT user_id, count(DISTINCT event_type) FILTER (event_id % 2 = 0) AS sa, count(DISTINCT event_type) FILTER (event_id % 2 = 1) AS sb, avg(value) FILTER (event_id % 2 = 0) AS la, avg(value) FILTER (event_id % 2 = 1) AS lb, count(*) FILTER (event_id % 2 = 0) AS na, count(*) FILTER (event_id % 2 = 1) AS nb FROM events GROUP BY user_id), g AS (SELECT count(*) FILTER (na > 0 AND nb > 0 AND sa > sb)::BIGINT AS wins_a, count(*) FILTER (na > 0 AND nb > 0 AND sb > sa)::BIGINT AS wins_b, count(*) FILTER (na > 0 AND nb > 0 AND sa = sb)::BIGINT AS ties, count(*) FILTER (na = 0 OR nb = 0)::BIGINT AS errors, round(avg(la), 4) AS latency_a, round(avg(lb), 4) AS latency_b FROM v) SELECT *, CASE WHEN wins_a > wins_b THEN 'a' WHEN wins_b > wins_a THEN 'b' ELSE 'tie' END AS winner FROM g")
def j8(spark, d):
    side = lambda m: table(spark, d, "events").where(f"event_id % 2 = {m}").groupBy(F.col("user_id").alias("query_id")).agg(F.count_distinct("event_type").alias("sources"), F.avg("value").alias("latency"))
    return ev.variant_winners(side(0), side(1))
