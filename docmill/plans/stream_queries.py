"""Registered queries: sources (A), chunking (F) and batch twins of the streaming reports (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import chunking as ck, context as cx
from docmill.operators.storage import scratch
from docmill.sources import readers as rd
from docmill.streaming import jobs

from .registry import query
from .views import EVENTS_SQL, events, table


# Scripts, styles, comments and tags end a text node; the entities are those of these pages, which count without their
# semicolon too, as in HTML (titles that are cut within one have such).
_NODES = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(1), 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g')"
_PLAIN = "x"
for _name, _is in {"copy": "'©'", "middot": "'·'", "lt": "'<'", "gt": "'>'", "quot": "chr(34)", "amp": "'&'"}.items():
    _PLAIN = f"regexp_replace({_PLAIN}, '&{_name};?', {_is}, 'g')"
A3_SQL = f"WITH t AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split({_NODES}, chr(1)), lambda x: regexp_replace({_PLAIN}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM pages) SELECT page_id, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words, length(text)::BIGINT AS n_chars FROM t"


@query("a3_html_text", A3_SQL)
def a3(spark, d):
    return rd.html_texts(table(spark, d, "pages"), "page_id", "html")


# Lines that begin with "The" or "De" are taken as headings, so that the texts have sections.
MD = "regexp_replace(text, '(^|\\n)(The|De) ', '\\1## \\2 ', 'g')"
def marked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "(^|\\n)(The|De) ", "$1## $2 ").alias("text"))


SECTIONS_SQL = f"""WITH t AS (SELECT doc_id, {MD} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t),
s AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+\\S') AS head, sum(regexp_matches(line, '^#{{1,6}}\\s+\\S')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)"""
@query("a4_markdown_sections", SECTIONS_SQL + " SELECT doc_id, section::BIGINT AS section, 2::BIGINT AS level, trim(regexp_replace(max(line) FILTER (head), '^#{1,6}\\s+', '')) AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS body FROM s WHERE section >= 1 GROUP BY doc_id, section")
def a4(spark, d):
    return rd.markdown_sections(marked(spark, d), "doc_id", "text")


@query("a5_markdown_cells", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
p AS (SELECT doc_id, pos, '|' || raw || '|' AS line FROM l WHERE contains(raw, ' | ')), i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM p),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS n FROM i), t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS table_no, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) - 1 AS row FROM n WHERE n >= 2),
c AS (SELECT doc_id, table_no, row, unnest(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|')) AS content, unnest(range(len(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|')))) AS col FROM t)
SELECT doc_id, table_no::BIGINT AS table_no, row::BIGINT AS row, col::BIGINT AS col, trim(content) AS content, row = 0 AS is_header FROM c""")
def a5(spark, d):
    line = F.transform(F.split("text", "\n"), lambda x: F.when(F.contains(x, F.lit(" | ")), F.concat(F.lit("|"), x, F.lit("|"))).otherwise(x))
    return rd.markdown_cells(table(spark, d, "documents").select("doc_id", F.array_join(line, "\n").alias("text")), "doc_id", "text")


@query("a8_titles", "SELECT doc_id, source || '-' || doc_id AS title, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words, length(text)::BIGINT AS n_letters FROM documents")
def a8(spark, d):
    t = rd.titled(table(spark, d, "documents"), F.col("text"), F.concat(F.lit("in/"), "source", F.lit("-"), "doc_id", F.lit(".txt")))
    return t.select("doc_id", "title", "n_words", "n_letters")


# Lines of JSON, written by Spark and read again; every 50th of them is cut short and teaches nothing.
@query("a9_vector_import", "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'completed' WHEN vec_id IS NOT NULL AND vec_id % 50 <> 0 THEN 'completed' ELSE 'pending' END AS embedding_status, CASE WHEN doc_id % 3 <> 0 AND vec_id % 50 <> 0 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def a9(spark, d):
    path = scratch(spark, "vectors")
    v = table(spark, d, "embeddings").select("vec_id", F.to_json(F.struct(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("dense_vector"))).alias("line"))
    v.select(F.when(F.col("vec_id") % 50 == 0, F.substring("line", 1, 20)).otherwise(F.col("line"))).write.text(path)
    c = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit(None).cast("array<float>").alias("embedding"), F.when(F.col("doc_id") % 3 == 0, "completed").otherwise("pending").alias("embedding_status"))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total")
    return rd.with_vectors(c, rd.imported_vectors(spark, path)).select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding_status", total)


# Three sections a part where a text has any, else slices.
A14_SQL = SECTIONS_SQL + """, b AS (SELECT doc_id, section, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS body FROM s WHERE section >= 1 GROUP BY ALL),
g AS (SELECT doc_id, ((section - 1) // 3)::INT AS part, string_agg(body, chr(10) ORDER BY section) AS body FROM b GROUP BY ALL)
SELECT doc_id, part, '(chunk ' || (part + 1) || ')' AS title, md5(body) AS body FROM g UNION ALL
SELECT doc_id, part::INT, '(chunk ' || (part + 1) || ')', md5(substr(text, (part * 10000 + 1)::INT, 10000)) FROM (SELECT doc_id, text, unnest(range(0, greatest(0, (length(text) - 1) // 10000) + 1)) AS part FROM t WHERE doc_id NOT IN (SELECT doc_id FROM b))"""
@query("a14_long_text_parts", A14_SQL)
def a14(spark, d):
    return rd.split_long(marked(spark, d), "doc_id", "text", 3).select("doc_id", "part", "title", F.md5(F.col("body").cast("binary")).alias("body"))


@query("f6_chunk_corpus")
def f6(spark, d):
    return ck.chunk_corpus(table(spark, d, "documents")).drop("content")


@query("e8_carried_headings", SECTIONS_SQL + " SELECT doc_id, pos::INT AS chunk_index, last_value(CASE WHEN head THEN regexp_replace(line, '^#{1,6}\\s+', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM s")
def e8(spark, d):
    p = marked(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return cx.carried_headings(p, "doc_id").select("doc_id", "chunk_index", "heading")


NTZ = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


@query("k2_tumbling_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def k2(spark, d):
    return jobs.tumbling_counts(events(spark, d), "1 day", ["event_type"]).select(NTZ("start"), "event_type", "n")


def sliding_sql(width, step):
    return f"""w AS (SELECT time_bucket(INTERVAL {step}, ts) - i * INTERVAL {step} AS start, failed, value FROM e, range({{n}}) r(i)),
g AS (SELECT start, count(*)::BIGINT AS n, count(*) FILTER (failed)::BIGINT AS errors, max(value) AS slowest, list_sort(list(value))[ceil(0.95::DOUBLE * count(*))::BIGINT] AS p95 FROM w GROUP BY start)"""


SLIDE = EVENTS_SQL + ", " + sliding_sql("1 DAY", "6 HOURS").format(n=4)


@query("k3_sliding_errors", SLIDE + " SELECT start, n, errors, round(errors / n::DOUBLE, 6) AS error_ratio, slowest, p95 FROM g")
def k3(spark, d):
    return jobs.sliding_errors(events(spark, d), "1 day", "6 hours", F.col("failed")).select(NTZ("start"), "n", "errors", "error_ratio", "slowest", "p95")


@query("k4_sustained_alerts", SLIDE + ", f AS (SELECT start, epoch(start) / 21600 - row_number() OVER (ORDER BY start) AS island FROM g WHERE errors / n::DOUBLE > 0.05) SELECT min(start) AS start, max(start) AS \"end\", count(*)::BIGINT AS n FROM f GROUP BY island HAVING count(*) >= 3")
def k4(spark, d):
    rows = jobs.sliding_errors(events(spark, d), "1 day", "6 hours", F.col("failed"))
    return jobs.sustained(rows, F.col("errors") / F.col("n") > 0.05, 3, 21600).select(NTZ("start"), NTZ("end"), "n")


@query("k5_rates_over", "SELECT date_trunc('day', ts) AS start, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL HAVING count(*) > 5")
def k5(spark, d):
    return jobs.rates_over(events(spark, d), "1 day", "user_id", 5).select(NTZ("start"), "user_id", "n")


@query("k6_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOURS, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, no""")
def k6(spark, d):
    return jobs.sessions(events(spark, d), "user_id", "2 hours").select("user_id", NTZ("start"), NTZ("end"), "n")


@query("k7_first_by_hash", "SELECT event_id, sha256(event_type || props) AS hash FROM events QUALIFY row_number() OVER (PARTITION BY event_type, props ORDER BY ts, event_id) = 1")
def k7(spark, d):
    e = table(spark, d, "events").withColumn("hash", F.sha2(F.concat("event_type", "props").cast("binary"), 256))
    return jobs.first_by_hash(e).select("event_id", "hash")


@query("k8_cache_replay", EVENTS_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT k, ts, event_id, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS rn FROM e),
r AS (SELECT k, rn, event_id, ts AS written, false AS hit FROM o WHERE rn = 1 UNION ALL SELECT o.k, o.rn, o.event_id, CASE WHEN o.ts - r.written <= INTERVAL 1 DAY THEN r.written ELSE o.ts END, o.ts - r.written <= INTERVAL 1 DAY FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
SELECT event_id, k, hit FROM r""")
def k8(spark, d):
    return jobs.cache_replay(events(spark, d), "k", 86400)


_STATUS = {"signup": "processing", "view": "parsing", "click": "embedding", "purchase": "completed", "error": "failed"}
@query("k9_latest_status", "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id, CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END AS status, CASE t WHEN 'signup' THEN 5 WHEN 'view' THEN 10 WHEN 'click' THEN 50 WHEN 'purchase' THEN 100 ELSE 0 END AS percent, t NOT IN ('purchase', 'error') AND epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) > 86400 AS timed_out FROM l")
def k9(spark, d):
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv]), F.col("event_type"))
    return jobs.latest_status(events(spark, d).withColumn("status", status), "user_id", "2024-01-31", 86400)


@query("k11_budget_burn", EVENTS_SQL + ", " + sliding_sql("7 DAYS", "1 DAY").format(n=7) + " SELECT start, n, errors, round(errors / n::DOUBLE / 0.001::DOUBLE, 4) AS budget_spent FROM g")
def k11(spark, d):
    return jobs.sliding_errors(events(spark, d), "7 days", "1 day", F.col("failed")).select(NTZ("start"), "n", "errors", "budget_spent")
