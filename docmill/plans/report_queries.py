"""Registered queries: aggregations and reports (D), listings and selections (B, I), joins on tables (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators import analytics as an, filters as fl
from docmill.operators.ranks import ranked

from .registry import query
from .views import CHUNKS_SQL, EVENTS_SQL, chunks, events, table

DOCS = "documents"


@query("a12_table_scan", "SELECT doc_id, lang, n_chars::BIGINT AS n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def a12(spark, d):
    return table(spark, d, DOCS).where((F.col("lang") == "en") & (F.col("n_chars") > 500)).select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"))


@query("b1_search_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') AND n_chars >= 100 AND n_chars <= 5000")
def b1(spark, d):
    f = fl.search_filter({"lang": "en"}, {"source": ["src1", "src2", "src3"]}, {"n_chars": (100, 5000)})
    return table(spark, d, DOCS).where(f).select("doc_id")


@query("b2_document_listing", "SELECT doc_id, total FROM (SELECT doc_id, n_chars, count(*) OVER ()::BIGINT AS total FROM documents WHERE lang = 'en' AND source = 'src3') ORDER BY n_chars DESC, doc_id LIMIT 5 OFFSET 5")
def b2(spark, d):
    kept = table(spark, d, DOCS).where(fl.search_filter({"lang": "en", "source": "src3"}))
    total = kept.agg(F.count("*").alias("total"))
    return fl.page(kept, [F.desc("n_chars"), F.col("doc_id")], 2, 5).join(F.broadcast(total)).select("doc_id", "total")


@query("b3_title_search", "SELECT doc_id FROM documents WHERE lower(string_split(text, chr(10))[1]) LIKE '%the%'")
def b3(spark, d):
    return table(spark, d, DOCS).withColumn("title", F.substring_index("text", "\n", 1)).where(fl.contains_any(["title"], "THE")).select("doc_id")


@query("b4_multi_column_search", "SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77')) AND c_acctbal > 0 ORDER BY c_custkey LIMIT 20")
def b4(spark, d):
    kept = table(spark, d, "customer").where(fl.contains_any(["c_name", "c_mktsegment"], "77") & (F.col("c_acctbal") > 0))
    return fl.page(kept, [F.col("c_custkey")], 1, 20).select("c_custkey")


@query("b9_rows_to_embed", CHUNKS_SQL + "SELECT chunk_id, length(substr(content, 1, 300))::BIGINT AS n FROM chunks LEFT JOIN embeddings ON vec_id = document_id WHERE vec_id IS NULL AND trim(content) <> ''")
def b9(spark, d):
    c = chunks(spark, d).join(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("document_id") == F.col("vec_id"), "left")
    return fl.to_embed(c, most_chars=300).select("chunk_id", F.length("content").cast("long").alias("n"))


@query("b10_c11_rows_to_extract", CHUNKS_SQL + "SELECT chunk_id, token_count FROM chunks WHERE token_count >= 50 AND document_id % 3 <> 0 AND document_id % 5 <> 1")
def b10(spark, d):
    c = chunks(spark, d)
    done = [c.where("document_id % 3 = 0"), c.where("document_id % 5 = 1")]
    return fl.to_extract(c, done, 50).select("chunk_id", "token_count")


@query("b11_pending_work", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def b11(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "uploaded").when(F.col("o_orderstatus") == "F", "queued").otherwise("completed")
    return fl.pending(table(spark, d, "orders").withColumn("status", status), 25, order=["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("b14_requeue", "SELECT o_orderkey, 'queued' AS status FROM orders WHERE o_orderstatus = 'F'")
def b14(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("processing")
    return fl.requeued(table(spark, d, "orders").withColumn("status", status)).select("o_orderkey", "status")


@query("c1_active_documents", "SELECT o_orderkey, c_name, n_name, CASE WHEN DATE '1998-01-01' < o_orderdate::DATE THEN 'NOT_YET_VALID' WHEN DATE '1998-01-01' > (o_orderdate + INTERVAL 1 YEAR)::DATE THEN 'EXPIRED' ELSE 'VALID' END AS validity FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def c1(spark, d):
    start = F.to_date("o_orderdate")
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("o_orderkey", "c_name", "n_name", tx.validity(start, F.add_months(start, 12), F.lit("1998-01-01").cast("date")).alias("validity"))


@query("c9_duplicate_files", "SELECT text_hash, count(*)::BIGINT AS copies, min(doc_id) AS kept FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) GROUP BY text_hash HAVING count(*) > 1")
def c9(spark, d):
    h = table(spark, d, DOCS).select("doc_id", tx.query_hash(F.col("text")).alias("text_hash"))
    return h.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


@query("c16_search_trend", "SELECT day::DATE AS day, coalesce(n, 0)::BIGINT AS n FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-02', INTERVAL 1 DAY) s(day) LEFT JOIN (SELECT ts::DATE AS d, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) ON d = day::DATE")
def c16(spark, d):
    e = events(spark, d).where("event_type = 'click'")
    return an.with_all_days(an.daily(e, "ts", "2000-01-01", "2100-01-01"), "2024-01-01", "2024-03-01")


@query("c17_bookmarked", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def c17(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("c18_category_tree", "SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, 1 AS level, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def c18(spark, d):
    from docmill.operators.graph import category_tree

    rows = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    rows = rows.unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    return category_tree(rows).select("id", "parent", "level", "path")


@query("c19_chunk_parents", CHUNKS_SQL + "SELECT chunk_id, n_chars::BIGINT AS n_chars FROM chunks LEFT JOIN documents ON doc_id = document_id")
def c19(spark, d):
    docs = table(spark, d, DOCS).select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    return chunks(spark, d).join(docs, F.col("document_id") == F.col("doc_id"), "left").select("chunk_id", "n_chars")


@query("d1_corpus_statistics", CHUNKS_SQL + "SELECT count(DISTINCT document_id)::BIGINT AS documents, count(*)::BIGINT AS chunks, count(DISTINCT source)::BIGINT AS projects, count(DISTINCT document_id) FILTER (lang = 'en')::BIGINT AS english, sum(token_count)::BIGINT AS tokens FROM chunks")
def d1(spark, d):
    en = F.when(F.col("lang") == "en", F.col("document_id"))
    return chunks(spark, d).agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.count_distinct("source").alias("projects"), F.count_distinct(en).alias("english"), F.sum("token_count").alias("tokens"))


@query("d2_dashboard_totals", EVENTS_SQL + "SELECT (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(*) FROM customer)::BIGINT AS users, count(*) FILTER (event_type = 'click')::BIGINT AS searches, count(DISTINCT user_id)::BIGINT AS active, count(*) FILTER (failed)::BIGINT AS failed FROM e")
def d2(spark, d):
    one = lambda n, name: table(spark, d, n).agg(F.count("*").alias(name))
    e = events(spark, d).agg(F.count_if(F.col("event_type") == "click").alias("searches"), F.count_distinct("user_id").alias("active"), F.count_if("failed").alias("failed"))
    return one(DOCS, "documents").join(F.broadcast(one("customer", "users"))).join(F.broadcast(e))


@query("d3_popular_queries", EVENTS_SQL + "SELECT k, count(*)::BIGINT AS n FROM e WHERE event_type = 'click' GROUP BY k ORDER BY n DESC, k LIMIT 10")
def d3(spark, d):
    return an.popular(events(spark, d).where("event_type = 'click'"), "k", 10)


@query("d4_daily_counts", "SELECT ts::DATE AS day, count(*)::BIGINT AS n FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY 1")
def d4(spark, d):
    return an.daily(events(spark, d), "ts", "2024-01-05", "2024-01-20")


@query("d5_type_distribution", "SELECT lang, n, percent FROM (SELECT lang, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY lang) WHERE lang IN ('en', 'de', 'ko')")
def d5(spark, d):
    return an.type_shares(table(spark, d, DOCS), "lang", ["en", "de", "ko"])


@query("d6_chunk_totals", CHUNKS_SQL + "SELECT document_id, count(*)::BIGINT AS chunks, round(avg(token_count), 4) AS avg_tokens FROM chunks GROUP BY document_id")
def d6(spark, d):
    return chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.round(F.avg("token_count"), 4).alias("avg_tokens"))


@query("d7_load_summary", "SELECT count(*)::BIGINT AS files, count(*) FILTER (s = 'F')::BIGINT AS succeeded, count(*) FILTER (s = 'O')::BIGINT AS failed, count(*) FILTER (s = 'P')::BIGINT AS skipped, coalesce(sum(n) FILTER (s = 'F'), 0)::BIGINT AS chunks, coalesce(sum(parts) FILTER (s = 'F'), 0)::BIGINT AS entities, round(count(*) FILTER (s = 'F') / count(*)::DOUBLE, 6) AS success_rate FROM (SELECT o_orderstatus AS s, n, parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)")
def d7(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chunk_count"), F.count_distinct("l_partkey").alias("entity_count"))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return an.load_summary(table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("status", status))


@query("d8_chunks_per_document", CHUNKS_SQL + "SELECT document_id, count(*)::BIGINT AS n FROM chunks GROUP BY document_id ORDER BY document_id LIMIT 100 OFFSET 100")
def d8(spark, d):
    return fl.page(chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("n")), [F.col("document_id")], 2, 100)


@query("d9_status_terms", "SELECT coalesce(label, 'none') AS label, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN 'clean' END AS label FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def d9(spark, d):
    j = table(spark, d, DOCS).join(table(spark, d, "labels"), "doc_id", "left")
    return an.missing_counts(j.withColumn("label", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")), "label")


_P = "max(value) FILTER (i = least(floor(n * {p} / 100), n - 1)) AS p{p}"
@query("d13_latency_percentiles", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS avg, min(value) AS min, max(value) AS max, " + ", ".join(_P.format(p=p) for p in (50, 95, 99)) + ", round(avg(value), 4) < 10.5 AS passed FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def d13(spark, d):
    return an.ranked_percentiles(events(spark, d), ["event_type"], "value", limit=10.5)


@query("d14_group_means", "SELECT lang, round(avg(n_chars), 4) AS avg_chars, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def d14(spark, d):
    return table(spark, d, DOCS).join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.round(F.avg("quality"), 6).alias("quality"))


@query("d15_hit_rates", EVENTS_SQL + "SELECT user_id, count(*)::BIGINT AS n, round(coalesce(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'view')), 0)::DOUBLE, 0), 6) AS hit_rate FROM e GROUP BY user_id")
def d15(spark, d):
    hit, tried = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type").isin("click", "view"))
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(an.rate(hit, tried), 6).alias("hit_rate"))


@query("d16_cost_report", "SELECT l_returnflag, l_shipdate::DATE AS day, sum(l_quantity)::BIGINT AS tokens, round(sum(l_quantity::DECIMAL(18,2) * l_extendedprice::DECIMAL(18,6)) / 1000, 2)::DOUBLE AS cost, count(*)::BIGINT AS calls FROM lineitem GROUP BY 1, 2")
def d16(spark, d):
    log = table(spark, d, "lineitem").withColumns({"tokens": F.col("l_quantity"), "day": F.to_date("l_shipdate")})
    r = an.cost_report(log, ["l_returnflag", "day"], F.col("l_extendedprice"), F.col("l_discount"))
    return r.select("l_returnflag", "day", "tokens", F.round("cost", 2).cast("double").alias("cost"), "calls")


@query("d17_error_budget", EVENTS_SQL + "SELECT day, n, errors, round(errors / n::DOUBLE, 6) AS error_ratio, round(1 - errors / n::DOUBLE, 6) AS availability, round(errors / n::DOUBLE / (1 - 0.999::DOUBLE), 4) AS budget_spent FROM (SELECT ts::DATE AS day, count(*)::BIGINT AS n, count(*) FILTER (failed)::BIGINT AS errors FROM e GROUP BY 1)")
def d17(spark, d):
    return an.error_budget(events(spark, d), F.col("failed"), [F.to_date("ts").alias("day")])


@query("d18_bucket_quantiles", """WITH b AS (SELECT event_type, le::DOUBLE AS le, count(*)::BIGINT AS n FROM (SELECT event_type, ceil(value / 5) * 5 AS le FROM events WHERE value > 0) GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY le) AS cum, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS low, sum(n) OVER (PARTITION BY event_type) AS total FROM b)
SELECT event_type, round(low + (le - low) * (0.95::DOUBLE * total - (cum - n)) / n, 6) AS quantile FROM c WHERE cum >= 0.95::DOUBLE * total AND cum - n < 0.95::DOUBLE * total""")
def d18(spark, d):
    b = events(spark, d).where("value > 0").withColumn("le", (F.ceil(F.col("value") / 5) * 5).cast("double"))
    return an.bucket_quantile(b.groupBy("event_type", "le").agg(F.count("*").alias("n")), 0.95, ["event_type"])


@query("d19_session_summary", "SELECT conv_id, count(*)::BIGINT AS turns, min(turn) AS first_turn, max(turn) AS last_turn, max_by(text, turn) FILTER (role = 'user') AS last_text FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def d19(spark, d):
    c = table(spark, d, "conversations").where("role <> 'system'")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("last_text"))


@query("d20_source_distribution", "SELECT source, count(*)::BIGINT AS n, round(avg(n_chars), 4) AS mean, count(DISTINCT lang)::BIGINT AS langs FROM documents GROUP BY source")
def d20(spark, d):
    return table(spark, d, DOCS).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.count_distinct("lang").alias("langs"))


@query("d21_document_outcome", CHUNKS_SQL + "SELECT document_id, count(*) FILTER (length(content) >= 100)::BIGINT AS succeeded, count(*) FILTER (length(content) < 100)::BIGINT AS failed, CASE WHEN count(*) FILTER (length(content) >= 100) = 0 THEN 'failed' ELSE 'completed' END AS status FROM chunks GROUP BY document_id")
def d21(spark, d):
    return an.document_outcome(chunks(spark, d), F.length("content") >= 100)


@query("d22_largest_documents", CHUNKS_SQL + "SELECT document_id, count(*)::BIGINT AS chunks, round(count(*) FILTER (length(content) < 50) / count(*)::DOUBLE, 6) AS short_share FROM chunks GROUP BY document_id ORDER BY chunks DESC, document_id LIMIT 10")
def d22(spark, d):
    g = chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.round(an.rate(F.count_if(F.length("content") < 50), F.count("*")), 6).alias("short_share"))
    return g.orderBy(F.desc("chunks"), "document_id").limit(10)


@query("i4_recent_rows", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def i4(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts")


@query("i6_result_sets", "SELECT count(*) FILTER (a AND b)::BIGINT AS both_, count(*) FILTER (a AND NOT b)::BIGINT AS only_a, count(*) FILTER (b AND NOT a)::BIGINT AS only_b FROM (SELECT contains(text, 'the') AS a, contains(text, 'and') AS b FROM documents)")
def i6(spark, d):
    t = table(spark, d, DOCS)
    a, b = (t.where(F.contains("text", F.lit(w))).select("doc_id", F.lit(True).alias(w)) for w in ("the", "and"))
    j = a.join(b, "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("the").isNotNull() & F.col("and").isNotNull()).alias("both_"), F.count_if(F.col("and").isNull()).alias("only_a"), F.count_if(F.col("the").isNull()).alias("only_b"))


@query("e5_history_budget", """WITH t AS (SELECT conv_id, turn, length(text) + 2 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system'),
s AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM t WHERE back <= 5)
SELECT conv_id, count(*)::BIGINT AS turns, max(used)::BIGINT AS used FROM s WHERE used <= 1000 GROUP BY conv_id""")
def e5(spark, d):
    from docmill.operators.context import history_window

    h = history_window(table(spark, d, "conversations").where("role <> 'system'"), turns=5, budget=1000)
    return h.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("used").alias("used"))


@query("e6_keep_last_turns", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def e6(spark, d):
    return fl.numbered(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], "back").where("back <= 3").select("conv_id", "turn")


@query("e9_worker_slices", "SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % 4 AS worker FROM documents")
def e9(spark, d):
    r = ranked(table(spark, d, DOCS).select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")])
    return r.select("doc_id", ((F.col("rank") - 1) % 4).cast("long").alias("worker"))


@query("e11_question_answer_pairs", "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def e11(spark, d):
    from docmill.operators.context import answered

    return answered(table(spark, d, "conversations")).select("conv_id", "turn", "question", "answer")


@query("e12_length_batches", "SELECT doc_id, ntile(16) OVER (ORDER BY n_chars, doc_id)::BIGINT AS batch FROM documents")
def e12(spark, d):
    docs = table(spark, d, DOCS).select("doc_id", "n_chars")
    r = ranked(docs, [F.asc("n_chars"), F.asc("doc_id")]).join(F.broadcast(docs.agg(F.count("*").alias("total"))))
    # Batches of nearly equal size; the first ones are larger by one.
    size, rest, at = F.floor(F.col("total") / 16), F.col("total") % 16, F.col("rank") - 1
    batch = F.when(at < rest * (size + 1), F.floor(at / (size + 1))).otherwise(rest + F.floor((at - rest * (size + 1)) / F.greatest(size, F.lit(1))))
    return r.select("doc_id", (batch + 1).cast("long").alias("batch"))


@query("e13_diminishing_passes", """WITH p AS (SELECT l_orderkey, l_linenumber AS pass, sum(l_quantity)::BIGINT AS fresh FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY pass) - fresh AS prior FROM p),
s AS (SELECT *, min(CASE WHEN pass > 3 OR (prior > 0 AND fresh / prior::DOUBLE < 0.1) THEN pass END) OVER (PARTITION BY l_orderkey) AS stop FROM r)
SELECT l_orderkey, count(*)::BIGINT AS passes, sum(fresh)::BIGINT AS found FROM s WHERE stop IS NULL OR pass < stop GROUP BY l_orderkey""")
def e13(spark, d):
    from docmill.operators.context import worthwhile_passes

    p = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pass")).agg(F.sum("l_quantity").cast("long").alias("fresh"))
    return worthwhile_passes(p, "l_orderkey", F.lit(3)).groupBy("l_orderkey").agg(F.count("*").alias("passes"), F.sum("fresh").alias("found"))


@query("h16_suggestions", "SELECT DISTINCT p_name AS suggestion FROM part WHERE contains(lower(p_name), 'ring') ORDER BY 1 LIMIT 10")
def h16(spark, d):
    from docmill.operators.retrieval import suggestions

    return suggestions(table(spark, d, "part").withColumnRenamed("p_name", "query"), "ring", 10)
