"""Registered queries: scalar functions (G), and chunk-level filters (B) that are one expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import files, text as tx
from docmill.operators import filters

from .registry import query
from .views import CHUNKS_SQL, KEYWORDS_SQL, chunks, table, title_of

T1 = "string_split(text, chr(10))[1]"
WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
Q = "SELECT item_id, {} FROM benchmark"


def _any(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


_S = "trim(text, ' ' || chr(10) || chr(9))"
_TYPE = f"CASE WHEN {_S} = '' THEN 'complex' WHEN {_any(_S, tx.RELATIONAL)} THEN 'relational' WHEN len({WORDS.format(_S)}) <= 8 AND {_any(_S, tx.FACTUAL)} THEN 'factual' WHEN len({WORDS.format(_S)}) <= 5 AND regexp_matches({_S}, '[을를]\\s*(설명|알려)') THEN 'factual' WHEN len({WORDS.format(_S)}) <= 2 AND NOT regexp_matches({_S}, '[?？]') THEN 'keyword' ELSE 'complex' END"


@query("g1_query_type", f"SELECT doc_id, chunk, kind, CASE kind WHEN 'factual' THEN 'vector' WHEN 'relational' THEN 'graph' WHEN 'keyword' THEN 'keyword' ELSE 'hybrid' END AS strategy FROM (SELECT doc_id, chunk, {_TYPE} AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS chunk FROM documents))")
def g1(spark, d):
    c = chunks(spark, d).select(F.col("document_id").alias("doc_id"), F.col("chunk_index").alias("chunk"), tx.query_type(F.col("content")).alias("kind"))
    return c.withColumn("strategy", tx.search_strategy(F.col("kind")))


def _score(signs):
    return " + ".join(f"contains(lower(text), '{s}')::INT" for s in signs)


@query("g2_planned_strategy", f"SELECT doc_id, CASE WHEN k > 0 AND m > 0 THEN 'hybrid' WHEN k > m THEN 'keyword' WHEN m > k THEN 'semantic' ELSE 'hybrid' END AS strategy FROM (SELECT doc_id, {_score(tx.KEYWORD_SIGNS)} AS k, {_score(tx.MEANING_SIGNS)} AS m FROM documents)")
def g2(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.planned_strategy(F.col("text")).alias("strategy"))


_CLEAN = "regexp_replace(w, '[?!.。,;:]+$', '')"
@query("g3_query_words", f"SELECT item_id, array_to_string(ws, '|') AS words, len(ws)::BIGINT AS n FROM (SELECT item_id, list_filter(flatten([[regexp_replace({_CLEAN}, '[은는이가을를의와과에서로도만으로부터까지에게]+$', ''), {_CLEAN}] FOR w IN {WORDS.format('text')} IF length(w) >= 2]), lambda w: length(w) >= 2) AS all_, list_filter(all_, lambda w, i: list_position(all_, w) = i) AS ws FROM benchmark)")
def g3(spark, d):
    w = table(spark, d, "benchmark").select("item_id", tx.query_words(F.col("text")).alias("w"))
    return w.select("item_id", F.array_join("w", "|").alias("words"), F.size("w").cast("long").alias("n"))


# The part's number chooses how its type is named: known names, synonyms in other cases, blanks, unknown names, none.
_NAMED = ["people", " Company", "TOOL", "methodology", "Period", "place ", "Organization", "p_type"]
_TYPED = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {n if n == 'p_type' else repr(n)}" for i, n in enumerate(_NAMED)) + " END"
_TYPES = "CASE " + " ".join(f"WHEN lower(trim(source)) = '{k}' THEN '{v}'" for k, v in tx.ENTITY_TYPES.items()) + " WHEN source IN (" + ", ".join(f"'{v}'" for v in sorted(set(tx.ENTITY_TYPES.values()))) + ") THEN source ELSE 'Concept' END"
_LABELS = "CASE typ " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.TYPE_LABELS.items()) + " ELSE 'Topic' END"
_KEYS = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LABEL_KEYS.items()) + " ELSE 'name' END"
@query("g4_g5_entity_types", f"SELECT *, {_KEYS} AS key FROM (SELECT *, {_LABELS} AS label FROM (SELECT p_partkey, source, {_TYPES} AS typ FROM (SELECT p_partkey, {_TYPED} AS source FROM part)))")
def g4(spark, d):
    named = F.when(F.col("p_partkey") % 9 == 7, F.col("p_type"))
    for i, n in enumerate(_NAMED[:7]):
        named = named.when(F.col("p_partkey") % 9 == i, n)
    p = table(spark, d, "part").select("p_partkey", named.alias("source")).withColumn("typ", tx.entity_type(F.col("source"))).withColumn("label", tx.graph_label(F.col("typ")))
    return p.withColumn("key", tx.merge_key(F.col("label")))


@query("g5_slug", "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug FROM part")
def g5(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


def _case_types():
    path = " ".join(f"WHEN contains(lower(url), '{k}') THEN '{v}'" for k, v in tx.PATH_TYPES.items())
    content = " ".join("WHEN " + " OR ".join(f"contains(lower(substr(html, 1, 2000)), '{s}')" for s in signs) + f" THEN '{k}'" for k, signs in tx.CONTENT_TYPES.items())
    return f"CASE {path} {content} ELSE 'unknown' END"


@query("g6_document_type", f"SELECT page_id, {_case_types()} AS doc_type FROM pages")
def g6(spark, d):
    return table(spark, d, "pages").select("page_id", tx.document_type(F.col("url"), F.col("html")).alias("doc_type"))


@query("g7_file_format", "SELECT page_id, CASE lower(string_split(url, '.')[-1]) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' ELSE 'unknown' END AS format FROM pages")
def g7(spark, d):
    return table(spark, d, "pages").select("page_id", tx.file_format(F.col("url")).alias("format"))


@query("g9_public_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'processing' END AS status FROM orders")
def g9(spark, d):
    raw = F.when(F.col("o_orderstatus") == "O", "uploaded").when(F.col("o_orderstatus") == "F", "completed").otherwise("indexing")
    return table(spark, d, "orders").select("o_orderkey", tx.public_status(raw).alias("status"))


@query("g10_title_keywords", f"SELECT doc_id, array_to_string({KEYWORDS_SQL.format(t=T1)}, '|') AS names, regexp_matches({T1}, '\\.[\\p{{L}}\\p{{N}}_]{{2,5}}$') AS is_file FROM documents")
def g10(spark, d):
    t = title_of(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.title_keywords(t), "|").alias("names"), tx.is_file_name(t).alias("is_file"))


@query("g11_audit_action", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'purchase' THEN 'CREATE' WHEN 'view' THEN 'READ' WHEN 'click' THEN 'SEARCH' ELSE 'DELETE' END AS action, CASE WHEN event_type = 'click' THEN 'SEARCH' ELSE 'DOCUMENTS' END AS resource, '10.0.' || user_id % 256 || '.' || event_id % 256 AS ip FROM events")
def g11(spark, d):
    e = table(spark, d, "events")
    method = F.when(F.col("event_type").isin("signup", "purchase"), "POST").when(F.col("event_type") == "error", "DELETE").otherwise("GET")
    path = F.when(F.col("event_type") == "click", "/api/v1/search/q").otherwise("/api/v1/documents/7")
    ip = F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256)
    return e.select("event_id", files.audit_action(method, path).alias("action"), files.resource_type(path).alias("resource"), files.client_address(F.concat(ip, F.lit(", 1.1.1.1")), F.lit("9.9.9.9")).alias("ip"))


@query("g12_validity", "SELECT o_orderkey, CASE WHEN DATE '1998-01-01' < o_orderdate::DATE THEN 'NOT_YET_VALID' WHEN DATE '1998-01-01' > (o_orderdate + INTERVAL 1 YEAR)::DATE THEN 'EXPIRED' ELSE 'VALID' END AS validity FROM orders")
def g12(spark, d):
    start = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", tx.validity(start, F.add_months(start, 12), F.lit("1998-01-01").cast("date")).alias("validity"))


@query("g13_snippet", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def g13(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("g14_hashes", "SELECT doc_id, sha256(text) AS file_hash, substr(sha256(text), 1, 16) AS short, sha256('search:' || lower(trim(text)) || ':{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}:10:true:1') AS cache_key FROM documents")
def g14(spark, d):
    h = tx.query_hash(F.col("text"))
    key = tx.cache_key("search", F.col("text"), F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")), 10, True, 1)
    return table(spark, d, "documents").select("doc_id", h.alias("file_hash"), F.substring(h, 1, 16).alias("short"), key.alias("cache_key"))


@query("g15_l2_normalise", "SELECT vec_id, round(v[1] / n, 6) AS first, round(list_sum([x / n * (x / n) FOR x IN v]), 6) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) AS n FROM embeddings)")
def g15(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", tx.l2_normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", 0), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("g17_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 10)), 6) AS score FROM events")
def g17(spark, d):
    return table(spark, d, "events").select("event_id", F.round(tx.sigmoid(F.col("value") / 10), 6).alias("score"))


@query("g21_answer_sentences", "SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))::BIGINT AS sentences FROM documents")
def g21(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.answer_sentences(F.col("text"))).cast("long").alias("sentences"))


@query("g22_context_line", "SELECT event_id, '[' || event_type || '] ' || user_id || ' (score: ' || printf('%.4f', value) || ')' AS line FROM events")
def g22(spark, d):
    return table(spark, d, "events").select("event_id", F.format_string("[%s] %d (score: %.4f)", "event_type", "user_id", "value").alias("line"))


@query("g24_clean_text", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents")
def g24(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("g25_truncate", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN instr(reverse(h), ' ') > 0 AND 100 - instr(reverse(h), ' ') > 50 THEN substr(h, 1, (100 - instr(reverse(h), ' '))::INT) || '...' ELSE h || '...' END AS short FROM (SELECT doc_id, text, substr(text, 1, 100) AS h FROM documents)")
def g25(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncated(F.col("text"), 100).alias("short"))


@query("g26_rough_tokens", "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def g26(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.rough_tokens(F.col("text")).alias("tokens"))


@query("g27_tokens", f"SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS distinct_n, t[1] AS first FROM (SELECT doc_id, regexp_extract_all(translate(lower(text), '{tx.ACCENTS}', '{tx.PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents)")
def g27(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("distinct_n"), F.get("t", 0).alias("first"))


@query("g28_char_grams", "SELECT p_partkey, sum(greatest(0, length(p_name) - n + 1))::BIGINT AS grams, count(*)::BIGINT AS sizes FROM part, range(2, 21) r(n) WHERE n <= length(p_name) GROUP BY p_partkey")
def g28(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.size(tx.char_grams(F.col("p_name"))).cast("long").alias("grams"), (F.least(F.lit(20), F.length("p_name")) - 1).cast("long").alias("sizes"))
    return p


@query("f8_token_estimate", CHUNKS_SQL + "SELECT chunk_id, token_count FROM chunks")
def f8(spark, d):
    return chunks(spark, d).select("chunk_id", "token_count")


@query("f3_sentences", "SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '([.!?]\\s+)', '\\1' || chr(1), 'g'), '(\\n\\n)', '\\1' || chr(1), 'g'), '\\n(#{1,6}\\s)', chr(10) || chr(1) || '\\1', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(9)) <> ''))::BIGINT AS sentences FROM documents")
def f3(spark, d):
    from docmill.operators.chunking import sentences

    return table(spark, d, "documents").select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("sentences"))


_MEANING = "length(regexp_replace(c, '[^\\p{L}\\p{N}_]', '', 'g'))"
_NOISE = " OR ".join(f"regexp_matches(c, '{p}')" for p in filters.CHUNK_NOISE)
@query("b5_quality_gate", CHUNKS_SQL + f", t AS (SELECT *, trim(content, ' ' || chr(9) || chr(13)) AS c FROM chunks) SELECT chunk_id, CASE WHEN c = '' THEN 'empty' WHEN token_count < 50 THEN 'few_tokens' WHEN length(c) < 30 THEN 'short' WHEN {_NOISE} THEN 'noise' WHEN {_MEANING} / length(c)::DOUBLE < 0.3 THEN 'symbols' END AS reject_reason FROM t")
def b5(spark, d):
    return chunks(spark, d).select("chunk_id", filters.reject_reason(F.col("content"), F.col("token_count"), F.lit(None)).alias("reject_reason"))


@query("b6_section_noise", CHUNKS_SQL + "SELECT chunk_id, length(content)::BIGINT AS n FROM chunks WHERE NOT (" + " OR ".join(f"regexp_matches(trim(content), '{p}')" for p in filters.SECTION_NOISE) + ") AND length(trim(content)) >= 100")
def b6(spark, d):
    c = chunks(spark, d)
    return filters.real_sections(c, "content", 100).select("chunk_id", F.length("content").cast("long").alias("n"))


_JUNK = "name IS NULL OR length(name) < 2 OR name = 'None' OR starts_with(name, '/') OR starts_with(name, '.') OR " + " OR ".join(f"contains(name, '{p}')" for p in tx.JUNK_PARTS + tx.JUNK_DOCS)
@query("b7_junk_names", f"SELECT doc_id, name, ({_JUNK}) AS junk FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex({T1}, '\\s+'), lambda w: w <> ''))) AS name FROM documents)")
def b7(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(title_of(F.col("text"))))).alias("name"))
    return w.withColumn("junk", tx.is_junk_name(F.col("name")))


@query("b12_artefacts", CHUNKS_SQL + "SELECT count(*)::BIGINT AS total, count(*) FILTER (regexp_matches(content, '[■□★☆●○◆◇△▽▷◁▶◀♠♣♥♦]'))::BIGINT AS glyph, count(*) FILTER (length(content) < 50)::BIGINT AS short, round(count(*) FILTER (length(content) < 50) * 100.0::DOUBLE / count(*), 4) AS short_percent FROM chunks")
def b12(spark, d):
    return filters.artefact_report(chunks(spark, d), "content")


_STRIP = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', '', 'g')"
@query("b13_markup", f"SELECT page_id, sha256({_STRIP}) AS plain_hash, regexp_matches(html, '(?is)<script[^>]*>.*?</script>|javascript\\s*:|\\bon[a-z0-9_]+\\s*=|data\\s*:[^,]*;base64|vbscript\\s*:') AS suspicious FROM pages")
def b13(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.sha2(filters.plain_text(h).cast("binary"), 256).alias("plain_hash"), filters.suspicious(h).alias("suspicious"))
