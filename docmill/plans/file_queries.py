"""Registered queries of what reads or writes files, streams and model answers: the files are made by Spark from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from docmill.functions import files as fs, records as rc, text as tx
from docmill.operators import analytics as an, filters as fl, fusion as fu, quality as qu, retrieval as rt, sinks as si
from docmill.operators.storage import scratch, staged
from docmill.sources import readers as rd
from docmill.streaming import jobs, latest

from .registry import query
from .search_queries import ALL_SQL, BM25_SQL, SPARSE_SQL, WITH, channels, docs_of
from .views import EVENTS_SQL, KEYWORDS_SQL, events, table, title_of

L = lambda c: F.col(c).cast("long").alias(c)


def text_folders(spark, d):
    """The documents' texts as UTF-8 files, a folder for each language and source; one source is put into a junk folder."""
    path = scratch(spark, "texts")
    docs = table(spark, d, "documents").withColumn("part", F.when(F.col("source") == "src3", "node_modules").otherwise("texts"))
    docs.select("text", "part", "lang", "source").repartition("part", "lang", "source").write.partitionBy("part", "lang", "source").text(path)
    return path


def folder(name):
    return F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)


@query("a1_file_discovery", "SELECT lang, source, 'txt' AS extension, sum(strlen(text) + 1)::BIGINT AS size FROM documents WHERE source <> 'src3' GROUP BY ALL")
def a1(spark, d):
    f = rd.discover_files(spark, text_folders(spark, d)).select(folder("lang"), folder("source"), "extension", "size")
    return f.groupBy("lang", "source", "extension").agg(F.sum("size").alias("size"))


@query("a2_read_texts", "SELECT lang, source, sum(length(text) + 1)::BIGINT AS n_chars FROM documents GROUP BY ALL")
def a2(spark, d):
    t = rd.read_texts(spark, text_folders(spark, d)).select(folder("lang"), folder("source"), F.length("text").alias("n"))
    return t.groupBy("lang", "source").agg(F.sum("n").alias("n_chars"))


# A file is decoded whole by one worker, so files are of bounded length, and more of them are written of more rows.
LINES_PER_FILE = 50_000


# Every text, with an accent at its start, in Latin-1 for odd numbers and in UTF-8 for even ones, one folder each; lines come back as they were.
@query("a2_other_encodings", "SELECT doc_id % 2 AS odd, sha256(line) AS line_hash, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split('é' || regexp_replace(text, '[^\\x{0a}\\x{20}-\\x{7e}]', '?', 'g'), chr(10))) AS line FROM documents) GROUP BY ALL")
def a2_other(spark, d):
    path = scratch(spark, "encoded")
    plain = F.regexp_replace("text", "[^\\x0A\\x20-\\x7E]", "?")
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.concat(F.lit("é"), plain), "\n")).alias("line"))
    # The writer leaves empty rows out, so each line has a mark at its end.
    docs = docs.withColumn("line", F.concat("line", F.lit("|")))
    # One column without quotes or escapes is a text file, and only this writer takes an encoding.
    write = lambda df, odd, encoding: df.where(F.col("doc_id") % 2 == odd).select("line").write.options(encoding=encoding, quote="\u0000", sep="\u0001", emptyValue="", escape="\u0000", maxRecordsPerFile=LINES_PER_FILE).csv(f"{path}/odd={odd}")
    write(docs, 0, "UTF-8")
    write(docs, 1, "ISO-8859-1")
    t = rd.read_texts(spark, path).select(F.regexp_extract("path", "/odd=([01])/", 1).cast("long").alias("odd"), F.explode(F.split(F.regexp_replace("text", "\n\\z", ""), "\n")).alias("line"))
    t = t.withColumn("line", F.substr("line", F.lit(1), F.length("line") - 1))
    return t.groupBy("odd", F.sha2("line", 256).alias("line_hash")).agg(F.count("*").alias("n"))


# The words after "the" are taken as pictures.
PICTURED = "regexp_replace(text, '(^| )the ([a-z]+)', '\\1![\\2 shown](img/\\2.png)', 'g')"
@query("a6_images", f"WITH t AS (SELECT doc_id, regexp_extract_all({PICTURED}, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1) AS alt, regexp_extract_all({PICTURED}, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2) AS target FROM documents) SELECT doc_id, unnest(range(len(alt)))::BIGINT AS pos, unnest(alt) AS alt, unnest(target) AS target FROM t")
def a6(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "(^| )the ([a-z]+)", "$1![$2 shown](img/$2.png)").alias("text"))
    return rd.markdown_images(t, "doc_id", "text").select("doc_id", L("pos"), "alt", "target")


# A conversation as a notebook: what the assistant says is code, and every third turn is empty.
CELLS_SQL = "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'code' WHEN 'user' THEN 'markdown' ELSE 'raw' END AS cell_type, CASE WHEN turn % 3 = 2 THEN ' ' ELSE text END AS source FROM conversations"
def notebooks(spark, d):
    kind = F.when(F.col("role") == "assistant", "code").when(F.col("role") == "user", "markdown").otherwise("raw")
    source = F.when(F.col("turn") % 3 == 2, F.array(F.lit(" "))).otherwise(F.array(F.col("text")))
    cells = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("cell_type"), source.alias("source")))).alias("cells"))
    return cells.select("conv_id", F.to_json(F.struct("cells")).alias("body"))


BOOK_SQL = f"SELECT conv_id, string_agg(CASE cell_type WHEN 'code' THEN '```python' || chr(10) || trim(source) || chr(10) || '```' ELSE trim(source) END, chr(10) || chr(10) ORDER BY turn) AS text, count(*)::BIGINT AS n_cells FROM ({CELLS_SQL}) WHERE trim(source) <> '' GROUP BY conv_id"
@query("a7_notebooks", BOOK_SQL)
def a7(spark, d):
    return rd.notebook_texts(notebooks(spark, d), "conv_id", "body")


@query("a10_pending_export", "SELECT doc_id AS chunk_id, length(substr(text, 1, 8000))::BIGINT AS n FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def a10(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    path = scratch(spark, "pending")
    si.pending_export(docs_of(spark, d).join(v, "chunk_id", "left"), path)
    back = spark.read.schema("chunk_id long, document_id long, content string").json(path)
    return back.select("chunk_id", F.length("content").cast("long").alias("n"))


@query("a11_question_set", "SELECT conv_id, text AS question, CASE WHEN turn % 4 = 2 THEN role END AS ground_truth FROM conversations")
def a11(spark, d):
    turns = table(spark, d, "conversations")
    named = F.when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.col("text").alias("q"), F.col("role").alias("gt")))).when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.col("text").alias("question")))).otherwise(F.to_json(F.array("text")))
    entry = F.when(F.col("turn") % 4 < 1, F.substr(named, F.lit(2), F.length(named) - 2)).when(F.col("turn") % 4 == 3, F.substr(named, F.lit(2), F.length(named) - 2)).otherwise(named)
    lists = turns.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("body"))
    return rd.questions_in(lists, "body")


@query("a13_parse_batch", f"""WITH b AS ({BOOK_SQL}), f AS (SELECT 'nb/' || conv_id AS path, conv_id % 7 <> 0 AS ok, CASE WHEN conv_id % 7 = 0 THEN 'invalid' END AS error, CASE WHEN conv_id % 7 <> 0 THEN text END AS text FROM b
UNION ALL SELECT 'doc/' || doc_id, source NOT IN ('src1', 'src2'), CASE source WHEN 'src1' THEN 'unsupported' WHEN 'src2' THEN 'unreadable' END, CASE WHEN source NOT IN ('src1', 'src2') THEN text END FROM documents)
SELECT path, ok, error, length(text)::BIGINT AS n_chars FROM f""")
def a13(spark, d):
    books = notebooks(spark, d).select(F.concat(F.lit("nb/"), "conv_id").alias("path"), F.lit("ipynb").alias("extension"), F.when(F.col("conv_id") % 7 == 0, "{broken").otherwise(F.col("body")).alias("text"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.when(F.col("source") == "src1", "exe").otherwise("TXT").alias("extension"), F.when(F.col("source") != "src2", F.col("text")).alias("text"))
    return rd.parse_batch(books.unionByName(docs))[0].select("path", "ok", "error", F.length("text").cast("long").alias("n_chars"))


FAST = {"en": 1, "de": 2, "fr": 3}
@query("b15_work_order", "SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 99 END, n_chars, doc_id) AS place FROM documents")
def b15(spark, d):
    return fl.work_rank(table(spark, d, "documents"), "lang", "n_chars", "doc_id", FAST).select("doc_id", F.col("rank").cast("long").alias("place"))


@query("b16_admission", "WITH l AS (SELECT lang AS format, avg(n_chars)::BIGINT AS max_bytes FROM documents WHERE lang <> 'fr' GROUP BY lang) SELECT doc_id, CASE WHEN max_bytes IS NULL THEN 'unsupported' WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 100 THEN 'too_small' WHEN n_chars > max_bytes THEN 'too_large' END AS reason FROM documents LEFT JOIN l ON format = lang")
def b16(spark, d):
    docs = table(spark, d, "documents")
    limits = docs.where("lang <> 'fr'").groupBy(F.col("lang").alias("format")).agg(F.round(F.avg("n_chars")).cast("long").alias("max_bytes"))
    return fl.admission(docs.select("doc_id", F.col("lang").alias("format"), F.col("n_chars").alias("size")), limits, 100).select("doc_id", "reason")


_RAW = "string_split(text, chr(10))[1] || '/../' || source || '??.' || lang"
_FLAT = f"regexp_replace(trim(regexp_replace(regexp_replace(nfc_normalize(replace(regexp_replace({_RAW}, '[/\\\\\\\\]', '_', 'g'), '..', '_')), '[^\\p{{L}}\\p{{N}}_\\s.\\-]', '_', 'g'), '_{{2,}}', '_', 'g'), ' _.'), '', '')"
@query("g8_safe_file_name", f"WITH s AS (SELECT doc_id, {_FLAT} AS s FROM documents), x AS (SELECT doc_id, s, string_split(s, '.')[-1] AS suffix FROM s) SELECT doc_id, CASE WHEN s = '' THEN 'unnamed_document' WHEN length(s) > 255 THEN substr(s, 1, greatest(0, 254 - length(suffix))::INT) || '.' || suffix ELSE s END AS name FROM x")
def g8(spark, d):
    raw = F.concat(title_of(F.col("text")), F.lit("/../"), "source", F.lit("??."), "lang")
    return table(spark, d, "documents").select("doc_id", fs.safe_file_name(raw).alias("name"))


@query("g16_sparse_prune", WITH + BM25_SQL + ", " + SPARSE_SQL.split("sk AS (")[0] + "x AS (SELECT chunk_id, token, weight FROM sw WHERE weight >= 0.1 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, token) <= 50) SELECT * FROM x")
def g16(spark, d):
    docs = docs_of(spark, d)
    w = rt.sparse_weights(rt.text_index(docs, ["content"]), "content", docs.count(), 0.0, 1_000_000)
    maps = w.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("weights"))
    return maps.select("chunk_id", F.explode(tx.pruned_sparse(F.col("weights"))).alias("token", "weight"))


# Answers of a model: the JSON of a document's title and keywords, fenced, bare in a sentence, or missing.
KEYS_SQL = KEYWORDS_SQL.format(t="string_split(text, chr(10))[1]")
def answers(spark, d):
    t = title_of(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", "lang", t.alias("title"), tx.title_keywords(t).alias("names"))
    named = F.transform("names", lambda x, i: F.struct(F.when(i % 2 == 0, F.concat(F.lit("id"), i.cast("string"))).alias("id"), x.alias("name"), F.when(i % 3 == 0, "company").when(i % 3 == 1, "Concept").alias("type"), F.when(i == 0, F.lit("first")).alias("description")))
    tied = F.when(F.size("names") > 1, F.transform(F.slice("names", 2, 10), lambda x, i: F.struct(F.lit("id0").alias("source"), F.concat(F.lit("x"), i.cast("string")).alias("target"), F.when(i == 0, "uses").alias("type"))))
    body = F.to_json(F.struct(named.alias("entities"), tied.alias("relationships"), "title", F.col("names").alias("keywords")))
    fence = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))
    return docs.select("doc_id", "title", F.when(F.col("doc_id") % 3 == 0, fence).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Well: "), body, F.lit(" so."))).otherwise("no idea").alias("answer"))


@query("g18_json_part", "SELECT doc_id, doc_id % 3 < 2 AS found, CASE WHEN doc_id % 3 < 2 THEN string_split(text, chr(10))[1] END AS title FROM documents")
def g18(spark, d):
    part = tx.json_part(F.col("answer"))
    return answers(spark, d).select("doc_id", (part != "").alias("found"), F.get_json_object(part, "$.title").alias("title"))


@query("g19_records", f"""WITH k AS (SELECT doc_id, {KEYS_SQL} AS names FROM documents WHERE doc_id % 3 < 2), n AS (SELECT doc_id, names, unnest(range(len(names))) AS i FROM k),
e AS (SELECT 'entity' AS kind, doc_id || ':' || CASE WHEN i % 2 = 0 THEN 'id' || i ELSE 'e' || (i + 1) END AS a, trim(names[i + 1]) AS b, CASE WHEN i % 3 = 0 THEN 'Organization' ELSE 'Concept' END AS c, CASE WHEN i = 0 THEN 'first' ELSE '' END AS d FROM n WHERE trim(names[i + 1]) <> ''),
r AS (SELECT 'relation' AS kind, doc_id || ':id0' AS a, doc_id || ':x' || (i - 1) AS b, CASE WHEN i = 1 THEN 'USES' ELSE 'RELATED_TO' END AS c, '' AS d FROM n WHERE i >= 1),
m AS (SELECT 'metadata' AS kind, doc_id::VARCHAR AS a, CASE WHEN doc_id % 3 < 2 THEN string_split(text, chr(10))[1] ELSE '' END AS b, 'unknown' AS c, CASE WHEN doc_id % 3 < 2 THEN array_to_string({KEYS_SQL}, '|') ELSE '' END AS d FROM documents)
SELECT * FROM e UNION ALL SELECT * FROM r UNION ALL SELECT * FROM m""")
def g19(spark, d):
    a = answers(spark, d)
    row = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[F.col(x).cast("string").alias(n) if isinstance(x, str) else x.alias(n) for x, n in zip(c, "abcd")])
    e = row(rc.entities(a, "doc_id", "answer"), "entity", "id", "name", "type", "description")
    r = row(rc.relationships(a, "doc_id", "answer"), "relation", "src", "dst", "rel_type", "description")
    return e.unionByName(r).unionByName(row(rc.metadata(a, "doc_id", "answer"), "metadata", "doc_id", "title", "document_type", F.array_join("keywords", "|")))


@query("g20_csv_field", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS field FROM documents")
def g20(spark, d):
    return table(spark, d, "documents").select("doc_id", si.csv_field(F.col("text")).alias("field"))


_W, _N = "[^\\p{L}\\p{N}_]", 97
_MARKED = f"replace(regexp_replace(regexp_replace(x, '({_W})', chr(1) || '\\1' || chr(1), 'g'), '(?i)(^|' || chr(1) || ')(the)($|' || chr(1) || ')', '\\1<em>\\2</em>\\3', 'g'), chr(1), '')"
@query("g23_highlights", f"SELECT doc_id, list_transform(regexp_extract_all(text, '(?is)(?:\\A|.{{0,{_N}}}{_W})the(?:\\z|{_W}.{{0,{_N}}})')[1:3], lambda x: {_MARKED}) AS fragments FROM documents")
def g23(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.highlighted(F.col("text"), "the").alias("fragments"))


# Every channel counts alike and ranks weigh more than by default.
@query("h8_rrf_arguments", ALL_SQL + ", eq AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (10 + rank) ORDER BY no), 6) AS score, count(*)::BIGINT AS n_sources FROM ch GROUP BY ALL) SELECT * FROM eq")
def h8(spark, d):
    weights = dict.fromkeys(fu.WEIGHTS, 1.0)
    fu.check_arguments(list(weights), list(weights.values()), 10)
    return fu.fused(fu.contributions(channels(spark, d), weights, 10)).select("query_id", "chunk_id", "score", "n_sources")


# Each table of the given ones against the next: what a loader that expects the one finds in the other. The SQL names types as Spark does.
PAIRS = [("documents", "pages"), ("orders", "lineitem"), ("customer", "supplier"), ("nation", "region"), ("labels", "documents"), ("conversations", "benchmark"), ("events", "events")]
_FIELDS = "(SELECT column_name AS field, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE replace(lower(column_type), 'float[]', 'array<float>') END AS kind FROM (DESCRIBE {}))"
_DRIFT = "SELECT '{0}' AS expected_table, '{1}' AS actual_table, coalesce(e.field, a.field) AS field, e.kind AS expected, a.kind AS actual, CASE WHEN a.field IS NULL THEN 'missing' WHEN e.field IS NULL THEN 'unexpected' ELSE 'type' END AS problem FROM " + _FIELDS.format("{0}") + " e FULL JOIN " + _FIELDS.format("{1}") + " a ON e.field = a.field WHERE e.kind IS DISTINCT FROM a.kind"
@query("j11_schema_drift", " UNION ALL ".join(_DRIFT.format(*p) for p in PAIRS))
def j11(spark, d):
    one = lambda e, a: qu.schema_drift(spark, table(spark, d, e).schema, table(spark, d, a).schema).select(F.lit(e).alias("expected_table"), F.lit(a).alias("actual_table"), "field", "expected", "actual", "problem")
    return reduce(lambda x, y: x.unionByName(y), [one(*p) for p in PAIRS])


_TWO = "round({c}, 2)::DECIMAL(18,2)::VARCHAR"
@query("j13_benchmark_report", "WITH r AS (SELECT event_type, count(*) AS n, avg(value) AS mean, " + ", ".join(f"max(value) FILTER (i = least(floor(n0 * {p} / 100), n0 - 1)) AS p{p}" for p in (50, 95, 99)) + " FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n0 FROM events) GROUP BY event_type), t AS (SELECT event_type, n::VARCHAR AS n, " + ", ".join(f"{_TWO.format(c=c)} AS {c}" for c in ("p50", "p95", "p99")) + " FROM r) SELECT 'csv' AS kind, concat_ws(',', event_type, n, p50, p95, p99) AS line FROM t UNION ALL SELECT 'markdown', '| ' || concat_ws(' | ', event_type, n, p50, p95, p99) || ' |' FROM t UNION ALL SELECT 'json', concat_ws('/', event_type, n, p50, p95, p99) FROM t")
def j13(spark, d):
    r = an.ranked_percentiles(events(spark, d), ["event_type"], "value")
    r = staged(r.select("event_type", F.col("n").cast("string").alias("n"), *[F.round(c, 2).cast("decimal(18,2)").cast("string").alias(c) for c in ("p50", "p95", "p99")]), "report")
    path = scratch(spark, "report-json")
    si.report_json(r, path)
    back = spark.read.schema(r.schema).json(path).select(F.lit("json").alias("kind"), F.concat_ws("/", *r.columns).alias("line"))
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), "line")
    return line(si.report_csv(r), "csv").unionByName(line(si.report_markdown(r), "markdown")).unionByName(back)


def event_stream(spark, d):
    """The events as a stream of files."""
    path = scratch(spark, "event-files")
    e = events(spark, d).select("event_id", "ts", "user_id", "event_type", "value")
    e.repartition(4).write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)


def finished(stream):
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


@query("k1_continuous_ingest", "SELECT event_id, event_type, round(value * 2, 6) AS doubled FROM events WHERE event_type IN ('view', 'click')")
def k1(spark, d):
    out = scratch(spark, "ingested")
    step = lambda df: df.where(F.col("event_type").isin("view", "click")).select("event_id", "event_type", F.round(F.col("value") * 2, 6).alias("doubled"))
    write = lambda df, no: df.write.mode("overwrite").parquet(f"{out}/batch={no}")  # noqa: E731  once for each batch number
    finished(jobs.ingest(event_stream(spark, d), step, write, scratch(spark, "ingest-log")))
    return spark.read.schema("event_id long, event_type string, doubled double").option("recursiveFileLookup", True).parquet(out)


@query("k10_stream_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def k10(spark, d):
    out = scratch(spark, "latest")
    step = lambda df: df.select("user_id", "event_id", "event_type", "ts")
    finished(jobs.ingest(event_stream(spark, d), step, latest.upsert_into(out, "user_id", ["ts", "event_id"]), scratch(spark, "upsert-log")))
    return latest.latest(spark, out, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("l12_evaluation_report", "SELECT lang, count(*)::BIGINT AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def l12(spark, d):
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))
    path = scratch(spark, "evaluation")
    si.report_json(r, path)
    return spark.read.schema("lang string, n long, quality double, toxic double").json(path)
