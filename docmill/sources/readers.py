"""Files and tables to documents: discovery, decoding, HTML, Markdown, notebooks, question sets, vectors."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import any_of, words

# What is read, and parts of paths that hold nothing to read.
EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "hwp", "md", "txt", "html", "ipynb"]
JUNK_PATHS = ["__pycache__", "\\.git", "node_modules", "\\.pytest_cache", "\\.vscode", "\\.idea", "\\.DS_Store", "Thumbs\\.db"]
ENCODINGS = ["utf-8", "cp949", "euc-kr", "latin-1"]


def discover_files(spark: SparkSession, path: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """A1: (path, name, extension, size, modified) of the files worth reading; contents are not read. Files of no bytes are left out, as Spark's readers do."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.substring_index(name, ".", -1))
    return f.where(~any_of([F.col("path").rlike(p) for p in JUNK_PATHS]) & ext.isin(extensions)).select("path", name.alias("name"), ext.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


@F.pandas_udf(T.StringType())
def decoded(contents: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        for e in ENCODINGS if b is not None else []:
            try:
                return b.decode(e)
            except UnicodeDecodeError:
                continue
        return None

    return contents.map(one)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A2: (path, text); UTF-8 is checked natively, only the rest goes through other encodings."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    f = f.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("valid"), "content")
    # A function in Python sees every row, whatever stands around it; so valid files are null in its input.
    return f.select("path", F.coalesce("valid", decoded(F.when(F.col("valid").isNull(), F.col("content")))).alias("text"))


class Visible(HTMLParser):
    """Text nodes outside of what is not shown; any end tag ends the hidden part."""

    HIDDEN = frozenset({"script", "style", "head", "meta"})

    def __init__(self):
        super().__init__()
        self.now, self.parts = "", []

    def handle_starttag(self, tag, attrs):
        self.now = tag

    def handle_endtag(self, tag):
        self.now = ""

    def handle_data(self, data):
        if self.now not in self.HIDDEN and data.strip():
            self.parts.append(data.strip())


def html_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A3: (key, text, n_words, n_chars), one line per text node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source in batch[html]:
                parser = Visible()
                parser.feed(source or "")
                out.append("\n".join(parser.parts))
            yield pd.DataFrame({key: batch[key], "text": out})

    t = pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, text string")
    return t.withColumns({"n_words": F.size(words(F.col("text"))).cast("long"), "n_chars": F.length("text").cast("long")})


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A4: (key, section, level, title, body) from one heading to the next; what stands before the first is dropped."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("mark", F.regexp_extract("line", "^(#{1,6})\\s+\\S", 1))
    head = F.col("mark") != ""
    lines = lines.withColumn("section", F.sum(head.cast("int")).over(W.partitionBy(key).orderBy("pos"))).where("section >= 1")
    body = F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("pos", "line")))), lambda x: x["line"])
    g = lines.groupBy(key, "section").agg(F.max(F.when(head, F.length("mark"))).alias("level"), F.max(F.when(head, F.trim(F.regexp_replace("line", "^#{1,6}\\s+", "")))).alias("title"), F.array_join(body, "\n").alias("body"))
    return g.select(key, F.col("section").cast("long").alias("section"), F.col("level").cast("long").alias("level"), "title", "body")


def markdown_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A5: (key, table_no, row, col, content, is_header) of runs of two piped lines or more, rules left out."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where(F.col("line").rlike("^\\|.*\\|$"))
    w = W.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("island", F.col("pos") - F.row_number().over(w))
    lines = lines.withColumn("n", F.count("*").over(W.partitionBy(key, "island"))).where("n >= 2")
    lines = lines.withColumns({"table_no": F.dense_rank().over(W.partitionBy(key).orderBy("island")), "first": F.row_number().over(W.partitionBy(key, "island").orderBy("pos")) == 1})
    rows = lines.where(~F.col("line").rlike("^\\|[-:\\s|]+\\|$")).withColumn("row", F.row_number().over(W.partitionBy(key, "island").orderBy("pos")) - 1)
    cells = rows.select(key, "table_no", "row", "first", F.posexplode(F.split(F.regexp_replace("line", "^\\||\\|$", ""), "\\|")).alias("col", "content"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return cells.select(key, long("table_no"), long("row"), long("col"), F.trim("content").alias("content"), F.col("first").alias("is_header"))


def markdown_images(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alt, target) of image references, in order."""
    p = "!\\[([^\\]]*)\\]\\(([^)]+)\\)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("alt"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("target"))
    return docs.select(key, F.posexplode(both).alias("pos", "x")).select(key, "pos", "x.alt", "x.target")


NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:string>>>"


def notebook_texts(docs: DataFrame, key: str, body: str) -> DataFrame:
    """A notebook's cells as one text, code fenced; cells without text have no number."""
    lines = F.from_json("source", "array<string>")
    cells = docs.select(key, F.posexplode(F.from_json(body, NOTEBOOK)["cells"]).alias("pos", "c")).select(key, "pos", "c.*")
    cells = cells.withColumn("source", F.trim(F.coalesce(F.array_join(lines, ""), "source"))).where("source <> ''")
    cells = cells.withColumn("no", F.row_number().over(W.partitionBy(key).orderBy("pos")))
    shown = F.when(F.col("cell_type") == "code", F.concat(F.lit("```python\n"), "source", F.lit("\n```"))).otherwise(F.col("source"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", shown.alias("s")))), lambda x: x["s"])
    return cells.groupBy(key).agg(F.array_join(parts, "\n\n").alias("text"), F.count("*").alias("n_cells"))


def titled(docs: DataFrame, text: Column, name: Column) -> DataFrame:
    """The first top heading, else the file's name without its suffix; with counts."""
    head = F.regexp_extract(text, "(?m)^#\\s+(.+)$", 1)
    stem = F.regexp_replace(F.substring_index(name, "/", -1), "\\.[^.]*$", "")
    return docs.withColumns({"title": F.when(head != "", F.trim(head)).otherwise(stem), "n_words": F.size(words(text)).cast("long"), "n_letters": F.length(text).cast("long")})


def imported_vectors(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of chunk vectors, bad lines kept apart by _corrupt_record."""
    return spark.read.schema("chunk_id string, document_id string, dense_vector array<float>, sparse_vector map<string,double>, _corrupt_record string").json(path)


def with_vectors(chunks: DataFrame, new: DataFrame, skip_completed: bool = True) -> DataFrame:
    """Chunks (chunk_id, embedding, embedding_status) with imported vectors; completed ones stay if told so."""
    n = new.where("dense_vector is not null").dropDuplicates(["chunk_id"]).select("chunk_id", F.col("dense_vector").alias("__v"))
    j = chunks.join(n, "chunk_id", "left")
    take = F.col("__v").isNotNull() & (F.lit(not skip_completed) | (F.coalesce("embedding_status", F.lit("")) != "completed"))
    return j.withColumns({"embedding": F.when(take, F.col("__v").cast(chunks.schema["embedding"].dataType)).otherwise(F.col("embedding")), "embedding_status": F.when(take, "completed").otherwise(F.col("embedding_status"))}).drop("__v")


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, ground_truth) from a JSON list of strings or of objects with other names for the same."""
    return questions_in(spark.read.option("wholetext", True).text(path), "value").select("question", "ground_truth")


def questions_in(lists: DataFrame, column: str) -> DataFrame:
    """A row (..., question, ground_truth) for each entry of JSON lists of strings or objects; other columns stay."""
    raw = lists.select(*[c for c in lists.columns if c != column], F.explode(F.from_json(column, "array<string>")).alias("x"))
    get = lambda *names: F.coalesce(*[F.get_json_object("x", f"$.{n}") for n in names])
    plain = ~F.col("x").startswith("{")
    return raw.select(*[c for c in raw.columns if c != "x"], F.when(plain, F.col("x")).otherwise(get("question", "q")).alias("question"), F.when(~plain, get("ground_truth", "answer", "gt")).alias("ground_truth")).where("question is not null")


def parse_batch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, text[, extension]) -> (path, ok, error, text) with what each holds, and totals.

    HTML and notebooks are parsed, Markdown and plain text are taken as they are (also where no extension is given); one
    bad file stops no other: it is unreadable, empty, of an unsupported kind, or invalid.
    """
    kind = F.lower("extension") if "extension" in files.columns else F.lit("txt")
    f = files.select("path", "text", kind.alias("kind"))
    html = html_texts(f.where(F.col("kind").isin("html", "htm") & F.col("text").isNotNull()), "path", "text").select(F.col("path").alias("p"), F.col("text").alias("shown"))
    books = notebook_texts(f.where((F.col("kind") == "ipynb") & F.col("text").isNotNull()), "path", "text").select(F.col("path").alias("p"), F.col("text").alias("shown"))
    parsed = f.join(html.unionByName(books), F.col("path") == F.col("p"), "left")
    body = F.when(F.col("kind").isin("html", "htm", "ipynb"), F.col("shown")).otherwise(F.col("text"))
    invalid = (F.col("kind") == "ipynb") & F.from_json("text", NOTEBOOK)["cells"].isNull()
    error = F.when(F.col("text").isNull(), "unreadable").when(~F.col("kind").isin("md", "txt", "html", "htm", "ipynb"), "unsupported").when(invalid, "invalid").when(F.coalesce(body, F.lit("")) == "", "empty")
    out = parsed.select("path", error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), body).alias("text"))
    return out, out.agg(F.count("*").alias("files"), F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("failed"))


def sliced(docs: DataFrame, key: str, text: str, size: int = 10_000) -> DataFrame:
    """Long texts in parts of a fixed size."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int"))
    return docs.select(key, F.explode(starts).alias("part"), text).select(key, "part", part_title(F.col("part")).alias("title"), F.substr(F.col(text), F.col("part") * size + 1, F.lit(size)).alias("body"))


def part_title(part: Column) -> Column:
    return F.concat(F.lit("(chunk "), part + 1, F.lit(")"))


def split_long(docs: DataFrame, key: str, text: str, sections: int = 10, size: int = 10_000) -> DataFrame:
    """(key, part, title, body): so many sections a part, or slices of a fixed size where a text has no section."""
    s = markdown_sections(docs, key, text).withColumn("part", F.floor((F.col("section") - 1) / sections).cast("int"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda x: x["body"])
    parts = s.groupBy(key, "part").agg(F.array_join(body, "\n").alias("body"))
    plain = docs.where(~F.coalesce(F.col(text), F.lit("")).rlike("(?m)^#{1,6}\\s+\\S"))
    return parts.select(key, "part", part_title(F.col("part")).alias("title"), "body").unionByName(sliced(plain, key, text, size))
