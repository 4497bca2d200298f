"""Filters and gates: search filters, listings, chunk quality, work selection, admission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.text import any_of

from .ranks import ranked
from .storage import small

# Shapes of chunks and of sections that say nothing.
CHUNK_NOISE = ["^[-=*_]{3,}$", "^```[A-Za-z0-9_]*$", "^#+\\s*$", "^\\|[-:\\s|]+\\|$", "^>\\s*$", "^\\s*\\[\\^?[0-9]+\\]:\\s*$"]
SECTION_NOISE = ["^-{3,}$", "^={3,}$", "^```\\w*$", "^\\*{3,}$", "^_{3,}$", "^\\s*<!--.*?-->\\s*$"]
GLYPHS = "[■□★☆●○◆◇△▽▷◁▶◀♠♣♥♦]"
BROKEN = "[\\ufff0-\\uffff\\x00-\\x08\\x0e-\\x1f]{3,}"


def search_filter(equal: dict | None = None, any_value: dict | None = None, dates: dict | None = None, any_tag: dict | None = None) -> Column:
    """B1: the conjunction of what is given: equal values, lists of values, inclusive ranges open at None, shared tags."""
    parts = [F.col(c) == v for c, v in (equal or {}).items()]
    parts += [F.col(c).isin(list(v)) for c, v in (any_value or {}).items()]
    for c, (low, high) in (dates or {}).items():
        parts += [F.col(c) >= low] if low is not None else []
        parts += [F.col(c) <= high] if high is not None else []
    parts += [F.arrays_overlap(F.col(c), F.array(*[F.lit(x) for x in v])) for c, v in (any_tag or {}).items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page by its number from 1; order ends in a unique key."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def contains_any(columns: list[str], word: str) -> Column:
    """A word in any of the columns, whatever its case."""
    return any_of([F.contains(F.lower(c), F.lit(word.lower())) for c in columns])


def meaningful_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}_]", "")) / F.length(text)


def reject_reason(content: Column, tokens: Column, block_type: Column) -> Column:
    """Why a chunk fails the gate; null if it passes."""
    text = F.regexp_replace(content, "^\\s+|\\s+$", "")
    block = F.coalesce(block_type.isin("code", "table"), F.lit(False))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(block, F.when((tokens < 20) | (F.length(text) < 30), "small_block"))
        .when(tokens < 50, "few_tokens")
        .when(F.length(text) < 30, "short")
        .when(any_of([text.rlike(p) for p in CHUNK_NOISE]), "noise")
        .when(meaningful_share(text) < 0.3, "symbols")
    )


def real_sections(df: DataFrame, column: str, least: int) -> DataFrame:
    """Sections that are not one noise mark and are long enough."""
    text = F.trim(F.col(column))
    return df.where(~any_of([text.rlike("(?U)" + p) for p in SECTION_NOISE]) & (F.length(text) >= least))


def above_cutoff(df: DataFrame, least: float, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """The rows kept, and one row with how many were dropped."""
    return df.where(F.col(score) >= least), df.agg(F.count_if(F.col(score) < least).alias("dropped"))


def to_embed(df: DataFrame, mode: Column | None = None, force: bool = False, most_chars: int = 8000) -> DataFrame:
    """Rows without a vector and with text, the text cut."""
    wanted = F.lit(True) if force else F.col("embedding").isNull()
    kept = df.where(wanted & (F.trim("content") != "") & (mode if mode is not None else F.lit(True)))
    return kept.withColumn("content", F.substring("content", 1, most_chars))


def to_extract(df: DataFrame, done: list[DataFrame], least_tokens: int, key: str = "chunk_id") -> DataFrame:
    """Large rows that no worker's checkpoint holds, largest first."""
    seen = reduce(DataFrame.unionByName, [x.select(key) for x in done]).distinct()
    return df.where(F.col("token_count") >= least_tokens).join(seen, key, "left_anti").orderBy(F.desc("token_count"), key)


def pending(df: DataFrame, batch: int, status: str = "status", order: list | None = None) -> DataFrame:
    """Fresh rows first; older queued ones only if there are no fresh ones; one batch."""
    rank = F.when(F.col(status) == "uploaded", 0).when(F.col(status) == "queued", 1)
    ranked = df.where(F.col(status).isin("uploaded", "queued"))
    best = ranked.agg(F.min(rank).alias("best"))
    return ranked.join(F.broadcast(best), rank == F.col("best")).drop("best").orderBy(*(order or [])).limit(batch)


def artefact_report(df: DataFrame, column: str) -> DataFrame:
    """Counts of broken and short chunks."""
    c = F.col(column)
    return df.agg(F.count("*").alias("total"), F.count_if(c.rlike(GLYPHS)).alias("glyph"), F.count_if(F.length(c) < 50).alias("short"), F.round(F.try_divide(F.count_if(F.length(c) < 50) * 100.0, F.count("*")), 4).alias("short_percent"))


def plain_text(html: Column) -> Column:
    """Without scripts, styles and tags."""
    for p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[^>]*>"):
        html = F.regexp_replace(html, p, "")
    return html


def suspicious(html: Column) -> Column:
    return any_of([html.rlike(p) for p in ("(?is)<script[^>]*>.*?</script>", "(?i)javascript\\s*:", "(?i)\\bon\\w+\\s*=", "(?i)data\\s*:[^,]*;base64", "(?i)vbscript\\s*:")])


def requeued(df: DataFrame, status: str = "status") -> DataFrame:
    """Failed and completed rows may run again."""
    return df.where(F.col(status).isin("failed", "completed")).withColumn(status, F.lit("queued"))


def priority(suffix: Column, fast: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fast.items() for x in kv]), suffix), F.lit(99))


def work_order(df: DataFrame, suffix: str, size: str, key: str, fast: dict[str, int]) -> DataFrame:
    """Cheap formats first, then small files."""
    return df.orderBy(priority(F.col(suffix), fast), size, key)


def work_rank(df: DataFrame, suffix: str, size: str, key: str, fast: dict[str, int]) -> DataFrame:
    """(suffix, size, key) with each row's place in that order, from 1; nulls first."""
    return ranked(df.select(suffix, size, key), [priority(F.col(suffix), fast).asc(), F.asc_nulls_first(size), F.asc_nulls_first(key)])


def admission(df: DataFrame, limits: DataFrame, least_bytes: int = 1) -> DataFrame:
    """With the reason for which a file is not admitted; limits: (format, max_bytes), one row per format."""
    j = df.join(small(limits), "format", "left")
    size = F.col("size")
    return j.withColumn("reason", F.when(F.col("max_bytes").isNull(), "unsupported").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size < least_bytes, "too_small").when(size > F.col("max_bytes"), "too_large")).drop("max_bytes")


def numbered(df: DataFrame, partition: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(*order)))
