"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows (10 consecutive words, or the whole item if it is shorter) must be contained whole, so the necessary
prefix of a window's tokens, ordered by rarity in the corpus, is its single rarest token. Texts are cut into words once
and kept as 32-bit tokens. They are joined to the prefixes only; a hit at a position fixes where the window would start,
which must lie inside the document (length and positional bound), and the tokens on both sides of it must fit. What is
left is a pair of numbers, start and window; only then are the words of the few texts concerned compared with the
window's, all of them, one row for each spot, and collected once they are verified.

Defined results: null or empty texts have no words, hit nothing and give no windows; equal windows of several items
count for each of them; repeated items count once by id; repeated documents get equal results, null ids included; texts
and words may be of any length; other columns pass through, whatever their names; with an empty benchmark nothing is
hit; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, joined_back, small, staged, text_key

#: What separates words, as a pattern and as characters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isdigit() and not "a" <= chr(c) <= "z")


def item_words(text: Column) -> Column:
    inner = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BETWEEN))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(words, items): the distinct windows with the ids of the items that hold them."""
    w = items.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, F.lit(window)))).alias("words"))
    return w.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """docs with a struct column contamination: n_words, n_hit, n_items, items_sha256, items, contaminated."""
    windows = staged(windows_of(items, item_id, item_text, window).withColumn("w", F.monotonically_increasing_id()), "benchmark-windows")
    hashes = F.transform("words", lambda x: F.hash(x))
    tokens = windows.select("w", F.size("words").alias("long"), hashes.alias("all"), F.posexplode(hashes).alias("at", "token"))
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    words = staged(texts.select("id", "th", F.transform(item_words(F.col("text")), lambda x: F.hash(x)).alias("tokens")), "tokens")
    seen = words.select(F.explode("tokens").alias("token")).join(small(tokens.select("token").distinct()), "token", "left_semi")
    seen = staged(seen.groupBy("token").agg(F.count("*").alias("n")), "token-counts")
    # The rarest token of each window; a token that no document has rules its window out.
    ranked = tokens.join(small(seen), "token", "left").withColumn("r", F.row_number().over(W.partitionBy("w").orderBy(F.coalesce("n", F.lit(0)), "token", "at")))
    prefixes = ranked.where((F.col("r") == 1) & F.col("n").isNotNull()).select("token", "at", "w", "long", F.get("all", F.col("at") - 1).alias("left"), F.get("all", F.col("at") + 1).alias("right"))
    prefixes = staged(prefixes, "benchmark-prefixes")
    around = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("pos"), F.get("tokens", i - 1).alias("before"), F.get("tokens", i + 1).alias("after")))
    found = words.select("id", "th", F.size("tokens").alias("n"), F.explode(around).alias("x")).select("id", "th", "n", "x.*").join(small(prefixes), "token")
    fits = F.coalesce(F.col("left") == F.col("before"), F.col("at") == 0) & F.coalesce(F.col("right") == F.col("after"), F.col("at") == F.col("long") - 1)
    found = found.withColumn("start", F.col("pos") - F.col("at")).where(fits & (F.col("start") >= 0) & (F.col("start") + F.col("long") <= F.col("n")))
    spots = staged(found.groupBy("id", "th").agg(F.collect_set(F.struct("start", "w")).alias("spots")), "spots")
    asked = spots.select(F.col("id").alias("sid"), F.col("th").alias("sth"), "spots")
    same = F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth"))
    there = texts.join(small(asked.drop("spots")), same, "left_semi").groupBy("id", "th").agg(F.first("text").alias("text")).join(asked, same)
    # The words are bound once, not split again for every spot.
    cut = F.flatten(F.transform(F.array(item_words(F.col("text"))), lambda x: F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["w"].alias("w"), F.slice(x, s["start"] + 1, F.lit(window)).alias("part")))))
    real = there.select("id", "th", F.explode(cut).alias("x")).select("id", "th", "x.*").join(small(windows), "w")
    real = real.where(F.slice("part", 1, F.size("words")) == F.col("words"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", F.size("words").alias("long"))), lambda s: F.sequence(s["start"], s["start"] + s["long"] - 1))))
    hits = real.groupBy("id", "th").agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    sizes = words.groupBy("id", "th").agg(F.first(F.size("tokens")).cast("long").alias("n_words"))
    hits = hits.select(F.col("id").alias("sid"), F.col("th").alias("sth"), "n_hit", "items")
    figures = sizes.join(hits, same, "left").select("id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    d, f = joined_back(docs, figures, id_col, text_col)
    at = lambda k: F.col(f"{f}.{k}")
    out = F.struct(at("n_words").alias("n_words"), at("n_hit").alias("n_hit"), F.size(at("items")).cast("long").alias("n_items"), F.sha2(F.array_join(at("items"), ",").cast("binary"), 256).alias("items_sha256"), at("items").alias("items"), (at("n_hit") > 0).alias("contaminated"))
    return d.select(*[F.col(x) for x in docs.columns], out.alias(free_name(docs, "contamination")))
