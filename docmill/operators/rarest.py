"""BM25 by a query's rarest term first, for short texts such as names, where one word may stand in nearly all of them.

A query's candidates are the documents that hold its rarest term; they are scored by all its terms. A document without that
term scores less than the query's other terms' gains times k1 + 1, so where the k-th best candidate is above that, the
query is settled, and no other document is looked at. The rest, and queries whose rarest term is a common one, meet all
documents. The result is the same either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyword import TextIndex, cut, keyword_top, term_gains
from .storage import SMALL_ROWS, staged

#: A term that more documents hold is a common one; so a query has at most so many candidates.
MOST_HELD = 1000


def rarest_first(terms: DataFrame, index: TextIndex, boosts: dict[str, float], k: int, digits: int | None = None, k1: float = 1.2, b: float = 0.75, most: int = MOST_HELD) -> DataFrame:
    """(query_id, chunk_id, score, rank): what keyword_top finds for terms (query_id, term[, weight]) in its channel 0."""
    gains = staged(term_gains(terms, index, boosts), "gains")
    stats = {r.field: r for r in index.statistics.collect()}  # a row for each field
    held = F.element_at(F.create_map(*[x for f, r in stats.items() for x in (F.lit(f), F.lit(float(r.n_docs)))]), F.col("field")) * F.col("share") if stats else F.lit(0.0)
    each = gains.groupBy("query_id", "term").agg(F.round(F.sum(held)).cast("long").alias("df"), F.max("gain").alias("gain"))
    lead = each.groupBy("query_id").agg(F.min(F.struct("df", "term", "gain")).alias("x"), F.sum("gain").alias("all"), F.count("*").alias("n"))
    rest = F.when(F.col("n") == 1, 0.0).otherwise((F.col("all") - F.col("x.gain")) * (k1 + 1))
    lead = staged(lead.where(F.col("x.df") <= most).select("query_id", F.col("x.term").alias("term"), rest.alias("rest")), "rarest-terms")
    # Common terms, which are no candidates' terms, are left out before the shuffle: a bounded number of words.
    common = index.frequencies.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > most).orderBy(F.desc("df"), "term").limit(SMALL_ROWS).select("term")
    fields = [i for i, f in enumerate(index.fields) if f in boosts and f in stats]
    words = F.array_distinct(F.concat(*[F.col(f"t{i}") for i in fields])) if fields else F.array().cast("array<string>")
    postings = index.documents.select("chunk_id", F.explode(words).alias("term")).join(F.broadcast(common), "term", "left_anti")
    pairs = staged(postings.join(lead.select("query_id", "term").hint("merge"), "term").select("query_id", "chunk_id"), "candidates")
    own = gains.groupBy("query_id").agg(*[F.collect_list(F.when(F.col("field") == index.fields[i], F.struct("term", "gain"))).alias(f"g{i}") for i in fields], F.count("*").alias("n_gains"))

    def score(i: int):
        length, average = F.size(f"t{i}"), stats[index.fields[i]].avg_len
        count = lambda g: F.size(F.filter(f"t{i}", lambda t: t == g["term"]))
        return F.aggregate(f"g{i}", F.lit(0.0), lambda sum_, g: sum_ + g["gain"] * count(g) * (k1 + 1) / (count(g) + k1 * (1 - b + b * length / average)))

    scored = pairs.join(index.documents, "chunk_id").join(own.hint("merge"), "query_id")
    total = F.array_max(F.array(*[score(i) for i in fields])) if fields else F.lit(0.0)
    scored = scored.select("query_id", F.lit(0).alias("channel"), "chunk_id", (total if digits is None else F.round(total, digits)).alias("score"))
    best = staged(cut(scored.where("score > 0"), k, 0), "candidates-best")
    kth = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).join(lead, "query_id")
    slack = 1e-6 if digits is None else 10.0**-digits
    settled = staged(kth.where((F.col("rest") == 0) | ((F.col("n") >= k) & (F.col("least") > F.col("rest") + slack))).select("query_id"), "settled")
    found = best.join(settled, "query_id", "left_semi").drop("channel")
    known = gains.select("query_id").distinct()  # a query of unknown terms finds nothing
    left = staged(terms.join(known, "query_id", "left_semi").join(settled, "query_id", "left_anti"), "terms-left")
    return found if left.isEmpty() else found.unionByName(keyword_top(left, index, boosts, k, digits, k1=k1, b=b).drop("channel"))
