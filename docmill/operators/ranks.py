"""Places of rows in a global order, without a task that sees them all.

Rows are dealt by ranges of their order, with the bounds that Spark samples, and sorted within each range. A row's place
is its place within its range plus the number of rows in the ranges before; only one count for each range and group
meets elsewhere. Where rows agree in all that orders them their place in the input decides, so one value that a third of
all rows share spreads over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import small, staged

#: monotonically_increasing_id() counts a partition's rows in its lower 33 bits.
ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", groups: Sequence[str] = ()) -> DataFrame:
    """df with a long column: each row's place, from 1, by order among the rows that agree in groups, nulls being equal.

    order holds sort orders such as F.desc("n"). Rows that are equal in all of it take their places in any way, which a
    rerun may settle otherwise; a unique last key prevents that. All of df's columns are moved and written once, so leave
    out what is not wanted; stage what is dear, because the bounds are sampled by a run of its own. An empty table gives
    an empty one.
    """
    tie, at, part, first, n, skip = (_free(df, x) for x in ("__tie", "__at", "__part", "__first", "__n", "__skip"))
    sort = [*[F.col(g).asc_nulls_first() for g in groups], *order, F.col(tie).asc()]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    d = staged(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()), "ranks").withColumn(part, F.shiftright(at, ROW_BITS))
    ranges = staged(d.groupBy(part, *groups).agg(F.min(at).alias(first), F.count("*").alias(n)), "ranges")
    before = W.partitionBy(*groups).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn(skip, F.coalesce(F.sum(n).over(before), F.lit(0))).select(F.col(part).alias(n), *[F.col(g).alias(f"{skip}_{i}") for i, g in enumerate(groups)], first, skip)
    same = F.col(part) == F.col(n)
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"{skip}_{i}"))
    joined = d.join(small(starts), same)
    return joined.select(*[F.col(c) for c in df.columns], (F.col(skip) + F.col(at) - F.col(first) + 1).alias(name))


def _free(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores in front as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(wanted) for c in taken):
        wanted = f"_{wanted}"
    return wanted
