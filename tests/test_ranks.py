"""Places in a global order."""

from collections import defaultdict

from pyspark.sql import functions as F

from docmill.operators.ranks import ranked

def test_places_without_a_hot_group(spark):
    """A third of all rows are equal in what orders them, another third in their group; places run from 1 without gaps."""
    rows = [(None if i % 3 == 0 else "a" if i % 3 == 1 else f"g{i % 7}", i % 5 if i % 2 else None) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, v int").repartition(6)
    got = ranked(d, [F.desc_nulls_last("v")], "place", ["g"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.place, r.v))
    assert len(got) == 3000
    for own in by.values():
        own.sort()
        values = [-1 if v is None else v for _, v in own]
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and values == sorted(values, reverse=True)
    assert sorted(r.rank for r in ranked(d, [F.asc("v")]).collect()) == list(range(1, 3001))
    assert ranked(d.limit(0), [F.asc("v")]).count() == 0
