"""The manifest against plain trees: nulls, repeated rows, groups of many sizes, runs of two and three, claims."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docmill.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, k):
    """Levels from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + k]) for i in range(0, len(levels[-1]), k)])
    return levels


def proof(levels, i, k):
    """For each level the others of the run, and the place among them."""
    steps = []
    for level in levels[:-1]:
        run = level[i - i % k : i - i % k + k]
        steps.append((run[: i % k], run[i % k + 1 :]))
        i //= k
    return steps


def plain(rows, k):
    """Sorted (id, leaf, subroot, root, proof hash, folded root) with one character more claimed for ids that 3 divides."""
    groups = defaultdict(list)
    for r in rows:
        d, text, lang, source, n = r
        row = lambda n: h(*map(field, (d, source, lang, n, text)))
        groups[lang].append((d is not None, d or 0, row(n), row(n + 1 if d is not None and d % 3 == 0 and n is not None else n), d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], k) for g in names}
    top = tree([trees[g][-1][0] for g in names], k)
    out = []
    for at, g in enumerate(names):
        for i, (_, _, leaf, claimed, d) in enumerate(sorted(groups[g])):
            steps = proof(trees[g], i, k) + proof(top, at, k)
            x = claimed
            for left, right in steps:
                x = h(*left, x, *right)
            out.append((str(d), leaf, trees[g][-1][0], top[-1][0], h(*[s for left, right in steps for s in left + right]), x))
    return sorted(out)


ROWS = [(i, f"text {i}" * (i % 4), ["en", "de", None, "é", "z" if i == 7 else "en"][i % 5], None if i % 6 == 0 else f"s{i % 2}", None if i % 11 == 0 else i) for i in range(83)]
ROWS += [(None, None, "en", None, None), (None, "x", "en", None, 3), (5, "other", "en", "s", 1)] + [(90, "same", "de", "s", 4)] * 3 + [(91, "", "", "", 0), (92, "long " * 40_000, "only", "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_plain_trees(spark, arity):
    names = ["g", "i", "n", "h", "left", "right", "path", "root", "place", "pg", "claimed", "id", "__tie", "__skip"]
    d = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in names}).repartition(5)
    claims = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.build_manifest(d, claims=claims, arity=arity).withColumn("proof", F.sha2(merkle.proof_digests(F.col("path")).cast("binary"), 256)).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got) == plain(ROWS, arity)
    assert {r.doc_id for r in got if not r.verified} == {d for d, _, _, _, n in ROWS if d is not None and d % 3 == 0 and n is not None}


def test_small_and_empty_tables(spark):
    for rows in ([], ROWS[:1], ROWS[2:4]):
        got = merkle.build_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == len(rows) and all(r.verified for r in got)
        assert sorted((str(r.doc_id), r.root) for r in got) == sorted((x[0], x[3]) for x in plain(rows, 2))
