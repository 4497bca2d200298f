import numpy as np

from docmill.llm import embedding_dedup as op


def brute(rows, threshold):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, float) / np.linalg.norm(v))
    links = {i: [j for j in ok if i in ok and j != i and ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1]) and ok[i][1] @ ok[j][1] >= threshold] for i, _, _ in rows}
    root = {i: i for i in links}
    for _ in links:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


def test_links_match_brute_force(spark):
    r = np.random.default_rng(1)
    rows = []
    for c in range(40):
        centre = r.standard_normal(16)
        rows += [(len(rows) + k, (centre + r.standard_normal(16) * r.choice([0.02, 0.15, 0.3])).tolist(), int(c % 3)) for k in range(r.integers(1, 12))]
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, None, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("nan")] + [1.0] * 15, 1), (n + 5, rows[0][1], None), (n + 6, [None] + [1.0] * 15, 1), (n + 7, [], 1), (n + 8, [1.0, 2.0], 1)]
    d = op.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=4, recall=0.99999)
    assert {x.vec_id: tuple(x.near_vec) for x in d.collect()} == brute(rows, 0.93)


def test_empty_table(spark):
    assert op.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_plan_grows_slowly():
    small, large = op.table_plan(1000, 0.93, 0.99), op.table_plan(1_000_000, 0.93, 0.99)
    assert small[0] < large[0] and large[1] < 12 * small[1]
