import math

import numpy as np

from reelspark.llm import embeddings as E
from reelspark.llm import queries


def brute(rows, threshold=0.93):
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, parent = {}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(ok)):
        for y in range(x):
            (i, a, u), (j, b, w) = ok[x], ok[y]
            if a == b and len(u) == len(w) and u @ w / math.sqrt(u @ u) / math.sqrt(w @ w) >= threshold:
                n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, n.get(i, 0), find(i), find(i) == i) for i, _, _ in rows)


def planted(rng, n=700, dim=64):
    base = rng.standard_normal((40, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(40)] + rng.uniform(0, 0.45) * rng.standard_normal(dim)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.1, 10)], int(rng.integers(0, 3))))
    return rows


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    rows = planted(np.random.default_rng(4))
    rows += [(800, rows[0][1], rows[0][2]), (801, rows[0][1], rows[0][2]), (802, rows[0][1], None), (803, None, 1), (804, [0.0] * 64, 1), (805, [float("nan")] + [1.0] * 63, 1), (806, [None] + [1.0] * 63, 1), (807, [1.0, 2.0], 1), (808, [2.0, 4.0], 1), (809, [], 1), (810, [float("inf")] * 64, 1), (811, [-x for x in rows[1][1]], rows[1][2])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute([(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert sorted(map(tuple, queries.op4_embedding_dedup(spark, str(tmp_path)).collect())) == want
    assert sum(r[1] for r in want) > 400
    monkeypatch.setattr(E, "TILE", 5)  # large groups are compared tile by tile
    assert sorted(map(tuple, queries.op4_embedding_dedup(spark, str(tmp_path)).collect())) == want
    monkeypatch.setattr(E, "TILE", 100)
    exact = E.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), miss=0)  # all pairs of a label, tile by tile
    assert sorted(map(tuple, exact.collect())) == want


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((2, 64))
    y = 0.6 * x + 0.8 * y
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    err = []
    for r in range(400):
        p = E.rotation(64, r, 1)
        o, q = x @ p, y @ p
        f = np.abs(o).sum() / 8
        err.append((np.sign(o) @ q / 8 / f - x @ y) / (math.sqrt(1 - f * f) / f / math.sqrt(63)))
    assert abs(np.mean(err)) < 0.2 and np.max(np.abs(err)) < E.SIGMAS
    est = E.Estimates(np.stack([x, y]), 1)
    assert est.upper(np.array([0]), np.array([1]))[0] >= x @ y and est.upper(np.array([1]), np.array([0]))[0] >= x @ y


def test_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 1.0], 1, 3), (5, [1.0, 1.0], 1, 3), (5, [1.0, 1.0], 1, 3), (5, [1.0, -1.0], 1, 3)], "vec_id long, embedding array<double>, label int, v int")
    got = sorted(map(str, map(tuple, E.near_duplicates(df).collect())))
    assert got == sorted(["(None, 0, None, True)", "(5, 1, 5, True)", "(5, 1, 5, True)", "(5, 0, 5, True)"])
    assert E.near_duplicates(df.limit(0)).count() == 0
    words = spark.createDataFrame([(1, [1.0, 1.0], "a"), (2, [1.0, 1.1], "a"), (3, [1.0, 1.0], "b"), (4, [1.0, 1.0], None)], "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, E.near_duplicates(words).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
