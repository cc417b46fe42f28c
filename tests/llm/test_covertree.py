"""Near vectors against all cosines."""

import numpy as np

from quillstack.llm import covertree


def brute(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {i: [0, i] for i, _ in rows}
    up = {i: i for i, _ in ok}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(ok):
        for j, b in ok[:n]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                out[i][0] += 1
                out[j][0] += 1
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    for i, _ in ok:
        out[i][1] = top(i)
    return {i: tuple(x) for i, x in out.items()}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    x = np.concatenate((base[rng.integers(0, 40, 200)] + rng.normal(size=(200, 8)) * rng.choice([0.02, 0.2, 0.4], (200, 1)), rng.normal(size=(60, 8)), np.repeat(base[:1], 30, axis=0), base[:1] * 1e-30))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] + [1.0] * 7), (9004, [None] + [1.0] * 7), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, []), (9008, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", __import__("pyspark").sql.functions.lit(3))
    for size in (16, 64, 2048):
        got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(df, node_size=size).collect()}
        assert got == brute(rows, 0.95)
    kept = covertree.near_vectors(df, node_size=64).where("kept").count()
    assert kept == len({c for _, c in got.values()})
    assert covertree.near_vectors(df.where("false")).count() == 0


def test_null_id(spark):
    got = covertree.near_vectors(spark.createDataFrame([(None, [1.0]), (1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)}
