import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import nearest


def brute(vectors, queries, k=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at]
        order = [i for i in np.lexsort((ids, -s)) if i != at][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_recall_on_the_table(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding and any(r.embedding)]
    want = brute(vectors, [i for i, _ in vectors if i % 20 == 0])
    got = {}
    for r in sorted(nearest.query(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.95 * sum(map(len, want.values()))
    exact = dict(vectors)
    for q, rows in got.items():
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        assert all(math.isclose(s, float(np.dot(np.array(exact[q], float), np.array(exact[i], float))), rel_tol=1e-9, abs_tol=1e-12) for i, s in rows)


def test_edges(spark):
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(30)]
    bad = [(100, None), (120, []), (140, [0.0] * 8), (160, [1.0] * 7 + [float("nan")]), (180, [1.0] * 7 + [float("inf")]), (200, [1.0] * 7 + [None]), (220, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, rank int")
    got = nearest.search(df, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20} and all(r.vec_id < 100 and r.vec_id != r.query_id for r in got)
    few = nearest.search(df.where("vec_id < 5 or vec_id is null"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.rank, r.query_id) for r in few) == [(k, 0) for k in range(1, 5)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] * 2, "vec_id long, embedding array<double>")
    ties = sorted((r.rank, r.vec_id) for r in nearest.search(same, F.col("vec_id") == 0, k=5).collect())
    assert [v for _, v in ties][:2] == [1, 1]  # repeated rows are rows
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_a_longer_vector_leaves_its_batch_alone(spark):
    rows = [(i, [float(i + 1), 1.0, float(i % 3)]) for i in range(12)] + [(99, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = nearest.search(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [11, 10, 9]


def test_many_dimensions_and_queries_that_repeat(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 768))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, [0, 50, 100, 150])
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.95 * 80
    other = [-float(v) for v in rows[0][1]]
    first = min(rows[0][1], other)
    twice = nearest.search(df.unionByName(spark.createDataFrame([(0, other)], df.schema)), F.col("vec_id") == 0, k=1).collect()
    best = max((float(np.dot(first, v)), -i) for i, v in rows[1:])
    assert [(r.query_id, r.vec_id) for r in twice] == [(0, -best[1])]


def test_estimates_come_from_packed_words():
    """The counted bits give the product with the rounded query, and the product with the query within the rounding."""
    rng = np.random.default_rng(3)
    for dim in (64, 200):
        bits = nearest.code_bits(dim)
        turn = nearest.rotation(dim, bits)
        q, signs = rng.normal(size=(5, dim)) @ turn, rng.integers(0, 2, (300, bits))
        codes = np.packbits(signs.astype(bool), axis=1, bitorder="little").view(np.uint64)
        plane, low, step = nearest.planes(q)
        for r in range(5):
            rounded = low[r] + step[r] * np.rint((q[r] - low[r]) / step[r])
            got = nearest.estimates(codes, signs.sum(axis=1), plane[r], low[r], step[r], rounded.sum())
            assert np.allclose(got, (2 * signs - 1) @ rounded / np.sqrt(bits))
            assert np.abs(got - (2 * signs - 1) @ q[r] / np.sqrt(bits)).max() < step[r] * 4


def test_estimates_of_long_vectors():
    """A code against the query it was made of: the weighted counts don't overflow at any length."""
    rng = np.random.default_rng(1)
    for dim in (64, 4096, 16_384, 65_536):
        q = rng.normal(size=(1, dim))
        codes = np.packbits(q > 0, axis=1, bitorder="little").view(np.uint64)
        plane, low, step = nearest.planes(q)
        held = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        total = low[0] * dim + step[0] * sum(int(np.bitwise_count(plane[0, j]).sum(dtype=np.int64)) << j for j in range(nearest.PLANES))
        exact = np.abs(q).sum() / np.sqrt(dim)
        assert abs(nearest.estimates(codes, held, plane[0], low[0], step[0], total)[0] - exact) < 0.02 * exact
