import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"


def expected(vectors):
    """By exact integers, numpy's eigenvalues of the covariance, and rows as they come."""
    rows = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    once = sorted({x for _, x in rows})
    n, dims = len(once), len(once[0])
    sums = [sum(x[j] for x in once) for j in range(dims)]
    a = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(dims)] for x in once])
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    return rows, n, sums, e, v


def check(got, vectors, k=4):
    rows, n, sums, e, v = expected(vectors)
    assert len(got) == len(rows) * k
    want = {}
    for i, x in rows:
        want.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums)), (np.array(x) - np.array(sums) / n) @ v[:, :k] / np.sqrt(e[:k])))
    signs = {}
    for r in got:
        j = r.component - 1
        assert r.n == n and r.deviation in [d for d, _ in want[r.vec_id]]
        assert abs(r.explained - e[j] / e.sum()) <= 1e-9
        assert r.identity_error < 1e-9
        w = next(w for d, w in want[r.vec_id] if d == r.deviation)
        if abs(w[j]) > 1e-4:
            signs.setdefault(j, math.copysign(1, w[j]) * math.copysign(1, r.whitened))
        assert abs(r.whitened * signs.get(j, 1) - w[j]) < 1e-7


def test_query_is_brute_force(spark):
    t = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pydict()
    check(queries.op12_whitening(spark, FOLDER).collect(), list(zip(t["vec_id"], t["embedding"])))


def test_nulls_copies_and_bad_entries(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * [4, 3, 2, 1, 0.5, 0.1] + 0.3]) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(1, rows[1][1]), (None, rows[2][1])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 4), (2002, [math.nan] * 6), (2003, [math.inf] * 6), (2004, [-0.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    check(queries.op12_whitening(spark, str(tmp_path)).collect(), rows)


def test_more_tasks_than_a_node_of_the_tree_takes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(70)
    with whitening.Scratch(spark, "test") as scratch:
        x = df.select(whitening.integers(df["embedding"]).alias("x"))
        r = whitening._triangular(x, np.zeros(3), scratch)
    a = np.floor(256 * np.array([v for _, v in rows]))
    assert np.allclose(r.T @ r, a.T @ a, rtol=1e-12)


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_jacobi_keeps_small_values(d):
    """Columns of very different scale: the least singular value has its full relative accuracy."""
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    scale = 10.0 ** -np.linspace(0, 12, d)
    s, v = whitening.jacobi(q * scale)
    assert np.allclose(s, scale, rtol=1e-12)
    assert np.allclose(v @ v.T, np.eye(d), atol=1e-12)


def test_degenerate_tables(spark, tmp_path):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    empty.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path))
    assert got.count() == 0 and got.dtypes[1:4] == [("component", "int"), ("n", "bigint"), ("deviation", "bigint")]
    one = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [1.0])], "vec_id long, embedding array<float>").selectExpr("*", "'a' AS x__", "'b' AS whitened")
    model = whitening.fit(one)
    got = whitening.whiten(one, model)
    assert model.n == 1 and model.identity_error == 0 and got.columns == ["vec_id", "embedding", "x__", "deviation", "whitened"]
    assert [tuple(r) for r in got.select("vec_id", "x__", "deviation", "whitened").orderBy("vec_id").collect()] == [(1, "a", 0, [0.0, 0.0]), (2, "a", 0, [0.0, 0.0])]
    big = spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(big, whitening.fit(big)).collect()} >= {None}
