"""Whitening of embeddings against numpy's eigenpairs and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 7) for i, v in rows], SCHEMA)


def plain(rows, k=4):
    """Fit list, components and rows by the definition, with numpy's eigenvectors."""
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    n, s = len(fit), [sum(int(v) for v in c) for c in fit.T]
    z = fit - np.array([v / n for v in s])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return good, n, s, e, u, np.trace(z.T @ z / n), z


@pytest.mark.parametrize("d", [3, 24])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, (rng.standard_normal(d) * np.linspace(2, 0.3, d) + 3).tolist()) for i in range(300)]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (900, rows[5][1]), (901, None), (902, [None] * d), (903, [float("nan")] * d), (904, [float("inf")] * d), (905, [1.0]), (906, [])]
    good, n, s, e, u, trace, _ = plain([r for r in rows if r[0] not in (905, 906)])
    got = whitening.whiten(table(spark, rows)).toPandas()
    k = min(4, d)
    assert len(got) == k * len(good) and set(got["n"]) == {n} and n == 300
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    sign = None
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, c + 1, sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True)), float((np.array(x) - np.array(s) / n) @ u[:, c] / np.sqrt(e[c])), e[c] / trace) for i, x in good for c in range(k)), key=key)
    have = sorted(((None if np.isnan(r.vec_id) else int(r.vec_id), r.component, r.deviation, r.whitened, r.explained) for r in got.itertuples()), key=key)
    assert [r[:3] for r in have] == [r[:3] for r in want]
    assert np.allclose([r[4] for r in have], [r[4] for r in want], rtol=1e-10)
    for c in range(1, k + 1):
        a, b = (np.array([r[3] for r in x if r[1] == c]) for x in (have, want))
        sign = np.sign(a @ b)
        assert np.allclose(a, sign * b, atol=1e-8)


def test_degenerate_tables(spark):
    same = [(i, [1.0, 2.0]) for i in range(5)]
    for rows in ([], same, same[:1], [(1, None)], [(1, [])]):
        assert whitening.whiten(table(spark, rows)).count() == 0
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)])).toPandas()
    assert set(line["component"]) == {1} and np.allclose(line["explained"], 1.0)
    big = whitening.whiten(table(spark, [(1, [1e15, 1.0]), (2, [2e15, 3.0]), (3, [1e38, 1.0])])).toPandas()
    assert set(big["vec_id"]) == {1, 2} and big["deviation"].isna().all() and np.allclose(np.abs(big["whitened"]), 1.0)


def test_deviation_is_exact_on_both_ways():
    x = np.array([[3, -7], [2**30, 5]], dtype=np.int64)
    for n, s in ((3, [5, -9]), (10**9, [10**12, 7])):
        want = [sum((n * v - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x.tolist()]
        assert whitening.deviations(x, n, s) == [w if w < 2**63 else None for w in want]


@pytest.mark.parametrize("kind", ["plain", "rank one", "equal values", "near values", "zero"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = {"plain": rng.random(30), "rank one": np.r_[2.0, np.zeros(29)], "equal values": np.ones(30), "near values": np.r_[5, 5, 5 + 1e-9, 4.999, np.ones(26)], "zero": np.zeros(30)}[kind]
    a = q * values @ q.T
    v, u = eigen.leading((a + a.T) / 2, 4)
    assert np.allclose(v, np.sort(values)[::-1][:4], atol=1e-13) and np.abs(a @ u - u * v).max() < 1e-13 and np.abs(u.T @ u - np.eye(4)).max() < 1e-13


def test_rows_are_dealt_by_spark(spark):
    v = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i).cast("float") for i in range(8))).alias("embedding")).repartition(7)
    assert whitening.whiten(v.unionByName(v)).groupBy("component").count().where("count = 4000").count() == 4
