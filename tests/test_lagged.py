"""Ridge models from lagged sums against the models of built windows, and the sums against a plain loop."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.operators import backtest, forecast, lagged

FEATURES = ["a", "b", "c"]
SPLITS = [("A", 1990, 1997), ("B", 1990, 1994)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = []
    for split, lo, hi in SPLITS:
        for e in ("x", "y", "z"):
            n = 150 if e != "z" else 6
            v = rng.standard_normal((n, 3)).cumsum(0) * 0.3
            for k in range(n):
                year = 1990 + k // 12
                part = "train" if lo <= year <= hi else "val" if year == hi + 1 else "test" if year <= hi + 4 else None
                a, b, c = (float(q) for q in v[k])
                if e == "y" and k in (30, 31, 77):  # gaps of an input and of the target
                    a, c = (None, c) if k != 77 else (a, None)
                data.append((split, e, dt.date(year, k % 12 + 1, 1), part, a, b, c))
    return spark.createDataFrame(data, "split_id string, entity_id string, month date, part string, a double, b double, c double").repartition(3).cache()


def grid(spark, cells):
    return spark.createDataFrame(cells, "feature_set string, features array<string>, lookback int")


@pytest.mark.parametrize("joint", [False, True])
def test_models_equal_those_of_windows(spark, rows, joint):
    cells = lagged.experiments(rows, grid(spark, [("all", FEATURES, 12), ("two", ["b", "c"], 12), ("all", FEATURES, 5)]))
    got = lagged.models(rows, cells, FEATURES, "c", 3, joint=joint).toPandas()
    assert set(got.entity_id) == {"x", "y"} and len(got) == 2 * 2 * 3 * 3
    pred = lagged.predictions(rows, cells, FEATURES, "c", 3, joint=joint).toPandas()
    for name, features, lookback in (("all", FEATURES, 12), ("two", ["b", "c"], 12), ("all", FEATURES, 5)):
        pairs = backtest.windows(rows, features, "c", lookback, 3)
        models = forecast.coefficients(pairs, joint=joint)
        want = models.toPandas().merge(got[(got.feature_set == name) & (got.lookback == lookback)], on=["split_id", "entity_id", "horizon"], suffixes=("", "_got"))
        assert len(want) == 12 and (want.alpha == want.alpha_got).all() and np.allclose(want.intercept, want.intercept_got, rtol=1e-8, atol=1e-8)
        for a, b in zip(want.coef, want.coef_got, strict=True):
            assert np.abs(np.array(a) - np.array(b)).max() < 1e-8
        p = forecast.predicted(pairs, models).where("part <> 'train'").toPandas()
        both = p.merge(pred[(pred.feature_set == name) & (pred.lookback == lookback)], on=["split_id", "entity_id", "horizon", "part", "target_month"], suffixes=("", "_got"))
        assert len(both) == len(p) == ((pred.feature_set == name) & (pred.lookback == lookback)).sum()
        assert np.allclose(both.pred, both.pred_got, atol=1e-8) and np.allclose(both.y, both.y_got) and np.allclose(both.persistence, both.persistence_got)


def test_empty_and_short_series(spark, rows):
    cells = lagged.experiments(rows, grid(spark, [("all", FEATURES, 12)]))
    assert lagged.models(rows.limit(0), cells, FEATURES, "c", 3).count() == 0
    assert lagged.models(rows, cells.limit(0), FEATURES, "c", 3).count() == 0
    assert lagged.models(rows.where("entity_id = 'z'"), cells, FEATURES, "c", 3).count() == 0
    assert lagged.predictions(rows.where("part = 'train'"), cells, FEATURES, "c", 3).count() == 0
    whole = lagged.experiments(rows, grid(spark, [("all", FEATURES, 400)]))
    assert lagged.models(rows, whole, FEATURES, "c", 3).count() == 0


def test_lagged_sums(spark, rows):
    one = rows.where("entity_id = 'y' and split_id = 'A'")
    got = {(r.year, r.lag, r.earlier, r.later): (r.n, r.total) for r in lagged.lagged_sums(one.withColumn("one", F.lit(1.0)), [*FEATURES, "one"], 4).collect()}
    g = one.orderBy("month").toPandas().assign(one=1.0)
    years = np.array([m.year for m in g.month])
    for year in (1990, 1992, 1996):
        for lag in range(4):
            for a in ("a", "c", "one"):
                for b in ("b", "c", "one"):
                    p = [g[a][s] * g[b][s + lag] for s in np.flatnonzero(years == year) if s + lag < len(g)]
                    p = [v for v in p if not np.isnan(v)]
                    assert got[year, lag, a, b][0] == len(p) and np.isclose(got[year, lag, a, b][1], sum(p))


def test_running_sums_of_a_range(spark):
    f = np.random.default_rng(1).standard_normal((30, 2))
    r = lagged.Running(f, 5)
    for d, lo, hi in ((0, 3, 9), (4, 0, 26), (2, 10, 11)):
        assert np.allclose(r.blocks(d, np.array([lo]), np.array([hi]))[0], f[lo:hi].T @ f[lo + d : hi + d])
