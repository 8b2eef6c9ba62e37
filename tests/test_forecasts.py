"""Models as rows, forecasts from the latest window and chained forecasts, against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.functions import special
from terralog.operators import backtest, forecast, spi

N = 144


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    months = [dt.date(1990 + k // 12, k % 12 + 1, 1) for k in range(N)]
    season = 50 + 40 * np.sin(2 * np.pi * np.arange(N) / 12)
    data = [(e, m, float(max(0.0, season[k] * rng.gamma(2.0, 0.5)))) for e in ("a", "b") for k, m in enumerate(months)]
    monthly = spark.createDataFrame(data, "entity_id string, month date, value double")
    index = spark.createDataFrame([(m, float(rng.normal())) for m in months], "month date, value double")
    splits = spark.createDataFrame([("A", 1991, 1998, 1999, 1999, 2000, 2001)], "split_id string, train_lo int, train_hi int, val_lo int, val_hi int, test_lo int, test_hi int")
    return forecast.prepared(forecast.frame(monthly, index, splits, (1991, 1998))).cache()


def test_frame_needs_no_later_rows(spark, rows):
    f = rows.where("entity_id = 'a'").orderBy("month").toPandas()
    assert list(f.month)[0] == dt.date(1991, 1, 1) and f[forecast.FEATURES].notna().all().all()
    v = f.value.to_numpy()
    assert np.allclose(f.roll3_sum[2:], v[2:] + v[1:-1] + v[:-2]) and np.allclose(f.value_lag1[1:], v[:-1]) and np.allclose(f.roll3_mean[2:], (v[2:] + v[1:-1] + v[:-2]) / 3)
    train = f[f.part == "train"]
    assert np.allclose(f.value_scaled, (v - train.value.min()) / (train.value.max() - train.value.min()))


def test_predictions_and_latest_window(spark, rows):
    pairs = backtest.windows(rows, forecast.SCALED, forecast.TARGET, 12, 3)
    models = forecast.coefficients(pairs, (10.0,)).cache()
    got = forecast.predicted(pairs, models).where("entity_id = 'a' and horizon = 2").orderBy("target_month").toPandas()
    want = backtest.ridge(pairs, (10.0,)).where("entity_id = 'a' and horizon = 2").orderBy("target_month").toPandas()
    assert np.allclose(got.pred, want.pred) and list(got.target_month) == list(want.target_month)
    latest = forecast.latest_windows(rows, forecast.SCALED, 12)
    manifest = spark.createDataFrame([("a", 1, 0.2, "validated"), ("a", 2, -0.1, "no skill")], "entity_id string, horizon int, skill double, label string")
    out = {r.horizon: r for r in forecast.forecasts(latest, models, manifest).where("entity_id = 'a'").collect()}
    f = rows.where("entity_id = 'a'").orderBy("month").toPandas()
    x = f[forecast.SCALED].to_numpy()[-12:].ravel()
    m = {r.horizon: r for r in models.where("entity_id = 'a'").collect()}
    for h in (1, 2, 3):
        assert np.isclose(out[h].predicted, m[h].intercept + x @ np.array(m[h].coef)) and out[h].month == dt.date(2002, h, 1)
    mean = np.mean([out[h].predicted for h in (1, 2, 3)])
    assert out[1].label == "validated" and out[3].label is None and out[1].risk_score == pytest.approx(round(min(10, max(0, -4 * mean + 2)), 1))
    assert forecast.latest_windows(rows.limit(0), forecast.SCALED, 12).count() == 0 and forecast.coefficients(pairs.where("part = 'test'")).count() == 0


def plain_chain(f, model, lookback, horizon, origin):
    """One origin at a time, a row at a time."""
    law = f.drop_duplicates("cal_month").set_index("cal_month")
    window, rain, out = f[forecast.FEATURES].to_numpy()[origin + 1 - lookback : origin + 1].tolist(), f.value.tolist()[: origin + 1], []
    least, top = (np.array([f[f"{c}_{k}"][0] for c in forecast.FEATURES]) for k in ("min", "max"))
    for step in range(1, horizon + 1):
        z = float(model.intercept + ((np.array(window) - least) / (top - least)).ravel() @ np.array(model.coef))
        cal = (f.month[origin].month - 1 + step) % 12 + 1
        q, a, b, base = law.loc[cal, ["q", "alpha", "beta", "baseline"]]
        p = special.normal_cdf(np.array([z]))[0]
        total = 0.0 if p <= q else float(special.gamma_ppf(np.array([a]), np.clip(np.array([(p - q) / (1 - q)]), 1e-9, 1 - 1e-9))[0] * b)
        new = max(0.0, total - rain[-1] - rain[-2])
        rain.append(new)
        angle = 2 * np.pi * cal / 12
        window = [*window[1:], [new, z, new - base, np.sin(angle), np.cos(angle), rain[-2], rain[-4], rain[-7], rain[-13], np.mean(rain[-3:]), np.sum(rain[-12:]), f.index_value[origin]]]
        out.append(z)
    return out


def test_chained_forecasts(spark, rows):
    one = forecast.coefficients(backtest.windows(rows, forecast.SCALED, forecast.TARGET, 12, 1)).cache()
    got = forecast.recursive(rows, one, 12, 3).where("entity_id = 'b'").toPandas()
    f = rows.where("entity_id = 'b'").orderBy("month").toPandas()
    model = one.where("entity_id = 'b'").first()
    place = {m: k for k, m in enumerate(f.month)}
    origins = [k for k in range(12, len(f) - 3) if set(f.part[k + 1 : k + 4]) == {"test"}]
    assert len(got) == 3 * len(origins)
    for r in got.itertuples():
        o = place[r.target_month] - r.horizon
        assert np.isclose(r.pred, plain_chain(f, model, 12, 3, o)[r.horizon - 1]) and r.y == f.spi[place[r.target_month]] and r.persistence == f.spi[o]
    assert forecast.recursive(rows.limit(0), one, 12, 3).count() == 0


def test_index_of_steady_series(spark):
    """A small spread against the mean gives large shapes of the gamma law."""
    rng = np.random.default_rng(2)
    data = [("A", "e", dt.date(1960 + k // 12, k % 12 + 1, 1), "train", float(1000 + rng.normal())) for k in range(480)]
    s = spi.scored(spark.createDataFrame(data, "split_id string, entity_id string, month date, part string, value double"), "value").agg(F.avg("spi"), F.stddev("spi")).first()
    assert abs(s[0]) < 0.05 and abs(s[1] - 1) < 0.05
