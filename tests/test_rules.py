"""Rules on small fixtures, and checks that hold whatever the data: truncation, refit, round trips."""

import datetime as dt
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.functions import special
from terralog.operators import backtest, corpus, decisions, grounding, heat, retrieval, series, spi
from terralog.sources import layers, payloads


def months(n, start=(2000, 1)):
    return [dt.date(start[0] + (start[1] - 1 + k) // 12, (start[1] - 1 + k) % 12 + 1, 1) for k in range(n)]


def monthly(spark, values, entity="e", start=(2000, 1)):
    return spark.createDataFrame([(entity, m, v) for m, v in zip(months(len(values), start), values, strict=True)], "entity_id string, month date, value double")


def column(df, name, order="month"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_interpolation_fills_two_months_of_inner_gaps(spark):
    got = column(series.interpolated(monthly(spark, [1.0, None, None, None, None, 6.0, 7.0, None]), "value"), "filled")
    assert [g and round(g, 3) for g in got] == [1.0, 2.02, 2.974, None, None, 6.0, 7.0, None]


def test_dense_interpolation_equals_that_of_dense_rows(spark):
    r = random.Random(5)
    rows = [(e, m, r.choice([None, round(r.random() * 9, 3)])) for e in (*"abcdefgh", None) for m in months(40) if r.random() < 0.5]
    df = spark.createDataFrame([*rows, ("x", None, 1.0), ("y", months(1)[0], None), ("z", months(1)[0], 2.0)], "entity_id string, month date, value double")
    got, want = series.dense_interpolated(df, "value"), series.interpolated(series.densify(df), "value")
    key = lambda x: (x.entity_id or "", x.month)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "UnboundedFollowing" not in plan


def test_densify_and_trailing(spark):
    m = monthly(spark, [1.0, 2.0, 3.0, 4.0]).where("month <> date'2000-02-01'")
    d = series.densify(m).withColumn("s", series.trailing("value", 3, F.sum, 2))
    assert column(d, "s") == [None, None, 4.0, 7.0]


def test_outlier_is_replaced_by_the_median_before(spark):
    v = [10.0 + k % 5 for k in range(40)]
    v[30] = 500.0
    out = series.causal_outliers(monthly(spark, v), "value", 2000, 2001)
    assert column(out, "cleaned")[30] == float(np.median(v[18:30])) and column(out, "replaced").count(True) == 1


def test_truncation_changes_nothing_before(spark):
    v = [float(x) for x in np.random.default_rng(1).gamma(2, 50, 60)]
    full = series.causal_outliers(series.lags(monthly(spark, v), "value"), "value", 2000, 2001)
    cut = series.causal_outliers(series.lags(monthly(spark, v[:48]), "value"), "value", 2000, 2001)
    assert cut.exceptAll(full).count() == 0


def test_statistics_use_train_rows_only(spark):
    splits = spark.sql("SELECT 'A' AS split_id, 2000 AS train_lo, 2002 AS train_hi, 2003 AS val_lo, 2003 AS val_hi, 2004 AS test_lo, 2004 AS test_hi")
    m = monthly(spark, [float(k % 12 + k // 12) for k in range(60)])
    a = series.month_stats(series.with_parts(m, splits), "value")
    b = series.month_stats(series.with_parts(m.withColumn("value", F.when(F.year("month") > 2002, F.col("value") + 99).otherwise(F.col("value"))), splits), "value")
    c = series.month_stats(series.with_parts(m.withColumn("value", F.when(F.year("month") == 2002, F.col("value") + 99).otherwise(F.col("value"))), splits), "value")
    assert a.exceptAll(b).count() == 0 and a.exceptAll(c).count() == 12
    assert {r.n_train for r in a.collect()} == {3}


def days(spark, values, start=dt.date(2020, 5, 1)):
    return spark.createDataFrame([("e", start + dt.timedelta(k), v) for k, v in enumerate(values)], "entity_id string, day date, value double")


RULE = {"hot": 45.0, "warm": 40.0, "dep": 4.5, "severe": 47.0, "severe_dep": 6.4}


def test_heat_criteria_and_spells(spark):
    norm = spark.createDataFrame([("e", 122 + k, 35.0 if 122 + k == 123 else 40.0) for k in range(8)], "entity_id string, doy int, normal double")
    f = heat.flagged(days(spark, [45.5, 39.9, 44.5, 47.2, 46.5, 34.0]), norm, **RULE)
    assert column(f, "heat_day", "day") == [True, False, True, True, True, False]
    assert column(f, "severe_day", "day") == [False, False, False, True, True, False]
    assert round(column(f, "departure", "day")[1], 1) == 4.9
    flags = days(spark, [1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0]).withColumn("heat_day", F.col("value") > 0)
    assert column(heat.spells(flags), "in_spell", "day") == [False, False, True, True, False, True, True, True]
    gap = flags.where("day <> date'2020-05-07'")
    assert column(heat.spells(gap), "in_spell", "day") == [False, False, True, True, False, False, False]
    assert column(heat.spells(gap, break_on_gap=False), "in_spell", "day")[-1]


def test_normals_pool_the_ring(spark):
    rng = np.random.default_rng(2)
    start, v = dt.date(2000, 1, 1), rng.normal(30, 5, 1461)
    got = {r.doy: r.normal for r in heat.normals(days(spark, [float(x) for x in v], start), 2000, 2003).collect()}
    doy = np.array([(start + dt.timedelta(k)).timetuple().tm_yday for k in range(len(v))])
    for d in (1, 5, 60, 366):
        near = np.minimum(abs(doy - d), 366 - abs(doy - d)) <= 7
        assert abs(got[d] - v[near].mean()) < 1e-9


def test_skewed_series_is_not_normal(spark):
    parted = lambda x: monthly(spark, [float(v) for v in x], start=(1980, 1)).withColumns({"split_id": F.lit("A"), "part": F.when(F.year("month") < 2010, "train").otherwise("test")})
    rng = np.random.default_rng(4)
    row = heat.distribution(parted(rng.exponential(1, 432)), "value").first()
    assert not row.approximately_normal and row["skew"] > 0.5 and row.n == 360
    row = heat.distribution(parted(1.4 + 0.6 * rng.normal(size=432)), "value").first()
    assert row.approximately_normal and not row.approximately_standard_normal
    assert heat.distribution(parted(rng.normal(size=432)), "value").first().approximately_standard_normal


def test_special_functions():
    z = np.linspace(-4, 4, 81)
    assert np.allclose(special.normal_cdf(z), [NormalDist().cdf(x) for x in z], atol=1e-12)
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 1 - 1e-6])
    assert np.allclose(special.normal_ppf(p), [NormalDist().inv_cdf(x) for x in p], atol=1e-8)
    assert np.allclose(special.digamma(np.array([0.1, 0.5, 1, 10])), [-10.423754940411076, -1.9635100260214235, -0.5772156649015329, 2.251752589066721])
    assert np.allclose(special.gammainc(np.array([1.0, 2.0, 0.5, 9.0]), np.array([1.0, 3.0, 2.0, 4.0])), [0.6321205588285577, 0.8008517265285442, 0.9544997361036416, 0.02136343430000000], atol=1e-6)
    a = np.array([0.3, 2.0, 40.0])
    assert np.allclose(special.gammainc(a, special.gamma_ppf(a, np.array([0.2, 0.5, 0.99]))), [0.2, 0.5, 0.99])
    assert np.allclose(special.gamma_shape(np.log(a) - special.digamma(a)), a, rtol=1e-6)


def test_spi_is_standard_and_goes_back(spark):
    splits = spark.sql("SELECT 'A' AS split_id, 1980 AS train_lo, 2019 AS train_hi, 2020 AS val_lo, 2020 AS val_hi, 2021 AS test_lo, 2021 AS test_hi")
    v = [float(x) for x in np.random.default_rng(3).gamma(2, 40, 480)]
    v[5] = 0.0
    s = spi.restored(spi.scored(series.with_parts(monthly(spark, v, start=(1980, 1)), splits), "value")).toPandas().sort_values("month")
    assert abs(s.spi.mean()) < 0.1 and abs(s.spi.std() - 1) < 0.1 and s.spi.min() < -1.5
    pos = s[s.value > 0]
    assert np.allclose(pos.value, pos.restored, rtol=1e-4) and s.restored.iloc[5] == 0


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(5)
    parts = ["train"] * 30 + ["val"] * 6 + ["test"] * 6
    x, y = rng.normal(size=(42, 4)), rng.normal(size=(42, 2))
    rows = [("A", "e", months(42)[k], parts[k], x[k].tolist(), y[k].tolist(), months(44)[k + 1 : k + 3], 0.5) for k in range(42)]
    df = spark.createDataFrame(rows, "split_id string, entity_id string, window_end date, part string, x array<double>, y array<double>, targets array<date>, last_y double")
    got = backtest.ridge(df, (10.0,)).where("horizon = 2").toPandas().sort_values("target_month")
    a, b = x[:30] - x[:30].mean(0), y[:30] - y[:30].mean(0)
    w = np.linalg.solve(a.T @ a + 10 * np.eye(4), a.T @ b)
    assert np.allclose(got.pred, ((x - x[:30].mean(0)) @ w + y[:30].mean(0))[:, 1])
    assert backtest.ridge(df.where("part = 'test'")).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(v,) for v in (0.2622, 0.1, 0.0766, 0.0001, 0.0, -0.0489)], "v double")
    assert [r[0] for r in df.select(backtest.label(F.col("v"))).collect()] == [backtest.VALIDATED] * 2 + [backtest.WEAK] * 2 + [backtest.NONE] * 2


@pytest.mark.parametrize(("report", "source", "bad"), [
    ("skill of +0.26", "0.2622", ""), ("skill of +0.31", "0.2622", "+0.31"), ("a 4-month gap", "0.0438", "4"), ("in 2024 at t+1 and SPI-3", "none", ""),
    ("about 26% of it", "0.26", ""), ("1,234 items", "1234", ""), ("7 and 7 and 8.5", "8.5", "7 7"),
])
def test_grounding(spark, report, source, bad):
    rows = lambda t: spark.createDataFrame([(1, t)], "report_id long, text string")
    got = grounding.check(rows(report), rows(source), "report_id", "text").first()
    assert got.unverified == bad and got.status == ("warning" if bad else "clean")


def test_empty_report_is_not_grounded(spark):
    rows = spark.createDataFrame([(1, "  "), (2, None)], "report_id long, text string")
    assert {r.status for r in grounding.check(rows, rows, "report_id", "text").collect()} == {"not_generated"}


def test_chunks():
    r = random.Random(1)
    text = "\n\n".join(" ".join("word%d" % r.randrange(99) for _ in range(120)) for _ in range(12))
    c = corpus.pack(text)
    assert len(c) > 1 and all(corpus.LEAST_CHUNK <= len(x) <= 2400 for x in c) and c[0][-60:] in c[1]
    assert corpus.pack(None) == [] and corpus.pack("short") == [] and len(corpus.pack("x" * 5000)[0]) == corpus.MOST_CHUNK


def test_sections_keep_tables_with_their_heading(spark):
    df = spark.createDataFrame([(1, "# Top\nintro\n## Results\n| a | 1 |\ncaveat\n## Else\nother")], "id long, text string")
    got = {r.heading: r.body for r in corpus.sections(df, "id").collect()}
    assert got["Results"] == "## Results\n| a | 1 |\ncaveat" and "other" in got["Else"]


def test_html(spark):
    df = spark.createDataFrame([("<html><script>var t='</p>';</script><style>p{}</style><!-- x --><p>A  &lt;b&gt;</p><p> </p>C</html>",)], "h string")
    assert df.select(corpus.page(F.col("h"))["text"]).first()[0] == "A <b>\nC"


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 8)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "vec_id long, embedding array<float>").repartition(5)
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for block in (1024, 4, 100):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        got = sorted((r.query_id, r.rank, r.vec_id) for r in retrieval.top_k(df.where("vec_id % 50 = 0 and vec_id < 300"), df, 4).collect())
        want = []
        for q in range(0, 300, 50):
            s = np.round(u @ u[q], 6)
            s[q] = -9
            want += [(q, k + 1, int(i)) for k, i in enumerate(np.lexsort((np.arange(300), -s))[:4])]
        assert got == want


def test_decisions(spark):
    f = spark.createDataFrame([("e", 3, -2.5, 0.0, "no skill"), ("e", 2, -2.0, 0.05, "weak/directional"), ("e", 1, -1.8, 0.3, "validated")], "entity_id string, horizon int, predicted double, skill double, label string")
    d = {r.horizon: r for r in decisions.drought_signal(f).collect()}
    assert not d[3].decisive and d[2].corroborating and d[1].decisive and d[1].drought_severity == "severe"
    assert d[3].no_skill and d[3].drought_available and decisions.drought_signal(f.withColumn("predicted", F.lit(None).cast("double"))).where("drought_available or drought_severity is not null").count() == 0
    h = spark.createDataFrame([("a", 0, 0, 5.35), ("b", 0, 0, 2.1), ("c", 3, 1, 0.0), ("d", 3, 0, 3.5)], "entity_id string, heat_days int, severe_days int, mean_departure double").withColumn("month", F.lit(None))
    assert [(r.heat_severity, r.heat_basis) for r in decisions.heat_signal(h).orderBy("entity_id").collect()] == [("severe", "departure"), (None, None), ("severe", "days"), ("moderate", "days")]
    rows = [
        (1, True, True, "severe", True, False, True, "moderate", "drought"), (2, True, True, "moderate", True, False, True, "moderate", "heat"), (3, False, True, "severe", True, False, True, "severe", "none dominant"), (4, True, True, "severe", False, False, None, None, "none dominant"),
        (5, True, None, None, None, None, None, None, "insufficient data"), (6, True, True, "severe", False, True, None, None, "insufficient data"), (7, True, True, "severe", False, True, True, None, "none dominant"), (8, True, False, None, False, False, True, "severe", "heat"),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows], "i int, in_season boolean, drought_available boolean, drought_severity string, decisive boolean, no_skill boolean, heat_available boolean, heat_severity string")
    assert [r.dominant for r in decisions.dominant(df).orderBy("i").collect()] == [r[-1] for r in rows]


def test_an_entry_for_all_severities_comes_in_its_turn(spark):
    t = spark.createDataFrame([(1, "w", "heat", "severe", None, None, 5.0), (2, "w", "heat", None, None, 3.0, 2.0), (3, "w", "heat", "mild", None, None, 1.0)], "entry int, crop string, risk string, severity string, lo double, hi double, impact double")
    rows = spark.createDataFrame([(1, "w", "heat", "severe", 9.0), (2, "w", "heat", "mild", 2.0), (3, "w", "heat", "mild", 9.0), (4, "w", "heat", None, 2.0), (5, "w", "none dominant", "mild", 2.0)], "row_id int, crop string, risk string, severity string, metric double")
    got = {r.row_id: (r.status, r.impact) for r in decisions.yield_impact(rows, t, spark.createDataFrame([], "crop string, risk string")).collect()}
    assert got[1] == ("available", 5.0) and got[2] == ("available", 2.0) and got[3][0].endswith("above the band") and got[4][0] == got[5][0] == "not available: no binding risk"


def test_yield_lookup_stops_at_the_first_entry(spark):
    t = spark.createDataFrame([(1, "wheat", "heat", "severe", 4.0, 6.0, 5.6), (2, "wheat", "heat", "severe", None, None, 9.0)], "entry int, crop string, risk string, severity string, lo double, hi double, impact double")
    g = spark.createDataFrame([("millet", "drought")], "crop string, risk string")
    rows = spark.createDataFrame([(1, "wheat", "heat", "severe", 5.35), (2, "wheat", "heat", "severe", 3.68), (3, "wheat", "heat", "moderate", 5.0), (4, "millet", "drought", "severe", 1.0), (5, "rice", "heat", "severe", 1.0), (6, "wheat", "heat", "severe", None)], "row_id int, crop string, risk string, severity string, metric double")
    got = {r.row_id: (r.status, r.impact) for r in decisions.yield_impact(rows, t, g).collect()}
    assert got[1] == ("available", 5.6) and got[2][0].endswith("band") and got[3][0].endswith("only") and got[4][0] == "recorded gap" and got[5][0] == "out of scope" and got[6][1] is None


def test_parsers(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    year = "1997 " + " ".join(f"{k / 10:.2f}" for k in range(1, 12)) + " 2.39"
    g = {str(r.month): r.value for r in payloads.index_grid(lines("1950 2026", year, "2026 " + " ".join(["1.40"] * 6 + ["-99.90"] * 6), "-99.9", "free text")).collect()}
    assert g["1997-12-01"] == 2.39 and g["2026-06-01"] == 1.4 and "2026-07-01" not in g and len(g) == 18
    s = {str(r.month): r.value for r in payloads.index_seasons(lines("SEAS YR TOTAL ANOM", "NDJ 1997 28.9 2.39", "OND 2010 25.0 -1.64")).collect()}
    assert s == {"1997-12-01": 2.39, "2010-11-01": -1.64}
    p = spark.createDataFrame([("e", '{"T2M": {"20240101": 33, "20240102": 35, "20240103": -999}, "RH2M": {"20240101": -999}}')], "entity_id string, payload string")
    m = payloads.parameter_months(payloads.parameter_maps(p, "payload"), []).collect()
    assert [(r.parameter, r.value, r.days_used, r.days_returned) for r in m] == [("T2M", 34.0, 2, 3)]
    a = payloads.parallel_arrays(spark.createDataFrame([("e", '{"time": ["2024-01-01", "2024-01-02"], "tmax": [1.5, null]}')], "entity_id string, payload string"), "payload", "time", ["tmax"])
    assert [(str(r.day), r.tmax) for r in a.collect()] == [("2024-01-01", 1.5), ("2024-01-02", None)]
    rec = '{"records": [' + ", ".join(f'{{"market": "m{k}", "modal_price": "{k}"}}' for k in range(8)) + "]}"
    assert payloads.price_records(spark.createDataFrame([("e", rec)], "entity_id string, payload string"), "payload").count() == 6


def test_csv_index(spark, tmp_path):
    (tmp_path / "dmi.csv").write_text("Date,DMI\n1997-11-01,1.279\n2019-10-01,0.964\n2026-06-01,-9999\nbroken\n")
    got = {str(r.month): r.value for r in payloads.index_csv(spark, str(tmp_path / "dmi.csv")).collect()}
    assert got == {"1997-11-01": 1.279, "2019-10-01": 0.964}


def test_refresh_stream_publishes_complete_months_once(spark, tmp_path):
    from terralog.streaming import refresh

    d = lambda start, n, v, seq: spark.createDataFrame([("e", start + dt.timedelta(k), v, seq) for k in range(n)], refresh.SCHEMA)
    paths = {k: str(tmp_path / k) for k in ("landing", "archive", "recent", "published", "checkpoint")}
    d(dt.date(2024, 1, 1), 40, 1.0, 1).write.parquet(paths["archive"])
    d(dt.date(2024, 2, 5), 60, 3.0, 2).write.mode("append").parquet(paths["landing"])
    refresh.run(spark, **paths)
    first = spark.read.parquet(paths["published"]).collect()
    assert [(str(r.month), r.n_days, r["mean"]) for r in first] == [("2024-03-01", 31, 3.0)]  # the archive's last month is February
    d(dt.date(2024, 3, 2), 60, 5.0, 3).write.mode("append").parquet(paths["landing"])
    refresh.run(spark, **paths)
    got = {str(r.month): r["mean"] for r in spark.read.parquet(paths["published"]).collect()}
    assert got == {"2024-03-01": pytest.approx((3 + 30 * 5) / 31), "2024-04-01": 5.0}
    archive = spark.read.parquet(paths["archive"])
    assert layers.live(archive, archive.limit(0), ["entity_id", "day"], ["seq"]).exceptAll(archive).count() == 0
