"""The leak-free feature frame, models as rows of coefficients, forecasts from the latest window, and recursive forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralog.functions import special
from terralog.operators import backtest, series, spi

KEYS = backtest.KEYS
#: The features of a window, in order; the index of precipitation is the target.
TARGET = "spi"
FEATURES = ["value", "spi", "anomaly", "month_sin", "month_cos", "value_lag1", "value_lag3", "value_lag6", "value_lag12", "roll3_mean", "roll12_sum", "index_value"]
SCALED = [f"{f}_scaled" for f in FEATURES]


def _by_month() -> Window:
    return Window.partitionBy(*KEYS).orderBy("month")


def frame(monthly: DataFrame, index: DataFrame, splits: DataFrame, baseline: tuple[int, int], k: float = 3.0) -> DataFrame:
    """All features of every entity and split, without the precipitation index: gaps filled, outliers replaced, baseline
    clipped, season, lags and trailing values, index of the month.

    ``monthly``: ``entity_id, month, value``. What is fitted (quartiles, baseline) is fitted on the split's train rows;
    windows look back only. Rows whose lags or index are missing are left out.
    """
    dense = series.dense_interpolated(monthly, "value").select("entity_id", "month", F.col("filled").alias("raw"))
    p = series.with_parts(dense, series.clipped_baseline(splits, *baseline))
    train = F.when(F.col("part") == "train", F.col("raw"))
    cal = F.month("month")
    q = p.groupBy(*KEYS).agg(F.percentile(train, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    w = _by_month()
    p = p.join(q, KEYS).withColumn("before", F.percentile("raw", F.lit(0.5)).over(w.rowsBetween(-12, -1)))
    reach = k * (F.col("q")[1] - F.col("q")[0])
    odd = ((F.col("raw") < F.col("q")[0] - reach) | (F.col("raw") > F.col("q")[1] + reach)) & F.col("before").isNotNull()
    p = p.withColumn("value", F.when(odd, F.col("before")).otherwise(F.col("raw"))).withColumn("cal_month", cal)
    base = p.where(F.year("month").between(F.col("baseline_lo"), F.col("baseline_hi"))).groupBy(*KEYS, "cal_month").agg(F.avg("value").alias("baseline"))
    p = series.season(p.join(base, [*KEYS, "cal_month"], "left"))
    last = lambda n, how: how("value").over(w.rowsBetween(1 - n, 0))
    p = p.withColumns({
        "anomaly": F.col("value") - F.col("baseline"), **{f"value_lag{n}": F.lag("value", n).over(w) for n in (1, 3, 6, 12)}, "roll3_mean": last(3, F.avg), "roll12_sum": last(12, F.sum),
        "roll3_sum": F.when(F.count("value").over(w.rowsBetween(-2, 0)) == 3, last(3, F.sum)),
    })
    p = p.join(index.select("month", F.col("value").alias("index_value")), "month", "left")
    kept = [*KEYS, "month", "part", "value", "baseline", "anomaly", "month_sin", "month_cos", "value_lag1", "value_lag3", "value_lag6", "value_lag12", "roll3_mean", "roll12_sum", "roll3_sum", "index_value"]
    return p.select(*kept).na.drop(subset=["value", "anomaly", "value_lag12", "roll3_sum", "index_value"])


def prepared(features: DataFrame) -> DataFrame:
    """The frame with the precipitation index of its three-month sums, fitted on train rows, its law, and scaled features."""
    s = spi.scored(features, "roll3_sum").na.drop(subset=["spi"])
    return series.scaled(s, FEATURES)


def latest_windows(parted: DataFrame, features: list[str], lookback: int) -> DataFrame:
    """``split_id, entity_id, anchor, x``: the last ``lookback`` rows of each, by time, then feature; shorter series have none."""
    back = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("month")))
    rows = parted.select(*KEYS, "month", F.array(*map(F.col, features)).alias("f"), back.alias("back")).where(F.col("back") <= lookback)
    last = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("month", "f"))).alias("xs"))
    return last.where(F.size("xs") == lookback).select(*KEYS, F.element_at("xs", -1)["month"].alias("anchor"), F.flatten("xs.f").alias("x"))


def coefficients(pairs: DataFrame, alphas: tuple[float, ...] = backtest.ALPHAS, joint: bool = False) -> DataFrame:
    """``split_id, entity_id, horizon, alpha, intercept, coef``: ridge models as rows, one a horizon of ``pairs``.

    Each horizon has its own alpha, or with ``joint`` all have the one of least error over all; the first of equals. A
    group is one entity's windows of one split, some hundreds of rows.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())
        tr, va = (rows["part"] == "train").to_numpy(), (rows["part"] == "val").to_numpy()
        out = {c: [] for c in ("split_id", "entity_id", "horizon", "alpha", "intercept", "coef")}
        if tr.sum() >= 2:
            mx, my = x[tr].mean(0), y[tr].mean(0)
            u, s, vt = np.linalg.svd(x[tr] - mx, full_matrices=False)
            w = [vt.T @ ((s / (s * s + a))[:, None] * (u.T @ (y[tr] - my))) for a in alphas]
            loss = np.array([(((x[va] - mx) @ b + my - y[va]) ** 2).mean(0) if va.any() else np.zeros(y.shape[1]) for b in w])
            best = np.full(y.shape[1], loss.mean(1).argmin()) if joint else loss.argmin(0)
            for h, k in enumerate(best):
                b = w[k][:, h]
                for c, v in zip(out, (rows["split_id"].iloc[0], rows["entity_id"].iloc[0], h + 1, alphas[k], float(my[h] - mx @ b), b), strict=True):
                    out[c].append(v)
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    return pairs.select(*KEYS, "part", "x", "y").groupBy(*KEYS).applyInPandas(fit, "split_id string, entity_id string, horizon int, alpha double, intercept double, coef array<double>")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def predicted(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """``split_id, entity_id, horizon, part, target_month, y, pred, persistence`` of all windows by their models' rows."""
    j = pairs.join(models.select(*KEYS, "horizon", "intercept", "coef"), KEYS)
    at = F.col("horizon") - 1
    return j.select(*KEYS, "horizon", "part", F.get("targets", at).alias("target_month"), F.get("y", at).alias("y"), (F.col("intercept") + dot("x", "coef")).alias("pred"), F.col("last_y").alias("persistence"))


def forecasts(latest: DataFrame, models: DataFrame, manifest: DataFrame) -> DataFrame:
    """A row an entity and horizon: the forecast from its latest window, its month, skill and label, flag and risk score.

    ``models`` and ``manifest`` (``entity_id, horizon, skill, label``) are of the split in use; a model of fewer rows than
    the latest window has takes the last of them. ``risk_score`` is of the mean over the horizons, those without skill too.
    """
    j = latest.join(models.select(*KEYS, "horizon", "intercept", "coef"), KEYS).join(manifest, ["entity_id", "horizon"], "left")
    own = F.slice("x", -F.size("coef"), F.size("coef"))
    f = j.where("size(x) >= size(coef)").withColumn("own", own)
    f = f.select(*KEYS, "horizon", "anchor", F.add_months("anchor", F.col("horizon")).alias("month"), (F.col("intercept") + dot("own", "coef")).alias("predicted"), "skill", "label")
    f = f.withColumn("mean_spi", F.avg("predicted").over(Window.partitionBy(*KEYS)))
    score, flag = spi.risk()[0], spi.risk("predicted")[1]
    return f.select(*KEYS, "horizon", "anchor", "month", "predicted", "skill", "label", flag.alias("flag"), score.alias("risk_score"))


def chained(x: np.ndarray, history: np.ndarray, months: np.ndarray, index: np.ndarray, model: tuple[float, np.ndarray], law: dict[str, np.ndarray], scale: tuple[np.ndarray, np.ndarray], horizon: int) -> np.ndarray:
    """Forecasts of 1 to ``horizon`` months ahead by a model of the next month that is fed with its own forecasts.

    Of n origins: ``x`` (n, lookback, features) unscaled windows, ``history`` (n, 13 or more) the values up to the origin,
    ``months`` and ``index`` those of the origin. ``law`` has q, alpha, beta and baseline of each calendar month, ``scale``
    the least value and the width of each feature. A forecast of the index is turned back into a three-month sum; less the
    two months known it gives the next value, 0 at least, from which the next row is built; the index is held.
    """
    x, history, out = x.copy(), history.copy(), []
    for step in range(1, horizon + 1):
        z = model[0] + ((x - scale[0]) / scale[1]).reshape(len(x), -1) @ model[1]
        out.append(z)
        cal = (months - 1 + step) % 12
        q, a, b = (law[c][cal] for c in ("q", "alpha", "beta"))
        p = special.normal_cdf(z)
        rest = np.clip((p - q) / np.maximum(1 - q, 1e-9), 1e-9, 1 - 1e-9)
        total = np.where(p <= q, 0.0, special.gamma_ppf(a, rest) * b)
        new = np.maximum(0.0, total - history[:, -1] - history[:, -2])
        history = np.column_stack([history, new])
        angle = 2 * np.pi * (cal + 1) / 12
        row = [new, z, new - law["baseline"][cal], np.sin(angle), np.cos(angle), history[:, -2], history[:, -4], history[:, -7], history[:, -13], history[:, -3:].mean(1), history[:, -12:].sum(1), index]
        x = np.concatenate([x[:, 1:], np.column_stack(row)[:, None, :]], axis=1)
    return np.column_stack(out)


def recursive(rows: DataFrame, models: DataFrame, lookback: int, horizon: int, parts: tuple[str, ...] = ("test",)) -> DataFrame:
    """``split_id, entity_id, horizon, part, target_month, y, pred, persistence`` by chaining the model of horizon 1.

    ``rows``: of ``prepared``. Origins are those of which all ``horizon`` targets lie in one of ``parts``. A group is one
    entity of one split, some hundreds of rows; the loop is over the horizon only.
    """
    law = ["q", "alpha", "beta", "baseline"]
    need = ["month", "part", *FEATURES, *law, *(f"{f}_{c}" for f in FEATURES for c in ("min", "max"))]
    one = models.where("horizon = 1").select(*KEYS, "intercept", "coef")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("month", ignore_index=True)
        f, month = g[FEATURES].to_numpy(float), pd.to_datetime(g["month"])
        cal, part, y = month.dt.month.to_numpy(), g["part"].to_numpy(), g[TARGET].to_numpy(float)
        by = g.drop_duplicates("cal").set_index("cal")[law].reindex(range(1, 13))
        least = g.loc[0, [f"{c}_min" for c in FEATURES]].to_numpy(float)
        width = g.loc[0, [f"{c}_max" for c in FEATURES]].to_numpy(float) - least
        place = month.dt.year.to_numpy() * 12 + cal
        first = max(lookback, 13) - 1
        whole = [t for t in range(first, len(g) - horizon) if place[t + horizon] - place[t - first] == first + horizon and part[t + 1] in parts and len(set(part[t + 1 : t + 1 + horizon])) == 1]
        o = np.array(whole, dtype=int)
        if not len(o):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("split_id", "entity_id", "horizon", "part", "target_month", "y", "pred", "persistence")})
        x = np.stack([f[t + 1 - lookback : t + 1] for t in o])
        history = np.stack([f[t - 12 : t + 1, 0] for t in o])
        pred = chained(x, history, cal[o], f[o, FEATURES.index("index_value")], (float(g["intercept"][0]), np.asarray(g["coef"][0])), {c: by[c].to_numpy(float) for c in law}, (least, np.where(width == 0, 1.0, width)), horizon)
        n = len(o)
        steps = np.tile(np.arange(1, horizon + 1), n)
        at = np.repeat(o, horizon) + steps
        return pd.DataFrame({"split_id": g["split_id"][0], "entity_id": g["entity_id"][0], "horizon": steps, "part": part[at], "target_month": g["month"].to_numpy()[at], "y": y[at], "pred": pred.ravel(), "persistence": np.repeat(y[o], horizon)})

    joined = rows.select(*KEYS, *need, F.month("month").alias("cal")).join(one, KEYS)
    return joined.groupBy(*KEYS).applyInPandas(run, "split_id string, entity_id string, horizon int, part string, target_month date, y double, pred double, persistence double")
