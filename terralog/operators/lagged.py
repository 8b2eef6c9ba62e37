"""Ridge models of many small series without windows: all moments of all windows come from lagged sums.

A window of ``lookback`` rows is never built. The products of a row with the rows some lags later are summed along the
series; as two inputs of a window are always the same lag apart, every block of the windows' Gram matrix is such a sum over
a range of rows: the sum of the range before it, less the product at one edge and more that at the other. Running sums give
any range, so one pass over an entity's rows serves all parts, feature sets, lookbacks and penalties of an experiment grid.
Cells of the grid are rows of a table. Predictions are sums of products by lag, again without windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralog.operators.backtest import ALPHAS, KEYS

PARTS = ("train", "val", "test")


def lagged_sums(rows: DataFrame, features: list[str], lags: int, keys: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """``*keys, year, lag, earlier, later, n, total``: sums of products of a row's features with those of the row ``lag`` later.

    By hash aggregation over each key and year of the earlier row; a product with a null is left out. With a feature that
    is always 1, sums of the features themselves are among them.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("month"))
    values = F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("v")) for f in features))
    at = rows.select(*keys, "month", place.alias("place"), values.alias("f"))
    later = at.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag"), "place", F.col("f").alias("g")).withColumn("place", F.col("place") - F.col("lag"))
    both = at.join(later, [*keys, "place"]).select(*keys, F.year("month").alias("year"), "lag", F.explode("f").alias("a"), "g").withColumn("b", F.explode("g"))
    both = both.select(*keys, "year", "lag", F.col("a.name").alias("earlier"), F.col("b.name").alias("later"), (F.col("a.v") * F.col("b.v")).alias("p"))
    return both.where("p is not null").groupBy(*keys, "year", "lag", "earlier", "later").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))


def experiments(rows: DataFrame, grid: DataFrame, keys: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """The cells of ``grid`` (``feature_set, features, lookback``, a few rows) for each series of ``rows``."""
    return rows.select(*(F.col(k).alias(k) for k in keys)).distinct().crossJoin(F.broadcast(grid))


class Running:
    """Sums along a series of the products of its rows (n, p) with those of each lag, up to ``lags`` - 1."""

    def __init__(self, f: np.ndarray, lags: int):
        n, p = f.shape
        self.sums = np.zeros((lags, n + 1, p, p))
        for d in range(min(lags, n)):
            np.cumsum(f[: n - d, :, None] * f[d:, None, :], axis=0, out=self.sums[d, 1 : n - d + 1])

    def blocks(self, d: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each range of earlier rows the summed products with the rows ``d`` later."""
        return self.sums[d][end] - self.sums[d][begin]


def runs(ok: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (end excluded) of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _all_in(good: np.ndarray, before: int, after: int) -> np.ndarray:
    """For each row whether all rows from ``before`` rows earlier to ``after`` rows later exist and are good."""
    n, c = len(good), np.r_[0, np.cumsum(~good)]
    t = np.arange(n)
    inside = (t - before >= 0) & (t + after < n)
    return inside & (c[np.minimum(n, t + after + 1)] - c[np.maximum(0, t - before)] == 0)


def window_ends(good_x: np.ndarray, good_y: np.ndarray, part: np.ndarray, lookback: int, horizon: int) -> dict[str, np.ndarray]:
    """Rows at which windows end, by part: all targets lie in it, and no value is missing; train windows lie wholly in train."""
    usable = _all_in(good_x, lookback - 1, 0) & _all_in(good_y, 0, horizon)
    out = {}
    for name in PARTS:
        inside = part == name
        targets = np.r_[_all_in(inside, 0, horizon - 1)[1:], False]
        out[name] = usable & targets & (_all_in(inside, lookback - 1, 0) if name == "train" else True)
    return out


class Moments:
    """Of the windows that end in the given rows: their number, means, and centred products of inputs and targets."""

    def __init__(self, r: Running, ends: np.ndarray, columns: list[int], lookback: int, horizon: int):
        p, size = len(columns), lookback * len(columns)
        one, target = r.sums.shape[2] - 1, r.sums.shape[2] - 2
        xx, xy, sx = np.zeros((lookback, p, lookback, p)), np.zeros((lookback, p, horizon)), np.zeros((lookback, p))
        yy, sy, self.n = np.zeros(horizon), np.zeros(horizon), 0
        for lo, hi in runs(ends):
            self.n += hi - lo
            first = lo - lookback + 1 + np.arange(lookback)  # of each input's range of rows
            for d in range(lookback):
                b = r.blocks(d, first[: lookback - d], first[: lookback - d] + hi - lo)[:, columns][:, :, columns]
                i = np.arange(lookback - d)
                xx[i, :, i + d, :] += b
                if d:
                    xx[i + d, :, i, :] += b.transpose(0, 2, 1)
            sx += r.blocks(0, first, first + hi - lo)[:, columns, one]
            for h in range(1, horizon + 1):
                for i in range(lookback):
                    xy[i, :, h - 1] += r.blocks(lookback - 1 - i + h, first[i : i + 1], first[i : i + 1] + hi - lo)[0, columns, target]
                t = r.blocks(0, np.array([lo + h]), np.array([hi + h]))[0]
                yy[h - 1] += t[target, target]
                sy[h - 1] += t[target, one]
        n = max(1, self.n)
        self.sx, self.sy = sx.reshape(size), sy
        self.xx, self.xy, self.yy = xx.reshape(size, size), xy.reshape(size, horizon), yy
        self.mx, self.my = self.sx / n, sy / n

    def about(self, mx: np.ndarray, my: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed products of the inputs less ``mx`` and the targets less ``my``."""
        xx = self.xx - np.outer(self.sx, mx) - np.outer(mx, self.sx) + self.n * np.outer(mx, mx)
        xy = self.xy - np.outer(self.sx, my) - np.outer(mx, self.sy) + self.n * np.outer(mx, my)
        return xx, xy, self.yy - 2 * my * self.sy + self.n * my * my


def ridge(train: Moments, val: Moments, alphas: tuple[float, ...], joint: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each horizon the alpha of least squared error on validation windows (``joint``: over all horizons), the intercept,
    and the coefficients as columns; intercepts are not penalised, and the first of equal alphas is taken."""
    xx, xy, _ = train.about(train.mx, train.my)
    w = [np.linalg.solve(xx + a * np.eye(len(xx)), xy) for a in alphas]
    loss = np.zeros((len(alphas), len(train.my)))
    if val.n:
        vx, vy, vv = val.about(train.mx, train.my)
        loss = np.array([((b * (vx @ b)).sum(0) - 2 * (b * vy).sum(0) + vv) / val.n for b in w])
    best = np.full(loss.shape[1], loss.mean(1).argmin()) if joint else loss.argmin(0)
    coef = np.column_stack([w[k][:, h] for h, k in enumerate(best)])
    return np.array(alphas)[best], train.my - train.mx @ coef, coef


class Series:
    """One entity's rows in order of time, ready for every cell of a grid."""

    def __init__(self, rows: pd.DataFrame, cells: pd.DataFrame, target: str, horizon: int):
        g = rows.sort_values("month", ignore_index=True)
        self.horizon, self.month, self.part = horizon, g["month"].to_numpy(), g["part"].to_numpy()
        self.names = sorted({f for x in cells["features"] for f in x})
        f = np.column_stack([g[c].to_numpy(float) for c in [*self.names, target]])
        self.good, self.y = np.isfinite(f), f[:, -1]
        f = np.where(self.good, f, 0.0)
        self.x = f[:, :-1]
        self.running = Running(np.column_stack([f, np.ones(len(f))]), int(cells["lookback"].max()) + horizon)

    def fit(self, features: list[str], lookback: int, alphas: tuple[float, ...], joint: bool):
        """Columns, window ends by part, and the model (None with under two train windows)."""
        columns = [self.names.index(f) for f in features]
        ends = window_ends(self.good[:, columns].all(1), self.good[:, -1], self.part, lookback, self.horizon)
        if ends["train"].sum() < 2:
            return columns, ends, None
        train, val = (Moments(self.running, ends[p], columns, lookback, self.horizon) for p in ("train", "val"))
        return columns, ends, (*ridge(train, val, alphas, joint), train.n, val.n)

    def predict(self, columns: list[int], coef: np.ndarray, intercept: np.ndarray, lookback: int, at: np.ndarray) -> np.ndarray:
        """Forecasts of all horizons from the windows that end in rows ``at``: products by lag, summed."""
        by_lag = np.einsum("tp,iph->ith", self.x[:, columns], coef.reshape(lookback, len(columns), -1))
        lags = np.arange(lookback)
        return intercept + by_lag[lags[:, None], at[None, :] - lookback + 1 + lags[:, None]].sum(0)


def _cells(series: Series, cells: pd.DataFrame, alphas: tuple[float, ...], joint: bool) -> Iterator[tuple]:
    for c in cells.sort_values(["feature_set", "lookback"]).itertuples():
        columns, ends, model = series.fit(list(c.features), int(c.lookback), alphas, joint)
        if model:
            yield c.feature_set, int(c.lookback), columns, ends, model


def _frame(schema: str, rows: dict[str, list] | None = None) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame({n: pd.Series((rows or {}).get(n, []), dtype=object) for n in names})


def _needed(rows: DataFrame, cells: DataFrame, target: str, keys: tuple[str, ...], features: list[str]) -> DataFrame:
    return rows.select(*dict.fromkeys([*keys, "month", "part", target, *features]))


def models(rows: DataFrame, cells: DataFrame, features: list[str], target: str, horizon: int, alphas: tuple[float, ...] = ALPHAS, joint: bool = False, keys: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """``*keys, feature_set, lookback, horizon, alpha, intercept, coef, n_train, n_val``: a ridge model a cell and horizon.

    ``rows``: ``*keys, month, part``, features and target of some hundreds of months a series; ``cells``: of
    ``experiments``; ``features``: those that any cell names. Windows are those of ``backtest.windows`` (consecutive rows,
    none with a missing value); series with under two train windows of a cell have no model of it. Alphas are chosen on
    validation windows, for each horizon or with ``joint`` for all together.
    """
    schema = ", ".join([*(f"{k} string" for k in keys), "feature_set string, lookback int, horizon int, alpha double, intercept double, coef array<double>, n_train long, n_val long"])

    def run(key: tuple, group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {}
        if len(group) and len(own):
            for name, lookback, _, _, (alpha, intercept, coef, n, n_val) in _cells(Series(group, own, target, horizon), own, alphas, joint):
                for h in range(horizon):
                    row = dict(zip(keys, key, strict=True)) | {"feature_set": name, "lookback": lookback, "horizon": h + 1, "alpha": float(alpha[h]), "intercept": float(intercept[h]), "coef": coef[:, h], "n_train": int(n), "n_val": int(n_val)}
                    for c, v in row.items():
                        out.setdefault(c, []).append(v)
        return _frame(schema, out)

    return _needed(rows, cells, target, keys, features).groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(run, schema)


def predictions(rows: DataFrame, cells: DataFrame, features: list[str], target: str, horizon: int, alphas: tuple[float, ...] = ALPHAS, joint: bool = False, keys: tuple[str, ...] = tuple(KEYS), parts: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """``*keys, feature_set, lookback, horizon, part, target_month, y, pred, persistence, alpha`` of all windows of ``parts``, by
    the models of ``models``; fitted and applied in one pass over the rows."""
    schema = ", ".join([*(f"{k} string" for k in keys), "feature_set string, lookback int, horizon int, part string, target_month date, y double, pred double, persistence double, alpha double"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(group) and len(own):
            s = Series(group, own, target, horizon)
            for name, lookback, columns, ends, (alpha, intercept, coef, *_) in _cells(s, own, alphas, joint):
                for part in parts:
                    at = np.flatnonzero(ends[part])
                    if not len(at):
                        continue
                    steps = np.tile(np.arange(1, horizon + 1), len(at))
                    to = np.repeat(at, horizon) + steps
                    pred = s.predict(columns, coef, intercept, lookback, at)
                    found.append(pd.DataFrame(dict(zip(keys, key, strict=True)) | {"feature_set": name, "lookback": lookback, "horizon": steps, "part": part, "target_month": s.month[to], "y": s.y[to], "pred": pred.ravel(), "persistence": np.repeat(s.y[at], horizon), "alpha": np.tile(alpha, len(at))}))
        return pd.concat(found)[names] if found else _frame(schema)

    return _needed(rows, cells, target, keys, features).groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(run, schema)
