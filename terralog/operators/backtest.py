"""Rolling-origin back-tests of many small models: windows, ridge fits, baselines, scores, selection and votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["split_id", "entity_id"]
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
#: Labels of a horizon's skill.
VALIDATED, WEAK, NONE = "validated", "weak/directional", "no skill"


def windows(parted: DataFrame, features: list[str], target: str, lookback: int, horizon: int) -> DataFrame:
    """Supervised pairs: ``x`` (inputs by time, then feature), ``y`` (the next values), ``part`` of all targets, and their months.

    All targets lie in one part; train windows also need all inputs in train. Windows with a null are left out.
    """
    w = Window.partitionBy(*KEYS).orderBy("month")
    past, future = w.rowsBetween(1 - lookback, 0), w.rowsBetween(1, horizon)
    part = F.coalesce("part", F.lit("-"))
    xs, parts, months = F.collect_list(F.array(*map(F.col, features))).over(past), F.collect_list(part).over(past), F.collect_list("month").over(past)
    ys = F.collect_list(F.struct(F.col(target).alias("y"), part.alias("part"), F.col("month").alias("m"))).over(future)
    rows = parted.select(*KEYS, "month", xs.alias("xs"), ys.alias("ys"), parts.alias("parts"), months.alias("inputs"), F.col(target).alias("last_y"))
    part = F.get("ys", F.lit(0))["part"]
    full = rows.where((F.size("xs") == lookback) & (F.size("ys") == horizon)).where(part.isin("train", "val", "test") & F.forall("ys", lambda t: t["part"] == part) & ((part != "train") | F.forall("parts", lambda p: p == "train")))
    full = full.where(~F.exists(F.flatten("xs"), lambda v: v.isNull()) & ~F.exists("ys", lambda t: t["y"].isNull()) & F.col("last_y").isNotNull())
    return full.select(*KEYS, F.col("month").alias("window_end"), part.alias("part"), F.flatten("xs").alias("x"), F.transform("ys", lambda t: t["y"]).alias("y"), F.transform("ys", lambda t: t["m"]).alias("targets"), "inputs", "last_y")


def ridge(pairs: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """``split_id, entity_id, horizon, part, target_month, y, pred, persistence, alpha``: one ridge model a group, all horizons.

    A group is one entity's windows of one split, some hundreds of rows. Intercepts are not penalised; the alpha of least
    mean squared error on validation is taken, the first of equals.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())
        tr, va = (rows["part"] == "train").to_numpy(), (rows["part"] == "val").to_numpy()
        if tr.sum() < 2:
            return pd.DataFrame({k: pd.Series(dtype=t) for k, t in (("split_id", object), ("entity_id", object), ("horizon", "int32"), ("part", object), ("target_month", object), ("y", float), ("pred", float), ("persistence", float), ("alpha", float))})
        mx, my = x[tr].mean(0), y[tr].mean(0)
        a, b = x[tr] - mx, y[tr] - my
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        best = None
        for alpha in alphas:
            pred = (x - mx) @ (vt.T @ ((s / (s * s + alpha))[:, None] * (u.T @ b))) + my
            loss = float(((pred[va] - y[va]) ** 2).mean()) if va.any() else 0.0
            if best is None or loss < best[0]:
                best = (loss, alpha, pred)
        h = y.shape[1]
        each = lambda c: np.repeat(rows[c].to_numpy(), h)
        return pd.DataFrame({"split_id": each("split_id"), "entity_id": each("entity_id"), "horizon": np.tile(np.arange(1, h + 1), len(rows)), "part": each("part"), "target_month": [m for t in rows["targets"] for m in t], "y": y.ravel(), "pred": best[2].ravel(), "persistence": each("last_y"), "alpha": best[1]})

    return pairs.drop("inputs").groupBy(*KEYS).applyInPandas(fit, "split_id string, entity_id string, horizon int, part string, target_month date, y double, pred double, persistence double, alpha double")


def with_climatology(predictions: DataFrame, parted: DataFrame, target: str, keys: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """Adds ``climatology``: the train mean of the target month's calendar month."""
    c = parted.where("part = 'train'").groupBy(*keys, F.month("month").alias("cal_month")).agg(F.avg(target).alias("climatology"))
    return predictions.withColumn("cal_month", F.month("target_month")).join(c, [*keys, "cal_month"], "left").drop("cal_month")


def skill(error: Column, reference: Column) -> Column:
    """1 - error / reference; null where the reference is 0."""
    return 1 - error / F.nullif(reference, F.lit(0.0))


def label(value: Column) -> Column:
    return F.when(value >= 0.1, VALIDATED).when(value > 0, WEAK).otherwise(NONE)


def scores(predictions: DataFrame, keys: list[str], pred: str = "pred") -> DataFrame:
    """Per horizon and over all (horizon null): errors, their baselines and skills, in one pass by grouping sets."""
    e = lambda c: F.col("y") - F.col(c)
    p = predictions.withColumns({"e2": e(pred) ** 2, "ae": F.abs(e(pred)), "c2": e("climatology") ** 2, "p2": e("persistence") ** 2})
    both = p.groupingSets([[*map(F.col, keys), F.col("horizon")], [*map(F.col, keys)]], *keys, "horizon")
    a = both.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("e2")).alias("rmse"), F.avg("ae").alias("mae"), F.sqrt(F.avg("c2")).alias("rmse_climatology"), F.sqrt(F.avg("p2")).alias("rmse_persistence"), (1 - F.sum("e2") / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("r2"))
    return a.withColumn("skill", F.round(skill(F.col("rmse"), F.col("rmse_climatology")), 4)).withColumn("skill_persistence", F.round(skill(F.col("rmse"), F.col("rmse_persistence")), 4))


def select_best(metrics: DataFrame, keys: list[str], metric: str, position: str) -> DataFrame:
    """The row of the highest metric of each key, the first in order of ``position`` among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), position)
    return metrics.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def votes(metrics: DataFrame, keys: list[str], metric: str = "skill", least: int = 3) -> DataFrame:
    """Mean, worst and best over splits, in how many it is positive, and whether in at least ``least``."""
    won = F.count_if(F.col(metric) > 0)
    return metrics.groupBy(*keys).agg(F.round(F.avg(metric), 6).alias("mean_skill"), F.min(metric).alias("worst"), F.max(metric).alias("best"), won.alias("n_positive"), F.count_if(F.col("skill_persistence") > 0).alias("n_beats_persistence"), (won >= least).alias("replicated"), F.array_join(F.sort_array(F.collect_list(F.when(F.col(metric) > 0, F.col("split_id")))), ",").alias("positive_in"))


def adopt(without: DataFrame, having: DataFrame, keys: list[str], metric: str = "skill", least: int = 3) -> DataFrame:
    """Whether a variant is adopted: a higher mean, and better in at least ``least`` splits."""
    both = without.select(*keys, "split_id", F.col(metric).alias("a")).join(having.select(*keys, "split_id", F.col(metric).alias("b")), [*keys, "split_id"])
    better = F.count_if(F.col("b") > F.col("a"))
    return both.groupBy(*keys).agg(F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_change"), better.alias("n_better"), ((F.avg(F.col("b") - F.col("a")) > 0) & (better >= least)).alias("adopted"))


def trailing_mean_forecasts(parted: DataFrame, target: str, lookbacks: tuple[int, ...], horizon: int) -> DataFrame:
    """Forecasts of each horizon by the mean of the last months, for each lookback: a model family that needs no fit."""
    w = Window.partitionBy(*KEYS).orderBy("month")
    means = F.array(*(F.struct(F.lit(k).alias("lookback"), F.when(F.count(target).over(w.rowsBetween(1 - k, 0)) == k, F.avg(target).over(w.rowsBetween(1 - k, 0))).alias("pred")) for k in lookbacks))
    ahead = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead(target, h).over(w).alias("y"), F.lead("part", h).over(w).alias("part"), F.lead("month", h).over(w).alias("target_month")) for h in range(1, horizon + 1)))
    rows = parted.select(*KEYS, F.col(target).alias("persistence"), means.alias("m"), ahead.alias("a"))
    out = rows.select(*KEYS, "persistence", F.explode("m").alias("m"), "a").select(*KEYS, "persistence", "m.*", F.explode("a").alias("a")).select(*KEYS, "persistence", "lookback", "pred", "a.*")
    return out.where("pred is not null and y is not null and part is not null")


def cut_scores(predictions: DataFrame, keys: list[str], cuts: dict[str, Column], pred: str = "pred") -> DataFrame:
    """Scores over each cut of the rows; a row may be in several, and all are taken in one pass."""
    named = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in cuts.items())), lambda x: x.isNotNull())
    e = lambda c: F.col("y") - F.col(c)
    rows = predictions.withColumns({"e2": e(pred) ** 2, "c2": e("climatology") ** 2}).withColumn("cut", F.explode(named))
    a = rows.groupBy("cut", *keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("e2")).alias("rmse"), F.sqrt(F.avg("c2")).alias("reference"))
    return a.withColumn("skill", F.round(skill(F.col("rmse"), F.col("reference")), 4)).drop("reference")


def climatology_mse(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared error of the climatology on validation rows."""
    return predictions.where("part = 'val'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") - F.col("climatology")) ** 2).alias("climatology_mse"))


def comparison(metrics: DataFrame, keys: list[str], horizons: tuple[int, ...], metric: str = "skill") -> DataFrame:
    """A row a model, a column a horizon (``t1`` ...) and ``averaged``: the mean of the metric over the splits."""
    of = lambda c: F.round(F.avg(F.when(c, F.col(metric))), 6)
    return metrics.groupBy(*keys).agg(*(of(F.col("horizon") == h).alias(f"t{h}") for h in horizons), of(F.col("horizon").isNull()).alias("averaged"))


def best_cell(metrics: DataFrame, keys: list[str], cell: list[str], metric: str = "skill") -> DataFrame:
    """The cell of the highest metric of each key, the least in order among equals, with a verdict by the thresholds."""
    first = F.min_by(F.struct(*cell, metric), F.struct(-F.col(metric), *cell))
    verdict = F.when(F.col(metric) >= 0.1, "useful").when(F.col(metric) > 0, "weak").otherwise("no better than climatology")
    return metrics.where(F.col(metric).isNotNull()).groupBy(*keys).agg(first.alias("best")).select(*keys, "best.*").withColumn("verdict", verdict)


def clipping(predictions: DataFrame, keys: list[str], pred: str = "pred") -> DataFrame:
    """How many forecasts of a quantity that is never negative are so, the least one, and the error before and after cutting at 0."""
    p, e = F.col(pred), lambda c: F.sqrt(F.avg((F.col("y") - c) ** 2))
    return predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(p < 0, 1.0).otherwise(0.0)).alias("negative_share"), F.min(p).alias("most_negative"), e(p).alias("rmse"), e(F.greatest(p, F.lit(0.0))).alias("rmse_clipped"))
