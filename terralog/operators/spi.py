"""Standardised precipitation index: a gamma law with a share of zeros for each calendar month, fitted on train rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions import special


def statistics(parted: DataFrame, value: str) -> DataFrame:
    """Sufficient statistics of the fit, by hash aggregation: share of zeros, mean and mean logarithm of positive values."""
    x = F.col(value)
    pos = F.when(x > 0, x)
    return parted.where((F.col("part") == "train") & x.isNotNull()).groupBy("split_id", "entity_id", F.month("month").alias("cal_month")).agg(F.count(x).alias("n_train"), F.avg(F.when(x == 0, 1.0).otherwise(0.0)).alias("q"), F.avg(pos).alias("mean_pos"), F.avg(F.ln(pos)).alias("mean_log"))


@F.pandas_udf(T.DoubleType())
def _shape(s: pd.Series) -> pd.Series:
    return pd.Series(np.where(s.isna(), np.nan, special.gamma_shape(s.fillna(1.0)))).astype(object).where(s.notna().to_numpy(), None).astype(float)


def parameters(parted: DataFrame, value: str) -> DataFrame:
    """``split_id, entity_id, cal_month, n_train, q, alpha, beta``; the solver runs on the small table of statistics."""
    st = statistics(parted, value)
    return st.withColumn("alpha", _shape(F.ln("mean_pos") - F.col("mean_log"))).withColumn("beta", F.col("mean_pos") / F.col("alpha")).drop("mean_pos", "mean_log")


@F.pandas_udf(T.DoubleType())
def _forward(x: pd.Series, q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    ok = (x.notna() & q.notna()).to_numpy()
    xs, alpha, beta = x.fillna(0).to_numpy(), a.fillna(1).to_numpy(), b.fillna(1).to_numpy()
    h = np.where(xs <= 0, q.fillna(0.5), q.fillna(0.5) + (1 - q.fillna(0.5)) * special.gammainc(alpha, np.maximum(xs, 0) / beta))
    return pd.Series(np.where(ok, special.normal_ppf(np.clip(h, 1e-6, 1 - 1e-6)), np.nan))


@F.pandas_udf(T.DoubleType())
def _inverse(z: pd.Series, q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    ok = (z.notna() & q.notna()).to_numpy()
    p, share = special.normal_cdf(z.fillna(0).to_numpy()), q.fillna(0.5).to_numpy()
    rest = np.clip((p - share) / np.maximum(1 - share, 1e-9), 1e-9, 1 - 1e-9)
    x = special.gamma_ppf(a.fillna(1).to_numpy(), rest) * b.fillna(1).to_numpy()
    return pd.Series(np.where(ok, np.where(p <= share + 1e-9, 0.0, x), np.nan))


def scored(parted: DataFrame, value: str) -> DataFrame:
    """Adds ``spi``: null for a null value, else the normal quantile of the value's place in its calendar month's law."""
    fit = parameters(parted, value).drop("n_train")
    joined = parted.withColumn("cal_month", F.month("month")).join(fit, ["split_id", "entity_id", "cal_month"], "left")
    spi = _forward(F.col(value).cast("double"), "q", "alpha", "beta")
    return joined.withColumn("spi", F.nanvl(spi, F.lit(None).cast("double")))


def restored(with_spi: DataFrame) -> DataFrame:
    """Adds ``restored``: the value that belongs to ``spi``, 0 below the share of zeros."""
    return with_spi.withColumn("restored", F.nanvl(_inverse("spi", "q", "alpha", "beta"), F.lit(None).cast("double")))


def risk(spi: str = "mean_spi"):
    """Risk score from 0 to 10, and the flag of a mean index."""
    score = F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), -4 * F.col(spi) + 2)), 1)
    return score, F.when(F.col(spi) < -1.5, "Severe").when(F.col(spi) < -1.0, "Moderate").otherwise("None")
