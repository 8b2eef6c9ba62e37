"""Monthly series of many entities: resampling, densifying, causal features, train-only statistics.

Frames are keyed by ``entity_id`` and ``month`` (first day). Fitted statistics use rows of the train years only, rolling
windows look back only, and the anomaly baseline lies inside the train years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_month():
    return Window.partitionBy("entity_id").orderBy("month")


def resample(rows: DataFrame, time: str, value: str) -> DataFrame:
    """``entity_id, month, value_sum, value_mean, value_max, n`` per month; all-null months have null sums."""
    return rows.groupBy("entity_id", F.trunc(time, "MM").alias("month")).agg(F.sum(value).alias("value_sum"), F.avg(value).alias("value_mean"), F.max(value).alias("value_max"), F.count(value).alias("n"))


def densify(monthly: DataFrame) -> DataFrame:
    """A row for each month between an entity's first and last, null where there was none."""
    span = monthly.groupBy("entity_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    grid = span.select("entity_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return grid.join(monthly, ["entity_id", "month"], "left")


def lags(frame: DataFrame, value: str, steps: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    return frame.withColumns({f"{value}_lag{k}": F.lag(value, k).over(by_month()) for k in steps})


def trailing(value: str, months: int, how, least: int = 1) -> Column:
    """``how`` over the last ``months`` rows, the current one too; null with under ``least`` values."""
    w = by_month().rowsBetween(1 - months, 0)
    return F.when(F.count(value).over(w) >= least, how(value).over(w))


def season(frame: DataFrame) -> DataFrame:
    angle = 2 * F.pi() * F.month("month") / 12
    return frame.withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def in_years(lo: Column | int, hi: Column | int) -> Column:
    return F.year("month").between(lo, hi)


def anomaly(frame: DataFrame, value: str, lo: int, hi: int) -> DataFrame:
    """Adds ``baseline`` (mean of the calendar month in the baseline years) and ``anomaly``."""
    base = frame.where(in_years(lo, hi)).groupBy("entity_id", F.month("month").alias("cal_month")).agg(F.avg(value).alias("baseline"))
    return frame.withColumn("cal_month", F.month("month")).join(base, ["entity_id", "cal_month"], "left").withColumn("anomaly", F.col(value) - F.col("baseline"))


def with_parts(frame: DataFrame, splits: DataFrame) -> DataFrame:
    """Each row once for each split, with its part: train, val, test or null. ``splits`` is a table of a few rows."""
    part = F.when(in_years(F.col("train_lo"), F.col("train_hi")), "train").when(in_years(F.col("val_lo"), F.col("val_hi")), "val").when(in_years(F.col("test_lo"), F.col("test_hi")), "test")
    return frame.crossJoin(splits).withColumn("part", part)


def clipped_baseline(splits: DataFrame, lo: int, hi: int) -> DataFrame:
    """``splits`` with ``baseline_lo, baseline_hi``, the years ``lo`` to ``hi`` within the train years; an error where none are left."""
    a, b = F.greatest(F.lit(lo), "train_lo"), F.least(F.lit(hi), "train_hi")
    none = F.raise_error(F.concat(F.lit("no baseline years in split "), "split_id")).cast("int")
    return splits.withColumns({"baseline_lo": F.when(a <= b, a).otherwise(none), "baseline_hi": b})


def month_stats(parted: DataFrame, value: str) -> DataFrame:
    """Mean and sample deviation of each calendar month's train rows, a split."""
    return parted.where("part = 'train'").groupBy("split_id", "entity_id", F.month("month").alias("cal_month")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n_train"))


def standardised(parted: DataFrame, value: str) -> DataFrame:
    """Adds ``z``; null where the deviation is 0 or missing."""
    return parted.withColumn("cal_month", F.month("month")).join(month_stats(parted, value), ["split_id", "entity_id", "cal_month"], "left").withColumn("z", (F.col(value) - F.col("mean")) / F.nullif("std", F.lit(0.0)))


def scaled(parted: DataFrame, features: list[str], keys: tuple[str, ...] = ("split_id", "entity_id")) -> DataFrame:
    """Min-max scaling by train rows; a constant feature is only shifted."""
    fit = parted.where("part = 'train'").groupBy(*keys).agg(*(g(f).alias(f"{f}_{n}") for f in features for n, g in (("min", F.min), ("max", F.max))))
    width = {f: F.col(f"{f}_max") - F.col(f"{f}_min") for f in features}
    return parted.join(fit, [*keys], "left").withColumns({f"{f}_scaled": (F.col(f) - F.col(f"{f}_min")) / F.when(width[f] == 0, F.lit(1.0)).otherwise(width[f]) for f in features})


def causal_outliers(frame: DataFrame, value: str, lo: int, hi: int, k: float = 3.0) -> DataFrame:
    """Replaces values outside the train quartiles by k times their distance with the median of the 12 rows before."""
    q = frame.where(in_years(lo, hi)).groupBy("entity_id").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    before = F.percentile(value, F.lit(0.5)).over(by_month().rowsBetween(-12, -1))
    out = frame.join(q, "entity_id", "left").withColumn("median_before", before)
    odd = (F.col(value) < F.col("q")[0] - k * iqr) | (F.col(value) > F.col("q")[1] + k * iqr)
    return out.withColumn("replaced", F.coalesce(odd & F.col("median_before").isNotNull(), F.lit(False))).withColumn("cleaned", F.when(F.col("replaced"), F.col("median_before")).otherwise(F.col(value))).drop("q", "median_before")


def interpolated(frame: DataFrame, value: str, limit: int = 2) -> DataFrame:
    """Fills the first ``limit`` months of each inner gap, linearly by days."""
    known = F.when(F.col(value).isNotNull(), F.struct("month", F.col(value).alias("v")))
    before, after = F.last(known, True).over(by_month().rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(by_month().rowsBetween(0, Window.unboundedFollowing))
    run = frame.withColumns({"before": before, "after": after}).withColumn("gap_place", F.months_between("month", "before.month"))
    share = F.date_diff("month", "before.month") / F.date_diff("after.month", "before.month")
    fill = F.when((F.col("gap_place") <= limit) & F.col("after").isNotNull(), F.col("before.v") + (F.col("after.v") - F.col("before.v")) * share)
    return run.withColumn("filled", F.coalesce(F.col(value), fill)).drop("before", "after", "gap_place")


def dense_interpolated(monthly: DataFrame, value: str, limit: int = 2) -> DataFrame:
    """``entity_id, month``, ``value`` and ``filled`` as ``interpolated`` of ``densify`` gives them, from one sort of the rows there are.

    ``monthly`` has one row an entity and month. A row knows the month of the next row and the next value, and makes the
    months up to that row; rows without an entity have no values, as they have none in a join by entity.
    """
    rows = monthly.where("month is not null").select("entity_id", "month", F.when(F.col("entity_id").isNotNull(), F.col(value)).alias("v"))
    rows = rows.withColumn("known", F.when(F.col("v").isNotNull(), F.struct("month", "v")))
    w = "over (partition by entity_id order by month)"
    run = rows.withColumns({"before": F.last("known", True).over(by_month().rowsBetween(Window.unboundedPreceding, 0)), "after": F.expr(f"lead(known, 1) ignore nulls {w}"), "last_month": F.coalesce(F.add_months(F.lead("month").over(by_month()), -1), "month")})
    grid = run.withColumn("at", F.explode(F.sequence("month", F.greatest("last_month", "month"), F.expr("interval 1 month"))))
    own = F.when(F.col("at") == F.col("month"), F.col("v"))
    share = F.date_diff("at", "before.month") / F.date_diff("after.month", "before.month")
    fill = F.when((F.months_between("at", "before.month") <= limit) & F.col("after").isNotNull(), F.col("before.v") + (F.col("after.v") - F.col("before.v")) * share)
    return grid.select("entity_id", F.col("at").alias("month"), own.alias(value), F.coalesce(own, fill).alias("filled"))


def complete_months(daily: DataFrame) -> DataFrame:
    """``entity_id, month, n_days, complete``: whether each day of the month has a value."""
    m = daily.where("value is not null").groupBy("entity_id", F.trunc("day", "MM").alias("month")).agg(F.count_distinct("day").alias("n_days"))
    return m.withColumn("complete", F.col("n_days") >= F.day(F.last_day("month")))


def attach_index(frame: DataFrame, index: DataFrame) -> DataFrame:
    """Adds the index of the month and of the calendar month before. ``index``: one row a month, so at most some thousands."""
    now, before = index.withColumnRenamed("value", "index_value"), index.select(F.add_months("month", 1).alias("month"), F.col("value").alias("index_lag1"))
    return frame.join(now, "month", "left").join(before, "month", "left")


def currency(frame: DataFrame, index: DataFrame, today: str) -> DataFrame:
    """Per entity: last month of the series and of the index, the earlier of both, and how many months it lies behind."""
    ends = frame.groupBy("entity_id").agg(F.max("month").alias("series_end")).crossJoin((index.agg(F.max("month").alias("index_end"))))
    anchor = F.least("series_end", "index_end")
    t = F.to_date(F.lit(today))
    behind = (F.year(t) - F.year("anchor")) * 12 + F.month(t) - F.month("anchor")
    limits = F.when(F.col("index_end") < F.col("series_end"), "index").when(F.col("index_end") > F.col("series_end"), "series").otherwise("both")
    return ends.withColumn("anchor", anchor).withColumn("months_behind", behind).withColumn("limited_by", limits)


def correlations(frame: DataFrame, a: str, b: str, lo: int, hi: int) -> DataFrame:
    """Pearson over all and over train rows, and Spearman by average ranks, an entity."""
    w = lambda c: Window.partitionBy("entity_id").orderBy(c)
    tied = lambda c: Window.partitionBy("entity_id", c)
    both = frame.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.withColumns({f"rank_{c}": F.rank().over(w(c)) + (F.count(F.lit(1)).over(tied(c)) - 1) / 2 for c in (a, b)})
    train = in_years(lo, hi)
    return ranked.groupBy("entity_id").agg(F.corr(a, b).alias("pearson"), F.corr(F.when(train, F.col(a)), F.when(train, F.col(b))).alias("pearson_train"), F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"), F.stddev_samp(a).alias("std_a"), F.stddev_samp(b).alias("std_b"), F.count(F.lit(1)).alias("n"))
