"""Heat-wave operators on daily series: ring-pooled normals, criteria, spells, monthly counts, distribution checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralog.operators import series


def by_day():
    return Window.partitionBy("entity_id").orderBy("day")


def normals(daily: DataFrame, lo: int, hi: int, reach: int = 7) -> DataFrame:
    """Mean of all baseline values within ``reach`` days of a day of the year, on a ring of 366.

    Values are summed by day of the year first; only those 366 sums are dealt to their neighbours.
    """
    doy = daily.where(F.year("day").between(lo, hi) & F.col("value").isNotNull()).groupBy("entity_id", F.dayofyear("day").alias("doy")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    near = doy.select("entity_id", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(366)) + 1)).alias("doy"), "s", "n")
    return near.groupBy("entity_id", "doy").agg((F.sum("s") / F.sum("n")).alias("normal"), F.sum("n").alias("n_pooled"))


def flagged(daily: DataFrame, norm: DataFrame, hot: float, warm: float, dep: float, severe: float, severe_dep: float) -> DataFrame:
    """Adds departure from normal and the heat-day and severe-day flags (false where the value is missing)."""
    d = daily.withColumn("doy", F.dayofyear("day")).join(norm.select("entity_id", "doy", "normal"), ["entity_id", "doy"], "left").withColumn("departure", F.col("value") - F.col("normal"))
    v, x = F.col("value"), F.col("departure")
    rule = lambda top, by: F.coalesce((v >= top) | ((v >= warm) & (x >= by)), (v >= top), F.lit(False))
    return d.withColumns({"heat_day": rule(hot, dep), "severe_day": rule(severe, severe_dep)})


def spells(days: DataFrame, least: int = 2, break_on_gap: bool = True) -> DataFrame:
    """Adds ``in_spell``: the day is one of at least ``least`` heat days in a row; a missing day ends a row of days."""
    before = F.lag("heat_day").over(by_day())
    gap = F.date_diff("day", F.lag("day").over(by_day())) > 1 if break_on_gap else F.lit(False)
    new = F.when(before.isNull() | (before != F.col("heat_day")) | gap, 1).otherwise(0)
    run = days.withColumn("new_run", new).withColumn("run", F.sum("new_run").over(by_day()))
    return run.withColumn("in_spell", F.col("heat_day") & (F.count(F.lit(1)).over(Window.partitionBy("entity_id", "run")) >= least)).drop("new_run", "run")


def monthly_counts(days: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("int"))
    return days.groupBy("entity_id", F.trunc("day", "MM").alias("month")).agg(n("heat_day").alias("heat_days"), n("severe_day").alias("severe_days"), n("in_spell").alias("spell_days"), F.max("value").alias("max_value"), (n("in_spell") > 0).alias("had_spell"), F.avg("departure").alias("mean_departure"))


def targets(daily: DataFrame, days: DataFrame, splits: DataFrame, index: DataFrame) -> DataFrame:
    """``split_id, entity_id, month, part, anomaly, extreme, heat_days, index_value`` of each month.

    ``anomaly``: the monthly mean, standardised by the calendar month's monthly means; ``extreme``: the hottest day,
    standardised by its daily values; both by train rows. ``days``: of ``flagged``.
    """
    keys, cal = ["split_id", "entity_id"], F.month("month").alias("cal_month")
    m = days.groupBy("entity_id", F.trunc("day", "MM").alias("month")).agg(F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.sum(F.col("heat_day").cast("double")).alias("heat_days"))
    p = series.with_parts(m, splits).withColumn("cal_month", F.month("month"))
    d = series.with_parts(daily.withColumn("month", F.trunc("day", "MM")), splits).where("part = 'train'")
    law = lambda rows, c, a: rows.groupBy(*keys, cal).agg(F.avg(c).alias(f"mean_{a}"), F.nullif(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{a}"))
    p = p.join(law(p.where("part = 'train'"), "mean_value", "m"), [*keys, "cal_month"], "left").join(law(d, "value", "d"), [*keys, "cal_month"], "left")
    p = p.join(index.select("month", F.col("value").alias("index_value")), "month", "left")
    z = {"anomaly": (F.col("mean_value") - F.col("mean_m")) / F.col("std_m"), "extreme": (F.col("max_value") - F.col("mean_d")) / F.col("std_d")}
    return p.withColumns(z).select(*keys, "month", "part", "anomaly", "extreme", "heat_days", "index_value")


def distribution(parted: DataFrame, value: str) -> DataFrame:
    """Whether a standardised series is normal: moments and quantiles of its train rows, by split and entity, with two verdicts.

    ``approximately_normal`` is about the shape, ``approximately_standard_normal`` about place and scale too.
    """
    p = [0.05, 0.25, 0.75, 0.95]
    z = [-1.6448536269514722, -0.6744897501960817, 0.6744897501960817, 1.6448536269514722]
    v = F.col(value)
    a = parted.where((F.col("part") == "train") & v.isNotNull()).groupBy("split_id", "entity_id").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), F.percentile(v, F.array(*map(F.lit, p))).alias("q")
    )
    gap = F.array_max(F.array(*(F.abs(F.col("q")[i] - z[i]) for i in range(4))))
    shape = (F.abs("skew") < 0.5) & (F.abs("kurtosis") < 1.0)
    place = (F.abs("mean") < 0.25) & (F.col("std") > 0.75) & (F.col("std") < 1.33)
    quantiles = [F.col("q")[i].alias(f"p{int(100 * x):02d}") for i, x in enumerate(p)]
    return a.select("split_id", "entity_id", "n", "mean", "std", "lo", "hi", "skew", "kurtosis", *quantiles, gap.alias("largest_gap"), shape.alias("approximately_normal"), (shape & place).alias("approximately_standard_normal"))


def zero_inflation(parted: DataFrame, value: str, months: tuple[int, ...] = (4, 5, 6)) -> DataFrame:
    """Share of zeros and mean of train rows, over all months and a cut of them, by split and entity."""
    cut = F.month("month").isin(*months)
    zero = F.when(F.col(value) == 0, 1.0).otherwise(0.0)
    rows = parted.where((F.col("part") == "train") & F.col(value).isNotNull())
    return rows.groupBy("split_id", "entity_id").agg(F.count(value).alias("n"), F.avg(zero).alias("zero_share"), F.avg(value).alias("mean"), F.avg(F.when(cut, zero)).alias("zero_share_cut"), F.avg(F.when(cut, F.col(value))).alias("mean_cut"), F.max(value).alias("most"))


def month_record(counts: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (``entity_id, month`` as text or null) the record of the month, by default the latest one; else the reason."""
    span = counts.groupBy("entity_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    wanted = requests.join(span, "entity_id", "left").withColumn("month", F.coalesce(F.trunc(F.try_to_date("month", "yyyy-MM"), "MM"), F.col("last_month")))
    found = wanted.join(counts, ["entity_id", "month"], "left")
    why = F.when(F.col("heat_days").isNull(), F.concat(F.lit("no record; available "), F.date_format("first_month", "yyyy-MM"), F.lit(" to "), F.date_format("last_month", "yyyy-MM")))
    return found.select("entity_id", "month", "heat_days", "severe_days", "had_spell", F.round("max_value", 1).alias("max_value"), F.lit(False).alias("forecast_available"), why.alias("reason"))
