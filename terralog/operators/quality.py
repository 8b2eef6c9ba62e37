"""Guards as rows: what is missing, late, leaked or changed, by entity. An empty or all-true result means that all is well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from terralog.operators import series

#: Share of a series' months that another one must have to be attached to it.
LEAST_OVERLAP = 0.9


def unknown_keys(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """``key, n_rows`` of keys that the reference table does not have."""
    missing = rows.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias("known_key")), F.col(key) == F.col("known_key"), "left_anti")
    return missing.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def coverage(frame: DataFrame, lo: str, hi: str) -> DataFrame:
    """``entity_id, first_month, last_month, covers``: whether a series begins and ends outside a span that is required."""
    a = frame.groupBy("entity_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    return a.withColumn("covers", (F.col("first_month") <= F.lit(lo).cast("date")) & (F.col("last_month") >= F.lit(hi).cast("date")))


def overlap(frame: DataFrame, other: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """``entity_id, n, n_matched, lo, hi, n_gaps, accepted``: how far ``other`` (``entity_id, month, value``) covers the months of ``frame``.

    ``lo`` and ``hi`` bound the shared span; a gap is a month inside it without a value.
    """
    have = other.where("value is not null").select("entity_id", "month", F.lit(True).alias("matched"))
    j = frame.select("entity_id", "month").join(have, ["entity_id", "month"], "left")
    hit = F.when(F.col("matched"), F.col("month"))
    j = j.withColumns({"lo": F.min(hit).over(Window.partitionBy("entity_id")), "hi": F.max(hit).over(Window.partitionBy("entity_id"))})
    inside = F.coalesce(F.col("month").between(F.col("lo"), F.col("hi")), F.lit(False))
    a = j.groupBy("entity_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.count("matched").alias("n_matched"), F.count_if(inside & F.col("matched").isNull()).alias("n_gaps"))
    return a.withColumn("accepted", (F.col("n_matched") >= least * F.col("n")) & (F.col("n_gaps") == 0))


def attached(frame: DataFrame, other: DataFrame, name: str, lags: tuple[int, ...] = (1, 3), least: float = LEAST_OVERLAP) -> DataFrame:
    """The rows of accepted entities within the shared span, with the other series' value and its lags."""
    span = overlap(frame, other, least).where("accepted").select("entity_id", "lo", "hi")
    kept = frame.join(span, "entity_id").where(F.col("month").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    return series.lags(kept.join(other.select("entity_id", "month", F.col("value").alias(name)), ["entity_id", "month"], "left"), name, lags)


def index_gaps(frame: DataFrame, index: DataFrame) -> DataFrame:
    """``entity_id, n_missing, first_missing, last_missing`` of months without a value of the index."""
    gone = frame.select("entity_id", "month").join(index.where("value is not null"), "month", "left_anti")
    return gone.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_missing"), F.min("month").alias("first_missing"), F.max("month").alias("last_missing"))


def train_only(parted: DataFrame, value: str) -> DataFrame:
    """``split_id, entity_id, from_train, from_all``: by how much the fitted month means differ from a fit on train rows and on all."""
    fitted = series.month_stats(parted, value).select("split_id", "entity_id", "cal_month", "mean")
    train = F.avg(F.when(F.col("part") == "train", F.col(value)))
    again = parted.groupBy("split_id", "entity_id", F.month("month").alias("cal_month")).agg(train.alias("train"), F.avg(value).alias("all"))
    far = lambda c: F.max(F.abs(F.col("mean") - F.col(c)))
    return fitted.join(again, ["split_id", "entity_id", "cal_month"]).groupBy("split_id", "entity_id").agg(far("train").alias("from_train"), far("all").alias("from_all"))


def truncation(frame: DataFrame, cut: str, features: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``entity_id, n_rows, n_changed``: rows before ``cut`` whose features change when what follows is taken away."""
    before = F.col("month") < F.lit(cut).cast("date")
    whole = features(frame).where(before).select("entity_id", "month", F.struct(*columns).alias("a"))
    part = features(frame.where(before)).select("entity_id", "month", F.struct(*columns).alias("b"))
    j = whole.join(part, ["entity_id", "month"], "left")
    return j.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))


def window_order(windows: DataFrame, lookback: int) -> DataFrame:
    """``split_id, entity_id, n_windows, n_late, n_broken``: inputs at or after a target, and inputs that are not in a row."""
    late = F.array_max("inputs") >= F.array_min("targets")
    broken = F.months_between(F.array_max("inputs"), F.array_min("inputs")) != lookback - 1
    return windows.groupBy("split_id", "entity_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(late).alias("n_late"), F.count_if(broken).alias("n_broken"))


def shared_targets(windows: DataFrame) -> DataFrame:
    """``split_id, entity_id, n_targets, n_shared``: target months, and those that are in several parts."""
    t = windows.select("split_id", "entity_id", "part", F.explode("targets").alias("month")).distinct()
    n = t.groupBy("split_id", "entity_id", "month").agg(F.count(F.lit(1)).alias("n_parts"))
    return n.groupBy("split_id", "entity_id").agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(F.col("n_parts") > 1).alias("n_shared"))


def unchanged(archive: DataFrame, later: DataFrame, recent: DataFrame, keys: list[str]) -> DataFrame:
    """``entity_id, n_archive, n_superseded, n_lost``: archive rows that a recent one replaces, and others that ``later`` lacks."""
    replaced = recent.select(*keys).distinct().withColumn("superseded", F.lit(True))
    a = archive.join(replaced, keys, "left").join(later.select(*archive.columns).distinct().withColumn("kept", F.lit(True)), archive.columns, "left")
    lost = F.col("superseded").isNull() & F.col("kept").isNull()
    return a.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_archive"), F.count("superseded").alias("n_superseded"), F.count_if(lost).alias("n_lost"))


def refresh_status(archive: DataFrame, recent: DataFrame) -> DataFrame:
    """``entity_id, n_new_days, n_complete, dropped, status`` of each entity of the archive or the recent days.

    New days lie after the archive's last one. Months after the archive's last month are published if each day is there,
    else they are named in ``dropped``. An entity without an archive or without news is reported like the others.
    """
    end = archive.groupBy("entity_id").agg(F.max("day").alias("last_day"))
    r = recent.where("value is not null").join(end, "entity_id", "left")
    new = r.where(F.col("last_day").isNull() | (F.col("day") > F.col("last_day"))).select("entity_id", "day", "last_day").distinct()
    m = new.groupBy("entity_id", F.trunc("day", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n_days"), F.max("last_day").alias("last_day"))
    later = F.col("last_day").isNull() | (F.col("month") > F.trunc("last_day", "MM"))
    full = F.col("n_days") >= F.day(F.last_day("month"))
    s = m.groupBy("entity_id").agg(F.sum("n_days").alias("n_new_days"), F.count_if(later & full).alias("n_complete"), F.array_join(F.array_sort(F.collect_list(F.when(later & ~full, F.date_format("month", "yyyy-MM")))), ",").alias("dropped"))
    every = end.select("entity_id", F.lit(True).alias("archived")).join(s, "entity_id", "full")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_new_days", "n_complete")}
    status = F.when(F.col("archived").isNull(), "no archive").when(F.col("n_complete") > 0, "refreshed").when(F.col("n_new_days") > 0, "incomplete").otherwise("current")
    return every.withColumns({**n, "dropped": F.coalesce("dropped", F.lit(""))}).withColumn("status", status).select("entity_id", "n_new_days", "n_complete", "dropped", "status")


def availability(expected: DataFrame, found: DataFrame, key: str, usable: Column, why: Column) -> DataFrame:
    """Every expected ``key``, ``available``, ``reason``, and whether any of its ``group_id`` is not available.

    ``expected``: ``key, group_id``; ``found``: at most a row a key, on which ``usable`` and ``why`` are judged.
    """
    j = expected.join(found.withColumn("found", F.lit(True)), key, "left")
    ok = F.col("found").isNotNull() & F.coalesce(usable, F.lit(False))
    j = j.select(key, "group_id", ok.alias("available"), F.when(F.col("found").isNull(), "not found").when(~ok, why).alias("reason"))
    bad = j.groupBy("group_id").agg(F.bool_or(~F.col("available")).alias("any_unavailable"))
    return j.join(bad, "group_id")


class Guards:
    """Figures of a table that are taken in the pass of the job that uses it (``frame``), so guarding costs no scan of its own."""

    def __init__(self, rows: DataFrame, figures: dict[str, Column]):
        """``figures``: aggregates by name."""
        self._seen = Observation()
        self.frame = rows.observe(self._seen, *(c.alias(n) for n, c in figures.items()))

    def figures(self) -> dict:
        """The figures, once a job over ``frame`` has ended; it waits for that."""
        return self._seen.get

    def require(self, *conditions: Column) -> None:
        """ValueError that names the conditions (over the figures) which do not hold."""
        spark = SparkSession.active()
        row = spark.createDataFrame([tuple(self.figures().values())], list(self.figures()))
        held = row.select(*(c.alias(f"c{k}") for k, c in enumerate(conditions))).first()
        if failed := [str(c) for k, c in enumerate(conditions) if not held[k]]:
            raise ValueError(f"{failed} do not hold: {self.figures()}")
