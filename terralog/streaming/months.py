"""Days of many entities to months and forecasts, by keyed state: the archive is read once, at the first start.

An entity's state holds the days of its last months, each with the number of its latest row, and the means of its closed
months. New rows of a batch change only the months of their own days: a month is published as its last missing day comes,
and again where a late or corrected day changes it. A closed month with the months of a window before it also gives the
forecast of the month after it.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "entity_id string, day date, value double, seq long"
OUTPUT = "entity_id string, kind string, month date, value double, n_days int"
#: Months of days that stay in the state; rows of days before them come too late to change anything.
KEEP = 6


def initial(archive: DataFrame, models: DataFrame, lookback: int) -> DataFrame:
    """A row an entity of the archive: its last month, the means of its last complete months, and its model.

    ``models``: ``entity_id, intercept, coef`` (the weights of ``lookback`` months, by time); entities without one have no forecasts.
    """
    m = archive.groupBy("entity_id", F.trunc("day", "MM").alias("month")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    full = F.when(F.col("n") >= F.day(F.last_day("month")), F.struct("month", "mean"))
    e = m.groupBy("entity_id").agg(F.max("month").alias("last_month"), F.array_sort(F.collect_list(full)).alias("full"))
    e = e.join(models.select("entity_id", "intercept", "coef"), "entity_id", "left")
    last = F.slice("full", -lookback, lookback)
    last = F.when(F.size("full") > lookback, last).otherwise(F.col("full"))
    return e.select("entity_id", "last_month", last["month"].alias("months"), last["mean"].alias("means"), "intercept", F.coalesce("coef", F.array().cast("array<double>")).alias("coef"))


def _after(month: dt.date, n: int) -> dt.date:
    k = month.year * 12 + month.month - 1 + n
    return dt.date(k // 12, k % 12 + 1, 1)


class Months(StatefulProcessor):
    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "month date", "day array<int>, value array<double>, seq array<long>")
        self.means = handle.getMapState("means", "month date", "mean double")
        self.entity = handle.getValueState("entity", "last_month date, newest date, intercept double, coef array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.entity.update((r["last_month"], r["last_month"], None if pd.isna(r["intercept"]) else float(r["intercept"]), [float(c) for c in r["coef"]]))
        for month, mean in zip(r["months"], r["means"], strict=True):
            self.means.updateValue((month,), (float(mean),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.entity.get() if self.entity.exists() else None
        if state is None:  # not in the archive: there is no month after which to publish
            return
        last_month, newest, intercept, coef = state
        coming: dict[dt.date, dict[int, tuple[int, float | None]]] = {}
        for part in rows:
            for day, value, seq in zip(part["day"], part["value"], part["seq"], strict=True):
                month = day.replace(day=1)
                if month <= last_month:
                    continue
                d = coming.setdefault(month, {})
                if day.day not in d or seq >= d[day.day][0]:
                    d[day.day] = (int(seq), None if pd.isna(value) else float(value))
        closed = []
        for month in sorted(coming):
            if _after(month, self.keep) <= newest:
                continue
            newest = max(newest, month)
            have = {}
            if self.days.containsKey((month,)):
                have = {d: (s, v) for d, v, s in zip(*self.days.getValue((month,)), strict=True)}
            for d, (s, v) in coming[month].items():
                if d not in have or s >= have[d][0]:
                    have[d] = (s, v)
            self.days.updateValue((month,), (list(have), [v for _, v in have.values()], [s for s, _ in have.values()]))
            values = [v for _, v in have.values() if v is not None]
            mean = sum(values) / len(values) if len(values) == calendar.monthrange(month.year, month.month)[1] else None
            old = self.means.getValue((month,))[0] if self.means.containsKey((month,)) else None
            if mean is not None and mean != old:
                self.means.updateValue((month,), (mean,))
                closed.append((month, mean, len(values)))
        out = [(key[0], "month", m, v, n) for m, v, n in closed]
        ends = {_after(m, k) for m, *_ in closed for k in range(len(coef))} if intercept is not None else ()
        for end in sorted(ends):  # every window that has a month that changed
            window = [_after(end, k - len(coef) + 1) for k in range(len(coef))]
            if all(self.means.containsKey((m,)) for m in window):
                x = [self.means.getValue((m,))[0] for m in window]
                out.append((key[0], "forecast", _after(end, 1), intercept + sum(a * b for a, b in zip(coef, x, strict=True)), 0))
        self._forget(newest, len(coef))
        self.entity.update((last_month, newest, intercept, coef))
        if out:
            yield pd.DataFrame(out, columns=["entity_id", "kind", "month", "value", "n_days"])

    def _forget(self, newest: dt.date, window: int) -> None:
        for state, reach in ((self.days, self.keep), (self.means, self.keep + window)):
            for (month,) in [k for k in state.keys()]:  # noqa: SIM118
                if _after(month, reach) <= newest:
                    state.removeKey((month,))

    def close(self) -> None:
        pass


def run(spark: SparkSession, landing: str, start: DataFrame, published: str, checkpoint: str, keep: int = KEEP) -> None:
    """Takes every new file under ``landing`` once. ``start``: of ``initial``; it is used at the first start only.

    Each batch writes its months and forecasts into a folder of its own, so a batch that runs again after a lost executor
    replaces what it wrote; ``current`` takes the latest of each.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = spark.readStream.schema(SCHEMA).parquet(landing)
    out = rows.groupBy("entity_id").transformWithStateInPandas(statefulProcessor=Months(keep), outputStructType=OUTPUT, outputMode="Update", timeMode="None", initialState=start.groupBy("entity_id"))

    def batch(found: DataFrame, number: int) -> None:
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(published)

    out.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, published: str) -> DataFrame:
    """The latest version of every month and forecast."""
    rows = spark.read.schema(f"{OUTPUT}, batch int").parquet(published)
    return rows.groupBy("entity_id", "kind", "month").agg(F.max_by(F.struct("value", "n_days"), "batch").alias("last")).select("entity_id", "kind", "month", "last.*")
