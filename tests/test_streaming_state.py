"""The stream with keyed state against the batch result, with late, repeated, corrected and out-of-order days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terralog.sources import layers
from terralog.streaming import months

COEF = [0.5, -0.25, 2.0]


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("stream")
    paths = {k: str(tmp / k) for k in ("landing", "published", "checkpoint")}
    r = random.Random(1)
    old = [(e, dt.date(2023, 10, 1) + dt.timedelta(k), float(k % 17), 0) for e in ("a", "b") for k in range(100)]
    archive = spark.createDataFrame(old, months.SCHEMA)
    models = spark.createDataFrame([("a", 1.0, COEF)], "entity_id string, intercept double, coef array<double>")
    start = months.initial(archive, models, 3)
    new = [(e, dt.date(2024, 1, 5) + dt.timedelta(k), r.random(), 1) for e in ("a", "b", "new") for k in range(115)]
    new += [(e, day, r.random(), 2 + k) for k, (e, day, _, _) in enumerate(r.sample(new, 60))]  # corrected days
    new = [x for x in new if x[:2] != ("b", dt.date(2024, 3, 7))]  # a month that never closes
    new += [new[3], new[4], ("a", dt.date(2024, 2, 2), None, 0)]  # repeated rows, and an old null
    late = [x for x in new if x[1] == dt.date(2024, 2, 20)]
    new = [x for x in new if x not in late]
    r.shuffle(new)
    for k, part in enumerate((new[:150], new[150:300], new[300:], late)):
        spark.createDataFrame(part, months.SCHEMA).repartition(2).write.mode("append").parquet(paths["landing"])
        months.run(spark, start=start if k == 0 else start.limit(0), **paths)  # the archive is gone after the first start
    return archive, spark.createDataFrame(new + late, months.SCHEMA), paths


def test_months_equal_the_batch(spark, streamed):
    archive, rows, paths = streamed
    got = {(r.entity_id, r.month): (round(r.value, 9), r.n_days) for r in months.current(spark, paths["published"]).where("kind = 'month'").collect()}
    want = {(r.entity_id, r.month): (round(r["mean"], 9), r.n_days) for r in layers.refreshed_months(archive, rows).collect()}
    assert got == want and len(got) == 3 and ("b", dt.date(2024, 3, 1)) not in got


def test_forecasts_are_of_the_last_versions(spark, streamed):
    archive, rows, paths = streamed
    m = archive.groupBy("entity_id", F.trunc("day", "MM").alias("month")).agg(F.avg("value").alias("v"), F.count("value").alias("n")).where("n >= day(last_day(month))").select("entity_id", "month", "v")
    m = m.unionByName(layers.refreshed_months(archive, rows).select("entity_id", "month", F.col("mean").alias("v")))
    v = {r.month: r.v for r in m.where("entity_id = 'a'").collect()}
    got = {r.month: r.value for r in months.current(spark, paths["published"]).where("kind = 'forecast'").collect()}
    want = {}
    for end in v:
        window = [months._after(end, k) for k in (-2, -1, 0)]
        if end > dt.date(2024, 1, 1) and all(x in v for x in window):
            want[months._after(end, 1)] = 1.0 + sum(a * v[x] for a, x in zip(COEF, window, strict=True))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
