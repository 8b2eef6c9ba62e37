"""Text grids, seasonal tables and JSON payloads as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")


def index_grid(lines: DataFrame, fill: float = -99.0) -> DataFrame:
    """``value`` lines of a year and twelve months: ``month, value``; values at or under ``fill`` and other lines are left out."""
    t = lines.select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") == 13).withColumn("year", F.get("t", F.lit(0)).try_cast("int")).where(F.col("year").between(1800, 2200))
    m = t.select("year", F.posexplode(F.slice("t", 2, 12)).alias("k", "x")).withColumn("value", F.col("x").try_cast("double"))
    return m.where(F.col("value") > fill).select(F.make_date("year", F.col("k") + 1, F.lit(1)).alias("month"), "value")


def index_seasons(lines: DataFrame) -> DataFrame:
    """``value`` lines of season, year, total and anomaly: the season's middle month and the anomaly."""
    t = lines.select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") == 4)
    k = F.array_position(F.array(*map(F.lit, SEASONS)), F.get("t", F.lit(0)))
    r = t.select(k.cast("int").alias("k"), F.get("t", F.lit(1)).try_cast("int").alias("year"), F.get("t", F.lit(3)).try_cast("double").alias("value"))
    return r.where("k > 0 and year is not null and value is not null").select(F.make_date("year", "k", F.lit(1)).alias("month"), "value")


def index_csv(spark: SparkSession, path: str, fill: float = -999.0) -> DataFrame:
    """Two columns, date and value; lines that do not parse and fill values are left out."""
    return spark.read.schema("month date, value double").option("mode", "DROPMALFORMED").csv(path).where((F.col("value") > fill) & F.col("month").isNotNull())


def parallel_arrays(payloads: DataFrame, column: str, time: str, values: list[str]) -> DataFrame:
    """JSON of arrays of equal length as rows: ``day`` and one double for each of ``values``."""
    schema = f"STRUCT<{time}: ARRAY<STRING>, {', '.join(f'{v}: ARRAY<DOUBLE>' for v in values)}>"
    p = payloads.withColumn("p", F.from_json(column, schema))
    keep = [c for c in payloads.columns if c != column]
    rows = p.select(*keep, F.explode(F.arrays_zip(*(F.col(f"p.{c}").alias(c) for c in (time, *values)))).alias("r"))
    return rows.select(*keep, F.to_date(f"r.{time}").alias("day"), *(F.col(f"r.{v}").alias(v) for v in values))


def parameter_maps(payloads: DataFrame, column: str) -> DataFrame:
    """JSON of parameter to day (``yyyyMMdd``) to value as rows: ``parameter, day, value``."""
    keep = [c for c in payloads.columns if c != column]
    a = payloads.select(*keep, F.explode(F.from_json(column, "MAP<STRING, MAP<STRING, DOUBLE>>")).alias("parameter", "days"))
    return a.select(*keep, "parameter", F.explode("days").alias("d", "value")).select(*keep, "parameter", F.try_to_date("d", "yyyyMMdd").alias("day"), "value")


def parameter_months(rows: DataFrame, totals: list[str], fill: float = -999.0) -> DataFrame:
    """Mean or total of each parameter and month, days used and returned; parameters with fill values only are left out."""
    v = F.when(F.col("value") != fill, F.col("value"))
    how = F.when(F.first("parameter").isin(totals), F.sum(v)).otherwise(F.avg(v)) if totals else F.avg(v)
    g = rows.groupBy("entity_id", "parameter", F.trunc("day", "MM").alias("month")).agg(F.round(how, 2).alias("value"), F.count(v).alias("days_used"), F.count(F.lit(1)).alias("days_returned"))
    return g.where("days_used > 0")


def parameter_report(rows: DataFrame, units: dict[str, tuple[str, str]], fill: float = -999.0) -> DataFrame:
    """``entity_id, month, parameter, unit, aggregation, value, days_used, days_returned, available, reason``.

    ``units``: of each parameter its unit and whether its month is a ``mean`` or a ``total``. A parameter without usable
    values in a month has no row; a month without any is one row that is not available, with the reason.
    """
    v = F.when(F.col("value") != fill, F.col("value"))
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for p, u in units.items() for x in (p, u[i]))), F.col("parameter"))
    g = rows.where(F.col("parameter").isin(*units)).groupBy("entity_id", F.trunc("day", "MM").alias("month"), "parameter").agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.count(v).alias("days_used"), F.count(F.lit(1)).alias("days_returned"))
    g = g.select("entity_id", "month", "parameter", of(0).alias("unit"), of(1).alias("aggregation"), "total", "mean", "days_used", "days_returned")
    value = F.round(F.when(F.col("aggregation") == "total", F.col("total")).otherwise(F.col("mean")), 2)
    found = g.where("days_used > 0").select("entity_id", "month", "parameter", "unit", "aggregation", value.alias("value"), "days_used", "days_returned", F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"))
    none = g.groupBy("entity_id", "month").agg(F.sum("days_used").alias("days_used"), F.sum("days_returned").alias("days_returned")).where("days_used = 0")
    return found.unionByName(none.withColumns({"available": F.lit(False), "reason": F.lit("no usable value")}), allowMissingColumns=True)


def price_records(payloads: DataFrame, column: str, most: int = 6) -> DataFrame:
    """JSON with ``records`` of market prices, kept as text; the first ``most`` in their order."""
    schema = "STRUCT<records: ARRAY<STRUCT<market: STRING, district: STRING, modal_price: STRING, min_price: STRING, max_price: STRING, arrival_date: STRING>>>"
    keep = [c for c in payloads.columns if c != column]
    return payloads.select(*keep, F.posexplode(F.slice(F.from_json(column, schema)["records"], 1, most)).alias("place", "r")).select(*keep, "place", "r.*")
