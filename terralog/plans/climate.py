"""Queries of the series, heat, index and back-test operators over the order tables, with their SQL.

Entities are nations. The monthly series is the sum of order prices, the daily one the largest line price of a day in
thousands; the index is the market-wide monthly total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.operators import backtest, heat, series, spi

QUERIES, SQL = {}, {}
SPLITS = "VALUES ('A', 1995, 1998, 1999, 1999, 2000, 2001), ('B', 1995, 1997, 1998, 1998, 1999, 1999), ('C', 1995, 1996, 1997, 1997, 1998, 1998), ('D', 1995, 1997, 1998, 1999, 2000, 2000)"
SPLIT_COLUMNS = "split_id, train_lo, train_hi, val_lo, val_hi, test_lo, test_hi"
HEAT = {"hot": 97.0, "warm": 90.0, "dep": 12.0, "severe": 102.0, "severe_dep": 16.0}
LOOKBACKS = (6, 12, 24)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = series.resample(rows.select(F.col("n_name").alias("entity_id"), "o_orderdate", "o_totalprice"), "o_orderdate", "o_totalprice")
    return series.densify(m.select("entity_id", "month", F.round("value_sum", 2).alias("value")))


def parts_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums of all lines by part brand; months without lines are 0."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = series.resample(rows.select(F.col("p_brand").alias("entity_id"), "l_shipdate", "l_extendedprice"), "l_shipdate", "l_extendedprice")
    return series.densify(m.select("entity_id", "month", F.round("value_sum", 2).alias("value"))).withColumn("value", F.coalesce("value", F.lit(0.0)))


def brand_sizes_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums of all lines by part brand and size, which are sparse at small scale; months without lines are 0."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = series.resample(rows.select(F.concat_ws(" ", "p_brand", "p_size").alias("entity_id"), "l_shipdate", "l_extendedprice"), "l_shipdate", "l_extendedprice")
    return series.densify(m.select("entity_id", "month", F.round("value_sum", 2).alias("value"))).withColumn("value", F.coalesce("value", F.lit(0.0)))


def customers_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums of each customer's orders; months without orders have no row."""
    m = series.resample(table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), "o_orderdate", "o_totalprice"), "o_orderdate", "o_totalprice")
    return m.select("entity_id", "month", F.round("value_sum", 2).alias("value"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("entity_id"), F.to_date("l_shipdate").alias("day")).agg((F.max("l_extendedprice") / 1000).alias("value"))


def index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.round(F.sum("o_totalprice") / 1e6, 4).alias("value"))


def parted(frame: DataFrame) -> DataFrame:
    return series.with_parts(frame, frame.sparkSession.sql(f"SELECT * FROM ({SPLITS}) AS t({SPLIT_COLUMNS})"))


M = """
    raw AS (SELECT n_name AS entity_id, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS value
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    grid AS (SELECT entity_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM raw GROUP BY 1),
    m AS (SELECT entity_id, month, value FROM grid LEFT JOIN raw USING (entity_id, month))"""
B = """
    raw AS (SELECT p_brand AS entity_id, date_trunc('month', l_shipdate)::DATE AS month, round(sum(l_extendedprice), 2) AS value
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    grid AS (SELECT entity_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM raw GROUP BY 1),
    m AS (SELECT entity_id, month, coalesce(value, 0.0) AS value FROM grid LEFT JOIN raw USING (entity_id, month))"""
BS = B.replace("p_brand AS entity_id", "concat_ws(' ', p_brand, p_size) AS entity_id")
C = """
    raw AS (SELECT o_custkey AS entity_id, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
    grid AS (SELECT entity_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM raw GROUP BY 1),
    m AS (SELECT entity_id, month, value FROM grid LEFT JOIN raw USING (entity_id, month))"""
D = """
    d AS (SELECT n_name AS entity_id, l_shipdate::DATE AS day, max(l_extendedprice) / 1000 AS value
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""
I = "idx AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice) / 1e6, 4) AS value FROM orders GROUP BY 1)"  # noqa: E741
P = f"""
    splits AS (SELECT * FROM ({SPLITS}) AS t({SPLIT_COLUMNS})),
    p AS (SELECT m.*, split_id, CASE WHEN year(month) BETWEEN train_lo AND train_hi THEN 'train' WHEN year(month) BETWEEN val_lo AND val_hi THEN 'val'
                 WHEN year(month) BETWEEN test_lo AND test_hi THEN 'test' END AS part FROM m, splits)"""
W = "OVER (PARTITION BY entity_id ORDER BY month"


@query(f"""WITH {M}, b AS (SELECT entity_id, month(month) AS k, avg(value) AS baseline FROM m WHERE year(month) BETWEEN 1995 AND 1998 GROUP BY 1, 2)
    SELECT entity_id, month, value, round(CASE WHEN count(value) {W} ROWS 2 PRECEDING) >= 3 THEN sum(value) {W} ROWS 2 PRECEDING) END, 4) AS roll3_sum,
           round(baseline, 4) AS baseline, round(value - baseline, 4) AS anomaly FROM m LEFT JOIN b USING (entity_id) WHERE b.k = month(month)""")
def series_monthly_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    m = monthly(spark, sf).withColumn("roll3_sum", series.trailing("value", 3, F.sum, 3))
    return rounded(series.anomaly(m, "value", 1995, 1998).select("entity_id", "month", "value", "roll3_sum", "baseline", "anomaly"))


@query(f"""WITH {M} SELECT entity_id, month, value, lag(value, 1) {W}) AS value_lag1, lag(value, 3) {W}) AS value_lag3, lag(value, 6) {W}) AS value_lag6, lag(value, 12) {W}) AS value_lag12,
    round(avg(value) {W} ROWS 2 PRECEDING), 4) AS roll3_mean, round(sum(value) {W} ROWS 11 PRECEDING), 4) AS roll12_sum,
    round(sin(2 * pi() * month(month) / 12), 4) + 0 AS month_sin, round(cos(2 * pi() * month(month) / 12), 4) + 0 AS month_cos FROM m""")
def series_lags_and_trailing(spark: SparkSession, sf: str) -> DataFrame:
    m = series.season(series.lags(monthly(spark, sf), "value"))
    return rounded(m.withColumn("roll3_mean", series.trailing("value", 3, F.avg)).withColumn("roll12_sum", series.trailing("value", 12, F.sum)))


def priorities_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums of all orders by nation, market segment and priority; months without orders are null."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = series.resample(rows.select(F.concat_ws(" ", "c_nationkey", "c_mktsegment", "o_orderpriority").alias("entity_id"), "o_orderdate", "o_totalprice"), "o_orderdate", "o_totalprice")
    return series.densify(m.select("entity_id", "month", F.round("value_sum", 2).alias("value")))


O = C.replace("o_custkey AS entity_id", "concat_ws(' ', c_nationkey, c_mktsegment, o_orderpriority) AS entity_id").replace("FROM orders GROUP BY 1, 2)", "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)")  # noqa: E741
GAPS = "g AS (SELECT * FROM m)"


@query(f"""WITH {O}, {GAPS}, k AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN month END) {W}) AS m0, min(CASE WHEN value IS NOT NULL THEN month END) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m1 FROM g)
    SELECT k.entity_id, k.month, k.value, round(coalesce(k.value, CASE WHEN datediff('month', m0, k.month) <= 2 THEN a.value + (b.value - a.value) * datediff('day', m0, k.month) / datediff('day', m0, m1) END), 4) AS filled
    FROM k LEFT JOIN g a ON a.entity_id = k.entity_id AND a.month = m0 LEFT JOIN g b ON b.entity_id = k.entity_id AND b.month = m1""")
def series_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.interpolated(priorities_monthly(spark, sf), "value"))


@query(SQL["series_interpolated"].replace(O, C))
def series_interpolated_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, by customer, with the gaps that these series have."""
    return rounded(series.dense_interpolated(customers_monthly(spark, sf), "value"))


@query(f"""WITH {B}, q AS (SELECT entity_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM m WHERE year(month) BETWEEN 1995 AND 1998 GROUP BY 1),
    w AS (SELECT *, (SELECT quantile_cont(x.value, 0.5) FROM m x WHERE x.entity_id = m.entity_id AND x.month < m.month AND x.month >= m.month - INTERVAL 12 MONTH) AS med FROM m JOIN q USING (entity_id))
    SELECT entity_id, month, value, coalesce((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AND med IS NOT NULL, false) AS replaced,
           round(CASE WHEN (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AND med IS NOT NULL THEN med ELSE value END, 4) AS cleaned FROM w""")
def series_causal_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.causal_outliers(parts_monthly(spark, sf), "value", 1995, 1998, 1.5))


@query(SQL["series_causal_outliers"].replace(B, BS))
def series_causal_outliers_whole(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.causal_outliers(brand_sizes_monthly(spark, sf), "value", 1995, 1998, 1.5))


@query(f"""WITH {M}, {P} SELECT split_id, entity_id, month(month) AS cal_month, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(value) AS n_train FROM p WHERE part = 'train' GROUP BY 1, 2, 3""")
def series_month_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.month_stats(parted(monthly(spark, sf)), "value"))


@query(f"""WITH {M}, {P}, s AS (SELECT split_id, entity_id, month(month) AS k, avg(value) AS mean, stddev_samp(value) AS std FROM p WHERE part = 'train' GROUP BY 1, 2, 3)
    SELECT p.split_id, p.entity_id, month, part, round((value - mean) / nullif(std, 0), 4) AS z FROM p LEFT JOIN s ON s.split_id = p.split_id AND s.entity_id = p.entity_id AND k = month(month)""")
def series_standardised(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.standardised(parted(monthly(spark, sf)), "value").select("split_id", "entity_id", "month", "part", "z"))


@query(f"""WITH {M}, {P}, s AS (SELECT split_id, entity_id, min(value) AS lo, max(value) AS hi FROM p WHERE part = 'train' GROUP BY 1, 2)
    SELECT split_id, entity_id, month, part, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4) AS value_scaled FROM p LEFT JOIN s USING (split_id, entity_id)""")
def series_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.scaled(parted(monthly(spark, sf)), ["value"]).select("split_id", "entity_id", "month", "part", "value_scaled"))


@query(f"""WITH {D} SELECT entity_id, date_trunc('month', day)::DATE AS month, count(DISTINCT day) AS n_days, count(DISTINCT day) >= day(last_day(date_trunc('month', day)::DATE)) AS complete FROM d WHERE value IS NOT NULL GROUP BY entity_id, date_trunc('month', day)""")
def series_complete_months(spark: SparkSession, sf: str) -> DataFrame:
    return series.complete_months(daily(spark, sf))


@query(f"""WITH {M}, {I} SELECT m.entity_id, m.month, m.value, a.value AS index_value, b.value AS index_lag1 FROM m LEFT JOIN idx a ON a.month = m.month LEFT JOIN idx b ON b.month = m.month - INTERVAL 1 MONTH""")
def series_index_join(spark: SparkSession, sf: str) -> DataFrame:
    return series.attach_index(monthly(spark, sf), index(spark, sf)).select("entity_id", "month", "value", "index_value", "index_lag1")


@query(f"""WITH {M}, {I}, e AS (SELECT entity_id, max(month) AS series_end, (SELECT max(month) FROM idx) AS index_end FROM m GROUP BY 1)
    SELECT *, least(series_end, index_end) AS anchor, ((2002 - year(least(series_end, index_end))) * 12 + 1 - month(least(series_end, index_end)))::INT AS months_behind,
           CASE WHEN index_end < series_end THEN 'index' WHEN index_end > series_end THEN 'series' ELSE 'both' END AS limited_by FROM e""")
def series_currency(spark: SparkSession, sf: str) -> DataFrame:
    return series.currency(monthly(spark, sf), index(spark, sf), "2002-01-15")


@query(f"""WITH {M}, {I}, j AS (SELECT m.entity_id, m.month, m.value, idx.value AS index_value FROM m JOIN idx USING (month) WHERE m.value IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY value) + (count(*) OVER (PARTITION BY entity_id, value) - 1) / 2 AS ra, rank() OVER (PARTITION BY entity_id ORDER BY index_value) + (count(*) OVER (PARTITION BY entity_id, index_value) - 1) / 2 AS rb FROM j)
    SELECT entity_id, round(corr(value, index_value), 4) AS pearson, round(corr(value, index_value) FILTER (year(month) BETWEEN 1995 AND 1998), 4) AS pearson_train, round(corr(ra, rb), 4) AS spearman, round(stddev_samp(value), 2) AS std_value, round(stddev_samp(index_value), 2) AS std_index, count(*) AS n FROM r GROUP BY 1""")
def series_index_correlation(spark: SparkSession, sf: str) -> DataFrame:
    j = series.attach_index(monthly(spark, sf), index(spark, sf)).where("index_value is not null")
    c = series.correlations(j, "value", "index_value", 1995, 1998)
    return c.select("entity_id", *(F.round(x, 4).alias(x) for x in ("pearson", "pearson_train", "spearman")), F.round("std_a", 2).alias("std_value"), F.round("std_b", 2).alias("std_index"), "n")


NORMALS = f"""{D}, y AS (SELECT entity_id, dayofyear(day) AS doy, sum(value) AS s, count(value) AS n FROM d WHERE year(day) BETWEEN 1995 AND 1998 GROUP BY 1, 2),
    nm AS (SELECT y.entity_id, (doy - 1 + k + 366) % 366 + 1 AS doy, sum(s) / sum(n) AS normal, sum(n)::BIGINT AS n_pooled FROM y, (SELECT unnest(range(-7, 8)) AS k) GROUP BY 1, 2)"""
FLAGS = f"""{NORMALS}, f0 AS (SELECT d.*, value - normal AS departure FROM d LEFT JOIN nm ON nm.entity_id = d.entity_id AND nm.doy = dayofyear(day)),
    f AS (SELECT *, value >= {HEAT["hot"]} OR (value >= {HEAT["warm"]} AND coalesce(departure >= {HEAT["dep"]}, false)) AS heat_day, value >= {HEAT["severe"]} OR (value >= {HEAT["warm"]} AND coalesce(departure >= {HEAT["severe_dep"]}, false)) AS severe_day FROM f0),
    r0 AS (SELECT *, CASE WHEN lag(heat_day) OVER w IS NULL OR lag(heat_day) OVER w <> heat_day OR datediff('day', lag(day) OVER w, day) > 1 THEN 1 ELSE 0 END AS new_run FROM f WINDOW w AS (PARTITION BY entity_id ORDER BY day)),
    r1 AS (SELECT *, sum(new_run) OVER (PARTITION BY entity_id ORDER BY day) AS run FROM r0),
    r AS (SELECT *, heat_day AND count(*) OVER (PARTITION BY entity_id, run) >= 2 AS in_spell FROM r1)"""


def hot_days(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    return heat.spells(heat.flagged(d, heat.normals(d, 1995, 1998), **HEAT))


@query(f"WITH {NORMALS} SELECT entity_id, doy::INT AS doy, round(normal, 8) AS normal, n_pooled FROM nm")
def heat_normals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(heat.normals(daily(spark, sf), 1995, 1998), 8)


@query(f"WITH {FLAGS} SELECT entity_id, day, value, round(departure, 8) AS departure, heat_day, severe_day, in_spell FROM r")
def heat_flags_and_spells(spark: SparkSession, sf: str) -> DataFrame:
    return hot_days(spark, sf).select("entity_id", "day", "value", F.round("departure", 8).alias("departure"), "heat_day", "severe_day", "in_spell")


@query(f"""WITH {FLAGS} SELECT entity_id, date_trunc('month', day)::DATE AS month, count_if(heat_day)::BIGINT AS heat_days, count_if(severe_day)::BIGINT AS severe_days, count_if(in_spell)::BIGINT AS spell_days,
    round(max(value), 8) AS max_value, count_if(in_spell) > 0 AS had_spell, round(avg(departure), 8) AS mean_departure FROM r GROUP BY 1, 2""")
def heat_monthly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(heat.monthly_counts(hot_days(spark, sf)), 8)


@query(f"""WITH {M}, {P}, s AS (SELECT split_id, entity_id, month(month) AS k, avg(value) AS mean, stddev_samp(value) AS std FROM p WHERE part = 'train' GROUP BY 1, 2, 3),
    t AS (SELECT p.split_id, p.entity_id, (value - mean) / nullif(std, 0) AS z FROM p JOIN s ON s.split_id = p.split_id AND s.entity_id = p.entity_id AND k = month(month) WHERE part = 'train'),
    a AS (SELECT split_id, entity_id, count(z) AS n, avg(z) AS mean, stddev_samp(z) AS std, min(z) AS lo, max(z) AS hi, (avg(z ** 3) - 3 * avg(z) * avg(z ** 2) + 2 * avg(z) ** 3) / var_pop(z) ** 1.5 AS skew, kurtosis_pop(z) AS kurtosis,
          quantile_cont(z, [0.05, 0.25, 0.75, 0.95]) AS q FROM t WHERE z IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT *, greatest(abs(q[1] + 1.6448536269514722), abs(q[2] + 0.6744897501960817), abs(q[3] - 0.6744897501960817), abs(q[4] - 1.6448536269514722)) AS gap FROM a)
    SELECT split_id, entity_id, n, round(mean, 3) + 0 AS mean, round(std, 3) AS std, round(lo, 3) AS lo, round(hi, 3) AS hi, round(skew, 3) + 0 AS skew, round(kurtosis, 2) AS kurtosis, round(q[1], 3) AS p05, round(q[2], 3) AS p25, round(q[3], 3) AS p75, round(q[4], 3) AS p95,
           round(gap, 3) AS largest_gap, abs(skew) < 0.5 AND abs(kurtosis) < 1 AS approximately_normal, abs(skew) < 0.5 AND abs(kurtosis) < 1 AND abs(mean) < 0.25 AND std > 0.75 AND std < 1.33 AS approximately_standard_normal FROM g""")
def heat_distribution_check(spark: SparkSession, sf: str) -> DataFrame:
    d = heat.distribution(series.standardised(parted(monthly(spark, sf)), "value"), "z")
    d = rounded(d.withColumn("kurtosis", F.round("kurtosis", 2)), 3)
    return d.withColumns({c: F.col(c) + 0.0 for c in ("mean", "skew")})


@query(f"""WITH {B}, {P} SELECT split_id, entity_id, count(value) AS n, round(avg((value = 0)::INT), 4) AS zero_share, round(avg(value), 4) AS mean, round(avg((value = 0)::INT) FILTER (month(month) IN (4, 5, 6)), 4) AS zero_share_cut,
    round(avg(value) FILTER (month(month) IN (4, 5, 6)), 4) AS mean_cut, max(value) AS most FROM p WHERE part = 'train' GROUP BY 1, 2""")
def heat_zero_inflation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(heat.zero_inflation(parted(parts_monthly(spark, sf)), "value"))


@query(SQL["heat_zero_inflation"].replace(B, BS))
def heat_zero_inflation_whole(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(heat.zero_inflation(parted(brand_sizes_monthly(spark, sf)), "value"))


@query(f"""WITH {FLAGS}, c AS (SELECT entity_id, date_trunc('month', day)::DATE AS month, count_if(heat_day)::BIGINT AS heat_days, count_if(severe_day)::BIGINT AS severe_days, count_if(in_spell) > 0 AS had_spell, max(value) AS max_value FROM r GROUP BY 1, 2),
    s AS (SELECT entity_id, min(month) AS a, max(month) AS b FROM c GROUP BY 1),
    q AS (SELECT n_name AS entity_id, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN DATE '1997-06-01' ELSE DATE '2031-01-01' END AS month FROM nation)
    SELECT q.entity_id, coalesce(q.month, b) AS month, heat_days, severe_days, had_spell, round(max_value, 1) AS max_value, false AS forecast_available,
           CASE WHEN heat_days IS NULL THEN 'no record; available ' || strftime(a, '%Y-%m') || ' to ' || strftime(b, '%Y-%m') END AS reason
    FROM q LEFT JOIN s USING (entity_id) LEFT JOIN c ON c.entity_id = q.entity_id AND c.month = coalesce(q.month, b)""")
def heat_month_record(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey") % 3
    asked = table(spark, sf, "nation").select(F.col("n_name").alias("entity_id"), F.when(n == 1, "1997-06").when(n == 2, "2031-01").alias("month"))
    return heat.month_record(heat.monthly_counts(hot_days(spark, sf)), asked)


@query(f"""WITH {B}, {P} SELECT split_id, entity_id, month(month) AS cal_month, count(value) AS n_train, round(avg((value = 0)::INT), 4) AS q,
    round(avg(value) FILTER (value > 0), 4) AS mean_pos, round(avg(ln(value)) FILTER (value > 0), 4) AS mean_log FROM (SELECT *, CASE WHEN value > 0 THEN value END AS vp FROM p) WHERE part = 'train' GROUP BY 1, 2, 3""".replace("avg(ln(value)) FILTER (value > 0)", "avg(ln(vp))"))
def spi_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spi.statistics(parted(parts_monthly(spark, sf)), "value"))


@query(SQL["spi_statistics"].replace(B, BS))
def spi_statistics_whole(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spi.statistics(parted(brand_sizes_monthly(spark, sf)), "value"))


@query()
def spi_scores(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: DuckDB has no incomplete gamma function. Tested against tabulated values and by the way back."""
    s = spi.restored(spi.scored(parted(monthly(spark, sf)), "value"))
    return s.select("split_id", "entity_id", "month", "part", "value", F.round("spi", 4).alias("spi"), F.round("restored", 2).alias("restored"))


@query(f"""WITH {M}, {P}, t AS (SELECT *, lead(value, 1) OVER w AS y1, lead(value, 2) OVER w AS y2, lead(value, 3) OVER w AS y3, lead(part, 1) OVER w AS p1, lead(part, 2) OVER w AS p2, lead(part, 3) OVER w AS p3,
        count(value) OVER (w ROWS 5 PRECEDING) AS nx, sum(value) OVER (w ROWS 5 PRECEDING) AS sx, first(value) OVER (w ROWS 5 PRECEDING) AS x0, count_if(part = 'train') OVER (w ROWS 5 PRECEDING) AS nt FROM p WINDOW w AS (PARTITION BY split_id, entity_id ORDER BY month))
    SELECT split_id, entity_id, month AS window_end, p1 AS part, round(x0, 2) AS first_x, round(sx, 2) AS sum_x, round(y1, 2) AS y1, round(y3, 2) AS y3 FROM t
    WHERE nx = 6 AND y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL AND p1 = p2 AND p2 = p3 AND (p1 <> 'train' OR nt = 6)""")
def backtest_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = backtest.windows(parted(monthly(spark, sf)), ["value"], "value", 6, 3)
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return w.select("split_id", "entity_id", "window_end", "part", F.round(F.col("x")[0], 2).alias("first_x"), F.round(total, 2).alias("sum_x"), F.round(F.col("y")[0], 2).alias("y1"), F.round(F.col("y")[2], 2).alias("y3"))


def ridge_predictions(spark: SparkSession, sf: str, features: list[str]) -> DataFrame:
    frame = series.lags(series.season(series.attach_index(monthly(spark, sf), index(spark, sf))), "value", (12,))
    p = series.scaled(parted(frame.na.drop(subset=["value_lag12"])), ["value", "index_value"])
    scaled_parts = p.withColumn("target", F.col("value_scaled"))
    return backtest.with_climatology(backtest.ridge(backtest.windows(scaled_parts, features, "target", 12, 3)), scaled_parts, "target")


@query()
def backtest_ridge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: one ridge model an entity and split. Tested against the normal equations."""
    t = ridge_predictions(spark, sf, ["value_scaled", "month_sin", "month_cos"])
    return rounded(backtest.scores(t.where("part = 'test'"), ["split_id", "entity_id"]))


@query()
def backtest_ridge_index_adoption(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index, as a further feature, is adopted for an entity and horizon."""
    plain, more = (backtest.scores(ridge_predictions(spark, sf, f).where("part = 'test'"), ["split_id", "entity_id"]).where("horizon is not null") for f in (["value_scaled"], ["value_scaled", "index_value_scaled"]))
    return backtest.adopt(plain, more, ["entity_id", "horizon"])


T = f"""{M}, {P}, t0 AS (SELECT split_id, entity_id, value AS persistence, month, k AS lookback, value, part,
        CASE k WHEN 6 THEN CASE WHEN count(value) OVER (w ROWS 5 PRECEDING) = 6 THEN avg(value) OVER (w ROWS 5 PRECEDING) END WHEN 12 THEN CASE WHEN count(value) OVER (w ROWS 11 PRECEDING) = 12 THEN avg(value) OVER (w ROWS 11 PRECEDING) END
               ELSE CASE WHEN count(value) OVER (w ROWS 23 PRECEDING) = 24 THEN avg(value) OVER (w ROWS 23 PRECEDING) END END AS pred
        FROM p, (VALUES (6), (12), (24)) AS ks(k) WINDOW w AS (PARTITION BY split_id, entity_id, k ORDER BY month)),
    t AS (SELECT a.split_id, a.entity_id, a.persistence, a.lookback, a.pred, h AS horizon, b.value AS y, b.part, b.month AS target_month
          FROM t0 a, (VALUES (1), (2), (3)) AS hs(h), p b WHERE b.split_id = a.split_id AND b.entity_id = a.entity_id AND b.month = a.month + to_months(h) AND pred IS NOT NULL AND b.value IS NOT NULL AND b.part IS NOT NULL),
    c AS (SELECT split_id, entity_id, month(month) AS k, avg(value) AS climatology FROM p WHERE part = 'train' GROUP BY 1, 2, 3),
    u AS (SELECT t.*, climatology FROM t LEFT JOIN c ON c.split_id = t.split_id AND c.entity_id = t.entity_id AND c.k = month(target_month)),
    s AS (SELECT part, split_id, entity_id, lookback, horizon, count(*) AS n, sqrt(avg((y - pred) ** 2)) AS rmse, avg(abs(y - pred)) AS mae, sqrt(avg((y - climatology) ** 2)) AS rmse_climatology, sqrt(avg((y - persistence) ** 2)) AS rmse_persistence, 1 - sum((y - pred) ** 2) / nullif(var_pop(y) * count(y), 0) AS r2
          FROM u GROUP BY GROUPING SETS ((part, split_id, entity_id, lookback, horizon), (part, split_id, entity_id, lookback))),
    sc AS (SELECT *, round(1 - rmse / nullif(rmse_climatology, 0), 4) + 0 AS skill, round(1 - rmse / nullif(rmse_persistence, 0), 4) + 0 AS skill_persistence FROM s)"""


def trailing_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = parted(monthly(spark, sf))
    return backtest.scores(backtest.with_climatology(backtest.trailing_mean_forecasts(p, "value", LOOKBACKS, 3), p, "value"), ["part", "split_id", "entity_id", "lookback"])


@query(f"WITH {T} SELECT part, split_id, entity_id, lookback, horizon, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(rmse_climatology, 4) AS rmse_climatology, round(rmse_persistence, 4) AS rmse_persistence, round(r2, 4) AS r2, skill, skill_persistence, CASE WHEN skill >= 0.1 THEN 'validated' WHEN skill > 0 THEN 'weak/directional' ELSE 'no skill' END AS label FROM sc")
def backtest_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trailing_scores(spark, sf)).withColumn("label", backtest.label(F.col("skill")))


BEST = f"""{T}, v AS (SELECT entity_id, horizon, lookback, round(avg(skill), 6) AS mean_skill FROM sc WHERE part = 'val' AND horizon IS NOT NULL GROUP BY 1, 2, 3),
    best AS (SELECT entity_id, horizon, lookback, mean_skill AS val_skill FROM v QUALIFY row_number() OVER (PARTITION BY entity_id, horizon ORDER BY mean_skill DESC NULLS LAST, lookback) = 1)"""


def selected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = trailing_scores(spark, sf).where("horizon is not null")
    v = s.where("part = 'val'").groupBy("entity_id", "horizon", "lookback").agg(F.round(F.avg("skill"), 6).alias("val_skill"))
    return s, backtest.select_best(v, ["entity_id", "horizon"], "val_skill", "lookback")


@query(f"WITH {BEST} SELECT * FROM best")
def backtest_lookback_selection(spark: SparkSession, sf: str) -> DataFrame:
    return selected(spark, sf)[1]


@query(f"""WITH {BEST} SELECT entity_id, horizon, lookback, round(avg(skill), 6) AS mean_skill, min(skill) AS worst, max(skill) AS best, count_if(skill > 0)::BIGINT AS n_positive, count_if(skill_persistence > 0)::BIGINT AS n_beats_persistence, count_if(skill > 0) >= 3 AS replicated,
    coalesce(string_agg(split_id, ',' ORDER BY split_id) FILTER (skill > 0), '') AS positive_in FROM sc JOIN best USING (entity_id, horizon, lookback) WHERE part = 'test' GROUP BY 1, 2, 3""")
def backtest_votes(spark: SparkSession, sf: str) -> DataFrame:
    s, best = selected(spark, sf)
    return backtest.votes(s.where("part = 'test'").join(best.drop("val_skill"), ["entity_id", "horizon", "lookback"]), ["entity_id", "horizon", "lookback"])


@query(f"""WITH {BEST}, t2 AS (SELECT entity_id, horizon, lookback, round(avg(skill), 6) AS skill, round(avg(rmse), 4) AS rmse FROM sc JOIN best USING (entity_id, horizon, lookback) WHERE part = 'test' GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN skill >= 0.1 THEN 'validated' WHEN skill > 0 THEN 'weak/directional' ELSE 'no skill' END AS label FROM t2""")
def backtest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    s, best = selected(spark, sf)
    t = s.where("part = 'test'").join(best.drop("val_skill"), ["entity_id", "horizon", "lookback"]).groupBy("entity_id", "horizon", "lookback").agg(F.round(F.avg("skill"), 6).alias("skill"), F.round(F.avg("rmse"), 4).alias("rmse"))
    return t.withColumn("label", backtest.label(F.col("skill")))


@query(f"""WITH {T}, a AS (SELECT split_id, entity_id, horizon, skill FROM sc WHERE part = 'test' AND horizon IS NOT NULL AND lookback = 6), b AS (SELECT split_id, entity_id, horizon, skill FROM sc WHERE part = 'test' AND horizon IS NOT NULL AND lookback = 24)
    SELECT entity_id, horizon, round(avg(b.skill - a.skill), 6) AS mean_change, count_if(b.skill > a.skill)::BIGINT AS n_better, avg(b.skill - a.skill) > 0 AND count_if(b.skill > a.skill) >= 3 AS adopted FROM a JOIN b USING (split_id, entity_id, horizon) GROUP BY 1, 2""")
def backtest_adoption(spark: SparkSession, sf: str) -> DataFrame:
    s = trailing_scores(spark, sf).where("part = 'test' and horizon is not null")
    return backtest.adopt(s.where("lookback = 6"), s.where("lookback = 24"), ["entity_id", "horizon"])
