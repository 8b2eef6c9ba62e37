"""Queries of the forecast block over the order tables, with SQL for all but what is fitted by gamma laws and ridge models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralog.operators import backtest, forecast, heat, lagged, series
from terralog.plans import climate
from terralog.plans.climate import index, monthly, rounded
from terralog.sources import files

QUERIES, SQL = {}, {}
LOOKBACK, HORIZON = 12, 3
BASELINE = (1995, 1998)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def splits(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({climate.SPLITS}) AS t({climate.SPLIT_COLUMNS})")


def features(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.frame(monthly(spark, sf), index(spark, sf), splits(spark), BASELINE, 1.5)


FRAME = f"""{climate.M}, {climate.I}, kn AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN month END) {climate.W}) AS m0, min(CASE WHEN value IS NOT NULL THEN month END) {climate.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m1 FROM m),
    mf AS (SELECT kn.entity_id, kn.month, coalesce(kn.value, CASE WHEN datediff('month', m0, kn.month) <= 2 THEN x.value + (y.value - x.value) * datediff('day', m0, kn.month) / datediff('day', m0, m1) END) AS value
        FROM kn LEFT JOIN m x ON x.entity_id = kn.entity_id AND x.month = m0 LEFT JOIN m y ON y.entity_id = kn.entity_id AND y.month = m1), {climate.P.replace(", split_id, CASE", ", split_id, train_lo, train_hi, CASE").replace("FROM m, splits", "FROM mf AS m, splits")},
    qt AS (SELECT split_id, entity_id, quantile_cont(value, 0.25) FILTER (part = 'train') AS a, quantile_cont(value, 0.75) FILTER (part = 'train') AS b FROM p GROUP BY 1, 2),
    md AS (SELECT p.*, a, b, (SELECT quantile_cont(x.value, 0.5) FROM mf x WHERE x.entity_id = p.entity_id AND x.month < p.month AND x.month >= p.month - INTERVAL 12 MONTH) AS med FROM p JOIN qt USING (split_id, entity_id)),
    cl AS (SELECT split_id, entity_id, month, part, train_lo, train_hi, CASE WHEN (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AND med IS NOT NULL THEN med ELSE value END AS value FROM md),
    bl AS (SELECT split_id, entity_id, month(month) AS k, avg(value) AS baseline FROM cl WHERE year(month) BETWEEN greatest(1995, train_lo) AND least(1998, train_hi) GROUP BY 1, 2, 3),
    ft AS (SELECT cl.split_id, cl.entity_id, cl.month, part, cl.value, baseline, cl.value - baseline AS anomaly, lag(cl.value, 1) OVER w AS value_lag1, lag(cl.value, 3) OVER w AS value_lag3, lag(cl.value, 6) OVER w AS value_lag6, lag(cl.value, 12) OVER w AS value_lag12,
        avg(cl.value) OVER (w ROWS 2 PRECEDING) AS roll3_mean, sum(cl.value) OVER (w ROWS 11 PRECEDING) AS roll12_sum, CASE WHEN count(cl.value) OVER (w ROWS 2 PRECEDING) = 3 THEN sum(cl.value) OVER (w ROWS 2 PRECEDING) END AS roll3_sum, idx.value AS index_value
        FROM cl LEFT JOIN bl ON bl.split_id = cl.split_id AND bl.entity_id = cl.entity_id AND k = month(cl.month) LEFT JOIN idx ON idx.month = cl.month WINDOW w AS (PARTITION BY cl.split_id, cl.entity_id ORDER BY cl.month)),
    fr AS (SELECT * FROM ft WHERE value IS NOT NULL AND anomaly IS NOT NULL AND value_lag12 IS NOT NULL AND roll3_sum IS NOT NULL AND index_value IS NOT NULL)"""
NUMBERS = "value baseline anomaly value_lag1 value_lag3 value_lag6 value_lag12 roll3_mean roll12_sum roll3_sum index_value".split()


@query(f"WITH {FRAME} SELECT split_id, entity_id, month, part, {', '.join(f'round({c}, 2) + 0 AS {c}' for c in NUMBERS)} FROM fr")
def forecast_frame(spark: SparkSession, sf: str) -> DataFrame:
    f = features(spark, sf)
    return f.select("split_id", "entity_id", "month", "part", *((F.round(c, 2) + 0.0).alias(c) for c in NUMBERS))


@query(f"""WITH {FRAME}, lw AS (SELECT split_id, entity_id, month, count(*) OVER (w ROWS 11 PRECEDING) AS n, first(value) OVER (w ROWS 11 PRECEDING) AS first_x, last(index_value) OVER (w ROWS 11 PRECEDING) AS last_x, sum(value + index_value) OVER (w ROWS 11 PRECEDING) AS sum_x
        FROM fr WINDOW w AS (PARTITION BY split_id, entity_id ORDER BY month))
    SELECT split_id, entity_id, month AS anchor, round(first_x, 2) AS first_x, round(last_x, 2) AS last_x, round(sum_x, 2) AS sum_x FROM lw WHERE n = 12 QUALIFY row_number() OVER (PARTITION BY split_id, entity_id ORDER BY month DESC) = 1""")
def forecast_latest_window(spark: SparkSession, sf: str) -> DataFrame:
    w = forecast.latest_windows(features(spark, sf), ["value", "index_value"], LOOKBACK)
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return w.select("split_id", "entity_id", "anchor", F.round(F.get("x", F.lit(0)), 2).alias("first_x"), F.round(F.element_at("x", -1), 2).alias("last_x"), F.round(total, 2).alias("sum_x"))


#: Rows of the experiment grid: which features, and how many months a window has.
LOOKBACKS = (6, 12, 24)
FEATURE_SETS = {"all": forecast.SCALED, "without index": [f for f in forecast.SCALED if f != "index_value_scaled"]}
PRODUCTION = "A"


def grid(spark: SparkSession, sets: dict[str, list[str]], lookbacks: tuple[int, ...]) -> DataFrame:
    rows = [(name, features, k) for name, features in sets.items() for k in lookbacks]
    return spark.createDataFrame(rows, "feature_set string, features array<string>, lookback int")


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return files.stored(forecast.prepared(features(spark, sf)))


CELL = ["split_id", "entity_id", "feature_set", "lookback"]


def grid_scores(rows: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Scores of every cell of the grid on validation and test rows, by horizon: one pass over the rows fits and applies all."""
    cells = lagged.experiments(rows, grid(rows.sparkSession, sets, LOOKBACKS))
    p = lagged.predictions(rows, cells, forecast.SCALED, forecast.TARGET, HORIZON)
    return files.stored(backtest.scores(backtest.with_climatology(p, rows, forecast.TARGET), ["part", *CELL]).where("horizon is not null"))


def chosen(scores: DataFrame) -> DataFrame:
    """``entity_id, feature_set, horizon, lookback, val_skill``: the lookback of best mean validation skill over the splits.

    Means over fewer splits, where a long lookback leaves no windows, are not compared with those over all.
    """
    keys = ["entity_id", "feature_set", "horizon"]
    v = scores.where("part = 'val'").groupBy(*keys, "lookback").agg(F.round(F.avg("skill"), 4).alias("val_skill"), F.count("skill").alias("n"))
    v = v.withColumn("most", F.max("n").over(Window.partitionBy(*keys))).where("n = most").drop("n", "most")
    return backtest.select_best(v, keys, "val_skill", "lookback")


def tested(scores: DataFrame) -> DataFrame:
    """Test scores of the chosen lookbacks."""
    return scores.where("part = 'test'").join(chosen(scores), ["entity_id", "feature_set", "horizon", "lookback"])


SUMS = ["value", "index_value", "one"]


@query(f"""WITH {FRAME}, q AS (SELECT split_id, entity_id, month, row_number() OVER (PARTITION BY split_id, entity_id ORDER BY month) AS place,
        [{{'name': 'value', 'v': round(value / 1e6, 4)}}, {{'name': 'index_value', 'v': index_value}}, {{'name': 'one', 'v': 1.0}}] AS f FROM fr),
    ab AS (SELECT a.split_id, a.entity_id, year(a.month)::INTEGER AS year, lag::INTEGER AS lag, unnest(a.f) AS x, b.f AS g
        FROM q a, range(0, 6) AS lags(lag), q b WHERE b.split_id = a.split_id AND b.entity_id = a.entity_id AND b.place = a.place + lag),
    pairs AS (SELECT split_id, entity_id, year, lag, x, unnest(g) AS y FROM ab)
    SELECT split_id, entity_id, year, lag, x.name AS earlier, y.name AS later, count(*) AS n, round(sum(x.v * y.v), 8) + 0 AS total
    FROM pairs GROUP BY ALL""")
def forecast_lagged_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of products of each year's rows with those up to five months later, of which any window set's moments consist."""
    f = features(spark, sf).withColumns({"one": F.lit(1.0), "value": F.round(F.col("value") / 1e6, 4)})
    s = lagged.lagged_sums(f, SUMS, 6)
    return s.withColumn("total", F.round("total", 8) + 0.0)


@query()
def backtest_ridge_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The vote of the splits on ridge models of the lookback that validation chose, an entity and horizon.

    No SQL, here and below: gamma laws and ridge models, which are tested against plain versions.
    """
    t = tested(grid_scores(prepared(spark, sf), {"all": FEATURE_SETS["all"]}))
    return backtest.votes(t, ["entity_id", "horizon", "lookback", "val_skill"])


@query()
def backtest_ridge_index_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index is adopted, where both feature sets have the lookback that suits them best on validation rows."""
    t = tested(grid_scores(prepared(spark, sf), FEATURE_SETS))
    keys = ["entity_id", "horizon"]
    of = lambda name: t.where(F.col("feature_set") == name)
    lookback = t.groupBy(*keys).agg(*(F.min(F.when(F.col("feature_set") == n, F.col("lookback"))).alias(c) for n, c in (("all", "lookback_with"), ("without index", "lookback_without"))))
    return backtest.adopt(of("without index"), of("all"), keys).join(lookback, keys)


def methods(rows: DataFrame) -> DataFrame:
    """Test scores by split of models of each horizon (of the chosen lookback) and of chained forecasts, on the same targets."""
    of_each = tested(grid_scores(rows, {"all": FEATURE_SETS["all"]})).withColumn("method", F.lit("direct"))
    one = lagged.models(rows, lagged.experiments(rows, grid(rows.sparkSession, {"all": FEATURE_SETS["all"]}, (LOOKBACK,))), forecast.SCALED, forecast.TARGET, 1)
    chain = backtest.with_climatology(forecast.recursive(rows, one, LOOKBACK, HORIZON), rows, forecast.TARGET)
    c = backtest.scores(chain, ["split_id", "entity_id"]).where("horizon > 1").withColumns({"method": F.lit("recursive"), "lookback": F.lit(LOOKBACK)})
    columns = ["split_id", "entity_id", "horizon", "method", "lookback", "rmse", "skill", "skill_persistence"]
    return files.stored(of_each.select(columns).unionByName(c.select(columns)))


def winners(scores: DataFrame) -> DataFrame:
    """``entity_id, horizon, method, lookback`` with the mean skill over the splits, and whether the method is taken."""
    m = scores.groupBy("entity_id", "horizon", "method", "lookback").agg(F.count(F.lit(1)).alias("n_splits"), F.round(F.avg("skill"), 4).alias("mean_skill"), F.count_if(F.col("skill_persistence") > 0).alias("n_beats_persistence"))
    best = Window.partitionBy("entity_id", "horizon").orderBy(F.desc_nulls_last("mean_skill"), F.desc("method"))
    return m.withColumn("taken", F.row_number().over(best) == 1)


@query()
def forecast_recursive_or_direct(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of chained forecasts and of a model for each horizon on the test rows, and which of them is taken.

    The lookback of a horizon's own model is the one of best validation skill; the next month is always forecast directly.
    """
    return winners(methods(prepared(spark, sf)))


def manifest(rows: DataFrame) -> DataFrame:
    """The winner of each entity and horizon with its production model: coefficients fitted on the production split."""
    scores = methods(rows)
    won = winners(scores).where("taken").drop("taken", "n_splits", "n_beats_persistence")
    rmse = scores.where(F.col("split_id") == PRODUCTION).select("entity_id", "horizon", "method", F.round("rmse", 4).alias("rmse"))
    spark = rows.sparkSession
    own = rows.where(F.col("split_id") == PRODUCTION)
    fitted = lagged.models(own, lagged.experiments(own, grid(spark, {"all": FEATURE_SETS["all"]}, LOOKBACKS)), forecast.SCALED, forecast.TARGET, HORIZON)
    model = fitted.select("split_id", "entity_id", F.col("horizon").alias("model_horizon"), "lookback", "alpha", "intercept", "coef")
    won = won.withColumn("model_horizon", F.when(F.col("method") == "recursive", F.lit(1)).otherwise(F.col("horizon")))  # a chain feeds the model of the next month
    joined = won.join(rmse, ["entity_id", "horizon", "method"], "left").join(model, ["entity_id", "model_horizon", "lookback"], "left")
    return joined.withColumnRenamed("mean_skill", "skill").withColumn("label", backtest.label(F.col("skill")))


@query()
def forecast_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Method, lookback, skill, error, label, penalty and coefficients of what is used for each entity and horizon."""
    m = manifest(prepared(spark, sf))
    places = {"intercept": F.round("intercept", 6), "coef": F.transform("coef", lambda c: F.round(c, 6))}
    return m.withColumns(places).drop("split_id", "model_horizon")


@query()
def forecast_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The forecast of every entity from its latest window in the production split, with the skill of each horizon.

    Each horizon has its own model, of the lookback of best validation skill.
    """
    rows = prepared(spark, sf)
    scores = tested(grid_scores(rows, {"all": FEATURE_SETS["all"]}))
    skill = scores.groupBy("entity_id", "horizon", "lookback").agg(F.round(F.avg("skill"), 4).alias("skill"))
    own = rows.where(F.col("split_id") == PRODUCTION)
    fitted = lagged.models(own, lagged.experiments(own, grid(spark, {"all": FEATURE_SETS["all"]}, LOOKBACKS)), forecast.SCALED, forecast.TARGET, HORIZON)
    used = fitted.join(skill.select("entity_id", "horizon", "lookback"), ["entity_id", "horizon", "lookback"], "left_semi")
    labels = skill.select("entity_id", "horizon", "skill", backtest.label(F.col("skill")).alias("label"))
    longest = F.max("lookback").over(Window.partitionBy("entity_id"))
    latest = [forecast.latest_windows(own.join(used.withColumn("longest", longest).where(F.col("longest") == k).select("entity_id").distinct(), "entity_id", "left_semi"), forecast.SCALED, k) for k in LOOKBACKS]
    return rounded(forecast.forecasts(reduce(DataFrame.unionByName, latest), used, labels), 4)


HEAT_TARGETS = ("anomaly", "extreme", "heat_days")
HEAT = ["own", "own_lag1", "own_lag12", "own_mean3", "month_sin", "month_cos", "index_value"]
DRYNESS = ["spi", "spi_lag1", "spi_lag3"]


def heat_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly heat series of each nation in the splits: standardised mean and hottest day, and the count of heat days."""
    return heat.targets(climate.daily(spark, sf), climate.hot_days(spark, sf), splits(spark), index(spark, sf))


@query(f"""WITH {climate.FLAGS}, c AS (SELECT entity_id, date_trunc('month', day)::DATE AS month, avg(value) AS mean_value, max(value) AS max_value, count_if(heat_day)::DOUBLE AS heat_days FROM r GROUP BY 1, 2),
    {climate.I}, sp AS (SELECT * FROM ({climate.SPLITS}) AS t({climate.SPLIT_COLUMNS})),
    cm AS (SELECT split_id, entity_id, month(month) AS k, avg(mean_value) AS mu, stddev_samp(mean_value) AS sd FROM c, sp WHERE year(month) BETWEEN train_lo AND train_hi GROUP BY 1, 2, 3),
    cd AS (SELECT split_id, entity_id, month(day) AS k, avg(value) AS mu, stddev_samp(value) AS sd FROM d, sp WHERE year(day) BETWEEN train_lo AND train_hi GROUP BY 1, 2, 3)
    SELECT sp.split_id, c.entity_id, c.month,
           CASE WHEN year(c.month) BETWEEN train_lo AND train_hi THEN 'train' WHEN year(c.month) BETWEEN val_lo AND val_hi THEN 'val' WHEN year(c.month) BETWEEN test_lo AND test_hi THEN 'test' END AS part,
           round((mean_value - cm.mu) / nullif(cm.sd, 0), 4) + 0 AS anomaly, round((max_value - cd.mu) / nullif(cd.sd, 0), 4) + 0 AS extreme, heat_days, idx.value AS index_value
    FROM c CROSS JOIN sp LEFT JOIN cm ON cm.split_id = sp.split_id AND cm.entity_id = c.entity_id AND cm.k = month(c.month)
         LEFT JOIN cd ON cd.split_id = sp.split_id AND cd.entity_id = c.entity_id AND cd.k = month(c.month) LEFT JOIN idx ON idx.month = c.month""")
def heat_target_frame(spark: SparkSession, sf: str) -> DataFrame:
    t = heat_targets(spark, sf)
    return t.withColumns({c: F.round(c, 4) + 0.0 for c in ("anomaly", "extreme")})


HEAT_KEYS = ("split_id", "entity_id", "target")


def heat_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The heat series in long form, a series a target: its own history, season and index, the dryness index and its lags."""
    w = Window.partitionBy("split_id", "entity_id").orderBy("month")
    dry = prepared(spark, sf).select("split_id", "entity_id", "month", "spi").withColumns({f"spi_lag{k}": F.lag("spi", k).over(w) for k in (1, 3)})
    t = heat_targets(spark, sf).join(dry, ["split_id", "entity_id", "month"], "left")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("target"), F.col(c).alias("own")) for c in HEAT_TARGETS))).alias("series")
    long = t.select("split_id", "entity_id", "month", "part", "index_value", *DRYNESS, each).select("*", "series.*").drop("series")
    w = Window.partitionBy(*HEAT_KEYS).orderBy("month")
    long = long.withColumns({"own_lag1": F.lag("own", 1).over(w), "own_lag12": F.lag("own", 12).over(w), "own_mean3": F.avg("own").over(w.rowsBetween(-2, 0))})
    long = series.season(long.na.drop(subset=["own", "own_lag12", "index_value"]))
    return files.stored(series.scaled(long, HEAT + DRYNESS, HEAT_KEYS))


@query()
def heat_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Three targets, two sets of features, three lookbacks: the lookback of best validation skill, its test skill, counts cut at 0.

    A cell whose features are missing in part of the rows uses the windows that have them all.
    """
    s = heat_rows(spark, sf)
    of = lambda names: [f"{c}_scaled" for c in names]
    cells = lagged.experiments(s, grid(spark, {"heat": of(HEAT), "heat and dryness": of(HEAT + DRYNESS)}, LOOKBACKS), HEAT_KEYS)
    p = lagged.predictions(s, cells, of(HEAT + DRYNESS), "own", HORIZON, joint=True, keys=HEAT_KEYS)
    p = p.withColumn("pred", F.when(F.col("target") == "heat_days", F.greatest("pred", F.lit(0.0))).otherwise(F.col("pred")))
    keys = [*HEAT_KEYS, "feature_set", "lookback"]
    m = files.stored(backtest.scores(backtest.with_climatology(p, s, "own", HEAT_KEYS), ["part", *keys]))
    best = backtest.select_best(m.where("part = 'val' and horizon is null").select(*keys, F.col("skill").alias("val_skill")), keys[:-1], "val_skill", "lookback")
    test = m.where("part = 'test' and horizon is not null").select(*keys, "horizon", "n", F.round("rmse", 4).alias("rmse"), "skill", "skill_persistence").join(best, keys)
    return test.withColumn("label", backtest.label(F.col("skill")))
