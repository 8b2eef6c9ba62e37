"""Queries of the guards, the refresh and availability tables, and the evaluation summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.operators import backtest, corpus, grounding, quality, retrieval, series
from terralog.plans import climate, evidence
from terralog.plans.climate import M, P, monthly, parted, rounded, table
from terralog.sources import files, layers

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, count(*) AS n_rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1")
def guard_unknown_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the table of labels does not know."""
    return quality.unknown_keys(table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels"), "doc_id")


@query(f"WITH {M} SELECT entity_id, min(month) AS first_month, max(month) AS last_month, min(month) <= DATE '1995-01-01' AND max(month) >= DATE '2001-08-01' AS covers FROM m GROUP BY 1")
def guard_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.coverage(monthly(spark, sf), "1995-01-01", "2001-08-01")


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums of the lines of each nation's suppliers that were returned."""
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("entity_id"), F.trunc("l_shipdate", "MM").alias("month")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


SHIPPED = """sh AS (SELECT n_name AS entity_id, date_trunc('month', l_shipdate)::DATE AS month, round(sum(l_extendedprice), 2) AS value
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"""
OVERLAP = f"""{M}, {SHIPPED}, j AS (SELECT m.entity_id, m.month, sh.month IS NOT NULL AS hit, min(sh.month) OVER (PARTITION BY m.entity_id) AS lo, max(sh.month) OVER (PARTITION BY m.entity_id) AS hi FROM m LEFT JOIN sh ON sh.entity_id = m.entity_id AND sh.month = m.month),
    ov AS (SELECT entity_id, lo, hi, count(*) AS n, count_if(hit)::BIGINT AS n_matched, count_if(NOT hit AND coalesce(month BETWEEN lo AND hi, false))::BIGINT AS n_gaps FROM j GROUP BY 1, 2, 3),
    acc AS (SELECT *, n_matched >= 0.9 * n AND n_gaps = 0 AS accepted FROM ov)"""


@query(f"WITH {OVERLAP} SELECT * FROM acc")
def guard_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return quality.overlap(monthly(spark, sf), shipped(spark, sf))


@query(f"""WITH {OVERLAP}, k AS (SELECT m.*, sh.value AS other FROM m JOIN acc ON acc.entity_id = m.entity_id AND accepted AND m.month BETWEEN lo AND hi LEFT JOIN sh ON sh.entity_id = m.entity_id AND sh.month = m.month)
    SELECT entity_id, month, value, other, lag(other, 1) OVER w AS other_lag1, lag(other, 3) OVER w AS other_lag3 FROM k WINDOW w AS (PARTITION BY entity_id ORDER BY month)""")
def series_attached(spark: SparkSession, sf: str) -> DataFrame:
    return quality.attached(monthly(spark, sf), shipped(spark, sf), "other")


@query("""WITH s AS (SELECT DISTINCT n_name AS entity_id, date_trunc('month', l_shipdate)::DATE AS month FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    i AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE o_totalprice IS NOT NULL)
    SELECT entity_id, count(*) AS n_missing, min(month) AS first_missing, max(month) AS last_missing FROM s WHERE month NOT IN (SELECT month FROM i) GROUP BY 1""")
def guard_index_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Months of the nations' shipments for which the index of orders has no value: the last ones, after the last order."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    shipments = rows.select(F.col("n_name").alias("entity_id"), F.trunc("l_shipdate", "MM").alias("month")).distinct()
    index = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum("o_totalprice").alias("value"))
    return quality.index_gaps(shipments, index)


@query(f"""WITH {M}, {P}, f AS (SELECT split_id, entity_id, month(month) AS k, avg(value) FILTER (part = 'train') AS mean, avg(value) AS every FROM p GROUP BY 1, 2, 3)
    SELECT split_id, entity_id, 0.0::DOUBLE AS from_train, round(max(abs(mean - every)), 2) AS from_all FROM f WHERE mean IS NOT NULL GROUP BY 1, 2""")
def guard_train_only(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.train_only(parted(monthly(spark, sf)), "value"), 2)


@query(f"WITH {M} SELECT entity_id, count(*) AS n_rows, 0::BIGINT AS n_changed FROM m WHERE month < DATE '2000-01-01' GROUP BY 1")
def guard_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """Lags, trailing values and filled gaps do not change when the years from 2000 on are taken away."""
    made = lambda f: series.lags(f, "value").withColumn("roll3", series.trailing("value", 3, F.avg)).withColumn("roll12", series.trailing("value", 12, F.sum))
    return quality.truncation(monthly(spark, sf), "2000-01-01", made, ["value_lag1", "value_lag3", "value_lag6", "value_lag12", "roll3", "roll12"])


WINDOWS = f"""{M}, {P}, tw AS (SELECT *, lead(value, 1) OVER w AS y1, lead(value, 2) OVER w AS y2, lead(value, 3) OVER w AS y3, lead(part, 1) OVER w AS p1, lead(part, 2) OVER w AS p2, lead(part, 3) OVER w AS p3, lead(month, 1) OVER w AS t1, lead(month, 2) OVER w AS t2, lead(month, 3) OVER w AS t3,
        count(value) OVER (w ROWS 5 PRECEDING) AS nx, first(month) OVER (w ROWS 5 PRECEDING) AS m0, count_if(part = 'train') OVER (w ROWS 5 PRECEDING) AS nt FROM p WINDOW w AS (PARTITION BY split_id, entity_id ORDER BY month)),
    win AS (SELECT * FROM tw WHERE nx = 6 AND y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL AND p1 = p2 AND p2 = p3 AND (p1 <> 'train' OR nt = 6))"""


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.windows(parted(monthly(spark, sf)), ["value"], "value", 6, 3)


@query(f"WITH {WINDOWS} SELECT split_id, entity_id, count(*) AS n_windows, count_if(month >= t1)::BIGINT AS n_late, count_if(datediff('month', m0, month) <> 5)::BIGINT AS n_broken FROM win GROUP BY 1, 2")
def guard_window_order(spark: SparkSession, sf: str) -> DataFrame:
    return quality.window_order(windows(spark, sf), 6)


@query(f"""WITH {WINDOWS}, u AS (SELECT DISTINCT split_id, entity_id, p1 AS part, unnest([t1, t2, t3]) AS month FROM win), c AS (SELECT split_id, entity_id, month, count(*) AS n FROM u GROUP BY 1, 2, 3)
    SELECT split_id, entity_id, count(*) AS n_targets, count_if(n > 1)::BIGINT AS n_shared FROM c GROUP BY 1, 2""")
def guard_disjoint_targets(spark: SparkSession, sf: str) -> DataFrame:
    return quality.shared_targets(windows(spark, sf))


@query(f"""WITH e AS (SELECT entity_id, day, round(value, 4) AS value, seq FROM ({evidence.DAYS})), a AS (SELECT * FROM e WHERE day <= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY entity_id, day ORDER BY seq DESC) = 1)
    SELECT entity_id, count(*) AS n_archive, count_if(day >= DATE '2024-01-18')::BIGINT AS n_superseded, 0::BIGINT AS n_lost FROM a GROUP BY 1""")
def guard_archive_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    archive, recent = evidence.event_layers(spark, sf)
    archive = layers.latest(archive, ["entity_id", "day"], ["seq"])
    return quality.unchanged(archive, layers.live(archive, recent, ["entity_id", "day"], ["seq"]), recent, ["entity_id", "day"])


ORDER_DAYS = "od AS (SELECT o_orderpriority AS entity_id, o_orderdate::DATE AS day FROM orders WHERE o_totalprice IS NOT NULL)"


@query(f"""WITH {ORDER_DAYS}, e AS (SELECT entity_id, max(day) AS last_day FROM od WHERE day <= DATE '2001-04-10' AND entity_id <> '5-LOW' GROUP BY 1),
    n AS (SELECT DISTINCT od.entity_id, day, last_day FROM od LEFT JOIN e ON e.entity_id = od.entity_id WHERE day > DATE '2001-04-01' AND (last_day IS NULL OR day > last_day)),
    m AS (SELECT entity_id, date_trunc('month', day)::DATE AS month, count(*) AS n_days, max(last_day) AS last_day FROM n GROUP BY 1, 2),
    f AS (SELECT *, last_day IS NULL OR month > date_trunc('month', last_day) AS later, n_days >= day(last_day(month)) AS full_month FROM m),
    s AS (SELECT entity_id, sum(n_days)::BIGINT AS n_new_days, count_if(later AND full_month)::BIGINT AS n_complete, coalesce(string_agg(strftime(month, '%Y-%m'), ',' ORDER BY month) FILTER (later AND NOT full_month), '') AS dropped FROM f GROUP BY 1)
    SELECT coalesce(e.entity_id, s.entity_id) AS entity_id, coalesce(n_new_days, 0) AS n_new_days, coalesce(n_complete, 0) AS n_complete, coalesce(dropped, '') AS dropped,
           CASE WHEN e.entity_id IS NULL THEN 'no archive' WHEN coalesce(n_complete, 0) > 0 THEN 'refreshed' WHEN coalesce(n_new_days, 0) > 0 THEN 'incomplete' ELSE 'current' END AS status FROM e FULL JOIN s ON s.entity_id = e.entity_id""")
def source_refresh_status(spark: SparkSession, sf: str) -> DataFrame:
    """Days with orders of each priority: an archive up to 2001-04-10 for all but one, and recent days from 2001-04-02 on."""
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("entity_id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))
    return quality.refresh_status(d.where("day <= date'2001-04-10' and entity_id <> '5-LOW'"), d.where("day > date'2001-04-01'"))


@query("""WITH f AS (SELECT d.doc_id, lang AS group_id, e.vec_id IS NOT NULL AS found, list_sum(list_transform(embedding, lambda x: x * x)) > 0 AS ok FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
    j AS (SELECT doc_id, group_id, found AND coalesce(ok, false) AS available, CASE WHEN NOT found THEN 'not found' WHEN NOT coalesce(ok, false) THEN 'zero vector' END AS reason FROM f)
    SELECT group_id, doc_id, available, reason, bool_or(NOT available) OVER (PARTITION BY group_id) AS any_unavailable FROM j""")
def source_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its vector or the reason why there is none, and whether its language lacks any."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("group_id"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), (norm > 0).alias("ok"))
    return quality.availability(d, v, "doc_id", F.col("ok"), F.lit("zero vector"))


@query("""WITH c AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS called FROM conversations GROUP BY 1), e AS (SELECT *, list_sort(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(called, x))) AS missing FROM c)
    SELECT conv_id, array_to_string(called, ',') AS called, array_to_string(missing, ',') AS missing, len(missing) = 0 AS all_called FROM e""")
def evaluation_expected_called(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a conversation has all roles that are expected of it."""
    expected = F.array(*map(F.lit, ("assistant", "system", "user")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("called"))
    missing = F.array_sort(F.array_except(expected, "called"))
    return c.select("conv_id", F.array_join("called", ",").alias("called"), F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("all_called"))


CHECKED = f"WITH {evidence.DOCS}, nxt AS (SELECT report_id - 1 AS report_id, raw FROM docs), {evidence.claims_sql('c', 'docs', 'raw')}, {evidence.hits_sql('c', 'nxt', 'c.report_id = s.report_id')}, {evidence.SUMMED}, k AS (SELECT report_id, {evidence.STATUS} FROM docs LEFT JOIN n USING (report_id) LEFT JOIN bad USING (report_id))"


@query(f"""{CHECKED} SELECT lang, count(*) AS n_items, count_if(n_checked > 0)::BIGINT AS n_judged, round(avg(1 - n_unverified / n_checked) FILTER (n_checked > 0), 4) AS mean_faithfulness, sum(n_unverified)::BIGINT AS n_unsupported,
    coalesce(bool_and(n_unverified = 0) FILTER (n_checked > 0), true) AS all_supported FROM k JOIN documents ON doc_id = report_id GROUP BY 1""".replace("1 - n_unverified / n_checked", "CASE WHEN n_checked > 0 THEN 1 - n_unverified / n_checked END"))
def grounding_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of judged reports, by language: the share of their numbers that a source has."""
    k = evidence.grounding_check(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), "lang"), "report_id")
    judged = F.col("n_checked") > 0
    faithful = F.when(judged, 1 - F.try_divide("n_unverified", "n_checked"))
    return k.groupBy("lang").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(judged).alias("n_judged"), F.round(F.avg(faithful), 4).alias("mean_faithfulness"), F.sum("n_unverified").alias("n_unsupported"), F.coalesce(F.bool_and(F.when(judged, F.col("n_unverified") == 0)), F.lit(True)).alias("all_supported"))


@query(f"{CHECKED} SELECT k.report_id, unverified, substring(raw, 1, 1200) AS excerpt FROM k JOIN docs USING (report_id) WHERE status = 'warning'")
def grounding_failures(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a failure log: reports that are not grounded, their offending numbers, and the start of the text."""
    bad = evidence.grounding_check(spark, sf).where("status = 'warning'").select("report_id", "unverified")
    return bad.join(table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), F.substring("text", 1, 1200).alias("excerpt")), "report_id")


@query(f"""WITH {evidence.DOCS}, nxt AS (SELECT report_id - 1 AS report_id, raw FROM docs WHERE length(raw) >= 500), {evidence.claims_sql('c', 'docs', 'raw')}, {evidence.hits_sql('c', 'nxt', 'c.report_id = s.report_id')}, {evidence.SUMMED}
    SELECT report_id, {evidence.STATUS} FROM docs LEFT JOIN n USING (report_id) LEFT JOIN bad USING (report_id)""")
def grounding_available_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Only sources that are available count: here those of at least 500 characters."""
    claims, sources = evidence.reports(spark, sf)
    return grounding.check(claims, sources.where(F.length("text") >= 500), "report_id", "text").drop("n_source_numbers")


@query("SELECT lang, source, count(*) AS n_documents, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.length("text")).alias("chars"))


KEYWORDS = "the|und|que|les"


@query(rf"""WITH c AS (SELECT doc_id, text, substring(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), 1, 1500) AS opening, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS lines FROM documents),
    k AS (SELECT *, list_filter(lines, lambda x: length(x) > 40 AND regexp_matches(x, '(?i)(^|[^\p{{L}}])({KEYWORDS})($|[^\p{{L}}])')) AS marked, list_filter(lines, lambda x: length(x) > 120)[1:2] AS long_lines FROM c),
    e AS (SELECT *, coalesce(array_to_string(CASE WHEN len(marked) > 0 THEN marked ELSE long_lines END, ' '), '') AS excerpt FROM k)
    SELECT doc_id, opening, excerpt, length(opening) >= 100 AS available FROM e""")
def corpus_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.excerpts(table(spark, sf, "documents"), "doc_id", "text", KEYWORDS)


@query("""SELECT event_id, try_cast(props->>'k' AS BIGINT) AS k, event_id % 3 = 0 AS parse_failed FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props FROM events)""")
def corpus_recovered_json(spark: SparkSession, sf: str) -> DataFrame:
    """An object out of prose and a code fence; every third text has only the start of one, which does not parse."""
    e = table(spark, sf, "events")
    broken = F.concat(F.lit("Sorry: "), F.rtrim("props", F.lit("}")))
    text = F.when(F.col("event_id") % 3 == 0, broken).otherwise(F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nas asked")))
    return corpus.recovered_json(e.select("event_id", text.alias("text")), "text", "k LONG").select("event_id", "value.k", "parse_failed")


RANKED = evidence.RANKED.replace("FROM q, embeddings e WHERE vec_id <> query_id", "FROM q, embeddings e WHERE vec_id <> query_id AND e.label IN (1, 2, 3)")


@query(f"WITH {RANKED} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def retrieval_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Only vectors of some types are ranked; the filter stands before the search, at the scan."""
    v = table(spark, sf, "embeddings")
    return retrieval.top_k(v.where("vec_id % 50 = 0"), retrieval.of_types(v, "label", [1, 2, 3]), 5)


HEAT_MEANS = f"{climate.D}, hm AS (SELECT entity_id, date_trunc('month', day)::DATE AS month, round(avg(value), 6) AS value FROM d GROUP BY 1, 2), gh AS (SELECT entity_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM hm GROUP BY 1), h AS (SELECT entity_id, month, value FROM gh LEFT JOIN hm USING (entity_id, month))"


@query(f"""WITH {HEAT_MEANS} SELECT entity_id, month, value, {", ".join(f"lag(value, {k}) OVER w AS value_lag{k}" for k in (1, 2, 3, 12))}, round(avg(value) OVER (w ROWS 2 PRECEDING), 3) AS roll3_mean, round(avg(value) OVER (w ROWS 5 PRECEDING), 3) AS roll6_mean
    FROM h WINDOW w AS (PARTITION BY entity_id ORDER BY month)""")
def heat_lags_and_means(spark: SparkSession, sf: str) -> DataFrame:
    m = series.resample(climate.daily(spark, sf), "day", "value").select("entity_id", "month", F.round("value_mean", 6).alias("value"))
    f = series.lags(series.densify(m), "value", (1, 2, 3, 12))
    return f.withColumn("roll3_mean", F.round(series.trailing("value", 3, F.avg), 3)).withColumn("roll6_mean", F.round(series.trailing("value", 6, F.avg), 3))


@query(f"WITH s AS (SELECT * FROM ({climate.SPLITS}) AS t({climate.SPLIT_COLUMNS})) SELECT split_id, greatest(1996, train_lo)::INT AS baseline_lo, least(1999, train_hi)::INT AS baseline_hi, count(*) FILTER (year(o_orderdate) BETWEEN greatest(1996, train_lo) AND least(1999, train_hi)) AS n_orders FROM s, orders GROUP BY ALL")
def series_clipped_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline years 1996 to 1999 within each split's train years, and the orders in them."""
    s = series.clipped_baseline(spark.sql(f"SELECT * FROM ({climate.SPLITS}) AS t({climate.SPLIT_COLUMNS})"), 1996, 1999)
    by_year = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    j = s.join(by_year, F.col("year").between(F.col("baseline_lo"), F.col("baseline_hi")))
    return j.groupBy("split_id", "baseline_lo", "baseline_hi").agg(F.sum("n").alias("n_orders"))


@query("SELECT n_name AS entity_id, l_shipdate::DATE AS day, max(l_extendedprice) FILTER (l_returnflag = 'R') AS returned, max(l_extendedprice) FILTER (l_returnflag = 'A') AS accepted FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2 HAVING returned IS NOT NULL OR accepted IS NOT NULL")
def series_nonempty_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days that have at least one of two values."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    price = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    d = rows.groupBy(F.col("n_name").alias("entity_id"), F.to_date("l_shipdate").alias("day")).agg(price("R").alias("returned"), price("A").alias("accepted"))
    return d.na.drop("all", subset=["returned", "accepted"])


@query(f"""WITH {climate.T}, cut AS (SELECT u.*, 'pre-monsoon' AS cut FROM u WHERE month(target_month) IN (4, 5, 6) UNION ALL SELECT u.*, 'winter' FROM u WHERE month(target_month) IN (12, 1, 2) UNION ALL SELECT u.*, 'May 2000' FROM u WHERE target_month = DATE '2000-05-01')
    SELECT cut, entity_id, lookback, count(*) AS n, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse, round(1 - sqrt(avg((y - pred) ** 2)) / nullif(sqrt(avg((y - climatology) ** 2)), 0), 4) + 0 AS skill FROM cut WHERE part = 'test' GROUP BY ALL""")
def backtest_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of test forecasts over cuts of the target months, all in one pass."""
    p = parted(monthly(spark, sf))
    t = backtest.with_climatology(backtest.trailing_mean_forecasts(p, "value", climate.LOOKBACKS, 3), p, "value").where("part = 'test'")
    cuts = {"pre-monsoon": F.month("target_month").isin(4, 5, 6), "winter": F.month("target_month").isin(12, 1, 2), "May 2000": F.col("target_month") == F.lit("2000-05-01").cast("date")}
    s = backtest.cut_scores(t, ["entity_id", "lookback"], cuts)
    return rounded(s).withColumn("skill", F.col("skill") + 0.0)


@query(f"WITH {climate.T} SELECT split_id, entity_id, lookback, count(*) AS n, round(avg((y - climatology) ** 2), 2) AS climatology_mse FROM u WHERE part = 'val' GROUP BY ALL")
def backtest_climatology_mse(spark: SparkSession, sf: str) -> DataFrame:
    p = parted(monthly(spark, sf))
    t = backtest.with_climatology(backtest.trailing_mean_forecasts(p, "value", climate.LOOKBACKS, 3), p, "value")
    return rounded(backtest.climatology_mse(t, ["split_id", "entity_id", "lookback"]), 2)


@query(f"""WITH {climate.T} SELECT entity_id, lookback, {", ".join(f"round(avg(skill) FILTER (horizon = {h}), 6) AS t{h}" for h in (1, 2, 3))}, round(avg(skill) FILTER (horizon IS NULL), 6) AS averaged FROM sc WHERE part = 'test' GROUP BY 1, 2""")
def backtest_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Models side by side: mean test skill over the splits, a column a horizon."""
    s = climate.trailing_scores(spark, sf).where("part = 'test'")
    return backtest.comparison(s, ["entity_id", "lookback"], (1, 2, 3))


@query(f"""WITH {climate.T}, c2 AS (SELECT entity_id, lookback, horizon, round(avg(skill), 6) AS skill FROM sc WHERE part = 'test' AND horizon IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY skill DESC, lookback, horizon) = 1)
    SELECT entity_id, lookback, horizon, skill, CASE WHEN skill >= 0.1 THEN 'useful' WHEN skill > 0 THEN 'weak' ELSE 'no better than climatology' END AS verdict FROM b""")
def backtest_best_cell(spark: SparkSession, sf: str) -> DataFrame:
    s = climate.trailing_scores(spark, sf).where("part = 'test' and horizon is not null").groupBy("entity_id", "lookback", "horizon").agg(F.round(F.avg("skill"), 6).alias("skill"))
    return backtest.best_cell(s, ["entity_id"], ["lookback", "horizon"])


TREND = f"""{climate.BS}, lg AS (SELECT entity_id, month, 2 * value - lag(value, 1) {climate.W}) AS raw, lead(value, 1) {climate.W}) AS y FROM m), tr AS (SELECT * FROM lg WHERE raw IS NOT NULL AND y IS NOT NULL)"""


@query(f"WITH {TREND} SELECT entity_id, count(*) AS n, round(avg((raw < 0)::INT), 4) AS negative_share, round(min(raw), 4) AS most_negative, round(sqrt(avg((y - raw) ** 2)), 4) AS rmse, round(sqrt(avg((y - greatest(raw, 0)) ** 2)), 4) AS rmse_clipped FROM tr GROUP BY 1")
def backtest_clipping(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of sums by their trend, which may be negative, and what cutting them at 0 does."""
    w = series.by_month()
    t = climate.brand_sizes_monthly(spark, sf).select("entity_id", "month", (2 * F.col("value") - F.lag("value", 1).over(w)).alias("pred"), F.lead("value", 1).over(w).alias("y"))
    return rounded(backtest.clipping(t.where("pred is not null and y is not null"), ["entity_id"]))


@query("""WITH raw AS (SELECT o_custkey::VARCHAR AS entity_id, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
    SELECT entity_id, month, value FROM raw WHERE entity_id IN (SELECT c_custkey::VARCHAR FROM customer ORDER BY c_custkey LIMIT 20)""")
def source_archive_entities(spark: SparkSession, sf: str) -> DataFrame:
    """All customers' months are written as an archive in buckets; those of twenty customers are read from their buckets."""
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("entity_id"), F.trunc("o_orderdate", "MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    path = files.work_folder(spark, "archive")
    files.write_archive(m, path)
    wanted = [str(r[0]) for r in table(spark, sf, "customer").select("c_custkey").orderBy("c_custkey").limit(20).collect()]
    return files.read_archive(spark, path, "entity_id STRING, month DATE, value DOUBLE", wanted)


@query("SELECT doc_id, lang, text FROM documents")
def source_chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON lines, read back."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = files.work_folder(spark, "lines")
    files.write_lines(d, path)
    return files.read_lines(spark, path, d.schema)


@query()
def corpus_section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the sections of pages. No SQL: long sections are cut by sentences. Tested against its rules."""
    marked = F.regexp_replace(F.regexp_replace("html", "<h([1-3])[^>]*>", "\n# "), "</h[1-3]>", "\n")
    return corpus.section_chunks(table(spark, sf, "pages").select("page_id", marked.alias("text")), "page_id")


@query()
def corpus_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the chunks, by language. No SQL, as chunks have none."""
    d = table(spark, sf, "documents")
    return corpus.invariants(corpus.chunks(d, "doc_id").join(d.select("doc_id", F.col("lang").alias("type")), "doc_id"), "doc_id", "type")
