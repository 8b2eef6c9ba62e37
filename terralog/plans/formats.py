"""Queries of the parsers and files: payloads and files are made from the given tables, read back, and held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralog.operators import corpus, quality, quantiles
from terralog.plans.climate import table
from terralog.sources import files, payloads, versions

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def monthly_index(spark: SparkSession, sf: str) -> DataFrame:
    """``month, value``: all orders of a month in millions, with two decimals."""
    return table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.round(F.sum("o_totalprice") / 1e6, 2).cast("decimal(18,2)").alias("value"))


INDEX = "idx AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice) / 1e6, 2)::DECIMAL(18, 2) AS value FROM orders GROUP BY 1)"


@query(f"WITH {INDEX} SELECT month, value::DOUBLE AS value FROM idx")
def source_index_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of years and months as text lines, with a header and fill values, and back."""
    i = monthly_index(spark, sf).withColumns({"year": F.year("month"), "k": F.month("month")})
    cell = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("value"))).cast("string"), F.lit("-99.90"))
    years = i.groupBy("year").agg(*(cell(k).alias(f"m{k}") for k in range(1, 13)))
    lines = years.select(F.concat_ws("   ", F.concat(F.lit(" "), "year"), *(f"m{k}" for k in range(1, 13))).alias("value"))
    header = i.agg(F.concat_ws(" ", F.min("year"), F.max("year")).alias("value"))
    return payloads.index_grid(header.unionByName(lines).unionByName(header.select(F.lit("-99.9").alias("value"))))


@query(f"""WITH {INDEX}, s AS (SELECT month, sum(value) OVER w AS total, count(*) OVER w AS n FROM idx WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT month, round((total - 100)::DOUBLE, 2) AS value FROM s WHERE n = 3""")
def source_index_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """Three-month seasons as text lines of season, year, total and anomaly, and back."""
    w = Window.orderBy("month").rowsBetween(-1, 1)  # an index has a row a month
    s = monthly_index(spark, sf).select("month", F.sum("value").over(w).alias("total"), F.count("value").over(w).alias("n")).where("n = 3")
    name = F.element_at(F.array(*map(F.lit, payloads.SEASONS)), F.month("month"))
    lines = s.select(F.concat_ws("  ", name, F.year("month").cast("string"), F.col("total").cast("string"), (F.col("total") - 100).cast("string")).alias("value"))
    return payloads.index_seasons(lines.unionByName(lines.limit(1).select(F.lit("SEAS YR TOTAL ANOM").alias("value"))))


@query(f"WITH {INDEX} SELECT month, value::DOUBLE AS value FROM idx WHERE month(month) <> 2")
def source_index_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The index as a CSV file with a header, fill values for each February and a broken line, and back."""
    rows = monthly_index(spark, sf).select(F.concat_ws(",", F.col("month").cast("string"), F.when(F.month("month") == 2, "-9999").otherwise(F.col("value").cast("string"))).alias("value"))
    path = files.work_folder(spark, "index")
    rows.unionByName(rows.limit(1).select(F.explode(F.array(F.lit("Date,index value"), F.lit("broken"))).alias("value"))).write.text(path)
    return payloads.index_csv(spark, path)


@query("""WITH r AS (SELECT o_custkey AS entity_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderpriority AS market, o_orderstatus AS district, o_totalprice::DECIMAL(18, 2)::VARCHAR AS modal_price, o_orderdate::DATE::VARCHAR AS arrival_date FROM orders)
    SELECT entity_id, place::INTEGER AS place, market, district, modal_price, NULL::VARCHAR AS min_price, NULL::VARCHAR AS max_price, arrival_date FROM r WHERE place < 6""")
def source_price_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as one JSON payload of records, of which the first six are listed (that is what the source gives)."""
    o = table(spark, sf, "orders")
    record = F.struct("o_orderkey", F.struct(F.col("o_orderpriority").alias("market"), F.col("o_orderstatus").alias("district"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("modal_price"), F.to_date("o_orderdate").cast("string").alias("arrival_date")).alias("r"))
    p = o.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.array_sort(F.collect_list(record)).alias("all"))
    return payloads.price_records(p.select("entity_id", F.to_json(F.struct(F.col("all.r").alias("records"))).alias("payload")), "payload")


@query("""WITH c AS (SELECT p_brand AS crop, p_size, max(p_retailprice)::DECIMAL(18, 2) AS impact, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT row_number() OVER (ORDER BY crop, p_size) - 1 AS entry, crop || '-' || p_size AS id, crop, 'drought' AS risk, CASE WHEN p_size % 2 = 0 THEN 'severe' END AS severity, 'size' AS metric, (p_size)::DOUBLE AS lo, NULL::DOUBLE AS hi, impact::DOUBLE AS impact, 'part' AS source, 'n ' || n AS citation FROM c""")
def source_reference_table(spark: SparkSession, sf: str) -> DataFrame:
    """Prices by brand and size as a nested JSON reference file, read back as its entries in their order."""
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("crop"), "p_size").agg(F.max("p_retailprice").cast("decimal(18,2)").alias("impact"), F.count(F.lit(1)).alias("n"))
    band = F.struct(F.lit("size").alias("metric"), F.col("p_size").cast("double").alias("min"))
    entry = F.struct("crop", "p_size", F.struct(F.concat_ws("-", "crop", "p_size").alias("id"), "crop", F.lit("drought").alias("risk"), F.when(F.col("p_size") % 2 == 0, "severe").alias("severity"), band.alias("match_band"), F.col("impact").alias("yield_impact_pct"), F.lit("part").alias("source"), F.concat(F.lit("n "), "n").alias("citation")).alias("e"))
    whole = c.agg(F.array_sort(F.collect_list(entry)).alias("all")).select(F.to_json(F.struct(F.col("all.e").alias("coefficients"), F.array().cast("array<struct<crop:string>>").alias("gaps"))).alias("value"))  # brands and sizes: a file of some hundred entries
    path = files.work_folder(spark, "reference")
    whole.write.text(path)
    return files.reference_table(spark, path)[0].withColumn("entry", F.col("entry").cast("long"))


@query("""SELECT l_returnflag || l_linestatus AS experiment, l_linenumber::INTEGER AS step, round(avg(l_extendedprice), 2) AS metric, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2
    UNION ALL SELECT l_returnflag || l_linestatus, 0, round(avg(l_extendedprice), 2), count(*) FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1""")
def source_metric_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A metric table by experiment, written whole, then anew for some experiments: the others stay."""
    path = files.work_folder(spark, "metrics")
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("experiment"), F.col("l_linenumber").alias("step"), "l_extendedprice", "l_linestatus")
    of = lambda r, *keys: r.groupBy("experiment", *keys).agg(F.round(F.avg("l_extendedprice"), 2).alias("metric"), F.count(F.lit(1)).alias("n"))
    files.write_metrics(of(rows.withColumn("step", F.lit(0)), "step"), path)
    files.write_metrics(of(rows.where("l_linestatus = 'O'"), "step"), path)
    return spark.read.schema("step int, metric double, n long, experiment string").parquet(path).select("experiment", "step", "metric", "n")


@query("SELECT item_id::VARCHAR AS query_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END AS doc_type, unnest(['s' || item_id % 7, 's' || (item_id % 7 + 1)]) AS source_id FROM benchmark")
def source_labelled_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as a JSON array of labelled queries, read back as pairs of query and acceptable source."""
    b = table(spark, sf, "benchmark")
    s = lambda k: F.concat(F.lit("s"), F.col("item_id") % 7 + k)
    one = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "A").otherwise("B").alias("doc_type"), F.array(s(0), s(1)).alias("acceptable_sources"))
    path = files.work_folder(spark, "queries")
    b.agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)  # the labelled queries of an evaluation are few
    return files.labelled_queries(spark, path)


@query(r"""WITH f AS (SELECT lang, list('# ' || doc_id || chr(10) || replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' ') ORDER BY doc_id) AS x FROM documents GROUP BY 1), t AS (SELECT lang, array_to_string(x, chr(10)) AS text FROM f)
    SELECT lang, length(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '))::INTEGER AS chars, len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '#')))::INTEGER AS headings FROM t""")
def source_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as markdown, a folder a language with parts in order, a heading a document: characters and headings of each."""
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ")
    d = table(spark, sf, "documents").select("lang", "doc_id", F.concat(F.lit("# "), "doc_id", F.lit("\n"), line).alias("value"))
    path = files.work_folder(spark, "markdown")
    d.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(path)
    found = files.markdown(spark, f"{path}/*/*.txt", folders=True)
    return found.select(F.regexp_extract("path", "lang=([^/]*)$", 1).alias("lang"), "chars", "headings")


@query("SELECT doc_id, doc_id || '::' || substring(sha256(coalesce(text, '')), 1, 12) AS chunk_id FROM documents")
def corpus_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The id of a chunk, of its document and a hash of its text; here of whole texts."""
    d = table(spark, sf, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    return d.select("doc_id", corpus.chunk_id("doc_id", "body").alias("chunk_id"))


UNITS = {"k": ("points", "mean"), "value": ("money", "total")}


@query("""WITH e AS (SELECT user_id || '/' || event_type AS entity_id, date_trunc('month', ts)::DATE AS month, CASE WHEN (props->>'k')::DOUBLE < 8 THEN (props->>'k')::DOUBLE END AS k, CASE WHEN value > 40 THEN round(value, 2) END AS v FROM events),
    a AS (SELECT entity_id, month, unnest([{'parameter': 'k', 'unit': 'points', 'how': 'mean', 'x': round(avg(k), 2), 'used': count(k)}, {'parameter': 'value', 'unit': 'money', 'how': 'total', 'x': round(sum(v), 2), 'used': count(v)}]) AS r, count(*) AS days_returned FROM e GROUP BY 1, 2),
    b AS (SELECT entity_id, month, r.*, days_returned, sum(r.used) OVER (PARTITION BY entity_id, month) AS any_used, row_number() OVER (PARTITION BY entity_id, month ORDER BY r.parameter) AS nth FROM a)
    SELECT entity_id, month, CASE WHEN any_used > 0 THEN parameter END AS parameter, CASE WHEN any_used > 0 THEN unit END AS unit, CASE WHEN any_used > 0 THEN how END AS aggregation, CASE WHEN any_used > 0 THEN x END AS value, CASE WHEN any_used > 0 THEN used ELSE 0 END AS days_used,
        CASE WHEN any_used > 0 THEN days_returned ELSE 2 * days_returned END AS days_returned, any_used > 0 AS available, CASE WHEN any_used = 0 THEN 'no usable value' END AS reason
    FROM b WHERE used > 0 OR (any_used = 0 AND nth = 1)""")
def source_parameter_report(spark: SparkSession, sf: str) -> DataFrame:
    """Two parameters of each user and type of event with their units; months of fill values only are rows that say so."""
    e = table(spark, sf, "events").select(F.concat_ws("/", "user_id", "event_type").alias("entity_id"), F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.round("value", 2).alias("v"))
    fill = F.lit(-999.0)
    both = F.inline(F.array(F.struct(F.lit("k").alias("parameter"), F.when(F.col("k") < 8, F.col("k")).otherwise(fill).alias("value")), F.struct(F.lit("value").alias("parameter"), F.when(F.col("v") > 40, F.col("v")).otherwise(fill).alias("value"))))
    return payloads.parameter_report(e.select("entity_id", "day", both), UNITS)


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, month(o_orderdate) % 2 = 0 AS odd, o_totalprice FROM orders)
    SELECT month, count(*) AS n, round(sum(CASE WHEN odd THEN o_totalprice + 1 ELSE o_totalprice END), 2) AS total, CASE WHEN bool_or(odd) THEN 'changed' END AS change FROM o GROUP BY 1""")
def source_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by month published as a version, then with other prices in every second month: the current version, and what changed."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_totalprice", (F.month("o_orderdate") % 2 == 0).alias("odd"))
    root, schema = files.work_folder(spark, "versions"), "month string, o_orderkey long, o_totalprice double"
    versions.publish(o.drop("odd"), root, "month")
    again = o.withColumn("o_totalprice", F.when(F.col("odd"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).drop("odd")
    diff = versions.publish(again, root, "month")
    now = versions.read(spark, root, schema).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return now.join(diff.withColumnRenamed("part", "month"), "month", "left")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (l_shipdate IS NULL) AS n_without_day, count(*) FILTER (NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)) AS n_unknown,
    min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day, min(l_quantity) AS least FROM lineitem""")
def guard_observed(spark: SparkSession, sf: str) -> DataFrame:
    """The guards' figures of all lines, taken while the lines are joined and stored, without a scan of their own."""
    known = table(spark, sf, "supplier").select("s_suppkey", F.lit(True).alias("known"))
    rows = table(spark, sf, "lineitem").join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    n = lambda c: F.count_if(c)
    seen = quality.Guards(rows, {"n_rows": F.count(F.lit(1)), "n_without_day": n(F.col("l_shipdate").isNull()), "n_unknown": n(F.col("known").isNull()), "first_day": F.to_date(F.min("l_shipdate")), "last_day": F.to_date(F.max("l_shipdate")), "least": F.min("l_quantity")})
    files.stored(seen.frame.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"))
    seen.require(F.expr("n_rows > 0"))
    return spark.createDataFrame([tuple(seen.figures().values())], "n_rows long, n_without_day long, n_unknown long, first_day date, last_day date, least double")


@query("""SELECT l_returnflag, n, round(q[1], 4) AS q05, round(q[2], 4) AS q25, round(q[3], 4) AS q50, round(q[4], 4) AS q75, round(q[2] - 1.5 * (q[4] - q[2]), 4) AS lowest, round(q[4] + 1.5 * (q[4] - q[2]), 4) AS highest
    FROM (SELECT l_returnflag, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1)""")
def series_exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles and outlier bounds of the prices of all lines by return flag, of which one has half of all lines."""
    q = quantiles.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.25, 0.5, 0.75])
    at = lambda k: F.get("q", F.lit(k))
    out = {"q05": at(0), "q25": at(1), "q50": at(2), "q75": at(3), "lowest": at(1) - 1.5 * (at(3) - at(1)), "highest": at(3) + 1.5 * (at(3) - at(1))}
    return q.select("l_returnflag", "n", *(F.round(c, 4).alias(n) for n, c in out.items()))
