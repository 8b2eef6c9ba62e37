"""Files that the jobs leave and find: bucketed archives, chunk lines, reference tables, documents, logs and metric tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an archive; a request for some entities reads theirs only.
BUCKETS = 32
BAND = "STRUCT<metric: STRING, min: DOUBLE, max: DOUBLE>"
TABLE = f"coefficients ARRAY<STRUCT<id: STRING, crop: STRING, risk: STRING, severity: STRING, match_band: {BAND}, yield_impact_pct: DOUBLE, source: STRING, citation: STRING>>, gaps ARRAY<STRUCT<crop: STRING, risk: STRING, status: STRING, why_nothing_qualified: STRING>>"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, under a temporary folder in local mode, as in tests; ValueError on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terralog-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to a new work folder and reads it back, for tables that several jobs use."""
    path = work_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("entity_id").cast("string")), F.lit(buckets)).cast("int")


def write_archive(frame: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Rows with an ``entity_id`` into one folder a bucket; buckets that the frame does not touch stay as they are."""
    parted = frame.withColumn("entity_bucket", _bucket(buckets)).repartition("entity_bucket")
    parted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity_bucket").parquet(path)


def read_archive(spark: SparkSession, path: str, schema: str, entities: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The archive, or the rows of some entities, for which only the folders of their buckets are read."""
    rows = spark.read.schema(f"{schema}, entity_bucket INT").parquet(path)
    if entities is not None:
        ids = spark.createDataFrame([(e,) for e in entities], "entity_id string")
        wanted = [r[0] for r in ids.select(_bucket(buckets)).distinct().collect()]
        rows = rows.where(F.col("entity_bucket").isin(wanted) & F.col("entity_id").cast("string").isin(entities))
    return rows.drop("entity_bucket")


def write_lines(rows: DataFrame, path: str) -> None:
    """A JSON object a row and line."""
    rows.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """The lines of ``write_lines``; an error where there are none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def reference_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries (``entry, id, crop, risk, severity, metric, lo, hi, impact, source, citation``) in their order, and gaps, of one JSON file."""
    t = spark.read.schema(TABLE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    e = t.select(F.posexplode("coefficients").alias("entry", "c"))
    columns = {"id": "id", "crop": "crop", "risk": "risk", "severity": "severity", "match_band.metric": "metric", "match_band.min": "lo", "match_band.max": "hi", "yield_impact_pct": "impact", "source": "source", "citation": "citation"}
    return e.select("entry", *(F.col(f"c.{c}").alias(a) for c, a in columns.items())), t.select(F.inline("gaps"))


def markdown(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """``path, chars, headings`` of each file: characters after spaces collapse, and lines that begin with ``#``.

    With ``folders`` of each folder, whose files are parts of one text and end at line ends. Files are read by lines, whose
    figures are summed, so that a text of any size costs no more than its longest line.
    """
    path_of = F.col("_metadata.file_path")
    lines = spark.read.text(path, lineSep="\n").select((F.regexp_extract(path_of, "^(.*)/[^/]*$", 1) if folders else path_of).alias("path"), "value")
    n = F.length(F.trim(F.regexp_replace("value", r"\s+", " "))).cast("long")  # lines with text are joined by one space each
    chars = F.greatest(F.sum(n) + F.count_if(n > 0) - 1, F.lit(0))
    return lines.groupBy("path").agg(chars.alias("chars"), F.count_if(F.startswith("value", F.lit("#"))).alias("headings"))


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query, doc_type, source_id``: a row for each acceptable source of each query of a JSON array."""
    q = spark.read.schema("id STRING, query STRING, doc_type STRING, acceptable_sources ARRAY<STRING>").option("multiLine", True).json(path)
    return q.select(F.col("id").alias("query_id"), "query", "doc_type", F.explode("acceptable_sources").alias("source_id"))


def log_failures(failures: DataFrame, path: str) -> None:
    """Adds rows (a report, its offending numbers, an excerpt) to a log of JSON lines."""
    failures.write.mode("append").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metric table by ``experiment``; those of other experiments stay."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment").parquet(path)
