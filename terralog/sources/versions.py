"""Tables that are published as whole versions: readers see the old one or the new one, never half of a refresh.

A version is a manifest: a row a partition with the folder of its files, its number of rows and a digest that does not
depend on their order. A refresh writes folders only for partitions whose digest has changed, then the manifest, and at
last one line that names it; a reader starts from the last such line. A job that is lost before that line leaves files
that nothing refers to.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, folder string, n_rows long, digest decimal(38,0)"
POINTER = "number long, version string"


def digest(columns: list[str]) -> Column:
    """Sum of two hashes of each row (an aggregate): equal for equal rows in any order, and for repeated rows as often."""
    both = (F.xxhash64(*columns).cast("decimal(38,0)"), F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)") * 1_000_003)
    return F.sum((both[0] + both[1]).cast("decimal(38,0)")).cast("decimal(38,0)")


def digests(frame: DataFrame, part: str) -> DataFrame:
    """``part, n_rows, digest`` of each partition, by hash aggregation."""
    columns = [c for c in frame.columns if c != part]
    return frame.groupBy(F.col(part).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), digest(columns).alias("digest"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``part, change`` (``new``, ``gone``, ``changed``) of partitions whose digests differ; no row of the tables is compared."""
    j = old.select("part", F.struct("n_rows", "digest").alias("a")).join(new.select("part", F.struct("n_rows", "digest").alias("b")), "part", "full")
    how = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return j.select("part", how.alias("change")).where("change is not null")


def _last(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and manifest of the current version."""
    try:
        lines = spark.read.schema(POINTER).json(f"{root}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = lines.orderBy(F.desc("number")).first()
    return tuple(row) if row else None


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest of the current version; None before the first."""
    last = _last(spark, root)
    return spark.read.schema(MANIFEST).json(last[1]) if last else None


def publish(frame: DataFrame, root: str, part: str) -> DataFrame:
    """Publishes ``frame`` as the next version, and returns ``changed``. Partitions of equal digests keep their files.

    One job publishes at a time; a job that runs again writes other folders and one more line.
    """
    spark, token = frame.sparkSession, uuid.uuid4().hex
    old, new = manifest(spark, root), digests(frame, part)
    none = spark.createDataFrame([], MANIFEST)
    old = none if old is None else old
    diff = changed(old, new).collect()  # a row a partition
    write = [r["part"] for r in diff if r["change"] != "gone"]
    folder = f"{root}/data-{token}"
    name = F.col(part).cast("string")
    frame.where(name.isin(write) | name.isNull()).withColumn("part", name).write.partitionBy("part").parquet(folder)
    own = new.where(F.col("part").isin(write) | F.col("part").isNull()).withColumn("folder", F.lit(folder))
    kept = old.join(new.select("part"), "part", "left_semi").where(~F.col("part").isin(write))
    version = f"{root}/manifest-{token}"
    own.unionByName(kept).select("part", "folder", "n_rows", "digest").coalesce(1).write.json(version)
    number = 1 + (_last(spark, root) or (0,))[0]
    spark.createDataFrame([(number, version)], POINTER).coalesce(1).write.mode("append").json(f"{root}/pointer")
    return spark.createDataFrame([tuple(r) for r in diff], "part string, change string")


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The current version's rows; ``schema`` is that of the published frame. A reader keeps its version while others publish."""
    m = manifest(spark, root)
    rows = m.select("part", "folder").collect() if m is not None else []  # a row a partition
    empty = spark.createDataFrame([], schema)
    out = None
    for folder in sorted({r["folder"] for r in rows}):
        parts = [r["part"] for r in rows if r["folder"] == folder]
        found = spark.read.schema(f"{schema}, part string").parquet(folder)
        found = found.where(F.col("part").isin([p for p in parts if p is not None]) | (F.col("part").isNull() if None in parts else F.lit(False))).drop("part")
        out = found if out is None else out.unionByName(found)
    return empty if out is None else out
