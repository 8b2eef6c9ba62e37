"""Whole versions: unchanged partitions keep their files, and a job that is lost leaves the old version readable."""

import pytest
from pyspark.sql import functions as F

from terralog.operators import quality
from terralog.sources import versions

SCHEMA = "month string, k long, v double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    a = spark.createDataFrame([("a", k, 1.0) for k in range(50)] + [("b", k, 2.0) for k in range(50)] + [("b", 7, 2.0)], SCHEMA)
    assert versions.read(spark, root, SCHEMA).count() == 0 and versions.manifest(spark, root) is None
    assert rows(versions.publish(a, root, "month")) == [("a", "new"), ("b", "new")]
    assert rows(versions.read(spark, root, SCHEMA)) == rows(a)
    b = a.where("month = 'a'").repartition(7).unionByName(a.where("month = 'b'").withColumn("v", F.when(F.col("k") == 3, 9.0).otherwise(F.col("v")))).unionByName(spark.createDataFrame([("c", 1, None)], SCHEMA))
    held = versions.read(spark, root, SCHEMA)
    assert rows(versions.publish(b, root, "month")) == [("b", "changed"), ("c", "new")]
    assert rows(versions.read(spark, root, SCHEMA)) == rows(b) and rows(held) == rows(a)
    m = {r.part: r.folder for r in versions.manifest(spark, root).collect()}
    assert m["a"] != m["b"] == m["c"]
    assert rows(versions.publish(b.repartition(3), root, "month")) == []
    assert rows(versions.publish(b.where("month <> 'c'"), root, "month")) == [("c", "gone")]
    assert rows(versions.read(spark, root, SCHEMA)) == rows(b.where("month <> 'c'"))


def test_a_lost_job_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    a = spark.createDataFrame([("a", k, 1.0) for k in range(20)], SCHEMA)
    versions.publish(a, root, "month")
    late = F.udf(lambda k: 1 / (k - 25), "double")  # fails in the middle of the write
    broken = a.unionByName(spark.range(20, 40).select(F.lit("b").alias("month"), F.col("id").alias("k"), late("id").alias("v")))
    with pytest.raises(Exception, match="division by zero"):
        versions.publish(broken, root, "month")
    assert rows(versions.read(spark, root, SCHEMA)) == rows(a)
    broken.where("k < 20").write.parquet(f"{root}/data-half")  # files without a line that names them
    assert rows(versions.read(spark, root, SCHEMA)) == rows(a)
    assert rows(versions.publish(a.withColumn("v", F.lit(3.0)), root, "month")) == [("a", "changed")]


def test_digest_tells_repeated_rows_and_order(spark):
    d = lambda r: versions.digests(spark.createDataFrame(r, SCHEMA), "month").first().digest
    x, y = ("a", 1, 1.0), ("a", 2, 2.0)
    assert d([x, y]) == d([y, x]) and len({d([x]), d([x, x]), d([x, y]), d([y, y]), d([("a", 1, 2.0), ("a", 2, 1.0)])}) == 5


def test_observed_guards(spark, tmp_path):
    f = spark.createDataFrame([("e", None), ("e", 2.0), ("x", 3.0), (None, -1.0)], "entity_id string, value double")
    seen = quality.Guards(f, {"n_rows": F.count(F.lit(1)), "n_null": F.count_if(F.col("value").isNull()), "least": F.min("value")})
    seen.frame.where("value > 0").write.parquet(str(tmp_path / "out"))
    assert seen.figures() == {"n_rows": 4, "n_null": 1, "least": -1.0}
    with pytest.raises(ValueError, match="n_null"):
        seen.require(F.expr("n_null = 0"), F.expr("n_rows > 0"))
    seen.require(F.expr("n_rows = 4"))
