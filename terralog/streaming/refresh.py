"""New daily files to published months: a stream of all files not yet seen, the batch refresh for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.sources import files, layers

SCHEMA = "entity_id string, day date, value double, seq long"


def run(spark: SparkSession, landing: str, archive: str, recent: str, published: str, checkpoint: str) -> None:
    """Takes every new file under ``landing`` once, adds it to ``recent`` and publishes the complete months that it touches.

    ``recent`` is kept by month, so a batch reads the months of its own days only; of the archive it needs each entity's
    last month, which is read once a run, as no later month has archived days. A batch that runs again after a lost
    executor adds the same keys again; the last of a key counts, so nothing changes.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.withColumn("month", F.trunc("day", "MM"))
        rows.write.mode("append").partitionBy("month").parquet(recent)
        touched = [r[0] for r in rows.select("month").distinct().collect()]  # a few months a batch
        days = spark.read.schema(f"{SCHEMA}, month date").parquet(recent).where(F.col("month").isin(touched)).drop("month")
        layers.publish(layers.complete_after(layers.latest(days, ["entity_id", "day"], ["seq"]), ends), published)

    ends = files.stored(layers.last_months(spark.read.schema(SCHEMA).parquet(archive)))
    stream = spark.readStream.schema(SCHEMA).parquet(landing)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
