"""Archive and recent layers of one table: union by key, refresh with late rows, dynamic partition overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, by aggregation, which is partial before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def live(archive: DataFrame, recent: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Archive and recent rows; of one key the recent one counts."""
    both = archive.withColumn("layer", F.lit(0)).unionByName(recent.withColumn("layer", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["layer", *order]).drop("layer")


def last_months(archive: DataFrame) -> DataFrame:
    """``entity_id, archive_month``: the month of the last day of each entity."""
    return archive.groupBy("entity_id").agg(F.trunc(F.max("day"), "MM").alias("archive_month"))


def complete_after(days: DataFrame, ends: DataFrame) -> DataFrame:
    """Months after ``archive_month`` of which every day is there; ``days``: a row an entity and day."""
    m = days.groupBy("entity_id", F.trunc("day", "MM").alias("month")).agg(F.avg("value").alias("mean"), F.count("value").alias("n_days"))
    return m.join(ends, "entity_id").where((F.col("month") > F.col("archive_month")) & (F.col("n_days") >= F.day(F.last_day("month")))).drop("archive_month")


def refreshed_months(archive: DataFrame, recent: DataFrame) -> DataFrame:
    """Months after the archive's last one of which every day is there, from the union of both layers' days.

    Both have ``entity_id, day, value, seq``. The archive's own months are not published again.
    """
    return complete_after(live(archive, recent, ["entity_id", "day"], ["seq"]), last_months(archive))


def publish(months: DataFrame, path: str) -> None:
    """Writes only the months' own partitions."""
    months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
