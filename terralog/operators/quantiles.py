"""Exact quantiles of groups of any size: selection by histograms that merge, so no task holds a group's values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Low bits of the order of doubles that each pass leaves open: a pass counts at most 2 ** 22 buckets a group and place.
LEFT = (44, 22, 0)


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Between a double's bits and a long of the same order; its own inverse."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


@F.arrow_udf(T.LongType())
def order_bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A long of a double's order; null for null. Both zeros are one."""
    for v in batches:
        x = v.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
        yield pa.array(_flipped(x.view(np.int64)), mask=v.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def of_bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for v in batches:
        yield pa.array(_flipped(v.fill_null(0).to_numpy(zero_copy_only=False)).view(np.float64), mask=v.is_null().to_numpy(zero_copy_only=False))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``*keys, n, q``: the number of values of each group and its quantiles as an array, interpolated as by ``percentile``.

    Each pass counts the values of the buckets in which a wanted place lies, by a partial aggregation before the shuffle,
    and finds the finer bucket of each place; after the last pass a bucket is one value. Nulls are left out, and groups of
    nulls only have no row. Keys that are null are a group.
    """
    b = rows.select(*keys, order_bits(F.col(value).cast("double")).alias("bits")).where("bits is not null")
    b = b.withColumn("group", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    sizes = b.groupBy("group", *keys).agg(F.count(F.lit(1)).alias("n"))
    place = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for k, p in enumerate(shares)))).alias("p")
    wanted = sizes.select("group", "n", place).select("group", F.explode(F.array(F.floor("p.at"), F.ceil("p.at"))).alias("place")).distinct()
    found = wanted.withColumns({"bucket": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    last = 64
    for left in LEFT:
        upper = F.lit(0).cast("long") if last == 64 else F.shiftright("bits", last)
        inside = b.withColumn("upper", upper)
        if last < 64:
            inside = inside.join(found.select("group", F.col("bucket").alias("upper")).distinct(), ["group", "upper"], "left_semi")
        counts = inside.groupBy("group", "upper", F.shiftright("bits", left).alias("finer")).agg(F.count(F.lit(1)).alias("m"))
        counts = counts.withColumn("upto", F.sum("m").over(Window.partitionBy("group", "upper").orderBy("finer")))
        j = found.withColumnRenamed("bucket", "upper").join(counts, ["group", "upper"])
        rank = F.col("place") - F.col("before")
        j = j.where((rank >= F.col("upto") - F.col("m")) & (rank < F.col("upto")))
        found = j.select("group", "place", F.col("finer").alias("bucket"), (F.col("before") + F.col("upto") - F.col("m")).alias("before"))
        last = left
    found = found.select("group", F.struct("place", of_bits(F.col("bucket")).alias("v")).alias("e"))
    values = found.groupBy("group").agg(F.map_from_entries(F.collect_list("e")).alias("v"))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    low, high = ([F.element_at("v", f(a)) for a in at] for f in (F.floor, F.ceil))
    q = F.array(*(lo + (hi - lo) * (a - F.floor(a)) for lo, hi, a in zip(low, high, at, strict=True)))
    return sizes.join(values, "group").select(*keys, "n", q.alias("q"))
