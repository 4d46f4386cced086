"""Exact distinct counts by mergeable bitmaps over dense device numbers.

``count(DISTINCT ifa)`` for several grouping sets makes Spark copy every row
once a set and shuffle all of them by (group, device).  Here devices get dense
numbers once (``device_numbers``); a group's devices are then bits of 4 KB
bitmaps, one for every 32,768 numbers, built by partial aggregation
(``bitmap_construct_agg``).  Coarser groups, other segments and later periods
are unions of those bitmaps (``bitmap_or_agg``): they never read the rows again,
and a written bitmap table merges with those of other periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simtrail.session import materialize


def device_numbers(devices: DataFrame, key: str = "ifa") -> DataFrame:
    """(``key``, ``device_no``): the distinct non-null devices, numbered from 0 without gaps.

    Range partitioned and written once; a number is the place in its range
    plus the devices of earlier ranges (one row a range).
    """
    ids = devices.select(key).where(F.col(key).isNotNull()).distinct()
    rows = materialize(ids.repartitionByRange(key).withColumn("__at", F.monotonically_increasing_id()), "device-numbers")
    part = F.shiftright("__at", 33)
    ranges = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range, at most spark.sql.shuffle.partitions of them.
    ranges = ranges.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__off"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(F.broadcast(ranges), "__part").select(key, (F.col("__off") + place).alias("device_no"))


def device_bitmaps(rows: DataFrame, dims: Sequence[str], number: str = "device_no") -> DataFrame:
    """(dims, ``bucket``, ``devices``): the devices of each group as bitmaps."""
    spread = rows.where(F.col(number).isNotNull()).select(
        *dims, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("__bit")
    )
    return spread.groupBy(*dims, "bucket").agg(F.bitmap_construct_agg("__bit").alias("devices"))


def merged_bitmaps(bitmaps: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``bitmaps`` of one or several tables, united over everything but ``dims``."""
    return bitmaps.groupBy(*dims, "bucket").agg(F.bitmap_or_agg("devices").alias("devices"))


def distinct_counts(bitmaps: DataFrame, dims: Sequence[str], out: str) -> DataFrame:
    """(dims, ``out``): distinct devices of each group."""
    return merged_bitmaps(bitmaps, dims).groupBy(*dims).agg(F.sum(F.bitmap_count("devices")).alias(out))
