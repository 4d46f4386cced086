"""Cohort profiles by membership segment, with an ``all`` roll-up row set.

D19 ``segment_tier_profile``     distinct devices per (segment, tier)
D20 ``segment_daypart_profile``  corridor trips per (segment, daypart)
D21 ``segment_weekpart_profile`` corridor trips per (segment, weekday/weekend)
V5  ``segment_travel``           trips per (segment, trip key)
A25 ``segment_tier_profile_merged`` D19 from mergeable bitmaps of devices

Each is one join with the membership table and one ``GROUPING SETS``
aggregate: per segment and over all segments in the same pass.  A device in
two segments is counted once by the distinct counts of the ``all`` rows and
twice by their sums -- the same as aggregating the union of all segment
folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simtrail import config
from simtrail.functions.distinct import device_bitmaps, device_numbers, distinct_counts
from simtrail.session import materialize


def _by_segment(joined: DataFrame, dim: str, agg: Column) -> DataFrame:
    return (
        joined.groupingSets([["segment", dim], [dim]], "segment", dim)
        .agg(agg, F.grouping("segment").alias("__g"))
        .withColumn("segment", F.when(F.col("__g") == 1, F.lit(config.ALL_SEGMENTS)).otherwise(F.col("segment")))
        .drop("__g")
    )


def segment_tier_profile(tiers: DataFrame, membership: DataFrame) -> DataFrame:
    """D19 (A25): (segment, tier_level, ifa_count)."""
    joined = tiers.join(membership.select("ifa", "segment"), "ifa")
    return _by_segment(joined, "tier_level", F.count_distinct("ifa").alias("ifa_count"))


def segment_tier_bitmaps(tiers: DataFrame, membership: DataFrame) -> DataFrame:
    """The devices of each (segment, tier) as bitmaps over the numbers of the devices in ``tiers``, written once."""
    members = membership.select("ifa", "segment")
    numbered = tiers.join(device_numbers(tiers), "ifa").select("ifa", "device_no", "tier_level").join(members, "ifa")
    return materialize(device_bitmaps(numbered, ["segment", "tier_level"]), "segment-bitmaps")


def segment_tier_profile_merged(bitmaps: DataFrame) -> DataFrame:
    """D19 (A25) from ``segment_tier_bitmaps`` (of one run or of several, united): (segment, tier_level, ifa_count).

    The rows over all segments are unions of the segments' bitmaps; the rows
    behind them are not read again.
    """
    overall = distinct_counts(bitmaps, ["tier_level"], "ifa_count").withColumn("segment", F.lit(config.ALL_SEGMENTS))
    return distinct_counts(bitmaps, ["segment", "tier_level"], "ifa_count").unionByName(overall)


def segment_daypart_profile(device_daypart: DataFrame, membership: DataFrame) -> DataFrame:
    """D20 (A27): (segment, time_of_day, count) from per-device daypart counts."""
    joined = device_daypart.join(membership.select("ifa", "segment"), "ifa")
    return _by_segment(joined, "time_of_day", F.sum("count").alias("count"))


def segment_weekpart_profile(device_weekpart: DataFrame, membership: DataFrame) -> DataFrame:
    """D21 (A29): (segment, weekday_weekend, count) from per-device counts."""
    joined = device_weekpart.join(membership.select("ifa", "segment"), "ifa")
    return _by_segment(joined, "weekday_weekend", F.sum("count").alias("count"))


def segment_travel(profile: DataFrame, membership: DataFrame) -> DataFrame:
    """V5: trips per (segment, trip key) from the trip profile."""
    joined = profile.join(membership.select("ifa", "segment"), "ifa")
    return joined.groupBy("segment", "travel").agg(F.sum("count").alias("count"))
