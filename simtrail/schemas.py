"""Explicit schemas for every table the library reads or hands over.

Nothing is inferred: Parquet inputs are read with these schemas (which also
narrows nested reads to the struct fields that are used), and the CSV
profile is read back typed instead of as all-strings.
"""

from __future__ import annotations

from pyspark.sql import types as T

# T1 carrier activity, as landed: one row per device, carrier, network and day.
CARRIER_ACTIVITY_RAW = T.StructType(
    [
        T.StructField("ifa", T.StringType()),
        T.StructField("carrier", T.StringType()),
        T.StructField("network", T.StringType()),
        T.StructField("date", T.StringType()),  # yyyyMMdd
        T.StructField("brq_count", T.LongType()),
    ]
)

# T2 nested location time series.  Only the listed struct fields are read,
# which is how nested-column pruning reaches the Parquet scan through explode.
GPS_POINT = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("last_seen", T.StringType()),  # yyyy-MM-dd HH:mm:ss
        T.StructField("brq_count", T.LongType()),
    ]
)
LOCATION_TIMESERIES = T.StructType(
    [
        T.StructField("ifa", T.StringType()),
        T.StructField("gps", T.ArrayType(GPS_POINT)),
    ]
)

# Flat observation stream every mobility operator consumes.
# ``obs_id`` is the tie-break for equal timestamps.
POINTS_COLUMNS = ("ifa", "obs_id", "seen_at", "state")

# T3 SIM profile (output of the scoring job, input of the mobility job).
# Score columns depend on the carrier slots; this is the default layout.
def sim_profile_schema(score_columns: list[str]) -> T.StructType:
    fields = [
        T.StructField("ifa", T.StringType()),
        T.StructField("primary_sim", T.StringType()),
        T.StructField("secondary_sim", T.StringType()),
        T.StructField("third_sim", T.StringType()),
        T.StructField("all_rfm", T.DoubleType()),
    ]
    fields += [T.StructField(c, T.DoubleType()) for c in score_columns]
    fields.append(T.StructField("delta_rfm", T.DoubleType()))
    return T.StructType(fields)


# T4 segment membership: ``ifa`` plus the ``segment`` partition column.
SEGMENT_MEMBERSHIP = T.StructType(
    [
        T.StructField("ifa", T.StringType()),
        T.StructField("segment", T.StringType()),
    ]
)

