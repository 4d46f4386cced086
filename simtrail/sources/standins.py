"""Driver tables in the shapes of the job's inputs.

The test tables carry no carrier or location data, so columns of the given
tables play those roles.  Each stand-in reads its whole table, with only the
columns it needs (column pruning reaches the scan):

=====================  =======================================================
role                   stand-in
=====================  =======================================================
carrier activity (T1)  ``orders``: ifa = o_custkey, carrier = o_orderstatus,
                       date = o_orderdate as DATE, brq_count = o_totalprice in
                       cents (the declared type is a count: whole numbers keep
                       sums exact and order-independent), network = cellular
carrier slots          focal F, challenger 1 O, challenger 2 P
location points (T2)   ``events``: ifa = user_id, state = event_type,
                       seen_at = ts, obs_id = event_id (tie-break)
segments (T4)          ``customer``: ifa = c_custkey, segment = c_mktsegment
corridor               click <-> view
=====================  =======================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail import config
from simtrail.config import CarrierSlots

STANDIN_SLOTS = CarrierSlots(focal="F", challenger_1="O", challenger_2="P")
STANDIN_CORRIDOR = ("click", "view")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def activity_from_orders(
    spark: SparkSession,
    sf_dir: str,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """T1 from ``orders``; ``start``/``end`` are inclusive ``yyyy-MM-dd`` days.

    The period bounds compare the raw timestamp column, so they are pushed
    into the Parquet scan.
    """
    o = _table(spark, sf_dir, "orders")
    if start is not None:
        o = o.where(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        o = o.where(F.col("o_orderdate") < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp_ntz"))
    return o.select(
        F.col("o_custkey").alias("ifa"),
        F.col("o_orderstatus").alias("carrier"),
        F.lit(config.NETWORK_KEPT).alias("network"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("brq_count"),
    )


def mixed_activity_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 from ``orders`` with rows that scoring must leave out.

    Low priorities have no device, status P has no carrier, and priorities
    below high (but the low ones) are another network.
    """
    o = _table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    return o.select(
        F.when(priority != "5-LOW", F.col("o_custkey")).alias("ifa"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("carrier"),
        F.when(priority.isin("1-URGENT", "2-HIGH", "5-LOW"), F.lit(config.NETWORK_KEPT)).otherwise(F.lit("wifi")).alias("network"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("brq_count"),
    )


def tied_points_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``points_from_events`` by the hour and without ids: many observations tie."""
    return points_from_events(spark, sf_dir).withColumns(
        {
            "seen_at": F.date_trunc("hour", "seen_at").cast("timestamp_ntz"),
            "obs_id": F.lit(None).cast("long"),
        }
    )


def points_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat location points from ``events``."""
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("ifa"),
        F.col("event_id").alias("obs_id"),
        F.col("ts").alias("seen_at"),
        F.col("event_type").alias("state"),
    )


# Observations per nested stand-in row: a block of consecutive event ids.
NEST_BLOCK = 256


def nested_locations_from_events(spark: SparkSession, sf_dir: str, day_step: int = 1) -> DataFrame:
    """T2-shaped nested rows from ``events``.

    Each row holds one device's observations within a block of ``NEST_BLOCK``
    consecutive event ids, as a ``gps`` array of
    ``struct<city, state, country, last_seen, brq_count, obs_id>``
    (``last_seen`` is the ``yyyy-MM-dd HH:mm:ss`` text of the source).  Event
    ids are unique, so no array holds more than ``NEST_BLOCK`` points however
    active a device is; every event is kept.  ``day_step`` moves the days of
    a month that many days apart, so that the rows span months.
    """
    e = _table(spark, sf_dir, "events")
    if day_step > 1:
        e = e.withColumn("ts", F.expr(f"ts + make_dt_interval({day_step - 1} * (day(ts) - 1))"))
    point = F.struct(
        F.col("event_type").alias("city"),
        F.col("event_type").alias("state"),
        F.lit(config.COUNTRY_KEPT).alias("country"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        F.lit(1).cast("long").alias("brq_count"),
        F.col("event_id").alias("obs_id"),
    )
    return e.groupBy(
        F.col("user_id").alias("ifa"), F.floor(F.col("event_id") / F.lit(NEST_BLOCK)).alias("block")
    ).agg(F.collect_list(point).alias("gps")).select("ifa", "gps")


def segments_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 membership from ``customer``: (ifa, segment)."""
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("ifa"), F.col("c_mktsegment").alias("segment"))
