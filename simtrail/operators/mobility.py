"""Location observations -> consecutive moves -> trips -> calendar features.

D10 ``location_points``  un-nest the per-device ``gps`` array, keep a country
D11 ``movements`` / ``movement_table``  each observation with the state of the device's next one
D12 ``trips``            moves whose state changes, keyed ``<origin>_<destination>``
D13 ``calendar_features`` weekday/weekend and daypart of the departure
D14 ``trip_profile`` / ``od_matrix``

Scale notes
-----------
``movements`` needs, per device, the next observation in time.  A plain
``lead`` over ``Window.partitionBy(ifa)`` sends all observations of one
device to one task, so a device holding a third of all rows would be a third
of the job in one task.  Instead the observations are put in total order:

* range partitioned on (device, time, id, state, hash of the other columns),
  so that a device, or one minute of one device, spans as many ranges as its
  rows ask for, and sorted once;
* a task links every row to the row after it; the linked rows are written,
  with the first and the last row of each range marked;
* the last row of a range takes the first row of the next range, one row a
  range, if that is the same device.

There is no work unit to tune and no second shuffle of the rows.
``unit_minutes`` selects the older plan, without a written table: the unit is
(device, ``unit_minutes`` of time), linked inside by a window and across by
the first observation of the device's next unit.

Ties are ordered by the state, so that equal timestamps give the same links
on every run; rows that tie in everything are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simtrail import config, schemas
from simtrail.functions.calendar import daypart, parse_seen_at, weekday_name, weekpart
from simtrail.session import materialize


def location_points(
    nested: DataFrame,
    country: str | None = config.COUNTRY_KEPT,
    tie_break: str | None = None,
) -> DataFrame:
    """One row per observation from ``ifa, gps: array<struct>``.

    Rows with a null or empty ``gps`` produce nothing (``explode`` semantics),
    nor do rows without a device.
    The country filter runs on the array before it is exploded, so points of
    other countries are never materialised.  ``tie_break`` names a struct
    field used to order equal timestamps; without it ties stay arbitrary.
    """
    gps = F.col("gps")
    if country is not None:
        gps = F.filter(gps, lambda p: p["country"] == F.lit(country))
    exploded = nested.where(F.col("ifa").isNotNull()).select("ifa", F.explode(gps).alias("p"))
    obs_id = F.col(f"p.{tie_break}") if tie_break else F.lit(None).cast("long")
    return exploded.select(
        "ifa",
        obs_id.alias("obs_id"),
        parse_seen_at(F.col("p.last_seen")).alias("seen_at"),
        F.col("p.city").alias("city"),
        F.col("p.state").alias("state"),
        F.col("p.country").alias("country"),
        F.col("p.brq_count").alias("brq_count"),
    )


def restrict_to_devices(points: DataFrame, devices: DataFrame | None) -> DataFrame:
    """Keep observations of listed devices.

    A left-semi join: a device listed twice (e.g. in two monthly profiles)
    never multiplies its observations, and no column of ``devices`` is kept.
    """
    if devices is None:
        return points
    return points.join(devices.select("ifa"), "ifa", "left_semi")


# The unit of rows without a time: before all others.
_NO_TIME = -(1 << 62)


def _unit(seen_at, minutes: int):
    """Number of the unit of a local time; follows the clock reading, so it never runs back."""
    day = F.datediff(F.to_date(seen_at), F.lit("1970-01-01").cast("date")).cast("long")
    of_day = F.hour(seen_at) * 60 + F.minute(seen_at)
    return F.coalesce(F.floor((day * 1440 + of_day) / F.lit(minutes)).cast("long"), F.lit(_NO_TIME))


ORDER = ("seen_at", "obs_id", "state")


def movements(
    points: DataFrame,
    devices: DataFrame | None = None,
    *,
    unit_minutes: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every observation with ``next_state`` of the same device's next one.

    Order within a device is (``seen_at``, ``obs_id``, ``state``), nulls
    first.  The device's last observation has ``has_next = false`` and a null
    ``next_state``; a following observation with a null state gives
    ``has_next = true`` and a null ``next_state``.  Observations without a
    device are dropped.  ``carry`` lists extra point columns to keep.
    Without ``unit_minutes`` the linked rows are written when this is called.
    """
    missing = [c for c in schemas.POINTS_COLUMNS if c not in points.columns]
    if missing:
        raise ValueError(f"points need columns {schemas.POINTS_COLUMNS}; missing {missing}")
    pts = restrict_to_devices(points, devices).where(F.col("ifa").isNotNull()).select("ifa", *ORDER, *carry)
    if unit_minutes is None:
        return _linked_in_order(pts)
    if unit_minutes < 1:
        raise ValueError("unit_minutes is at least 1")
    return _linked_in_units(pts, unit_minutes)


def _link_rows():
    """Task function over the sorted rows of a range: each row with device and state of the row after it."""

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(rows: pa.RecordBatch, after: pa.RecordBatch | None, begin: bool) -> pa.RecordBatch:
            """``rows`` linked; the last one to the first row of ``after``, or marked as the end of the range."""
            n = rows.num_rows
            marks = [pa.array([begin] + [False] * (n - 1)), pa.array([False] * (n - 1) + [after is None])]
            following = []
            for c in ("ifa", "state"):
                column = rows.column(c)
                tail = after.column(c).slice(0, 1) if after is not None else pa.nulls(1, column.type)
                following.append(pa.concat_arrays([column.slice(1), tail]))
            names = [*rows.schema.names, "__next_ifa", "__next_state", "__begin", "__end"]
            return pa.RecordBatch.from_arrays([*rows.columns, *following, *marks], names)

        held, begin = None, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                yield out(held, batch, begin)
                begin = False
            held = batch
        if held is not None:
            yield out(held, None, begin)

    return link


def ordered_points(pts: DataFrame) -> DataFrame:
    """``pts`` in total order, written once: ``__part`` (range), each row's following row in it, first and last row marked."""
    order = [F.col(c).asc_nulls_first() for c in ("ifa", *ORDER)]
    kinds = {f.name: f.dataType for f in pts.schema.fields}
    added = [
        T.StructField("__next_ifa", kinds["ifa"]),
        T.StructField("__next_state", kinds["state"]),
        T.StructField("__begin", T.BooleanType()),
        T.StructField("__end", T.BooleanType()),
    ]
    return materialize(
        pts.repartitionByRange(*order, F.xxhash64(*pts.columns))
        .sortWithinPartitions(*order)
        .mapInArrow(_link_rows(), T.StructType([*pts.schema.fields, *added]))
        .withColumn("__part", F.spark_partition_id()),
        "ordered-points",
    )


def _linked_in_order(pts: DataFrame) -> DataFrame:
    rows = ordered_points(pts)
    # One row a range reaches this un-partitioned window.
    head = F.struct(F.col("ifa").alias("ifa"), F.col("state").alias("state"))
    heads = rows.where("__begin").select("__part", F.lead(head).over(Window.orderBy("__part")).alias("__head"))
    joined = rows.join(F.broadcast(heads), "__part")
    end = F.col("__end")
    next_ifa = F.when(end, F.col("__head.ifa")).otherwise(F.col("__next_ifa"))
    has_next = F.coalesce(next_ifa == F.col("ifa"), F.lit(False))
    next_state = F.when(end, F.col("__head.state")).otherwise(F.col("__next_state"))
    return joined.select(*pts.columns, F.when(has_next, next_state).alias("next_state"), has_next.alias("has_next"))


def _linked_in_units(pts: DataFrame, minutes: int) -> DataFrame:
    keys = ["ifa", "__unit"]
    fields = pts.columns
    pts = pts.withColumn("__unit", _unit(F.col("seen_at"), minutes)).repartition(*keys)
    in_unit = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])
    linked = pts.withColumn("__next", F.lead(F.struct("state")).over(in_unit))

    firsts = pts.groupBy(*keys).agg(F.min(F.struct(*ORDER)).alias("__first"))
    across = Window.partitionBy("ifa").orderBy("__unit")
    following = firsts.select(*keys, F.lead(F.struct(F.col("__first.state").alias("state"))).over(across).alias("__after"))
    following = following.where(F.col("__after").isNotNull())
    joined = linked.join(following, keys, "left")
    after = F.coalesce("__next", "__after")
    return joined.select(*fields, after["state"].alias("next_state"), after.isNotNull().alias("has_next"))


def movement_table(points: DataFrame, devices: DataFrame | None = None, **kw) -> DataFrame:
    """D11 as a hand-over table (T8): ``city`` and ``brq_count`` kept, ``seen_at`` split into date, time, day, hour."""
    moves = movements(points, devices, carry=("city", "brq_count"), **kw)
    return moves.withColumns(
        {
            "date": F.to_date("seen_at"),
            "time": F.date_format("seen_at", "HH:mm:ss"),
            "day": weekday_name("seen_at"),
            "hour": F.hour("seen_at"),
        }
    )


def trips(moves: DataFrame) -> DataFrame:
    """Consecutive observations whose state changes.

    Both states must be known: a null state is never skipped over, so
    A, null, B yields no trip at all.  ``travel`` = ``<origin>_<destination>``.
    """
    return moves.where(
        F.col("has_next")
        & F.col("state").isNotNull()
        & F.col("next_state").isNotNull()
        & (F.col("state") != F.col("next_state"))
    ).withColumn(
        "travel", F.concat(F.col("state"), F.lit(config.TRAVEL_SEPARATOR), F.col("next_state"))
    )


def calendar_features(trip_rows: DataFrame, parts=config.DAYPARTS) -> DataFrame:
    """Day name, hour, weekday/weekend and daypart of the departure time."""
    hour = F.hour("seen_at")
    return trip_rows.withColumns(
        {
            "day": weekday_name("seen_at"),
            "hour": hour,
            "weekday_weekend": weekpart("seen_at"),
            "time_of_day": daypart(hour, parts),
        }
    )


PROFILE_KEYS = ("ifa", "travel", "weekday_weekend", "time_of_day")


def trip_profile(features: DataFrame) -> DataFrame:
    """Trips per device, trip key, weekpart and daypart."""
    return features.groupBy(*PROFILE_KEYS).agg(F.count(F.lit(1)).alias("count"))


def od_matrix(profile: DataFrame) -> DataFrame:
    """Trips per (trip key, weekpart, daypart), rolled up from the profile."""
    return profile.groupBy("travel", "weekday_weekend", "time_of_day").agg(
        F.sum("count").alias("count")
    )


def travel_counts(trip_rows: DataFrame) -> DataFrame:
    """V3: trips per trip key only."""
    return trip_rows.groupBy("travel").agg(F.count(F.lit(1)).alias("count"))


def undirected_travel(trip_rows: DataFrame) -> DataFrame:
    """V4: to-and-fro trips combined under one key ``<lesser>_<greater>``."""
    key = F.concat(
        F.least("state", "next_state"),
        F.lit(config.TRAVEL_SEPARATOR),
        F.greatest("state", "next_state"),
    )
    return trip_rows.groupBy(key.alias("route")).agg(F.count(F.lit(1)).alias("count"))


def top_trips(profile: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest profile rows; the key columns break count ties."""
    return profile.orderBy(F.col("count").desc(), *[F.col(c).asc() for c in PROFILE_KEYS]).limit(k)
