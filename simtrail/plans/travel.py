"""Job B: location observations of profiled devices -> trips -> corridor cohorts.

Building the trips writes the ordered observations (``mobility.movements``).
``corridor_report`` returns every dataset of one corridor,
``corridors.corridor_cohorts`` those of any number of corridors from one pass;
``run`` uses the latter on a trip profile that it writes once to the shared
checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simtrail import config
from simtrail.operators import cohort, mobility, segments
from simtrail.operators import corridors as corridors_ops
from simtrail.session import delete_path, materialize
from simtrail.sources import readers
from simtrail.sources.sinks import replace_folder


def build_features(
    points: DataFrame,
    devices: DataFrame | None = None,
    restrict: str = "early",
    unit_minutes: int | None = None,
) -> DataFrame:
    """Trips with calendar features, of ``devices`` only if given.

    Trips are computed per device, so keeping a device list before or after
    the computation gives the same rows.  ``restrict="early"`` (default)
    filters observations first, so only those of listed devices are shuffled
    and sorted; ``restrict="late"`` runs the semi join on the trip rows.
    """
    if restrict == "early":
        moves = mobility.movements(points, devices, unit_minutes=unit_minutes)
        return mobility.calendar_features(mobility.trips(moves))
    if restrict != "late":
        raise ValueError(f"unknown restrict {restrict!r}")
    moves = mobility.movements(points, unit_minutes=unit_minutes)
    return mobility.restrict_to_devices(mobility.calendar_features(mobility.trips(moves)), devices)


def build_trip_profile(
    points: DataFrame,
    devices: DataFrame | None = None,
    restrict: str = "early",
    unit_minutes: int | None = None,
) -> DataFrame:
    """The per-device trip profile.

    With ``restrict="late"`` the device list meets the aggregated profile
    (a few rows per device), the smallest point of the pipeline.
    """
    if restrict == "early":
        return mobility.trip_profile(build_features(points, devices, "early", unit_minutes))
    profile = mobility.trip_profile(build_features(points, None, "late", unit_minutes))
    return mobility.restrict_to_devices(profile, devices)


def corridor_report(
    profile: DataFrame,
    a: str,
    b: str,
    membership: DataFrame | None = None,
    cuts: Sequence[float] = config.TIER_CUTS,
) -> dict[str, DataFrame]:
    """D15-D21 for the corridor a <-> b."""
    rows = cohort.corridor(profile, a, b)
    per_device = cohort.corridor_per_device(rows)
    tiers = cohort.tier(per_device, cuts)
    out = {
        "by_weekpart": cohort.corridor_by_weekpart(rows),
        "by_daypart": cohort.corridor_by_daypart(rows),
        "per_device": per_device,
        "deciles": cohort.percentile_profile(per_device),
        "tiers": tiers,
    }
    if membership is not None:
        out["segment_tiers"] = segments.segment_tier_profile(tiers, membership)
        out["segment_dayparts"] = segments.segment_daypart_profile(cohort.device_daypart(rows), membership)
        out["segment_weekparts"] = segments.segment_weekpart_profile(cohort.device_weekpart(rows), membership)
    return out


def run(
    spark,
    locations_path: str,
    profile_path: str,
    out_root: str,
    *,
    score_columns: Sequence[str],
    profile_format: str = "parquet",
    segments_root: str | None = None,
    segments_layout: str = "partitioned",
    corridors: Sequence[tuple[str, str]] = config.CORRIDORS,
    country: str | None = config.COUNTRY_KEPT,
    cuts: Sequence[float] = config.TIER_CUTS,
    unit_minutes: int | None = None,
    restrict: str = "early",
    start: str | None = None,
    end: str | None = None,
) -> dict[str, str]:
    """Job B end to end; returns ``{dataset: path}`` of everything written.

    The trip profile feeds the OD matrix and every corridor report, so it is
    written once (``materialize``) and each output reads that table.
    ``start``/``end`` are inclusive ``yyyy-MM-dd`` days of the observations.
    """
    points = mobility.location_points(readers.read_location_timeseries(spark, locations_path, start, end), country)
    devices = readers.read_sim_profile(spark, profile_path, score_columns, fmt=profile_format)
    profile = materialize(
        build_trip_profile(points, devices, restrict, unit_minutes), "trip-profile"
    )
    membership = (
        readers.read_segments(spark, segments_root, layout=segments_layout) if segments_root else None
    )
    written: dict[str, str] = {}

    def save(df: DataFrame, name: str) -> None:
        path = f"{out_root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        written[name] = path

    save(profile, "trip_profile")
    save(mobility.od_matrix(profile), "od_matrix")
    keys = {corridors_ops.corridor_name(a, b): f"corridor={f'{a}_{b}'.replace(' ', '_').lower()}" for a, b in corridors}
    for name, df in corridors_ops.corridor_cohorts(profile, corridors, membership, cuts).items():
        written |= save_by_corridor(df, out_root, name, keys)
    return written


def save_by_corridor(df: DataFrame, out_root: str, name: str, keys: dict[str, str]) -> dict[str, str]:
    """Write all corridors of one dataset in one job, as ``<out_root>/<key>/<name>``; ``keys``: folder by corridor.

    The job writes a folder a corridor beside the results; each is then moved
    to its place.  A corridor without rows gets an empty table.
    """
    spark = df.sparkSession
    root = out_root.rstrip("/")
    staging = f"{root}/_{name}-{uuid.uuid4().hex}"
    number = F.array_position(F.array(*[F.lit(c) for c in keys]), F.col("corridor"))
    df.withColumn("__n", number).drop("corridor").write.partitionBy("__n").parquet(staging)
    written = {}
    for n, key in enumerate(keys.values(), 1):
        path = f"{root}/{key}/{name}"
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{staging}/__n={n}")
        if part.getFileSystem(spark._jsc.hadoopConfiguration()).exists(part):
            replace_folder(spark, part.toString(), path)
        else:
            spark.createDataFrame([], df.drop("corridor").schema).write.mode("overwrite").parquet(path)
        written[f"{key}/{name}"] = path
    delete_path(spark, staging)
    return written
