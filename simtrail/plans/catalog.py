"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables through the stand-ins of
``simtrail.sources.standins`` and composes the library's operators; nothing
is collected.  Column names and types match ``simtrail.plans.oracle``.
Output columns are plain scalars (arrays as comma-joined text, timestamps
as text) so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail import config
from simtrail.operators import cohort, corridors, mobility, rfm, segments, sim
from simtrail.plans import sim_profile, travel
from simtrail.session import scratch_path
from simtrail.sources import readers, standins

Query = Callable[[SparkSession, str], DataFrame]

SLOTS = standins.STANDIN_SLOTS
CORRIDOR = standins.STANDIN_CORRIDOR
# Several corridors at once.
CORRIDORS = (CORRIDOR, ("purchase", "view"), ("click", "signup"))
# V7: a one-year run, the period form of the monthly / biweekly runs.
PERIOD = ("1997-01-01", "1997-12-31")
# V7: periods whose states are written apart and merged.
HALVES = (("1900-01-01", "1995-06-17"), ("1995-06-18", "2099-12-31"))
QUARTERS = (
    ("1996-10-01", "1996-12-31"),
    ("1997-01-01", "1997-03-31"),
    ("1997-04-01", "1997-06-30"),
    ("1997-07-01", "1997-09-30"),
    ("1997-10-01", "1997-12-31"),
)
# Days of a location scan that starts and ends within a month.
DAYS = ("2024-02-03", "2024-03-20")
# The events lie in one month: here their days lie so many days apart.
DAY_STEP = 4
# Segments of the stand-in membership.
SEGMENT_NAMES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


# --- job A building blocks ---------------------------------------------------
def _activity(spark, sf, period=None):
    start, end = period or (None, None)
    return standins.activity_from_orders(spark, sf, start, end)


def _base(spark, sf, period=None, normalise=None):
    return rfm.rfm_base(_activity(spark, sf, period), normalise=normalise)


def _scores(spark, sf, period=None):
    return rfm.rfm_score(_base(spark, sf, period))


def _ranked(spark, sf, period=None):
    return sim_profile.build_wide(_scores(spark, sf, period), SLOTS)


def _profile(spark, sf, period=None, rule="ranked"):
    return sim.sim_profile(sim.focal_delta(_ranked(spark, sf, period), SLOTS, rule), SLOTS)


SCORE_COLUMNS = [
    "ifa", "carrier", "recency_days", "usage_frequency", "brq_m", "data_usage_freq", "brq_count",
    "r_percentile", "f_percentile", "m_percentile", "r", "f", "m", "rfm",
]


def _wide_out(df: DataFrame) -> DataFrame:
    return df.select(
        "ifa",
        F.array_join("carriers", ",").alias("carriers"),
        "carrier_number",
        "all_rfm",
        *SLOTS.score_columns,
    )


# --- job B building blocks ---------------------------------------------------
def _points(spark, sf):
    return standins.points_from_events(spark, sf)


def _moves(spark, sf, devices=None):
    return mobility.movements(_points(spark, sf), devices)


def _features(spark, sf, devices=None):
    return travel.build_features(_points(spark, sf), devices)


def _trip_profile(spark, sf, devices=None):
    return travel.build_trip_profile(_points(spark, sf), devices)


def _corridor_rows(spark, sf):
    return cohort.corridor(_trip_profile(spark, sf), *CORRIDOR)


def _per_device(spark, sf):
    return cohort.corridor_per_device(_corridor_rows(spark, sf))


def _tiers(spark, sf, cuts=config.TIER_CUTS):
    return cohort.tier(_per_device(spark, sf), cuts)


def _cohorts(spark, sf, with_segments=False):
    members = _membership(spark, sf) if with_segments else None
    return corridors.corridor_cohorts(_trip_profile(spark, sf), CORRIDORS, members)


def _membership(spark, sf):
    return standins.segments_from_customer(spark, sf)


def _profiled_devices(spark, sf):
    return _profile(spark, sf).select("ifa")


POINT_COLUMNS = [
    "ifa", "date_format(seen_at, 'yyyy-MM-dd HH:mm:ss') AS seen_at", "city", "state", "country", "brq_count"
]


def _nested_points(spark, sf):
    return mobility.location_points(
        standins.nested_locations_from_events(spark, sf), config.COUNTRY_KEPT, tie_break="obs_id"
    )


# --- round trips through the job's own files ---------------------------------
def _profile_csv(spark, sf):
    path = scratch_path(spark, "profile-csv")
    readers.write_sim_profile(_profile(spark, sf).withColumn("ifa", F.col("ifa").cast("string")), path, fmt="csv")
    return readers.read_sim_profile(spark, path, SLOTS.score_columns, fmt="csv")


def _segment_folders(spark, sf):
    path = scratch_path(spark, "segments")
    readers.write_segments(_membership(spark, sf).withColumn("ifa", F.col("ifa").cast("string")), path)
    return readers.read_segments(spark, path)


def _activity_files(spark, sf):
    path = scratch_path(spark, "activity")
    rows = _activity(spark, sf).withColumn("ifa", F.col("ifa").cast("string"))
    readers.write_carrier_activity(rows, path)
    start, end = (day.replace("-", "") for day in PERIOD)
    return readers.read_carrier_activity(spark, path, start, end)


def _segment_plain_folders(spark, sf):
    path = scratch_path(spark, "segment-folders")
    names = _membership(spark, sf).select(F.col("ifa").cast("string").alias("ifa"), F.col("segment").alias("name"))
    # A plain folder a segment, as a producer without partition columns would leave them.
    for name in SEGMENT_NAMES:
        names.where(F.col("name") == name).select("ifa").write.parquet(f"{path}/{name}")
    return readers.read_segments(spark, path, layout="folders")


def _merged_base(spark, sf):
    """D2 from the states of two halves, each aggregated by a run of its own."""
    path = scratch_path(spark, "activity-state")
    for start, end in HALVES:
        state = rfm.activity_state(_activity(spark, sf, (start, end)))
        readers.write_activity_state(state, path, start.replace("-", ""), end.replace("-", ""))
    return rfm.base_of_state(rfm.merge_states(readers.read_activity_state(spark, path)))


def _profile_of_states(spark, sf):
    """The SIM profile of ``PERIOD`` from quarterly states; a quarter outside it is not read."""
    path = scratch_path(spark, "quarter-state")
    for start, end in QUARTERS:
        state = rfm.activity_state(_activity(spark, sf, (start, end)))
        readers.write_activity_state(state, path, start.replace("-", ""), end.replace("-", ""))
    first, last = (day.replace("-", "") for day in PERIOD)
    base = rfm.base_of_state(rfm.merge_states(readers.read_activity_state(spark, path, first, last)))
    ranked = sim_profile.build_wide(rfm.rfm_score(base), SLOTS)
    return sim.sim_profile(sim.focal_delta(ranked, SLOTS, "ranked"), SLOTS)


def _profile_parquet(spark, sf):
    """Written twice: the second write replaces the first only when its checks hold."""
    path = scratch_path(spark, "profile-parquet")
    profile = _profile(spark, sf).withColumn("ifa", F.col("ifa").cast("string"))
    readers.write_sim_profile(profile, path)
    readers.write_sim_profile(readers.read_sim_profile(spark, path, SLOTS.score_columns), path)
    return readers.read_sim_profile(spark, path, SLOTS.score_columns)


def _location_months(spark, sf):
    path = scratch_path(spark, "location-months")
    nested = standins.nested_locations_from_events(spark, sf, DAY_STEP).withColumn("ifa", F.col("ifa").cast("string"))
    readers.write_location_timeseries(nested, path)
    return mobility.location_points(readers.read_location_timeseries(spark, path, *DAYS), config.COUNTRY_KEPT)


def _location_files(spark, sf):
    path = scratch_path(spark, "locations")
    nested = standins.nested_locations_from_events(spark, sf).withColumn("ifa", F.col("ifa").cast("string"))
    nested.write.parquet(path)
    return mobility.location_points(readers.read_location_timeseries(spark, path), config.COUNTRY_KEPT)


FEATURE_COLUMNS = ["ifa", "obs_id", "state", "next_state", "travel", "day", "hour", "weekday_weekend", "time_of_day"]


# --- the catalog -------------------------------------------------------------
QUERIES: dict[str, Query] = {
    # scoring
    "multi_sim_devices": lambda s, d: rfm.multi_sim_devices(_activity(s, d)),
    "rfm_base": lambda s, d: _base(s, d),
    "rfm_base_monthly_norm": lambda s, d: _base(s, d, normalise="months"),
    "rfm_base_mixed": lambda s, d: rfm.rfm_base(standins.mixed_activity_from_orders(s, d)),
    "rfm_score": lambda s, d: _scores(s, d).select(*SCORE_COLUMNS),
    "recency_rank": lambda s, d: _scores(s, d).select("ifa", "carrier", "recency_days", "r_percentile"),
    "frequency_rank": lambda s, d: _scores(s, d).select("ifa", "carrier", "usage_frequency", "f_percentile"),
    "monetary_rank": lambda s, d: _scores(s, d).select("ifa", "carrier", "brq_m", "m_percentile"),
    "recency_distribution": lambda s, d: rfm.rfm_distribution(_base(s, d), "recency_days", ordered=True),
    "frequency_distribution": lambda s, d: rfm.rfm_distribution(_base(s, d), "data_usage_freq", ordered=True),
    "monetary_distribution": lambda s, d: rfm.rfm_distribution(_base(s, d), "brq_m", ordered=True),
    "score_key_check": lambda s, d: rfm.key_check(_scores(s, d), ["ifa", "carrier"]),
    "score_maxima": lambda s, d: rfm.score_maxima(_scores(s, d)),
    # SIM profile
    "carrier_wide": lambda s, d: _wide_out(sim.carrier_wide(_scores(s, d), SLOTS)),
    "carrier_pivot": lambda s, d: sim.carrier_pivot(_scores(s, d), SLOTS),
    "sim_rank": lambda s, d: _ranked(s, d).select(
        "ifa", "carrier_number", *SLOTS.score_columns, "primary_sim", "secondary_sim", "third_sim"
    ),
    "sim_profile": lambda s, d: _profile(s, d),
    "sim_profile_period": lambda s, d: _profile(s, d, PERIOD),
    "focal_delta_total": lambda s, d: _profile(s, d, rule="total").select("ifa", "delta_rfm"),
    "focal_delta_by_count": lambda s, d: _profile(s, d, rule="by_count").select("ifa", "delta_rfm"),
    "profile_key_check": lambda s, d: rfm.key_check(_profile(s, d), ["ifa"]),
    "carrier_number_values": lambda s, d: sim.carrier_wide(_scores(s, d), SLOTS).select("carrier_number").distinct(),
    "delta_segments": lambda s, d: sim.delta_segments(_profile(s, d)),
    "delta_segments_period": lambda s, d: sim.delta_segments(_profile(s, d, PERIOD)),
    "primary_sim_breakdown": lambda s, d: sim.sim_breakdown(_profile(s, d), "primary_sim", ordered=True),
    "secondary_sim_breakdown": lambda s, d: sim.sim_breakdown(_profile(s, d), "secondary_sim", ordered=True),
    # mobility
    "location_points": lambda s, d: _nested_points(s, d).selectExpr("obs_id", *POINT_COLUMNS),
    "movement_table": lambda s, d: mobility.movement_table(_nested_points(s, d)).select(
        "ifa", "obs_id", "city", "state", "brq_count", F.date_format("date", "yyyy-MM-dd").alias("date"),
        "time", "day", "hour", "next_state", "has_next",
    ),
    "trips_tied": lambda s, d: travel.build_features(standins.tied_points_from_events(s, d)).select(
        "ifa", "state", "next_state", "travel", "day", "hour", "weekday_weekend", "time_of_day"
    ),
    "movements": lambda s, d: _moves(s, d).select("ifa", "obs_id", "state", "next_state", "has_next"),
    "trips": lambda s, d: _features(s, d).select(*FEATURE_COLUMNS),
    "trip_profile": lambda s, d: _trip_profile(s, d),
    "od_matrix": lambda s, d: mobility.od_matrix(_trip_profile(s, d)),
    "travel_counts": lambda s, d: mobility.travel_counts(mobility.trips(_moves(s, d))),
    "undirected_travel": lambda s, d: mobility.undirected_travel(mobility.trips(_moves(s, d))),
    "top_trips": lambda s, d: mobility.top_trips(_trip_profile(s, d), 10),
    "profiled_trip_profile": lambda s, d: _trip_profile(s, d, _profiled_devices(s, d)),
    "profiled_trips_early": lambda s, d: travel.build_features(
        _points(s, d), _profiled_devices(s, d), restrict="early"
    ).select(*FEATURE_COLUMNS),
    # Through the job's own files
    "profile_csv_round_trip": _profile_csv,
    "segments_round_trip": _segment_folders,
    "locations_round_trip": lambda s, d: _location_files(s, d).selectExpr(*POINT_COLUMNS),
    "locations_of_days": lambda s, d: _location_months(s, d).selectExpr(*POINT_COLUMNS),
    "activity_of_period": lambda s, d: _activity_files(s, d).withColumn("date", F.date_format("date", "yyyy-MM-dd")),
    "segment_folders_round_trip": _segment_plain_folders,
    "profile_replaced_round_trip": _profile_parquet,
    # V7: from mergeable period states
    "rfm_base_merged": _merged_base,
    "sim_profile_of_states": _profile_of_states,
    # Corridor cohorts
    "corridor_by_weekpart": lambda s, d: cohort.corridor_by_weekpart(_corridor_rows(s, d), ordered=True),
    "corridor_by_daypart": lambda s, d: cohort.corridor_by_daypart(_corridor_rows(s, d), ordered=True),
    "corridor_per_device": lambda s, d: _per_device(s, d),
    "corridor_deciles": lambda s, d: cohort.percentile_profile(_per_device(s, d)),
    "corridor_tiers": lambda s, d: _tiers(s, d),
    "corridor_tiers_four": lambda s, d: _tiers(s, d, config.TIER_CUTS_FOUR),
    "tier_levels": lambda s, d: _tiers(s, d).select("tier_level").distinct(),
    # Exact distinct counts from mergeable bitmaps
    "segment_tier_merged": lambda s, d: segments.segment_tier_profile_merged(
        segments.segment_tier_bitmaps(_tiers(s, d), _membership(s, d))
    ),
    "sim_breakdowns_merged": lambda s, d: sim.sim_breakdowns_merged(sim.sim_bitmaps(_profile(s, d))),
    # D15-D21 for several corridors in one pass
    "corridors_by_weekpart": lambda s, d: _cohorts(s, d)["by_weekpart"],
    "corridors_by_daypart": lambda s, d: _cohorts(s, d)["by_daypart"],
    "corridors_per_device": lambda s, d: _cohorts(s, d)["per_device"],
    "corridors_deciles": lambda s, d: _cohorts(s, d)["deciles"],
    "corridors_tiers": lambda s, d: _cohorts(s, d)["tiers"],
    "corridors_segment_tiers": lambda s, d: _cohorts(s, d, True)["segment_tiers"],
    "corridors_segment_dayparts": lambda s, d: _cohorts(s, d, True)["segment_dayparts"],
    "corridors_segment_weekparts": lambda s, d: _cohorts(s, d, True)["segment_weekparts"],
    # segments
    "segment_tier_profile": lambda s, d: segments.segment_tier_profile(_tiers(s, d), _membership(s, d)),
    "segment_daypart_profile": lambda s, d: segments.segment_daypart_profile(
        cohort.device_daypart(_corridor_rows(s, d)), _membership(s, d)
    ),
    "segment_weekpart_profile": lambda s, d: segments.segment_weekpart_profile(
        cohort.device_weekpart(_corridor_rows(s, d)), _membership(s, d)
    ),
    "segment_travel": lambda s, d: segments.segment_travel(_trip_profile(s, d), _membership(s, d)),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SIM profile: job A end to end."""
    return _profile(spark, sf_dir)
