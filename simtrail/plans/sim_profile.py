"""Job A: carrier activity -> multi-SIM profile (one row per device).

``build_scores`` and ``build_profile`` return DataFrames, but building them
writes two tables: the per-(device, carrier) table inside ``rfm_base`` and
the value counts inside ``rfm_score`` (the two fan-out points).  ``run`` writes the profile;
``run_reports`` writes the analysis tables of a written profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from simtrail.config import CarrierSlots
from simtrail.operators import rfm as rfm_ops
from simtrail.operators import sim as sim_ops
from simtrail.sources import readers


def build_scores(
    activity: DataFrame,
    *,
    network: str | None = "cellular",
    normalise: str | None = None,
    method: str = "distributed",
) -> DataFrame:
    """Scored (device, carrier) rows of multi-carrier devices."""
    base = rfm_ops.rfm_base(activity, network=network, normalise=normalise)
    return rfm_ops.rfm_score(base, method=method)


def build_wide(scores: DataFrame, slots: CarrierSlots = CarrierSlots()) -> DataFrame:
    """D5-D7 before the final projection (keeps ``carriers``, ``carrier_number``)."""
    ranked = sim_ops.sim_rank(sim_ops.carrier_wide(scores, slots), slots)
    return ranked


def build_profile(
    activity: DataFrame,
    slots: CarrierSlots = CarrierSlots(),
    *,
    network: str | None = "cellular",
    normalise: str | None = None,
    delta_rule: str = "ranked",
    method: str = "distributed",
) -> DataFrame:
    """The SIM profile (T3 columns)."""
    scores = build_scores(activity, network=network, normalise=normalise, method=method)
    ranked = build_wide(scores, slots)
    return sim_ops.sim_profile(sim_ops.focal_delta(ranked, slots, delta_rule), slots)


def run(
    spark,
    activity_path: str,
    out_path: str,
    *,
    start: str | None = None,
    end: str | None = None,
    slots: CarrierSlots = CarrierSlots(),
    network: str | None = "cellular",
    normalise: str | None = None,
    delta_rule: str = "ranked",
    fmt: str = "parquet",
    single_file: bool = False,
) -> None:
    """Read one period of activity (``yyyyMMdd`` bounds) and write its profile."""
    activity = readers.read_carrier_activity(spark, activity_path, start, end)
    profile = build_profile(activity, slots, network=network, normalise=normalise, delta_rule=delta_rule)
    readers.write_sim_profile(profile, out_path, fmt=fmt, single_file=single_file)


def run_reports(
    spark,
    profile_path: str,
    out_root: str,
    *,
    slots: CarrierSlots = CarrierSlots(),
    fmt: str = "parquet",
) -> dict[str, str]:
    """The analysis step: delta classes and SIM breakdowns of a written profile.

    Reads the profile back (typed, also from CSV) and writes
    ``delta_segments``, ``primary_sim`` and ``secondary_sim`` under
    ``out_root``; returns ``{dataset: path}``.
    """
    profile = readers.read_sim_profile(spark, profile_path, slots.score_columns, fmt=fmt)
    outputs = {
        "delta_segments": sim_ops.delta_segments(profile),
        "primary_sim": sim_ops.sim_breakdown(profile, "primary_sim", ordered=True),
        "secondary_sim": sim_ops.sim_breakdown(profile, "secondary_sim", ordered=True),
    }
    written = {}
    for name, df in outputs.items():
        path = f"{out_root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        written[name] = path
    return written
