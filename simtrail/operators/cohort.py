"""Corridor cohorts: one origin-destination pair, both directions.

D15 ``corridor``              trip-profile rows of one corridor, trip key dropped
D16 ``corridor_by_weekpart`` / ``corridor_by_daypart`` / ``corridor_per_device``
D17 ``percentile_profile``    exact percentiles of a column
D18 ``tier``                  Low / Mid / High (/ Ultra High) by percentile cuts

Percentile cut points are an uncorrelated scalar subquery (one array value,
computed once), not a join and not a ``collect`` in user code.  The exact
percentiles are selected from range-partitioned value counts by prefix sums
(``functions.ranking.exact_percentiles``), so no task holds all distinct
values; ``accuracy`` switches to a bounded sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simtrail import config
from simtrail.functions.ranking import exact_percentiles
from simtrail.operators.sim import by_count_desc
from simtrail.session import materialize


def corridor(profile: DataFrame, a: str, b: str) -> DataFrame:
    """Profile rows travelling a -> b or b -> a, without the trip key."""
    return profile.where(F.col("travel").isin(list(config.corridor_keys(a, b)))).drop("travel")


def corridor_by_weekpart(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """D16 (A20): corridor trips per weekday/weekend. ``ordered``: largest first (O3)."""
    out = rows.groupBy("weekday_weekend").agg(F.sum("count").alias("count"))
    return by_count_desc(out, ["weekday_weekend"]) if ordered else out


def corridor_by_daypart(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """D16 (A21): corridor trips per daypart. ``ordered``: largest first (O3)."""
    out = rows.groupBy("time_of_day").agg(F.sum("count").alias("count"))
    return by_count_desc(out, ["time_of_day"]) if ordered else out


def corridor_per_device(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """D16 (A22): corridor trips per device. ``ordered``: largest first (O3)."""
    out = rows.groupBy("ifa").agg(F.sum("count").alias("count"))
    return by_count_desc(out, ["ifa"]) if ordered else out


def device_daypart(rows: DataFrame) -> DataFrame:
    """Corridor trips per (device, daypart)."""
    return rows.groupBy("ifa", "time_of_day").agg(F.sum("count").alias("count"))


def device_weekpart(rows: DataFrame) -> DataFrame:
    """Corridor trips per (device, weekday/weekend)."""
    return rows.groupBy("ifa", "weekday_weekend").agg(F.sum("count").alias("count"))


def _pct_name(p: float) -> str:
    return f"p{round(p * 100):02d}"


def _percentiles(df: DataFrame, column: str, ps: list[float], accuracy: int | None) -> DataFrame:
    """One row, column ``__p``: percentiles of the non-null values of ``column``."""
    if accuracy is None:
        return exact_percentiles(df, column, ps)
    # A bounded sketch: data values, error about 1 / accuracy of the rank.
    return df.where(F.col(column).isNotNull()).agg(F.percentile_approx(column, ps, accuracy).alias("__p"))


def percentile_profile(
    df: DataFrame,
    column: str = "count",
    percentages: Sequence[float] = config.DECILES,
    accuracy: int | None = None,
) -> DataFrame:
    """D17 (A23): one row, column ``pNN`` = percentile of ``column``.

    Exact by default, whatever the number of distinct values; ``df`` is read
    once.  ``accuracy`` switches to ``percentile_approx``, which writes nothing.
    """
    ps = list(percentages)
    return _percentiles(df, column, ps, accuracy).select(
        *[F.col("__p")[i].alias(_pct_name(p)) for i, p in enumerate(ps)]
    )


def tier(
    per_device: DataFrame,
    cuts: Sequence[float] = config.TIER_CUTS,
    labels: Sequence[tuple[str, str]] = config.TIER_LABELS,
    column: str = "count",
    checkpoint: bool = True,
    accuracy: int | None = None,
) -> DataFrame:
    """Tier of each device's corridor trip count.

    With cut values c1 < c2 < ... (percentiles ``cuts`` of the non-null
    counts): ``0 < n <= c1`` -> tier 1, ``c1 < n <= c2`` -> tier 2, ...,
    ``n > c_last`` -> last tier; anything else (n <= 0, null) has no tier.
    ``labels`` gives (tier_id, tier_level) per tier; two cuts give
    Low/Mid/High, three cuts (V6) add Ultra High.

    ``accuracy`` computes the cuts with ``percentile_approx`` instead of the
    exact percentile.  The per-device table is read twice (cut points,
    rows).  With ``checkpoint`` it is written once to the shared checkpoint
    folder, so the trips behind it are not computed twice; it has one row
    per device.
    """
    cuts = list(cuts)
    if checkpoint:
        per_device = materialize(per_device, "tier-input")
    if len(labels) < len(cuts) + 1:
        raise ValueError("need one label per tier")
    bounds = _percentiles(per_device, column, cuts, accuracy).scalar()
    # scalar subquery: one array, computed once
    return with_tier(per_device.withColumn("__cuts", bounds), cuts, labels, column)


def with_tier(
    rows: DataFrame, cuts: Sequence[float], labels: Sequence[tuple[str, str]] = config.TIER_LABELS, column: str = "count"
) -> DataFrame:
    """``tier_id`` and ``tier_level`` of ``column`` by the cut values in the array column ``__cuts``, which goes."""
    if len(labels) < len(cuts) + 1:
        raise ValueError("need one label per tier")
    n = F.col(column)
    c = [F.col("__cuts")[i] for i in range(len(cuts))]
    tier_id = F.when((n > 0) & (n <= c[0]), F.lit(labels[0][0]))
    for i in range(1, len(cuts)):
        tier_id = tier_id.when((n > c[i - 1]) & (n <= c[i]), F.lit(labels[i][0]))
    tier_id = tier_id.when(n > c[-1], F.lit(labels[len(cuts)][0]))
    level = None
    for tid, name in labels[: len(cuts) + 1]:
        cond = F.col("tier_id") == F.lit(tid)
        level = F.when(cond, F.lit(name)) if level is None else level.when(cond, F.lit(name))
    return rows.withColumn("tier_id", tier_id).withColumn("tier_level", level).drop("__cuts")
