"""Recency / frequency / monetary scoring per (device, carrier).

D1  ``multi_sim_devices``  devices seen on more than one carrier
D2  ``rfm_base``           recency, frequency and monetary value per (device, carrier)
D3  ``rfm_score``          global percent ranks scaled to 0-5, summed to 0-15
D4  ``rfm_distribution``   devices per metric value and carrier
V7  ``activity_state`` / ``merge_states`` / ``base_of_state``: D2 from mergeable period states
D22 ``key_check`` / ``score_maxima`` sanity aggregates

Plan shape of D2: one shuffle of the raw rows, partially aggregated to
(device, carrier, 64 days) with the active days as the bits of a long, then
one of those far fewer rows on the device alone; the (device, carrier)
aggregate and the per-device carrier count (a window) both reuse that
partitioning.  A device with a third of all raw rows reaches the first
shuffle as at most one row per carrier and 64 days per map task.
The global last day is an uncorrelated scalar subquery (one value computed
once), not a join.

The (device, carrier) table is read several times downstream (global bounds,
range bounds and rows of the first rank).  Catalyst prunes each reader's columns
differently, so their plans never share an exchange and every reader would
re-run the raw scan and both aggregations.  ``rfm_base`` therefore cuts the
lineage there: the table is written once under the session's shared
checkpoint folder and read back (``checkpoint=False`` keeps it lazy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simtrail import config
from simtrail.functions.calendar import day_diff, month_index
from simtrail.functions.ranking import ranged_runs, ranked_runs
from simtrail.session import discard, materialize


def valid_activity(activity: DataFrame, network: str | None = config.NETWORK_KEPT) -> DataFrame:
    """Rows that count: a known device and carrier on the kept network type."""
    out = activity.where(F.col("ifa").isNotNull() & F.col("carrier").isNotNull())
    if network is not None:
        out = out.where(F.col("network") == F.lit(network))
    return out


def multi_sim_devices(activity: DataFrame, network: str | None = config.NETWORK_KEPT) -> DataFrame:
    """(ifa, total_carriers) for devices with more than one distinct carrier.

    Two shuffles: the distinct (ifa, carrier) pairs, de-duplicated map-side
    first, then their count by ``ifa``.
    """
    return (
        valid_activity(activity, network)
        .groupBy("ifa")
        .agg(F.count_distinct("carrier").alias("total_carriers"))
        .where(F.col("total_carriers") > 1)
    )


def activity_state(activity: DataFrame, network: str | None = config.NETWORK_KEPT) -> DataFrame:
    """The mergeable state of some activity (V7): one row per (device, carrier, 64 days).

    ``days`` has a bit for each active day of the span, ``first`` and ``last``
    are the first and last day, ``brq`` the summed volume.  States of disjoint
    activity merge with ``merge_states`` in any order, so a later period is
    added without reading earlier raw rows.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    return (
        valid_activity(activity, network)
        .withColumns({"__day": day, "span": F.floor(day / F.lit(64))})
        .groupBy("ifa", "carrier", "span")
        .agg(
            F.min("date").alias("first"),
            F.max("date").alias("last"),
            F.bit_or(F.expr("shiftleft(1L, pmod(__day, 64))")).alias("days"),
            F.sum("brq_count").alias("brq"),
        )
    )


def merge_states(state: DataFrame) -> DataFrame:
    """One state of several: a day counts once however many of them hold it; volumes add up.

    One shuffle, on the device, which ``base_of_state`` reuses.
    """
    return (
        state.repartition("ifa")
        .groupBy("ifa", "carrier", "span")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or("days").alias("days"), F.sum("brq").alias("brq"))
    )


def rfm_base(
    activity: DataFrame,
    *,
    network: str | None = config.NETWORK_KEPT,
    normalise: str | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """One row per (device, carrier) of multi-carrier devices.

    ``recency_days``    days from the pair's last active day to the last day
                        of all multi-carrier activity, plus one (true date
                        difference, so month and year ends are right)
    ``data_usage_freq`` distinct active days
    ``brq_count``       summed activity volume
    ``usage_frequency`` / ``brq_m``: the two above divided by the number of
                        periods -- 1 by default; ``normalise="months"`` uses
                        the number of calendar months spanned (V1).
    """
    state = activity_state(activity, network).repartition("ifa")
    return base_of_state(state, normalise=normalise, checkpoint=checkpoint)


def base_of_state(state: DataFrame, *, normalise: str | None = None, checkpoint: bool = True) -> DataFrame:
    """D2 from a state with one row per (device, carrier, 64 days), as ``merge_states`` returns it."""
    per_pair = state.groupBy("ifa", "carrier").agg(
        F.min("first").alias("earliest_date"),
        F.max("last").alias("latest_date"),
        # distinct days; an unparsable date is no day
        F.sum(F.coalesce(F.bit_count("days"), F.lit(0))).alias("data_usage_freq"),
        F.sum("brq").alias("brq_count"),
    )
    multi = (
        per_pair.withColumn("__carriers", F.count(F.lit(1)).over(Window.partitionBy("ifa")))
        .where(F.col("__carriers") > 1)
        .drop("__carriers")
    )
    if checkpoint:
        multi = materialize(multi, "rfm-pairs")
    # The last (and first) day of all multi-carrier activity: a scalar
    # subquery, computed once -- no join, no collect in user code.
    bounds = multi.agg(
        F.struct(F.max("latest_date").alias("last"), F.min("earliest_date").alias("first"))
    ).scalar()
    last_date, first_date = F.col("__bounds.last"), F.col("__bounds.first")
    if normalise is None:
        periods: Column = F.lit(1)
    elif normalise == "months":
        periods = month_index(last_date) - month_index(first_date) + 1
    else:
        raise ValueError(f"unknown normalise {normalise!r}")
    return multi.withColumn("__bounds", bounds).select(
        "ifa",
        "carrier",
        (day_diff(last_date, "latest_date") + 1).alias("recency_days"),
        (F.col("data_usage_freq") / periods).alias("usage_frequency"),
        (F.col("brq_count") / periods).alias("brq_m"),
        "data_usage_freq",
        "brq_count",
    )


# (metric column, ascending?, percentile column, score column).  Recency is
# ranked descending: fewer days since last activity -> higher score.
RFM_METRICS = (
    ("recency_days", False, "r_percentile", "r"),
    ("usage_frequency", True, "f_percentile", "f"),
    ("brq_m", True, "m_percentile", "m"),
)


def rfm_score(rfm: DataFrame, *, method: str = "distributed") -> DataFrame:
    """D3: ``rfm`` plus the three percentiles, ``r``/``f``/``m`` in [0, 5] and ``rfm``.

    Percentiles equal Spark's ``percent_rank`` over the whole table.  With
    ``method="distributed"`` the rows are ranked in place, one metric after
    another: range partitioned on the metric, numbered and written, see
    ``functions.ranking``; no step joins on a value, and a value that a third
    of the rows share is spread over ranges.  ``method="window"`` uses the
    built-in over an un-partitioned window (single task; small inputs only).
    """
    scored, last = rfm, None
    for value, ascending, pct, _ in RFM_METRICS:
        if method == "window":
            order = F.col(value).asc() if ascending else F.col(value).desc()
            scored = scored.withColumn(pct, F.percent_rank().over(Window.orderBy(order)))
            continue
        rows = ranged_runs(scored, value, ascending=ascending)
        if last is not None:
            discard(last)
        scored, last = ranked_runs(rows, value, pct), rows
    scores = {s: F.col(p) * F.lit(5.0) for _, _, p, s in RFM_METRICS}
    # One projection: fewer plan versions for the analyzer; rfm = (r + f) + m.
    return scored.select(
        *rfm.columns,
        *[p for _, _, p, _ in RFM_METRICS],
        *[e.alias(s) for s, e in scores.items()],
        (scores["r"] + scores["f"] + scores["m"]).alias("rfm"),
    )


def rfm_distribution(rfm: DataFrame, metric: str, ordered: bool = False) -> DataFrame:
    """D4 (A6-A8): distinct devices per (metric value, carrier).

    ``ordered`` sorts by the metric value, then carrier (O1).
    """
    out = rfm.groupBy(metric, "carrier").agg(F.count_distinct("ifa").alias("ifa_count"))
    return out.orderBy(F.col(metric).asc(), F.col("carrier").asc()) if ordered else out


def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """D22 (A10): one row ``rows``, ``distinct_keys``; equal when the key is unique.

    Null key parts count as values, as ``select(keys).distinct().count()``.
    """
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.struct(*keys)).alias("distinct_keys"),
    )


def score_maxima(score: DataFrame) -> DataFrame:
    """D22 (A9): largest r, f and m in one pass."""
    return score.agg(*[F.max(s).alias(f"max_{s}") for _, _, _, s in RFM_METRICS])
