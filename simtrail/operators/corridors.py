"""D15-D21 for a table of corridors at once.

``operators.cohort`` and ``operators.segments`` answer one corridor;
``corridor_cohorts`` answers any number of them from one pass over the trip
profile: a join with the corridor table (two trip keys a corridor), whose rows
are written once, then

* one ``GROUPING SETS`` aggregate for the totals by weekpart, daypart and
  device of every corridor,
* one pass of exact percentiles by corridor for deciles and tier cuts,
* one join with the membership and one ``GROUPING SETS`` aggregate for the
  weekparts and dayparts by segment, and one more for the tiers.

The work does not grow with the number of corridors, only with their trips.
Every dataset has a ``corridor`` column, ``<a>_<b>`` as the pair was given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail import config
from simtrail.functions.ranking import exact_percentiles
from simtrail.operators import cohort
from simtrail.session import materialize


def corridor_name(a: str, b: str) -> str:
    return f"{a}{config.TRAVEL_SEPARATOR}{b}"


def corridor_table(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(corridor, travel): both trip keys of each pair; a pair given twice, or the other way round, counts once."""
    rows, seen = [], set()
    for a, b in pairs:
        if frozenset((a, b)) not in seen:
            seen.add(frozenset((a, b)))
            rows += [(corridor_name(a, b), key) for key in dict.fromkeys(config.corridor_keys(a, b))]
    return spark.createDataFrame(rows, "corridor string, travel string")


def corridor_rows(profile: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """D15 for all pairs: profile rows with their corridor instead of the trip key.

    The table has two rows for each pair of the argument list, so it may be broadcast.
    """
    return profile.join(F.broadcast(corridor_table(profile.sparkSession, pairs)), "travel").drop("travel")


def _sets(rows: DataFrame, sets: Sequence[Sequence[str]], agg, name: str) -> list[DataFrame]:
    """One aggregate over several sets of columns, written once; one table for each set."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    marked = rows.groupingSets([list(s) for s in sets], *columns).agg(agg, F.grouping_id().alias("__gid"))
    table = materialize(marked, name)
    out = []
    for s in sets:
        # grouping_id has a 1 bit for every column not in the set.
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        out.append(table.where(F.col("__gid") == F.lit(gid)).drop("__gid", *[c for c in columns if c not in s]))
    return out


def _with_all(parts: Sequence[DataFrame]) -> DataFrame:
    """The tables by segment and over all segments as one."""
    by_segment, overall = parts
    return by_segment.unionByName(overall.withColumn("segment", F.lit(config.ALL_SEGMENTS)))


def corridor_cohorts(
    profile: DataFrame,
    pairs: Sequence[tuple[str, str]],
    membership: DataFrame | None = None,
    cuts: Sequence[float] = config.TIER_CUTS,
    deciles: Sequence[float] = config.DECILES,
) -> dict[str, DataFrame]:
    """The datasets of ``plans.travel.corridor_report`` for all ``pairs``, each with a ``corridor`` column."""
    rows = materialize(corridor_rows(profile, pairs), "corridor-rows")
    total = F.sum("count").alias("count")
    weekpart, daypart, device = _sets(
        rows, [["corridor", "weekday_weekend"], ["corridor", "time_of_day"], ["corridor", "ifa"]], total, "corridor-totals"
    )
    wanted = list(dict.fromkeys([*deciles, *cuts]))
    found = materialize(exact_percentiles(device, "count", wanted, by=["corridor"]), "corridor-percentiles")
    at = {p: F.col("__p")[i] for i, p in enumerate(wanted)}
    cut_rows = found.select("corridor", F.array(*[at[c] for c in cuts]).alias("__cuts"))
    # One row a corridor.
    tiers = cohort.with_tier(device.join(F.broadcast(cut_rows), "corridor"), cuts)
    out = {
        "by_weekpart": weekpart,
        "by_daypart": daypart,
        "per_device": device,
        "deciles": found.select("corridor", *[at[p].alias(cohort._pct_name(p)) for p in deciles]),
        "tiers": tiers,
    }
    if membership is not None:
        members = membership.select("ifa", "segment")
        sets = [["corridor", "segment", "time_of_day"], ["corridor", "time_of_day"],
                ["corridor", "segment", "weekday_weekend"], ["corridor", "weekday_weekend"]]
        parts = _sets(rows.join(members, "ifa"), sets, total, "corridor-segments")
        out["segment_dayparts"], out["segment_weekparts"] = _with_all(parts[:2]), _with_all(parts[2:])
        out["segment_tiers"] = _with_all(
            _sets(
                tiers.join(members, "ifa"),
                [["corridor", "segment", "tier_level"], ["corridor", "tier_level"]],
                F.count_distinct("ifa").alias("ifa_count"),
                "corridor-tiers",
            )
        )
    return out
