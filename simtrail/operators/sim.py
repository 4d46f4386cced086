"""Per-device carrier table, SIM ranking and the focal-carrier delta.

D5 ``carrier_wide``    carriers, carrier count, total and per-carrier scores
D6 ``sim_rank``        primary / secondary / third SIM
D7 ``focal_delta``     focal carrier's score minus its challenger(s)
D8 ``delta_segments``  devices and share per delta sign
D9 ``sim_breakdown``   devices per primary (or secondary) SIM

D5 is one aggregate keyed on the device: the pivot to per-carrier columns is
a conditional sum generated from the carrier list, so it adds no shuffle
(``groupBy().pivot()`` plans a second one).  D6-D7 are row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simtrail import config
from simtrail.config import CarrierSlots
from simtrail.functions.distinct import device_bitmaps, device_numbers, distinct_counts
from simtrail.session import materialize


def carrier_wide(score: DataFrame, slots: CarrierSlots = CarrierSlots()) -> DataFrame:
    """One row per device seen on more than one carrier.

    ``carriers``       sorted distinct carriers
    ``carrier_number`` their number (carriers outside ``slots`` count too)
    ``all_rfm``        sum of ``rfm`` over all the device's carriers, added in
                       carrier order so the double is the same on every run
    ``<carrier>_rfm``  score per slot carrier, lower-case name; 0.0 if absent
    """
    per_carrier = [
        F.sum(
            F.when(F.col("carrier") == F.lit(c), F.coalesce(F.col("rfm"), F.lit(0.0))).otherwise(F.lit(0.0))
        ).alias(slots.score_column(c))
        for c in slots.names
    ]
    # ``score`` has one row per (device, carrier): the collected arrays hold
    # at most one entry per carrier, whatever the device's activity.
    in_carrier_order = F.array_sort(F.collect_list(F.struct("carrier", "rfm")))
    total = F.aggregate(
        in_carrier_order, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["rfm"], F.lit(0.0))
    )
    carriers = F.collect_set("carrier")
    return (
        score.groupBy("ifa")
        .agg(
            F.sort_array(carriers).alias("carriers"),
            F.size(carriers).alias("carrier_number"),
            total.alias("all_rfm"),
            *per_carrier,
        )
        .where(F.col("carrier_number") > 1)
    )


def carrier_pivot(score: DataFrame, slots: CarrierSlots = CarrierSlots()) -> DataFrame:
    """A14 in ``pivot`` form: per-carrier score columns via ``groupBy().pivot()``.

    Same values as the conditional sums of ``carrier_wide``; kept for users of
    the pivot idiom.  Plans one more shuffle than ``carrier_wide``.
    """
    pivoted = score.groupBy("ifa").pivot("carrier", list(slots.names)).agg(F.sum("rfm"))
    return pivoted.select(
        "ifa", *[F.coalesce(F.col(c), F.lit(0.0)).alias(slots.score_column(c)) for c in slots.names]
    )


def _strictly(score: str, others: list[str], op: str) -> Column:
    cond = None
    for o in others:
        c = (F.col(score) > F.col(o)) if op == ">" else (F.col(score) < F.col(o))
        cond = c if cond is None else cond & c
    return cond


def sim_rank(wide: DataFrame, slots: CarrierSlots = CarrierSlots()) -> DataFrame:
    """``primary_sim``, ``secondary_sim``, ``third_sim`` from the slot scores.

    * primary: the carrier scoring strictly above both others, else ``'0'``
    * third: the carrier scoring strictly below both others, else ``'0'``
    * secondary: the remaining carrier when primary and third are two
      resolved carriers, else ``'others'``
    * a device with exactly two carriers has third ``'0'`` (applied after the
      secondary was derived from it)
    Ties therefore never pick a carrier.
    """
    names = list(slots.names)
    cols = {c: slots.score_column(c) for c in names}

    def pick(op: str) -> Column:
        expr = None
        for c in names:
            cond = _strictly(cols[c], [cols[o] for o in names if o != c], op)
            expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
        return expr.otherwise(F.lit(config.NO_SIM))

    primary, third = pick(">"), pick("<")
    secondary = None
    # Order of the tests: challenger 1, challenger 2, focal (the remaining one).
    for remaining in (slots.challenger_1, slots.challenger_2, slots.focal):
        rest = [c for c in names if c != remaining]
        cond = primary.isin(rest) & third.isin(rest)
        secondary = F.when(cond, F.lit(remaining)) if secondary is None else secondary.when(cond, F.lit(remaining))
    secondary = secondary.otherwise(F.lit(config.OTHER_SIM))
    # The two-carrier rule for third applies after secondary used it.
    third_final = F.when(F.col("carrier_number") == 2, F.lit(config.NO_SIM)).otherwise(third)
    return wide.select(
        "*", primary.alias("primary_sim"), secondary.alias("secondary_sim"), third_final.alias("third_sim")
    )


def focal_delta(ranked: DataFrame, slots: CarrierSlots = CarrierSlots(), rule: str = "ranked") -> DataFrame:
    """``delta_rfm``, the focal carrier's score against its challenger(s).

    ``rule="ranked"`` (default): if challenger 1 is primary or secondary,
    focal - challenger 1; else if challenger 2 is, focal - challenger 2; else
    focal - challenger 1 - challenger 2.  V2 variants: ``"total"`` is always
    focal - challenger 2 - challenger 1; ``"by_count"`` is focal -
    challenger 1 for three-carrier devices and the total rule otherwise.
    """
    s = F.col(slots.score_column(slots.focal))
    m = F.col(slots.score_column(slots.challenger_1))
    k = F.col(slots.score_column(slots.challenger_2))

    def holds(carrier: str) -> Column:
        return (F.col("secondary_sim") == F.lit(carrier)) | (F.col("primary_sim") == F.lit(carrier))

    if rule == "ranked":
        delta = F.when(holds(slots.challenger_1), s - m).when(holds(slots.challenger_2), s - k).otherwise(s - m - k)
    elif rule == "total":
        delta = s - k - m
    elif rule == "by_count":
        delta = F.when(F.col("carrier_number") == 3, s - m).otherwise(s - k - m)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return ranked.withColumn("delta_rfm", delta)


def sim_profile(delta: DataFrame, slots: CarrierSlots = CarrierSlots()) -> DataFrame:
    """T3 columns in hand-over order."""
    return delta.select(
        "ifa",
        "primary_sim",
        "secondary_sim",
        "third_sim",
        "all_rfm",
        *slots.score_columns,
        "delta_rfm",
    )


def delta_class(delta: str | Column = "delta_rfm") -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return (
        F.when(d > 0, F.lit("primary_focal"))
        .when(d < 0, F.lit("secondary_focal"))
        .when(d == 0, F.lit("either"))
    )


def delta_segments(profile: DataFrame) -> DataFrame:
    """Devices per delta sign and their share (percent) of all devices.

    One pass: group by the sign class; the total is a window sum over the
    (at most four) class rows.
    """
    counts = profile.groupBy(delta_class().alias("delta_class")).agg(
        F.count_distinct("ifa").alias("devices")
    )
    total = F.sum("devices").over(Window.partitionBy())
    return counts.withColumn(
        "share_pct", F.col("devices").cast("double") / total.cast("double") * F.lit(100.0)
    )


def sim_breakdown(profile: DataFrame, column: str = "primary_sim", ordered: bool = False) -> DataFrame:
    """D9 (A17): distinct devices per value of ``primary_sim`` / ``secondary_sim``.

    ``ordered`` sorts by count, largest first, then by the value (O3).
    """
    out = profile.groupBy(column).agg(F.count_distinct("ifa").alias("count"))
    return by_count_desc(out, [column]) if ordered else out


def sim_bitmaps(profile: DataFrame) -> DataFrame:
    """The devices of each (primary, secondary) SIM as bitmaps over the numbers of the profile's devices, written once."""
    numbered = profile.select("ifa", "primary_sim", "secondary_sim").join(device_numbers(profile), "ifa")
    return materialize(device_bitmaps(numbered, ["primary_sim", "secondary_sim"]), "sim-bitmaps")


def sim_breakdowns_merged(bitmaps: DataFrame) -> DataFrame:
    """D9 (A17) for both ranks from ``sim_bitmaps``: (rank, sim, count); each is a union over the other."""
    out = [
        distinct_counts(bitmaps, [c], "count").select(F.lit(c).alias("rank"), F.col(c).alias("sim"), "count")
        for c in ("primary_sim", "secondary_sim")
    ]
    return out[0].unionByName(out[1])


def by_count_desc(df: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """O3: largest count first; the key columns make the order unique."""
    return df.orderBy(F.col(count).desc(), *[F.col(k).asc() for k in keys])
