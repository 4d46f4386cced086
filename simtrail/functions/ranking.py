"""Exact ranks and quantiles of a whole table without a single-partition step over rows.

``F.percent_rank().over(Window.orderBy(x))`` has no partition key, so Spark
plans ``Exchange SinglePartition`` and sorts every row in one task.  At the
target scale that task is the whole job.  ``percent_rank`` gives the same
doubles by ranking the rows where they are:

1. ``ranged_runs``: the rows themselves are range partitioned on (value, hash
   of the row), so rows of one value that holds a third of the table spread
   over as many ranges as their number asks for.  Each range is sorted, a task
   numbers its rows and the first row of every run of equal values, and the
   numbered rows are written under the shared checkpoint folder.
2. ``range_offsets``: one row per range: the rows before it, and the rows
   before its first value, which may have begun in an earlier range.
3. Rows before a value = the offset of the range + the place of its run, or
   the carried start where the run continues from an earlier range.
   ``percent_rank = before / (n - 1)`` (0.0 when ``n <= 1``), the exact
   formula of Spark's built-in, so results are bit-equal.

There is no table of values and no join on the value; the only join is with
the one row per range, at most ``spark.sql.shuffle.partitions`` of them.

``exact_percentiles`` selects positions from ``value_counts``: one row per
distinct value, range partitioned, with the rows before it by prefix sums.
No task holds a map of all distinct values, as Spark's ``percentile`` does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simtrail.session import materialize


def value_counts(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows per distinct value (nulls included) of each column, as one written table.

    Columns: ``values``, ``__n`` (rows), ``__gid`` (which column the row
    counts; the others are null) and ``__part`` (number of the value range).
    Writing starts one job.
    """
    counts = df.groupingSets([[c] for c in values], *values).agg(
        F.count(F.lit(1)).alias("__n"), F.grouping_id().alias("__gid")
    )
    ranged = counts.repartitionByRange("__gid", *values).withColumn("__part", F.spark_partition_id())
    return materialize(ranged, "value-counts")


def value_positions(counts: DataFrame, value: str) -> DataFrame:
    """(``value``, ``__n``, ``__before``, ``__total``): rows of, and before, each distinct value (ascending, nulls first)."""
    values = [c for c in counts.columns if c not in ("__n", "__gid", "__part")]
    # grouping_id has a 1 bit for every column not in the set.
    gid = sum(1 << (len(values) - 1 - j) for j, c in enumerate(values) if c != value)
    own = counts.where(F.col("__gid") == F.lit(gid)).select(value, "__n", "__part")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: at most spark.sql.shuffle.partitions rows reach these un-partitioned windows.
    offsets = (
        own.groupBy("__part")
        .agg(F.sum("__n").alias("__pn"))
        .select(
            "__part",
            F.coalesce(F.sum("__pn").over(earlier), F.lit(0)).alias("__off"),
            F.sum("__pn").over(Window.partitionBy()).alias("__total"),
        )
    )
    within = Window.partitionBy("__part").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        own.withColumn("__within", F.coalesce(F.sum("__n").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "__part")
        .select(value, "__n", (F.col("__off") + F.col("__within")).alias("__before"), "__total")
    )


def grouped_positions(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``value_positions`` within each group of ``by``: (by, ``value``, ``__n``, ``__before``, ``__total``).

    The counts are range partitioned on (by, value), so one group may span
    ranges, and written once.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()), "group-value-counts")
    of_group = Window.partitionBy(*by)
    earlier = of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range and group reaches these windows.
    runs = counts.groupBy("__part", *by).agg(F.sum("__n").alias("__pn")).select(
        "__part", *by, F.coalesce(F.sum("__pn").over(earlier), F.lit(0)).alias("__off"), F.sum("__pn").over(of_group).alias("__total")
    )
    within = Window.partitionBy("__part", *by).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__within", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    return placed.join(runs, ["__part", *by]).select(*by, value, "__n", (F.col("__off") + F.col("__within")).alias("__before"), "__total")


def exact_percentiles(df: DataFrame, value: str, percentages: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row (one a group of ``by``), column ``__p``: the exact percentiles of the non-null values (null without any).

    The same interpolation, in the same order of operations, as Spark's
    ``percentile``.  Writing the value counts starts one job.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, value)
    at = grouped_positions(known, by, value) if by else value_positions(value_counts(known, [value]), value)
    found = []
    for p in percentages:
        position = (F.col("__total") - 1) * F.lit(float(p))
        ends = [F.floor(position), F.ceil(position)]
        inside = [(F.col("__before") <= e) & (e < F.col("__before") + F.col("__n")) for e in ends]
        low, high = (F.max(F.when(i, F.col(value).cast("double"))) for i in inside)
        found.append(F.struct(F.max(position).alias("at"), low.alias("low"), high.alias("high")))

    def between(e: Column) -> Column:
        mixed = (F.ceil(e["at"]) - e["at"]) * e["low"] + (e["at"] - F.floor(e["at"])) * e["high"]
        return F.when(e["low"] == e["high"], e["low"]).otherwise(mixed)

    row = at.groupBy(*by).agg(F.array(*found).alias("__ends"))
    return row.select(*by, F.when(F.col("__ends")[0]["low"].isNotNull(), F.transform("__ends", between)).alias("__p"))


def _number_runs(value: str):
    """Task function over the sorted rows of a range: place of each row, and of the first row of its run."""

    def number(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, first, held = 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            column = batch.column(value)
            both = column if held is None else pa.concat_arrays([held, column])
            a, b = both.slice(0, len(both) - 1), both.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            if pa.types.is_floating(column.type):  # NaN is one value, as in Spark's order
                same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
            new = ~same.to_numpy(zero_copy_only=False)
            if held is None:
                new = np.append(True, new)
            place = at + np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, first))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int64()), pa.array(start, pa.int64())], [*batch.schema.names, "__at", "__first"]
            )
            at, first, held = at + n, int(start[-1]), column.slice(n - 1, 1)

    return number


def ranged_runs(df: DataFrame, value: str, *, ascending: bool = True) -> DataFrame:
    """``df`` range partitioned and sorted on ``value``, written once.

    New columns: ``__part`` (number of the range), ``__at`` (place of the row
    in it) and ``__first`` (place of the first row of its run of equal
    values).  Rows of one value are spread by a hash of the whole row; only
    rows equal in every column stay together.
    """
    order = F.col(value).asc_nulls_first() if ascending else F.col(value).desc_nulls_last()
    added = [T.StructField(c, t) for c, t in (("__part", T.IntegerType()), ("__at", T.LongType()), ("__first", T.LongType()))]
    rows = (
        df.repartitionByRange(order, F.xxhash64(*df.columns))
        .sortWithinPartitions(order)
        .withColumn("__part", F.spark_partition_id())
        .mapInArrow(_number_runs(value), T.StructType([*df.schema.fields, *added]))
    )
    return materialize(rows, "ranged-rows")


def range_offsets(rows: DataFrame, value: str) -> DataFrame:
    """Per range of ``ranged_runs``: ``__off`` (rows before it), ``__carry`` (rows before its first value), ``__total``."""
    parts = rows.groupBy("__part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(value, "__at").alias("head"),
        F.max_by(value, "__at").alias("tail"),
        F.max("__first").alias("last_run"),
    )
    # One row per range reaches these un-partitioned windows.
    by_part = Window.orderBy("__part")
    off = F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    follows = F.lag(F.lit(True), 1, False).over(by_part) & F.col("head").eqNullSafe(F.lag("tail").over(by_part))
    parts = parts.select("__part", "n", "last_run", off.alias("__off"), follows.alias("follows"))
    # Where the last run of a range began: in it, unless the range is one run that follows on.
    begun = F.when(~(F.col("follows") & (F.col("last_run") == 0)), F.col("__off") + F.col("last_run"))
    parts = parts.withColumn("begun", F.last(begun, ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, 0)))
    carry = F.when(F.col("follows"), F.lag("begun").over(by_part)).otherwise(F.col("__off"))
    return parts.select("__part", "__off", carry.alias("__carry"), F.sum("n").over(Window.partitionBy()).alias("__total"))


def ranked_runs(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Rows of ``ranged_runs`` with column ``out``, their percent rank, instead of the run columns."""
    joined = rows.join(F.broadcast(range_offsets(rows, value)), "__part")
    before = F.when(F.col("__first") == 0, F.col("__carry")).otherwise(F.col("__off") + F.col("__first"))
    kept = [c for c in rows.columns if c not in ("__part", "__at", "__first")]
    return joined.select(*kept, _fraction(before, F.col("__total")).alias(out))


def _fraction(before: Column, total: Column) -> Column:
    # Same expression as Spark's PercentRank: (rank - 1) / (n - 1), 0 if n <= 1.
    return F.when(
        total > 1, before.cast("double") / (total - 1).cast("double")
    ).otherwise(F.lit(0.0))


def percent_rank(
    df: DataFrame,
    value: str,
    *,
    ascending: bool = True,
    out: str = "percent_rank",
    method: str = "distributed",
) -> DataFrame:
    """``df`` plus column ``out`` = global percent rank of ``value``.

    ``method="distributed"`` (default) is the plan described in the module
    docstring; it writes the numbered rows when called.  ``method="window"``
    is Spark's built-in over an un-partitioned window: one task sorts every
    row, so use it only for small inputs.
    """
    if method == "window":
        order = F.col(value).asc() if ascending else F.col(value).desc()
        return df.withColumn(out, F.percent_rank().over(Window.orderBy(order)))
    if method != "distributed":
        raise ValueError(f"unknown method {method!r}")
    return ranked_runs(ranged_runs(df, value, ascending=ascending), value, out)
