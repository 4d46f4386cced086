"""Readers and writers for the job's own tables (T1-T4), with declared schemas.

Paths may be directories, globs or lists.  Period and segment selection are
expressed as filters on columns so Spark prunes partitions and pushes the
predicate into the Parquet scan instead of relying on path wildcards.

Raw inputs that this module writes lie in ``month=`` folders: a reader with
period bounds lists and opens only the months between them
(``PartitionFilters``), then filters days.  Inputs without such folders are
read as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simtrail import schemas
from simtrail.functions.calendar import parse_yyyymmdd
from simtrail.sources.sinks import write_checked

# Three scores of at most 5 each.
SCORE_MAX = 15.0


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _check_columns(spark: SparkSession, paths: list[str], schema: T.StructType) -> list[str]:
    """The columns present in ``paths``; one that ``schema`` declares and the files lack is an error."""
    present = spark.read.parquet(*paths).columns
    missing = [c for c in schema.names if c not in present]
    if missing:
        raise ValueError(f"columns {missing} are missing in {paths}; found {present}")
    return present


def _parquet(spark: SparkSession, paths: list[str], schema: T.StructType, hidden: str | None = None) -> DataFrame:
    """Parquet with a declared schema; a declared column that the files lack is an error, not nulls.

    ``hidden`` is a partition column that is read (as a string) where it exists.
    """
    if hidden in _check_columns(spark, paths, schema):
        schema = T.StructType([*schema.fields, T.StructField(hidden, T.StringType())])
    return spark.read.schema(schema).parquet(*paths)


def _folders(spark: SparkSession, root: str) -> list[str]:
    """Sub-folders of ``root`` that hold data, on whatever storage it lies."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = [s.getPath().toString() for s in found if s.isDirectory()]
    return sorted(n for n in names if n.rsplit("/", 1)[1][0] not in "_.")


def _months(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """``df`` of the months between the bounds, without its ``month`` partition column if it has one."""
    if "month" not in df.columns:
        return df
    if first is not None:
        df = df.where(F.col("month") >= F.lit(first))
    if last is not None:
        df = df.where(F.col("month") <= F.lit(last))
    return df.drop("month")


def read_carrier_activity(
    spark: SparkSession,
    path: str | Sequence[str],
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Carrier activity with ``date`` parsed to DATE.

    ``start``/``end`` are inclusive ``yyyyMMdd`` bounds.  They filter the raw
    string column, which sorts like the date it encodes, so the predicate is
    pushed into the Parquet scan (and prunes ``date`` partitions if any).
    """
    raw = _months(
        _parquet(spark, _paths(path), schemas.CARRIER_ACTIVITY_RAW, hidden="month"),
        start and start[:6],
        end and end[:6],
    )
    if start is not None:
        raw = raw.where(F.col("date") >= F.lit(start))
    if end is not None:
        raw = raw.where(F.col("date") <= F.lit(end))
    return raw.withColumn("date", parse_yyyymmdd("date"))


def write_carrier_activity(activity: DataFrame, path: str) -> None:
    """T1 in ``month=yyyyMM`` folders; only the months of ``activity`` are replaced.

    ``activity`` is what ``read_carrier_activity`` returns (``date`` as DATE)
    or the raw form (``yyyyMMdd`` text).
    """
    kind = dict(activity.dtypes)["date"]
    text = F.col("date") if kind == "string" else F.date_format("date", "yyyyMMdd")
    rows = activity.select("ifa", "carrier", "network", text.alias("date"), "brq_count")
    _by_month(rows.withColumn("month", F.substring("date", 1, 6)), path)


def write_location_timeseries(nested: DataFrame, path: str) -> None:
    """T2 in ``month=yyyy-MM`` folders; an array that spans months becomes one row a month.

    Only the months of ``nested`` are replaced.  Rows without points are not written.
    """
    month_of = lambda p: F.substring(p["last_seen"], 1, 7)
    months = F.array_distinct(F.transform("gps", month_of))
    rows = nested.select("ifa", "gps", F.explode(months).alias("month"))
    gps = F.filter("gps", lambda p: month_of(p).eqNullSafe(F.col("month")))
    _by_month(rows.select("ifa", gps.alias("gps"), "month"), path)


def _by_month(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


STATE_COLUMNS = ("ifa", "carrier", "span", "first", "last", "days", "brq")


def write_activity_state(state: DataFrame, path: str, start: str, end: str) -> None:
    """V7: the state of one period (``rfm.activity_state``) under its inclusive ``yyyyMMdd`` bounds.

    Only that period is replaced; other periods stay as they are.
    """
    bounds = {"period_start": F.lit(start), "period_end": F.lit(end)}
    rows = state.select(*STATE_COLUMNS).withColumns(bounds)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*bounds).parquet(path)


def read_activity_state(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """V7: the states of all periods within the bounds, for ``rfm.merge_states``.

    A period that reaches over a bound, or two that overlap, are an error:
    their volumes cannot be told apart.
    """
    table = spark.read.parquet(path)
    table = table.withColumns({c: F.col(c).cast("string") for c in ("period_start", "period_end")})
    # One row a period: as many as runs were written.
    periods = sorted((r[0], r[1]) for r in table.select("period_start", "period_end").distinct().collect())
    lo, hi = start or "", end or "9"
    inside = [(a, b) for a, b in periods if b >= lo and a <= hi]
    cut = [p for p in inside if p[0] < lo or p[1] > hi]
    if cut:
        raise ValueError(f"periods {cut} reach over {start} .. {end}")
    for a, b in zip(inside, inside[1:]):
        if b[0] <= a[1]:
            raise ValueError(f"periods {a} and {b} overlap")
    rows = table.where((F.col("period_start") >= F.lit(lo)) & (F.col("period_end") <= F.lit(hi)))
    return rows.select(*STATE_COLUMNS)


def read_location_timeseries(
    spark: SparkSession,
    path: str | Sequence[str],
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Nested per-device observations.

    ``start``/``end`` are inclusive ``yyyy-MM-dd`` days.  They filter the
    array by the text of ``last_seen``, which sorts like the time it encodes,
    before anything is exploded.

    The declared schema lists only the struct fields the job uses, so the scan
    reads just those leaves of ``gps`` (nested pruning does not reach through
    ``explode`` on its own once several fields are used).
    """
    nested = _months(
        _parquet(spark, _paths(path), schemas.LOCATION_TIMESERIES, hidden="month"),
        start and start[:7],
        end and end[:7],
    )
    if start is not None:
        nested = nested.withColumn("gps", F.filter("gps", lambda p: p["last_seen"] >= F.lit(start)))
    if end is not None:
        nested = nested.withColumn("gps", F.filter("gps", lambda p: F.substring(p["last_seen"], 1, 10) <= F.lit(end)))
    return nested


def read_sim_profile(
    spark: SparkSession,
    path: str | Sequence[str],
    score_columns: Sequence[str],
    fmt: str = "parquet",
) -> DataFrame:
    """S3: the SIM profile, typed.  A CSV whose header or values do not fit the schema is an error."""
    schema = schemas.sim_profile_schema(list(score_columns))
    if fmt == "csv":
        return spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST").csv(_paths(path))
    return _parquet(spark, _paths(path), schema)


def write_sim_profile(
    profile: DataFrame,
    path: str,
    fmt: str = "parquet",
    single_file: bool = False,
) -> None:
    """Write the SIM profile in place of an earlier one, checked by the same job.

    One row a device, named-carrier scores between 0 and 15 and a total of at
    least 0, or ``sinks.CheckFailed`` and the earlier profile stays.
    ``single_file`` is opt-in and for small hand-offs: one task writes the
    file; everything before that write stays parallel.
    """
    plain = {"ifa", "primary_sim", "secondary_sim", "third_sim", "all_rfm", "delta_rfm"}
    bounds = {c: (0.0, SCORE_MAX) for c in profile.columns if c not in plain} | {"all_rfm": (0.0, None)}
    write_checked(profile, path, keys=["ifa"], bounds=bounds, fmt=fmt, single_file=single_file)


def read_segments(
    spark: SparkSession,
    root: str,
    segments: Sequence[str] | None = None,
    layout: str = "partitioned",
) -> DataFrame:
    """Segment membership, all segments as one table (ifa, segment).

    ``layout="partitioned"``: ``<root>/segment=<name>/`` folders, written by
    ``write_segments``; choosing ``segments`` is a partition filter, so only
    those folders are listed and read.  ``layout="folders"``: plain
    ``<root>/<name>/*.parquet`` folders; the folder name becomes ``segment``.
    Either way the union of all segments is one scan, not one read each.
    """
    if layout == "partitioned":
        df = spark.read.schema(schemas.SEGMENT_MEMBERSHIP).parquet(root)
        if segments:
            df = df.where(F.col("segment").isin(list(segments)))
    elif layout == "folders":
        paths = [f"{root.rstrip('/')}/{s}" for s in segments] if segments else _folders(spark, root)
        schema = T.StructType([schemas.SEGMENT_MEMBERSHIP["ifa"]])
        for folder in paths:  # one footer a segment
            _check_columns(spark, [folder], schema)
        folder_name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        df = spark.read.schema(schema).parquet(*paths).withColumn("segment", F.url_decode(folder_name))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return df.select("ifa", "segment")


def write_segments(membership: DataFrame, root: str) -> None:
    """Write (ifa, segment) partitioned by segment, for ``read_segments``."""
    membership.select("ifa", "segment").write.mode("overwrite").partitionBy("segment").parquet(root)
