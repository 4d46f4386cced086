"""S6 sinks that check while they write and replace a result only when it is whole.

``write_checked`` writes to a sibling folder, with the checks observed by the
same job (``DataFrame.observe``: no second scan), and moves the folder to its
name only if the write ended and every check holds.  A job that fails, or a
result with a repeated key, leaves the earlier result readable.

Every check counts rows that must not exist, so a task that ran twice cannot
turn a good result into a bad one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from simtrail.session import delete_path

Bounds = Mapping[str, tuple[float | None, float | None]]


class CheckFailed(ValueError):
    """A result that was written but not handed over; ``counts`` has the offending rows by check."""

    def __init__(self, path: str, counts: dict[str, int]):
        super().__init__(f"{path} was not replaced; rows that fail a check: {counts}")
        self.counts = counts


def checked(df: DataFrame, keys: Sequence[str] = (), bounds: Bounds | None = None) -> tuple[DataFrame, Observation | None]:
    """``df`` and the observation of its checks: null and repeated keys, values out of bounds (nulls are).

    A table that is already hash partitioned on the keys is not shuffled again.
    """
    tests = {}
    if keys:
        df = df.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        tests["repeated key"] = F.col("__same") > 1
        tests["null key"] = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    for column, (low, high) in (bounds or {}).items():
        value = F.col(column)
        good = value.isNotNull()
        if low is not None:
            good &= value >= low
        if high is not None:
            good &= value <= high
        tests[f"{column} out of bounds"] = ~good
    if not tests:
        return df, None
    seen = Observation()
    out = df.observe(seen, *[F.count_if(t).alias(name) for name, t in tests.items()])
    return out.drop("__same"), seen


def write_checked(
    df: DataFrame,
    path: str,
    *,
    keys: Sequence[str] = (),
    bounds: Bounds | None = None,
    fmt: str = "parquet",
    single_file: bool = False,
) -> None:
    """Write ``df`` to ``path`` (replacing it) if the write ends and all checks hold; else raise and leave ``path`` alone."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    out, seen = checked(df, keys, bounds)
    if single_file:
        out = out.repartition(1)
    try:
        if fmt == "csv":
            out.write.option("header", True).csv(staging)
        else:
            out.write.parquet(staging)
        failed = {name: n for name, n in (seen.get if seen else {}).items() if n}
        if failed:
            raise CheckFailed(path, failed)
    except Exception:
        delete_path(spark, staging)
        raise
    replace_folder(spark, staging, path)


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Move folder ``new`` to ``path``; what was there goes only after the move.

    Two renames: a reader never sees a half-written folder.  On stores whose
    rename copies (object stores) the move is as safe but not instant.
    """
    jvm = spark._jvm
    target, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-old-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not move {new} to {path}")
    if had:
        fs.delete(old, True)
