"""Session helpers: one place that decides how a SparkSession is configured.

On a cluster the session comes from the launcher (spark-submit / notebook);
``build_session`` is for tests, the bench and local runs.  Whatever built the
session, its settings win: the shared checkpoint folder comes from
``spark.checkpoint.dir``, the bytes of a batch of rows for Python tasks from
``spark.sql.execution.arrow.maxBytesPerBatch``; both are set here only when unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every run relies on.  ANSI stays on (Spark 4 default): the
# reference's implicit string arithmetic is rewritten with typed functions,
# so nothing here needs the legacy coercions.
_BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "simtrail",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.default.parallelism"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    A cluster names a shared (HDFS/object-store) folder in
    ``spark.checkpoint.dir``; that setting always wins.  Only a local-mode
    session without one (tests, local runs) gets a fresh scratch folder; a
    cluster session without one is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context on the client; use the conf
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            # A machine-local folder would scatter the table over executors'
            # disks and lose it with them.
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage (HDFS / object store)")
        configured = tempfile.mkdtemp(prefix="simtrail-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# Bytes of rows that go to a Python task at a time; Spark's own bound is 10,000 rows, 30 MB and more of text.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python tasks about ``BATCH_BYTES`` at a time, unless the session has a bound of its own.

    A batch lies in the executor's memory on both sides of the pipe.  Which rows
    share a batch changes no result.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


# Folders handed out by ``scratch_path`` in this process and not yet released.
_written: list[str] = []


def written_so_far() -> int:
    """How many tables are written and not yet released; a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables ``materialize`` wrote (after the mark ``since``); DataFrames that read them end with it.

    Tables in ``keep`` stay.  Paths go through Hadoop's file system API, so
    any shared storage works.
    """
    kept = {getattr(t, "_scratch", None) for t in keep}
    gone = [path for path in _written[since:] if path not in kept]
    _written[since:] = [path for path in _written[since:] if path in kept]
    for path in gone:
        delete_path(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that no later step reads."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path in _written:
            _written.remove(path)
            delete_path(table.sparkSession, path)


def delete_path(spark: SparkSession, name: str) -> None:
    """Delete a folder on whatever storage it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder, for ``release`` to delete."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/simtrail-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


# Spark deletes a query's shuffle files when the query ends, instead of at some later garbage collection.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize_hashes(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``materialize`` without dictionaries for ``columns``, hashes of which hardly one comes twice."""
    return _written_once(df, name, {f"parquet.enable.dictionary#{c}": "false" for c in columns})


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage at a fan-out point: write ``df`` once, read it back.

    The table goes to a fresh folder under the shared checkpoint folder, so a
    lost executor never forces recomputation from the raw scan (the files
    are on shared storage; ``localCheckpoint`` would lose its blocks with the
    executor and is never used).  A written Parquet table is preferred over
    ``Dataset.checkpoint()``: it is computed in one job (an un-persisted
    eager checkpoint computes its input twice) and later readers get column
    pruning and predicate pushdown.  The table stays until ``release``, which
    a job calls when its outputs are written.  The shuffle files behind it go
    with the job: nothing but the table reads them again.
    """
    return _written_once(df, name, {})


def _written_once(df: DataFrame, name: str, options: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    # The schema is known: reading it back needs no footer / inference job.
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
