"""Readers / writers: typed CSV round trip, segment folders, nested pruning."""

import os

import pytest
from pyspark.sql import functions as F

from simtrail import schemas
from simtrail.config import CarrierSlots
from simtrail.sources import readers

SLOTS = CarrierSlots()


def _profile(spark):
    return spark.createDataFrame(
        [("a", "Smart", "Metfone", "0", 3.0, 2.0, 1.0, 0.0, 1.0),
         ("b", "0", "others", "0", 0.0, 0.0, 0.0, 0.0, 0.0)],
        schemas.sim_profile_schema(SLOTS.score_columns),
    )


def test_profile_csv_round_trip_is_typed(spark, scratch_dir):
    path = os.path.join(scratch_dir, "profile_csv")
    readers.write_sim_profile(_profile(spark), path, fmt="csv", single_file=True)
    back = readers.read_sim_profile(spark, path, SLOTS.score_columns, fmt="csv")
    assert dict(back.dtypes)["delta_rfm"] == "double"
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in _profile(spark).collect())
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1


def test_profile_parquet_round_trip(spark, scratch_dir):
    path = os.path.join(scratch_dir, "profile_parquet")
    readers.write_sim_profile(_profile(spark), path)
    back = readers.read_sim_profile(spark, path, SLOTS.score_columns)
    assert back.count() == 2


def test_segments_partitioned_and_folders(spark, scratch_dir):
    membership = spark.createDataFrame([("a", "PP"), ("b", "SS"), ("a", "SS")], "ifa string, segment string")
    root = os.path.join(scratch_dir, "segments")
    readers.write_segments(membership, root)
    got = readers.read_segments(spark, root)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "PP"), ("a", "SS"), ("b", "SS")]
    only = readers.read_segments(spark, root, ["SS"])
    assert "PartitionFilters: [isnotnull(segment" in only._jdf.queryExecution().executedPlan().toString()
    assert only.count() == 2
    folders = os.path.join(scratch_dir, "segment_folders")
    for seg in ("PP", "SS"):
        membership.where(F.col("segment") == seg).select("ifa").write.mode("overwrite").parquet(f"{folders}/{seg}")
    got2 = readers.read_segments(spark, folders, layout="folders")
    assert sorted(tuple(r) for r in got2.collect()) == [("a", "PP"), ("a", "SS"), ("b", "SS")]


def test_activity_reader_parses_and_pushes_period(spark, scratch_dir):
    path = os.path.join(scratch_dir, "activity")
    spark.createDataFrame(
        [("a", "Smart", "cellular", "20211130", 1), ("a", "Smart", "cellular", "20211201", 2),
         ("a", "Smart", "cellular", "bad", 3)],
        schemas.CARRIER_ACTIVITY_RAW,
    ).write.mode("overwrite").parquet(path)
    df = readers.read_carrier_activity(spark, path, start="20211201", end="20211231")
    assert [r["date"].isoformat() for r in df.collect()] == ["2021-12-01"]
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,20211201)" in (
        df._jdf.queryExecution().executedPlan().toString()
    )


def test_location_reader_prunes_nested_fields(spark, scratch_dir):
    path = os.path.join(scratch_dir, "locations")
    spark.createDataFrame(
        [("a", [("X", "A", "KH", "2021-09-01 08:00:00", 1, "extra")])],
        "ifa string, gps array<struct<city:string,state:string,country:string,last_seen:string,"
        "brq_count:long,unused:string>>",
    ).write.mode("overwrite").parquet(path)
    df = readers.read_location_timeseries(spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan
    assert df.count() == 1


def test_checkpoint_folder_comes_from_session(spark):
    from simtrail.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark)
    assert folder and spark.conf.get("spark.checkpoint.dir") in folder


def test_csv_with_swapped_columns_is_an_error(spark, tmp_path):
    good = ["smart_rfm", "metfone_rfm"]
    frame = spark.createDataFrame([(2.0, 1.0)], "metfone_rfm double, smart_rfm double")
    schema = schemas.sim_profile_schema(good)
    wrong = frame.select(*[(F.col(f.name) if f.name in good else F.lit("1")).alias(f.name) for f in reversed(schema.fields)])
    wrong.write.option("header", True).csv(str(tmp_path / "p"))
    with pytest.raises(Exception):
        readers.read_sim_profile(spark, str(tmp_path / "p"), good, "csv").collect()


def test_segment_names_stay_strings(spark, tmp_path):
    readers.write_segments(spark.createDataFrame([("a", "01"), ("b", "02")], "ifa string, segment string"), str(tmp_path / "s"))
    assert {r["segment"] for r in readers.read_segments(spark, str(tmp_path / "s")).collect()} == {"01", "02"}


def test_months_are_pruned_at_planning(spark, tmp_path):
    activity = spark.createDataFrame(
        [("a", "Smart", "cellular", f"2021{m:02d}{d:02d}", m) for m in (9, 10, 11) for d in (1, 20)], schemas.CARRIER_ACTIVITY_RAW
    )
    path = str(tmp_path / "activity")
    readers.write_carrier_activity(activity, path)
    df = readers.read_carrier_activity(spark, path, start="20211005", end="20211105")
    assert sorted(r["date"].isoformat() for r in df.collect()) == ["2021-10-20", "2021-11-01"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "month" not in df.columns
    # A month that comes again replaces that month only.
    readers.write_carrier_activity(activity.where("date = '20211001'"), path)
    assert readers.read_carrier_activity(spark, path).count() == 5


def test_location_months_are_pruned_and_split(spark, tmp_path):
    point = lambda t: ("c", "A", "KH", t, 1)
    rows = [("a", [point("2021-09-30 23:00:00"), point("2021-10-01 01:00:00"), point("2021-11-02 08:00:00")]),
            ("b", [point(None), point("2021-10-31 08:00:00")]), ("c", []), ("d", None)]
    nested = spark.createDataFrame(rows, schemas.LOCATION_TIMESERIES)
    path = str(tmp_path / "locations")
    readers.write_location_timeseries(nested, path)
    df = readers.read_location_timeseries(spark, path, "2021-10-01", "2021-10-31")
    assert sorted((r["ifa"], p["last_seen"]) for r in df.collect() for p in r["gps"]) == [
        ("a", "2021-10-01 01:00:00"), ("b", "2021-10-31 08:00:00")]
    assert "PartitionFilters: [isnotnull(month" in df._jdf.queryExecution().executedPlan().toString()
    files = df.select("_metadata.file_path").distinct().count() if "_metadata" in df.columns else None
    assert files in (None, 1)
    assert sum(len(r["gps"]) for r in readers.read_location_timeseries(spark, path).collect()) == 5


def test_states_merge_to_the_one_pass_result(spark, tmp_path):
    import datetime as dt

    from simtrail.operators import rfm

    days = [dt.date(2021, 8, 25) + dt.timedelta(days=i) for i in range(90)]
    rows = [(f"d{i % 7}", "ABC"[i % 3 if i % 7 else 0], "cellular", d, i) for i, d in enumerate(days * 3)]
    activity = spark.createDataFrame(rows, "ifa string, carrier string, network string, date date, brq_count long")
    path = str(tmp_path / "state")
    for start, end in (("20210825", "20210915"), ("20210916", "20210930"), ("20211001", "20211231")):
        lo, hi = (dt.datetime.strptime(x, "%Y%m%d").date() for x in (start, end))
        part = activity.where(F.col("date").between(lo, hi))
        readers.write_activity_state(rfm.activity_state(part), path, start, end)
    merged = rfm.base_of_state(rfm.merge_states(readers.read_activity_state(spark, path)))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, rfm.rfm_base(activity).collect()))
    one = rfm.base_of_state(rfm.merge_states(readers.read_activity_state(spark, path, "20210825", "20210930")))
    want = rfm.rfm_base(activity.where(F.col("date") <= dt.date(2021, 9, 30)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="reach over"):
        readers.read_activity_state(spark, path, "20210901", "20210930")
    readers.write_activity_state(rfm.activity_state(activity), path, "20211201", "20220131")
    with pytest.raises(ValueError, match="overlap"):
        readers.read_activity_state(spark, path)


def test_repeated_device_stops_the_write(spark, tmp_path):
    from simtrail.sources.sinks import CheckFailed

    path = str(tmp_path / "profile")
    readers.write_sim_profile(_profile(spark), path)
    with pytest.raises(CheckFailed) as failed:
        readers.write_sim_profile(_profile(spark).unionByName(_profile(spark).limit(1)), path)
    assert failed.value.counts == {"repeated key": 2}
    wrong = _profile(spark).withColumn("smart_rfm", F.lit(15.5))
    with pytest.raises(CheckFailed) as failed:
        readers.write_sim_profile(wrong, path)
    assert failed.value.counts == {"smart_rfm out of bounds": 2}
    assert readers.read_sim_profile(spark, path, SLOTS.score_columns).count() == 2
    assert os.listdir(tmp_path) == ["profile"]


def test_failing_write_leaves_the_earlier_profile(spark, tmp_path):
    path = str(tmp_path / "profile")
    readers.write_sim_profile(_profile(spark), path)
    broken = _profile(spark).withColumn("all_rfm", F.when(F.col("ifa") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("all_rfm")))
    with pytest.raises(Exception, match="lost"):
        readers.write_sim_profile(broken, path)
    assert sorted(r["ifa"] for r in readers.read_sim_profile(spark, path, SLOTS.score_columns).collect()) == ["a", "b"]
    readers.write_sim_profile(_profile(spark).where("ifa = 'a'"), path)
    assert readers.read_sim_profile(spark, path, SLOTS.score_columns).count() == 1
    assert os.listdir(tmp_path) == ["profile"]


def test_segment_folder_without_ifa_is_an_error(spark, tmp_path):
    spark.createDataFrame([("a",)], "ifa string").write.parquet(str(tmp_path / "s" / "P P"))
    assert [tuple(r) for r in readers.read_segments(spark, str(tmp_path / "s"), layout="folders").collect()] == [("a", "P P")]
    spark.createDataFrame([("a",)], "device string").write.parquet(str(tmp_path / "s" / "SS"))
    with pytest.raises(ValueError, match="ifa"):
        readers.read_segments(spark, str(tmp_path / "s"), layout="folders")
