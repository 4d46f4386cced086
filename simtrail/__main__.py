"""Command line for the two jobs.

    python -m simtrail profile --activity PATH --start 20211101 --end 20211130 --out PATH [--csv]
    python -m simtrail report --profile PATH [--profile-csv] --out ROOT
    python -m simtrail travel --locations PATH --profile PATH --out ROOT \
        [--profile-csv] [--segments ROOT] [--corridor "Kandal,Phnom Penh" ...]

The session comes from ``spark-submit`` / the environment; only an unset
checkpoint folder is filled in (see ``simtrail.session``).  Tables written
there on the way are deleted when the job ends.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from simtrail import config
from simtrail.config import CarrierSlots
from simtrail.plans import sim_profile, travel
from simtrail.session import ensure_checkpoint_dir, release


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="simtrail")
    sub = parser.add_subparsers(dest="job", required=True)
    p = sub.add_parser("profile", help="job A: SIM profile of one period")
    p.add_argument("--activity", required=True)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--out", required=True)
    p.add_argument("--csv", action="store_true", help="write CSV with a header instead of Parquet")
    p.add_argument("--single-file", action="store_true")
    p.add_argument("--network", default=config.NETWORK_KEPT, help="network type kept; 'any' keeps all")
    p.add_argument("--normalise", choices=["months"], help="divide frequency and volume by the months spanned")
    p.add_argument("--delta-rule", default="ranked", choices=["ranked", "total", "by_count"])
    r = sub.add_parser("report", help="delta classes and SIM breakdowns of a written profile")
    r.add_argument("--profile", required=True)
    r.add_argument("--profile-csv", action="store_true")
    r.add_argument("--out", required=True)
    t = sub.add_parser("travel", help="job B: trips and corridor cohorts of profiled devices")
    t.add_argument("--locations", required=True)
    t.add_argument("--profile", required=True)
    t.add_argument("--profile-csv", action="store_true")
    t.add_argument("--segments")
    t.add_argument("--segments-layout", default="partitioned", choices=["partitioned", "folders"])
    t.add_argument("--out", required=True)
    t.add_argument("--country", default=config.COUNTRY_KEPT)
    t.add_argument("--corridor", action="append", help="'A,B' (repeatable); default: the three named corridors")
    t.add_argument("--unit-minutes", type=int, help="link observations in units of a device and so many minutes, without a written table")
    t.add_argument("--start", help="first day of the observations, yyyy-MM-dd")
    t.add_argument("--end", help="last day of the observations, yyyy-MM-dd")
    t.add_argument("--cuts", default=",".join(map(str, config.TIER_CUTS)), help="tier cut percentiles, e.g. 0.1,0.8,0.9")
    t.add_argument("--restrict", default="early", choices=["early", "late"], help="where the device list meets the data")
    for job in (p, r, t):
        job.add_argument(
            "--carriers", default=",".join(CarrierSlots().names), help="focal carrier and the two challengers: 'A,B,C'"
        )
    args = parser.parse_args(argv)
    carriers = args.carriers.split(",")
    if len(carriers) != 3:
        parser.error("--carriers takes three names")

    spark = SparkSession.builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    slots = CarrierSlots(*carriers)
    try:
        _run(spark, args, slots)
    finally:
        release(spark)


def _run(spark: SparkSession, args: argparse.Namespace, slots: CarrierSlots) -> None:
    if args.job == "profile":
        sim_profile.run(
            spark, args.activity, args.out, start=args.start, end=args.end, slots=slots,
            network=None if args.network == "any" else args.network,
            normalise=args.normalise, delta_rule=args.delta_rule,
            fmt="csv" if args.csv else "parquet", single_file=args.single_file,
        )
    elif args.job == "report":
        sim_profile.run_reports(
            spark, args.profile, args.out, slots=slots, fmt="csv" if args.profile_csv else "parquet"
        )
    else:
        corridors = (
            [tuple(c.split(",", 1)) for c in args.corridor] if args.corridor else list(config.CORRIDORS)
        )
        travel.run(
            spark, args.locations, args.profile, args.out,
            score_columns=slots.score_columns,
            profile_format="csv" if args.profile_csv else "parquet",
            segments_root=args.segments, segments_layout=args.segments_layout,
            corridors=corridors, country=args.country, unit_minutes=args.unit_minutes,
            cuts=[float(c) for c in args.cuts.split(",")], restrict=args.restrict,
            start=args.start, end=args.end,
        )


if __name__ == "__main__":
    main()
