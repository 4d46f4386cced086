"""Column expressions and reusable computations built from Spark built-ins."""

from simtrail.functions.calendar import (
    day_diff,
    daypart,
    month_index,
    parse_seen_at,
    parse_yyyymmdd,
    weekday_name,
    weekpart,
)
from simtrail.functions.ranking import exact_percentiles, percent_rank, value_counts

__all__ = [
    "day_diff",
    "daypart",
    "month_index",
    "parse_seen_at",
    "parse_yyyymmdd",
    "percent_rank",
    "value_counts",
    "exact_percentiles",
    "weekday_name",
    "weekpart",
]
