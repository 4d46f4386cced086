"""Calendar column expressions (all built-in, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from simtrail import config


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_name(ts: str | Column) -> Column:
    """Full English weekday name, e.g. ``Monday``."""
    return F.date_format(_col(ts), "EEEE")


def weekpart(ts: str | Column) -> Column:
    """``weekend`` on Saturday/Sunday, ``weekday`` otherwise, null for a null time.

    ``dayofweek`` is locale-free (1 = Sunday, 7 = Saturday), so the result
    does not depend on the JVM locale the way a name comparison would.
    """
    dow = F.dayofweek(_col(ts))
    return (
        F.when(dow.isin(1, 7), F.lit(config.WEEKEND))
        .when(dow.isNotNull(), F.lit(config.WEEKDAY))
    )


def daypart(hour: str | Column, parts=config.DAYPARTS) -> Column:
    """Daypart of an hour 0-23 from inclusive hour ranges; null hour -> null."""
    h = _col(hour)
    expr = None
    for name, lo, hi in parts:
        cond = h.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def day_diff(later: str | Column, earlier: str | Column) -> Column:
    """Whole days between two dates (``later - earlier``), true across month ends."""
    return F.datediff(_col(later), _col(earlier))


def month_index(d: str | Column) -> Column:
    """Months since year 0: differences are true across year ends."""
    c = _col(d)
    return F.year(c) * 12 + F.month(c)


def parse_yyyymmdd(s: str | Column) -> Column:
    """``yyyyMMdd`` string to DATE; a malformed value becomes null, not an error."""
    return F.try_to_date(_col(s), "yyyyMMdd")


def parse_seen_at(s: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` string to timestamp; malformed -> null."""
    return F.try_to_timestamp(_col(s), F.lit("yyyy-MM-dd HH:mm:ss"))
