"""Scalar column expressions (all JVM-side, codegen friendly; no Python UDFs)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

PLATFORM = "sqlserver"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value: str | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (UTC wall clock)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def hour_bucket(c: str | Column) -> Column:
    """``date_trunc('hour', t)`` kept as TIMESTAMP_NTZ."""
    return F.date_trunc("hour", col(c)).cast("timestamp_ntz")


def year_s(c: str | Column) -> Column:
    """``CAST(year(t) AS SMALLINT)``."""
    return F.year(col(c)).cast("smallint")


def month_t(c: str | Column) -> Column:
    return F.month(col(c)).cast("tinyint")


def day_t(c: str | Column) -> Column:
    return F.dayofmonth(col(c)).cast("tinyint")


def stamp_columns(ts: str | Column, platform: str | Column = PLATFORM) -> list[Column]:
    """Platform + the year/month/day partition stamp of one timestamp."""
    t = col(ts)
    p = platform if isinstance(platform, Column) else F.lit(platform)
    return [p.alias("platform"), year_s(t).alias("year"), month_t(t).alias("month"), day_t(t).alias("day")]


def minus_days(ts: str | Column, days: int) -> Column:
    """``t - INTERVAL n DAY``."""
    return col(ts) - F.expr(f"INTERVAL {int(days)} DAYS")


def minus_hours(ts: str | Column, hours: int) -> Column:
    return col(ts) - F.expr(f"INTERVAL {int(hours)} HOURS")


def nullif_zero(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(0))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """``a / NULLIF(b, 0)`` (ANSI-safe)."""
    return col(a) / nullif_zero(b)


def floor_ratio(a: str | Column, b: str | Column) -> Column:
    """F7 with F6: ``floor(a / NULLIF(b, 0))`` as BIGINT."""
    return F.floor(safe_div(a, b))


def round_half_even_cast(c: str | Column, typ: str) -> Column:
    """Narrowing with NULL on overflow, rounding half to even first."""
    return F.rint(col(c)).try_cast(typ)


def band_index(value: str | Column, direction: Column, warn: Column, crit: Column) -> Column:
    """F8: 0/1/2 band of a value under a direction-aware rule.

    NULL value -> 0. ``higher_worse``: < warn -> 0, < crit -> 1, else 2. Any other
    direction (NULL included): >= warn -> 0, >= crit -> 1, else 2. A missing rule
    (NULL thresholds) therefore falls through to 2.
    """
    v = col(value)
    higher = F.when(v < warn, 0).when(v < crit, 1).otherwise(2)
    lower = F.when(v >= warn, 0).when(v >= crit, 1).otherwise(2)
    return (
        F.when(v.isNull(), 0)
        .when(direction == F.lit("higher_worse"), higher)
        .otherwise(lower)
        .cast("tinyint")
    )


def coalesce_zero(c: str | Column) -> Column:
    """F5."""
    return F.coalesce(col(c), F.lit(0))


def clamp_zero(c: str | Column) -> Column:
    """``CASE WHEN x < 0 THEN 0 ELSE x END``."""
    x = col(c)
    return F.when(x < 0, 0).otherwise(x)


def neq_flag(a: str | Column, b: str | Column) -> Column:
    """F16: ``a <> b`` as a flag, NULL comparison -> false."""
    return F.coalesce(col(a) != col(b), F.lit(False))


def percent_ratio(part: str | Column, other: str | Column, digits: int = 1) -> Column:
    """``round(part / (other + part) * 100, d)``, 100.0 when both are 0."""
    total = col(part) + col(other)
    return F.when(total > 0, F.round(col(part) / total * 100.0, digits)).otherwise(F.lit(100.0))


def epoch_seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """seconds from ``earlier`` to ``later`` (double)."""
    return (
        F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))
    ) / F.lit(1_000_000.0)


def second_round(c: str | Column) -> Column:
    """F21 (T-SQL ``DATETIME2(0)``): round to the nearest second."""
    return F.date_trunc("second", col(c) + F.expr("INTERVAL 500 MILLISECONDS")).cast("timestamp_ntz")


def second_trunc(c: str | Column) -> Column:
    return F.date_trunc("second", col(c)).cast("timestamp_ntz")


def utc_now():
    """the current instant as a UTC wall-clock TIMESTAMP_NTZ (session zone is UTC)."""
    return F.current_timestamp().cast("timestamp_ntz")


def error_is_conflict(c: str | Column) -> Column:
    """classify an error message as a commit conflict (case-insensitive regex)."""
    return col(c).rlike("(?i)" + CONFLICT_PATTERN)


# Message fragments that mark a commit conflict.
CONFLICT_PATTERN = "conflict|serializ|concurrent|out of date|snapshot|transaction|retry"
