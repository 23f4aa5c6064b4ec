"""Column expressions shared by the reports, metric tables and feature sets.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (EVENING_FIRST_HOUR, EVENING_LAST_HOUR, TIME_OF_DAY,  # noqa: F401
                    TIME_OF_DAY_ELSE, TIME_ON_SITE, TIME_ON_SITE_ELSE, TIME_ON_SITE_ZERO,
                    WEEKDAYS, WEEKEND)


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def or_default(x: str | Column, default) -> Column:
    """IFNULL(x, default)."""
    return F.coalesce(c(x), F.lit(default))


def flag(cond: Column) -> Column:
    """IF(cond, 1, 0) as bigint; a NULL condition gives 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")


def is_converted(transactions: str | Column = "totals.transactions") -> Column:
    """IF(transactions IS NULL, 0, 1): the label and the converted-session count."""
    return flag(c(transactions).isNotNull())


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL (ANSI-safe division)."""
    return F.try_divide(c(num).cast("double"), c(den).cast("double"))


def pct(num: str | Column, den: str | Column, digits: int = 2) -> Column:
    """ROUND(num / den * 100, digits)."""
    return F.round(ratio(num, den) * F.lit(100.0), digits)


def session_date(date_col: str | Column = "date") -> Column:
    """PARSE_DATE('%Y%m%d', date)."""
    return F.to_date(c(date_col), "yyyyMMdd")


def weekday_name(d: Column) -> Column:
    """FORMAT_DATE('%A', d): English weekday name, independent of locale."""
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAYS]), F.dayofweek(d))


def utc_hour(epoch_seconds: str | Column = "visitStartTime") -> Column:
    """EXTRACT(HOUR FROM TIMESTAMP_SECONDS(n)) in UTC, as bigint.

    Plain arithmetic on the epoch, so the result does not depend on the
    session time zone of whoever runs the job."""
    return F.floor(F.pmod(c(epoch_seconds), F.lit(86400)) / F.lit(3600)).cast("long")


def evening_visit(hour: Column) -> Column:
    return flag((hour >= EVENING_FIRST_HOUR) & (hour <= EVENING_LAST_HOUR))


def time_of_day(hour: Column) -> Column:
    expr = None
    for lo, hi, name in TIME_OF_DAY:
        cond = hour.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(TIME_OF_DAY_ELSE))


def time_on_site_category(time_on_site: Column) -> Column:
    t = F.coalesce(time_on_site, F.lit(0))
    expr = F.when(t == 0, F.lit(TIME_ON_SITE_ZERO))
    for bound, name in TIME_ON_SITE:
        expr = expr.when(t < bound, F.lit(name))
    return expr.otherwise(F.lit(TIME_ON_SITE_ELSE))


def per_unit(num: Column, den: Column, digits: int) -> Column:
    """ROUND(IFNULL(num,0) / GREATEST(IFNULL(den,0), 1), digits)."""
    return F.round(
        F.coalesce(num, F.lit(0)).cast("double")
        / F.greatest(F.coalesce(den, F.lit(0)), F.lit(1)).cast("double"),
        digits,
    )


def session_key(visitor: str | Column = "fullVisitorId", visit: str | Column = "visitId") -> Column:
    """CONCAT(fullVisitorId, '-', visitId); NULL if either part is NULL."""
    return F.concat(c(visitor), F.lit("-"), c(visit).cast("string"))
