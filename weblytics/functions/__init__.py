"""Reusable column expressions (all built-in Spark functions)."""

from .columns import (  # noqa: F401
    evening_visit, flag, is_converted, or_default, pct, per_unit, ratio,
    session_date, session_key, time_of_day, time_on_site_category, utc_hour,
    weekday_name,
)
from .sampling import draw, in_eval_split, keep_positives  # noqa: F401
