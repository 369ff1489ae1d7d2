"""Time arithmetic against an explicit as-of instant, independent of the session time zone."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400


def instant(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def days_before(as_of: datetime, days: int) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(days))


def elapsed_micros(later: Column, earlier: Column) -> Column:
    gap = later - earlier
    return (
        F.extract(F.lit("DAY"), gap).cast("bigint") * F.lit(DAY_SECONDS * 1_000_000)
        + F.extract(F.lit("HOUR"), gap).cast("bigint") * F.lit(3_600_000_000)
        + F.extract(F.lit("MINUTE"), gap).cast("bigint") * F.lit(60_000_000)
        + (F.extract(F.lit("SECOND"), gap) * F.lit(1_000_000)).cast("bigint")
    )


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Fractional days, negative when `earlier` lies after `later`."""
    return elapsed_micros(later, earlier) / F.lit(1e6) / F.lit(float(DAY_SECONDS))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed 24-hour periods, rounded down (not calendar days)."""
    return F.floor(elapsed_micros(later, earlier) / F.lit(DAY_SECONDS * 1e6))


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def in_trailing_window(ts: Column, as_of: datetime, days: int = 30) -> Column:
    """At or after `as_of` minus `days`; later instants stay in, there is no upper bound."""
    return ts >= days_before(as_of, days)


def in_range(ts: Column, start: str, end: str) -> Column:
    """Closed-open range; both ends are literals so the scan can prune on them."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))
