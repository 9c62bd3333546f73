"""Time helpers. ``as_of`` stands for the wall clock wherever one is needed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = dt.datetime | Column | None


def as_of_column(as_of: AsOf = None) -> Column:
    """A literal, a column, or the current time when nothing is given.

    A naive ``datetime`` is read in the session time zone when compared with a
    zoned timestamp, as Spark does for every TIMESTAMP_NTZ operand.
    """
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if as_of.tzinfo is None:
        return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(as_of)


def minute_start(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def minutes_before(ts: Column, minutes: int) -> Column:
    return ts - F.make_dt_interval(mins=F.lit(minutes))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microsecond precision."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)
