"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, text

UNITS = {"SQL_TSI_FRAC_SECOND": "FRAC_SECOND", "SQL_TSI_SECOND": "SECOND", "SQL_TSI_MINUTE": "MINUTE", "SQL_TSI_HOUR": "HOUR", "SQL_TSI_DAY": "DAY", "SQL_TSI_WEEK": "WEEK", "SQL_TSI_MONTH": "MONTH", "SQL_TSI_QUARTER": "QUARTER", "SQL_TSI_YEAR": "YEAR"}


def dayname(d) -> Column:
    """Full English name."""
    return F.date_format(col(d), "EEEE")


def monthname(d) -> Column:
    return F.date_format(col(d), "MMMM")


def _unit(unit: str) -> str:
    unit = UNITS.get(unit.upper(), unit.upper())
    if unit not in UNITS.values():
        raise ValueError(f"unknown interval {unit}")
    return unit


def timestampadd(unit: str, n, ts) -> Column:
    """FRAC_SECOND counts nanoseconds (whole microseconds take effect)."""
    unit, n, ts = _unit(unit), col(n), col(ts)
    if unit in ("YEAR", "QUARTER", "MONTH"):
        return ts + F.make_ym_interval(F.lit(0), (n * {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit]).cast("int"))
    seconds = {"WEEK": 604_800, "DAY": 86_400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    if unit == "FRAC_SECOND":
        return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.call_function("div", n.cast("long"), F.lit(1000)) / 1_000_000).cast("decimal(18,6)"))
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n.cast("long") * seconds[unit]).cast("decimal(18,6)"))


def timestampdiff(unit: str, a, b) -> Column:
    """Counts the calendar boundaries crossed from ``a`` to ``b``; weeks begin on Sunday."""
    unit, a, b = _unit(unit), col(a).cast("timestamp_ntz"), col(b).cast("timestamp_ntz")
    months = lambda t: F.year(t) * 12 + F.month(t)
    if unit == "YEAR":
        out = F.year(b) - F.year(a)
    elif unit == "QUARTER":
        out = (F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))
    elif unit == "MONTH":
        out = months(b) - months(a)
    elif unit == "DAY":
        out = F.datediff(b, a)
    elif unit == "WEEK":  # 1970-01-04 was a Sunday
        week = lambda t: F.floor((F.datediff(t, F.lit("1970-01-04").cast("date"))) / 7)
        out = week(b) - week(a)
    else:
        micros = lambda t: F.unix_micros(F.to_timestamp_ltz(t.cast("string")))
        unit_micros = {"HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}
        if unit == "FRAC_SECOND":
            return (micros(b) - micros(a)) * 1000
        whole = lambda t: F.call_function("div", micros(t) - F.pmod(micros(t), F.lit(unit_micros[unit])), F.lit(unit_micros[unit]))
        out = whole(b) - whole(a)
    return out.cast("long")


def epoch(ts) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(col(ts).cast("timestamp")) / 1e6


def from_millis(n) -> Column:
    return F.timestamp_millis(col(n))


def to_millis(ts) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def timestampcreate(date, time) -> Column:
    """A date and a time written HH:mm:ss."""
    return F.to_timestamp_ntz(F.concat(col(date).cast("date").cast("string"), F.lit(" "), col(time)))


def curtime() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def modifytimezone(ts, first: str, second: str | None = None) -> Column:
    """The wall clock of ``ts`` in the first zone, taken as one of the second zone; with one zone the first is the session's."""
    own, other = (F.lit(first), F.lit(second)) if second else (F.current_timezone(), F.lit(first))
    return F.convert_timezone(other, own, col(ts).cast("timestamp_ntz"))


def parse_timestamp(s, pattern: str) -> Column:
    return F.to_timestamp_ntz(col(s), F.lit(pattern))


def format_timestamp(ts, pattern: str) -> Column:
    return F.date_format(col(ts), pattern)


def week(d) -> Column:
    """ISO week."""
    return F.weekofyear(col(d))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "F", "col", "text")]
