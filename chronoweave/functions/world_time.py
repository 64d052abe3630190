"""World time: partial dates, widening of approximate ones, and containment of a probe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(value: Column, start: int, size: int, other: int) -> Column:
    return F.coalesce(F.substring(value, start, size).try_cast("int"), F.lit(other))


def precision(value: Column) -> Column:
    """``year``, ``month`` or ``day`` by the value's length; null for anything else."""
    n = F.length(value)
    return F.when(n == 4, "year").when(n == 7, "month").when(n == 10, "day")


def lower_bound(kind: Column, value: Column) -> Column:
    """First day that the point covers; an approximate point starts one of its own units earlier.

    Added up from the year's first day, so that a day past the month's end rolls over.
    """
    back = lambda unit: F.when((kind == "approximate") & (precision(value) == unit), 1).otherwise(0)
    year = F.make_date(_number(value, 1, 4, 1) - back("year"), F.lit(1), F.lit(1))
    month = F.add_months(year, _number(value, 6, 2, 1) - 1 - back("month"))
    return F.when(kind != "unknown", F.date_add(month, _number(value, 9, 2, 1) - 1 - back("day")))


def upper_bound(value: Column) -> Column:
    """The day after the last one of an exact point."""
    low, unit = lower_bound(F.lit("exact"), value), precision(value)
    return F.when(unit == "year", F.add_months(low, 12)).when(unit == "month", F.add_months(low, 1)).otherwise(F.date_add(low, 1))


def contains(from_kind: Column, from_value: Column, to_kind: Column, to_value: Column, at: str) -> Column:
    """``certain``, ``possible`` or null: does ``[from, to)`` overlap the span of ``at``?

    A missing end is open. No world time at all, or an unknown end, never matches. Only the
    end's lower bound counts, so an approximate end shortens the interval.
    """
    probe_low, probe_high = lower_bound(F.lit("exact"), F.lit(at)), upper_bound(F.lit(at))
    known = (from_kind.isNotNull() | to_kind.isNotNull()) & (F.coalesce(from_kind, F.lit("")) != "unknown") & (F.coalesce(to_kind, F.lit("")) != "unknown")
    start = from_kind.isNull() | (probe_high > lower_bound(from_kind, from_value))
    end = to_kind.isNull() | (probe_low < lower_bound(to_kind, to_value))
    approximate = (F.coalesce(from_kind, F.lit("")) == "approximate") | (F.coalesce(to_kind, F.lit("")) == "approximate")
    return F.when(known & start & end, F.when(approximate, "possible").otherwise("certain"))


def fidelity(from_kind: Column, to_kind: Column) -> Column:
    """``absent``, ``unknown``, ``approximate`` or ``exact``, the first that applies."""
    has = lambda kind: (F.coalesce(from_kind, F.lit("")) == kind) | (F.coalesce(to_kind, F.lit("")) == kind)
    return F.when(from_kind.isNull() & to_kind.isNull(), "absent").when(has("unknown"), "unknown").when(has("approximate"), "approximate").otherwise("exact")


def valid_mixed_date(value: Column) -> Column:
    """Whether a mixed-precision date is ``unknown`` or an existing year, month or day, ``~`` allowed before it."""
    bare = F.regexp_replace(value, "^~", "")
    shaped = bare.rlike("^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$")
    day = F.concat(bare, F.when(F.length(bare) == 4, "-01-01").when(F.length(bare) == 7, "-01").otherwise(""))
    return (value == "unknown") | (shaped & F.try_to_date(day, "yyyy-MM-dd").isNotNull())


def date_key(value: Column) -> Column:
    """Lexical key of a mixed-precision date: unknown or missing sorts last."""
    return F.when(F.coalesce(value, F.lit("unknown")) == "unknown", "9999").otherwise(F.regexp_replace(value, "^~", ""))
