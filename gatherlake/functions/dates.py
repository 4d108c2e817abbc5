"""Date and time columns: labels, ranges, presets and runs of days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_d = F.date_format


def date_range_label(start: Column, end: Column) -> Column:
    return (
        F.when(end.isNull() | (start == end), _d(start, "MMM d"))
        .when(F.trunc(start, "month") == F.trunc(end, "month"), F.concat(_d(start, "MMM d"), F.lit("-"), _d(end, "d")))
        .when(F.year(start) == F.year(end), F.concat(_d(start, "MMM d"), F.lit(" - "), _d(end, "MMM d")))
        .otherwise(F.concat(_d(start, "MMM d, yyyy"), F.lit(" - "), _d(end, "MMM d, yyyy")))
    )


def compact_range_label(start: Column, end: Column) -> Column:
    """Month named once when both ends name the same month; only names are compared."""
    return F.when(_d(start, "MMM") == _d(end, "MMM"), F.concat(_d(start, "MMM d"), F.lit("–"), _d(end, "d"))).otherwise(F.concat(_d(start, "MMM d"), F.lit(" – "), _d(end, "MMM d")))


def day_label(day: Column) -> Column:
    return _d(day, "EEE, MMM d")


def time_label(time: Column) -> Column:
    """HH:MM as 12-hour time; null for a missing or empty time."""
    parts = F.split(time, ":")
    hour = F.try_to_number(parts[0], F.lit("99")).cast("int")
    label = F.concat(F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12).cast("string"), F.lit(":"), F.lpad(parts[1], 2, "0"), F.when(hour >= 12, F.lit(" PM")).otherwise(" AM"))
    return F.when(F.coalesce(time, F.lit("")) != "", label)


def time_range_label(start: Column, end: Column) -> Column:
    a, b = time_label(start), time_label(end)
    return F.when(a.isNull() & b.isNull(), F.lit("Time TBA")).when(a.isNull(), b).when(b.isNull() | (start == end), a).otherwise(F.concat(a, F.lit(" - "), b))


def compact_time_label(start: Column, end: Column) -> Column:
    """No label without a start; an en dash between two times."""
    a, b = time_label(start), time_label(end)
    return F.when(b.isNull(), a).otherwise(F.concat(a, F.lit(" – "), b))


def consecutive(days: Column) -> Column:
    """Each day follows the one before; repeated days don't."""
    ordered = F.array_sort(days)
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(days), F.lit(1))), lambda i: (i == 1) | (F.datediff(F.get(ordered, i - 1), F.get(ordered, i - 2)) == 1))


def many_dates_label(days: Column) -> Column:
    ordered = F.array_sort(days)
    first, last = F.get(ordered, F.lit(0)), F.get(ordered, F.size(days) - 1)
    listed = F.concat(_d(first, "MMM"), F.lit(" "), F.array_join(F.transform(ordered, lambda d: _d(d, "d")), ", "))
    return F.when(F.size(days) == 0, F.lit("")).when(F.size(days) == 1, _d(first, "MMM d")).when(consecutive(days), date_range_label(first, last)).otherwise(listed)


def days_between(start: Column, end: Column) -> Column:
    """Every day from start to end; no day if end is before start."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def day_span(start: Column, end: Column) -> Column:
    return F.datediff(F.coalesce(end, start), start) + 1


def many_days(start: Column, end: Column) -> Column:
    return F.coalesce(start != end, F.lit(False))


def preset(name: str, as_of: Column) -> Column:
    """start and end of "today", "week", "weekend" (the coming Friday to Sunday) or "month"."""
    friday = F.date_add(as_of, (12 - (F.dayofweek(as_of) - 1)) % 7)
    start, end = {
        "today": (as_of, as_of), "week": (as_of, F.date_add(as_of, 7)),
        "weekend": (friday, F.date_add(friday, 2)), "month": (as_of, F.add_months(as_of, 1)),
    }[name]
    return F.struct(start.alias("start"), end.alias("end"))
