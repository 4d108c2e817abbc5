"""Labels of prices, states, places and recurrence; distances; and upstream value conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CATEGORY_STYLE

# Display texts.
RECURRENCE = {
    "weekly:monday": "Every Monday", "weekly:tuesday": "Every Tuesday", "weekly:wednesday": "Every Wednesday", "weekly:thursday": "Every Thursday",
    "weekly:friday": "Every Friday", "weekly:saturday": "Every Saturday", "weekly:sunday": "Every Sunday",
    "monthly:first-saturday": "1st Saturday monthly", "monthly:last-friday": "Last Friday monthly", "daily": "Daily", "biweekly": "Every 2 weeks",
}
STATUS = {"rescheduled": "Rescheduled", "cancelled": "Cancelled", "postponed": "Postponed", "tentative": "Tentative"}
AVAILABILITY = {"sold_out": "SOLD OUT", "waitlist": "Waitlist", "limited": "Limited", "few_left": "Few Left"}
EARTH_METRES = 6_371_000


def _lookup(key: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _money(c: Column) -> Column:
    return F.concat(F.lit("₱"), F.call_function("format_number", c, F.lit("#,##0.###")))


def price_label(is_free: Column, price: Column, low: Column, high: Column) -> Column:
    both = low.isNotNull() & high.isNotNull()
    return (
        F.when(is_free, F.lit("FREE")).when(both & (low != high), F.concat(_money(low), F.lit(" – "), _money(high)))
        .when(both, _money(low)).when(price.isNotNull(), _money(price)).otherwise(F.lit("Price TBA"))
    )


def recurrence_label(pattern: Column) -> Column:
    weekly = F.regexp_extract(pattern, "(?i)^weekly:(\\w+)$", 1)
    nth, day = (F.regexp_extract(pattern, "(?i)^monthly:(\\w+)-(\\w+)$", i) for i in (1, 2))
    return (
        F.when(F.coalesce(pattern, F.lit("")) == "", F.lit("Recurring"))
        .when(F.lower(pattern).isin(*RECURRENCE), _lookup(F.lower(pattern), RECURRENCE))
        .when(weekly != "", F.concat(F.lit("Every "), F.initcap(weekly)))
        .when(nth != "", F.concat(nth, F.lit(" "), F.initcap(day), F.lit(" monthly")))
        .otherwise(pattern)
    )


def status_label(status: Column) -> Column:
    """Null where nothing is shown."""
    return _lookup(status, STATUS)


def availability_label(status: Column) -> Column:
    return _lookup(status, AVAILABILITY)


def location_label(status: Column, name: Column) -> Column:
    state = F.coalesce(status, F.lit("confirmed"))
    named = F.coalesce(F.nullif(name, F.lit("")), F.lit("Location not specified"))
    return F.when(state == "tba", F.lit("Location TBA")).when(state == "secret", F.lit("Secret Location")).when(state == "dm_for_details", F.lit("DM for address")).otherwise(named)


def category_color(category: Column, otherwise: str = "#9E9E9E") -> Column:
    return F.coalesce(_lookup(category, {c: color for c, color, _ in CATEGORY_STYLE}), F.lit(otherwise))


def category_label(category: Column) -> Column:
    return F.coalesce(_lookup(category, {c: label for c, _, label in CATEGORY_STYLE}), category)


def onboarded(preferences: Column) -> Column:
    return F.coalesce(F.size(preferences) > 0, F.lit(False))


def shows_status_row(status: Column, availability: Column, recurring: Column) -> Column:
    return (F.coalesce(status, F.lit("confirmed")) != "confirmed") | (F.coalesce(availability, F.lit("available")) != "available") | F.coalesce(recurring, F.lit(False))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_METRES * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def kilometres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return metres(lat1, lng1, lat2, lng2) / 1000


def json_array(c: Column) -> Column:
    """JSON array of strings; an empty array for anything else."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def flag(c: Column) -> Column:
    """1 is true, anything else false."""
    return F.coalesce(c == 1, F.lit(False))


def moment(c: Column) -> Column:
    return F.try_to_timestamp(c)


def strict_date(c: Column) -> Column:
    """A date written as YYYY-MM-DD that the calendar has; else null."""
    return F.when(c.rlike("^\\d{4}-\\d{2}-\\d{2}$") & (F.length(c) == 10), c.try_cast("date"))


def located(lat: Column, lng: Column) -> Column:
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))
