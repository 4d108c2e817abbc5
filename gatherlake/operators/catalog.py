"""Catalog queries: listings, lookups, nesting, search, counts, saved events and sub-events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from ..functions import labels
from ..functions.text import distance_label
from ..schemas import category_dimension
from ..sources.tables import confirmed

# Descriptions of performers.
PERFORMER = ("performer", "dj set", "dj", "b2b", "live set", "headliner", "opening act")
MAP_COLUMNS = (
    "id", "title", "event_date", "event_end_date", "event_time", "end_time", "venue_name", "venue_address", "venue_lat", "venue_lng", "category", "is_free", "price",
    "image_url", "source_username", "price_notes", "signup_url", "event_status", "availability_status", "is_recurring", "recurrence_pattern", "price_min", "price_max",
)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def pattern_search(text: str, *columns: str) -> Column:
    """Case-insensitive; % and _ in ``text`` are wildcards; a null column doesn't match."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def _grams(text: str) -> list[str]:
    """Runs of three characters that a text matched by a pattern must hold (no wildcard among them)."""
    found: list[str] = []
    for part in re.split("[%_]", text.lower()):
        found += [part[i : i + 3] for i in range(len(part) - 2)]
    return sorted(set(found))


def text_postings(rows: DataFrame, *columns: str, id: str = "id") -> DataFrame:
    """gram, id: the distinct runs of three characters of the lower-cased columns, and the rows that hold
    them. Written once, sorted by gram, it is read again by the few grams of a search."""

    def of(c: str) -> Column:
        low = F.lower(F.coalesce(c, F.lit("")))
        runs = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: low.substr(i, F.lit(3)))
        return F.when(F.length(low) > 2, runs).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[of(c) for c in columns]))
    return rows.select(F.explode(F.array_distinct(grams)).alias("gram"), F.col(id).alias("id"))


def indexed_search(rows: DataFrame, postings: DataFrame, text: str, *columns: str, id: str = "id") -> DataFrame:
    """The rows of :func:`pattern_search`, found by postings: rows that hold all runs of three characters
    of the text, then those of them that match. A text without such a run searches all rows."""
    grams = _grams(text)
    if grams:
        hits = postings.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        rows = rows.join(hits.select(F.col("id").alias(id)), id, "left_semi")
    return rows.where(pattern_search(text, *columns))


def literal_search(text: str, *columns: str) -> Column:
    """Case-insensitive without wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return out


def filter_events(events: DataFrame, status: str = "confirmed", category: str | None = None, date_from: str | None = None, date_to: str | None = None, is_free: bool | None = None, venue_id: int | None = None, search: str | None = None) -> DataFrame:
    """All conditions that are given hold; an empty status turns its filter off."""
    c = []
    if status:
        c.append(F.col("event_status") == status)
    if category:
        c.append(F.col("category") == category)
    if date_from:
        c.append(F.col("event_date") >= F.lit(date_from).cast("date"))
    if date_to:
        c.append(F.col("event_date") <= F.lit(date_to).cast("date"))
    if is_free is not None:
        c.append(F.col("is_free") == is_free)
    if venue_id is not None:
        c.append(F.col("venue_id") == venue_id)
    if search:
        c.append(pattern_search(search, *[x for x in ("title", "description", "venue_name") if x in events.columns]))
    return events.where(_all(c))


def upcoming(events: DataFrame, as_of: str) -> DataFrame:
    return events.where((F.col("event_date") >= F.lit(as_of).cast("date")) & (F.col("event_status") == "confirmed"))


def in_order(events: DataFrame) -> DataFrame:
    """By date and time, missing times last."""
    return events.orderBy(F.col("event_date").asc(), F.col("event_time").asc_nulls_last(), F.col("id").asc())


def page_bounds(page, limit, default: int = 20, most: int = 100) -> tuple[int, int]:
    """offset and limit of a page; values that aren't numbers count as missing."""

    def number(value, otherwise):
        try:
            return int(value) or otherwise
        except (TypeError, ValueError):
            return otherwise

    n = min(most, max(1, number(limit, default)))
    return (max(1, number(page, 1)) - 1) * n, n


def page(events: DataFrame, page=1, limit=20) -> DataFrame:
    offset, n = page_bounds(page, limit)
    return in_order(events).offset(offset).limit(n)


def page_summary(events: DataFrame, limit=20) -> DataFrame:
    n = page_bounds(1, limit)[1]
    return events.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / n).cast("long"))


def nest(events: DataFrame, venues: DataFrame, posts: DataFrame, sub_events: DataFrame) -> DataFrame:
    """Events with their venue and post as structs (null without one) and sub-events as an array.
    Cut the page first: only the given events take part in the joins."""
    v = venues.select(F.col("id").alias("venue_id"), F.struct("id", "name", "city").alias("venue"))
    p = posts.select(F.col("id").alias("source_post_id"), F.struct("shortcode", "post_url").alias("source_post"))
    wanted = sub_events.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    acts = wanted.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("id", "title", "event_date", "description"))).alias("sub_events")).withColumnRenamed("event_id", "id")
    out = events.join(v, "venue_id", "left").join(p, "source_post_id", "left").join(acts, "id", "left")
    return out.withColumn("sub_events", F.coalesce("sub_events", F.array().cast(acts.schema["sub_events"].dataType)))


def map_events(events: DataFrame, posts: DataFrame, as_of: str, category: str | None = None, date_to: str | None = None, date_from: str | None = None, is_free: bool | None = None, search: str | None = None) -> DataFrame:
    """Light columns of upcoming events with coordinates, with their post; date_from, is_free and search are optional extras."""
    some = upcoming(events, as_of).where(F.col("venue_lat").isNotNull() & F.col("venue_lng").isNotNull())
    some = filter_events(some, "", category, date_from, date_to, is_free, None, search)
    some = some.select(*[c for c in (*MAP_COLUMNS, "source_post_id") if c in events.columns])
    p = posts.select(F.col("id").alias("source_post_id"), F.col("shortcode").alias("source_post_shortcode"), F.col("post_url").alias("source_post_url"))
    return some.join(p, "source_post_id", "left").drop("source_post_id").orderBy("event_date", "id")


def venue_directory(venues: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Every venue with its number of upcoming events; counted before the join."""
    n = upcoming(events, as_of).groupBy("venue_id").agg(F.count("id").alias("upcoming_events"))
    out = venues.join(n, venues["id"] == n["venue_id"], "left").drop("venue_id")
    return out.withColumn("upcoming_events", F.coalesce("upcoming_events", F.lit(0).cast("long"))).orderBy("name", "id")


def category_counts(events: DataFrame, as_of: str) -> DataFrame:
    """Listed categories with the number of their upcoming events, most first."""
    return _by_category(upcoming(events, as_of).groupBy("category").agg(F.count("*").alias("count")))


def _by_category(n: DataFrame) -> DataFrame:
    dim = F.broadcast(category_dimension(n.sparkSession))
    out = dim.join(n, dim["value"] == n["category"], "left").select("ord", "value", "label", "emoji", F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    return out.orderBy(F.desc("count"), "ord")


def daily_counts(events: DataFrame) -> DataFrame:
    """category, venue_id, event_date, n of confirmed events: what counts of upcoming ones are kept up to date from."""
    return confirmed(events).where(F.col("event_date").isNotNull()).groupBy("category", "venue_id", "event_date").agg(F.count("*").alias("n"))


def changed_counts(counts: DataFrame, old: DataFrame, new: DataFrame, as_of: str | None = None) -> DataFrame:
    """Daily counts after a change: the changed events as they were are taken back, as they are now added.
    Only those are read, not the table of events. Days before ``as_of`` are dropped: no later count needs them."""
    change = daily_counts(new).unionByName(daily_counts(old).withColumn("n", -F.col("n")))
    all_ = counts.unionByName(change)
    if as_of:
        all_ = all_.where(F.col("event_date") >= F.lit(as_of).cast("date"))
    return all_.groupBy("category", "venue_id", "event_date").agg(F.sum("n").alias("n")).where("n <> 0")


def category_counts_kept(counts: DataFrame, as_of: str) -> DataFrame:
    """:func:`category_counts` from daily counts."""
    some = counts.where(F.col("event_date") >= F.lit(as_of).cast("date"))
    return _by_category(some.groupBy("category").agg(F.sum("n").alias("count")))


def venue_directory_kept(venues: DataFrame, counts: DataFrame, as_of: str) -> DataFrame:
    """:func:`venue_directory` from daily counts."""
    n = counts.where(F.col("event_date") >= F.lit(as_of).cast("date")).groupBy(F.col("venue_id").alias("id")).agg(F.sum("n").alias("upcoming_events"))
    return venues.join(n, "id", "left").withColumn("upcoming_events", F.coalesce("upcoming_events", F.lit(0).cast("long"))).orderBy("name", "id")


def search_venues(venues: DataFrame, text: str, columns: tuple[str, ...] = ("name", "city", "instagram_handle"), limit: int | None = None) -> DataFrame:
    """Venues where a column or an alias holds ``text``; the picker shows the first 50."""
    found = literal_search(text, *[c for c in columns if c in venues.columns])
    if "aliases" in venues.columns:
        found = found | F.coalesce(F.exists("aliases", lambda a: F.lower(a).contains(text.lower())), F.lit(False))
    out = venues.where(found).orderBy("name", "id")
    return out.limit(limit) if limit else out


def nearest(events: DataFrame, lat: float, lng: float, k: int = 20, search: str | None = None) -> DataFrame:
    """The k located events nearest to a point, with distance and its label."""
    some = events.where(labels.located(F.col("venue_lat"), F.col("venue_lng")))
    if search:
        some = some.where(literal_search(search, *[c for c in ("description", "title") if c in events.columns]))
    km = labels.kilometres(F.lit(lat), F.lit(lng), F.col("venue_lat"), F.col("venue_lng"))
    return some.withColumn("distance_km", km).withColumn("distance_label", distance_label(F.col("distance_km"))).orderBy("distance_km", "id").limit(k)


def saved_state(actions: DataFrame) -> DataFrame:
    """account_id, event_id, saved_at: what is saved after all toggles; a repeated action counts once."""
    once = actions.dropDuplicates(["action_id"])
    n = once.groupBy("account_id", "event_id").agg(F.count("*").alias("n"), F.max("ts").alias("saved_at"))
    return n.where(F.col("n") % 2 == 1).drop("n")


def saved_list(saved: DataFrame, events: DataFrame, venues: DataFrame, account_id: int) -> DataFrame:
    """One account's saved events with their venues, in the order they were saved."""
    own = saved.where(F.col("account_id") == account_id)
    v = venues.select(F.col("id").alias("venue_id"), F.col("city").alias("venue_city"))
    e = events.withColumnRenamed("id", "event_id")
    return own.join(e, "event_id").join(v, "venue_id", "left").orderBy("saved_at", "event_id")


def saved_counts(saved: DataFrame) -> DataFrame:
    return saved.groupBy("account_id").agg(F.count("*").alias("saved_events"))


def mark_saved(events: DataFrame, saved: DataFrame, account_id: int) -> DataFrame:
    own = saved.where(F.col("account_id") == account_id).select(F.col("event_id").alias("id"), F.lit(True).alias("is_saved")).distinct()
    return events.join(own, "id", "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))


def last_preferences(writes: DataFrame) -> DataFrame:
    """account_id and the categories written last; ties go to the larger seq."""
    return writes.groupBy("account_id").agg(F.max_by("categories", F.struct("ts", "seq")).alias("categories"))


def account_preferences(accounts: DataFrame, preferences: DataFrame) -> DataFrame:
    out = accounts.join(preferences, "account_id", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    return out.withColumn("onboarded", labels.onboarded(F.col("categories")))


def performers(sub_events: DataFrame) -> DataFrame:
    """Sub-events that name a performer: by description, artist, or short titles of one day."""
    same_day = F.count("*").over(Window.partitionBy("event_id", "event_date"))
    about, title = F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    short = (F.length(title) > 0) & (F.length(title) < 30) & (F.col("same_day") >= 3) & ~title.rlike("event|session|night")
    artist = F.coalesce(F.col("artist"), F.lit("")) != "" if "artist" in sub_events.columns else F.lit(False)
    return sub_events.withColumn("same_day", same_day).where(about.isin(*PERFORMER) | artist | about.rlike("\\b(b2b|dj|set|live)\\b") | short)


def schedule(sub_events: DataFrame) -> DataFrame:
    """Per event its scheduled days in order (entries with a date that aren't performers), and totals."""
    some = sub_events.where(F.col("event_date").isNotNull() & (F.coalesce("description", F.lit("")) != "performer"))
    days = some.groupBy("event_id", "event_date").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("slots"))
    out = days.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_date").alias("date"), "slots"))).alias("days"))
    return out.withColumn("n_dates", F.size("days").cast("long")).withColumn("n_slots", F.aggregate("days", F.lit(0).cast("long"), lambda a, d: a + F.size(d["slots"])))


def by_id(rows: DataFrame, id: int) -> DataFrame:
    """The row of an id, or none."""
    return rows.where(F.col("id") == id).limit(1)


def event_markers(events: DataFrame) -> DataFrame:
    """Marker columns of map events: short names, defaults for what is missing, empty or zero as none."""
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in events.columns else F.lit(None).cast("string")
    number = lambda c: F.nullif(F.col(c), F.lit(0.0)) if c in events.columns else F.lit(None).cast("double")
    return events.select(
        F.col("id").cast("string").alias("id"), F.coalesce(text("title"), F.lit("Untitled Event")).alias("event_title"), "event_date", text("event_time").alias("event_time"), text("venue_name").alias("location_name"),
        number("venue_lat").alias("location_lat"), number("venue_lng").alias("location_lng"), F.coalesce(text("category"), F.lit("other")).alias("category"), F.coalesce("is_free", F.lit(True)).alias("is_free"),
        number("price").alias("price"), F.coalesce(text("event_status"), F.lit("confirmed")).alias("event_status"), text("source_post_url").alias("post_url"),
    )


def post_card(events: DataFrame, *more: Column | str) -> DataFrame:
    """Feed columns: defaults for what is missing, zero prices as none; and ``more``."""
    return events.select(
        F.col("id").cast("string").alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Event")).alias("event_title"), F.col("event_date"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("other")).alias("category"), F.nullif("price", F.lit(0.0)).alias("price"), F.coalesce("is_free", F.lit(True)).alias("is_free"),
        F.nullif("venue_lat", F.lit(0.0)).alias("location_lat"), F.nullif("venue_lng", F.lit(0.0)).alias("location_lng"), F.coalesce("event_status", F.lit("confirmed")).alias("event_status"),
        *more,
    )


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if "A" <= c <= "Z" else c for c in name)


def _renamed(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(snake(f.name), _renamed(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(_renamed(kind.elementType), kind.containsNull)
    if isinstance(kind, MapType):
        return MapType(_renamed(kind.keyType), _renamed(kind.valueType), kind.valueContainsNull)
    return kind


def rename_keys(df: DataFrame) -> DataFrame:
    """All field names, nested ones too, from camelCase to snake_case."""
    return df.select(*[F.col(f"`{f.name}`").cast(_renamed(f.dataType)).alias(snake(f.name)) for f in df.schema.fields])


def scaled_scores(df: DataFrame, score: str, low: float = 12, high: float = 36) -> DataFrame:
    """``size``: score scaled to a range; null where all scores are equal. The extremes are
    aggregated once and joined as one row, so that rows needn't meet in one task."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    share = F.try_divide(F.col(score) - F.col("lo"), F.col("hi") - F.col("lo"))
    return df.join(F.broadcast(ends)).withColumn("size", low + share * (high - low)).drop("lo", "hi")
