"""Registered queries of the event catalog, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, labels, text
from .operators import catalog, dedup, merge, quality, spatial
from .sources.tables import catalog_view, cut, driver_table, keys, read, shared_folder, sql, with_coordinates

AS_OF = "1998-01-01"
QUERIES: dict = {}


def query(body: str | None = None, *views: str):
    def add(run):
        QUERIES[run.__name__] = (run, sql(body, *views) if body and views else body)
        return run

    return add


def fx(spark: SparkSession, d: str, *names: str):
    found = [catalog_view(spark, d, n) for n in names]
    return found[0] if len(found) == 1 else found


def _day(*columns: str):
    return [F.col(c).cast("string").alias(c) for c in columns]


@query("""SELECT id, title, CAST(event_date AS VARCHAR) AS event_date, event_time, venue_name, price FROM fx_event
WHERE event_status = 'confirmed' AND category = 'music' AND event_date >= DATE '1996-01-01' AND event_date <= DATE '1999-12-31' AND is_free = false AND (title ILIKE '%night%1%' OR venue_name ILIKE '%night%1%')
ORDER BY event_date, event_time NULLS LAST, id LIMIT 20 OFFSET 20""", "event")
def events_list_page(spark, d) -> DataFrame:
    e = catalog.filter_events(fx(spark, d, "event"), category="music", date_from="1996-01-01", date_to="1999-12-31", is_free=False, search="night%1")
    return catalog.page(e, 2, 20).select("id", "title", *_day("event_date"), "event_time", "venue_name", "price")


@query("""SELECT count(*) AS total, CAST(ceil(count(*) / 20e0) AS BIGINT) AS pages FROM fx_event WHERE event_status = 'confirmed' AND category = 'music'""", "event")
def events_list_summary(spark, d) -> DataFrame:
    return catalog.page_summary(catalog.filter_events(fx(spark, d, "event"), category="music"))


SAVED_SQL = "saved AS (SELECT account_id, event_id, max(ts) AS saved_at FROM fx_toggle GROUP BY account_id, event_id HAVING count(*) % 2 = 1)"


@query(f"""WITH {SAVED_SQL}
SELECT id, CAST(event_date AS VARCHAR) AS event_date, event_time, id IN (SELECT event_id FROM saved WHERE account_id = 7) AS is_saved
FROM fx_event WHERE event_status = 'confirmed' AND event_date >= DATE '{AS_OF}' ORDER BY fx_event.event_date, event_time NULLS LAST, id LIMIT 100""", "event", "toggle")
def events_upcoming(spark, d) -> DataFrame:
    e, t = fx(spark, d, "event", "toggle")
    top = catalog.page(catalog.upcoming(e, AS_OF), 1, 500)
    return catalog.mark_saved(top, catalog.saved_state(t), 7).select("id", *_day("event_date"), "event_time", "is_saved")


@query(f"""SELECT e.id, title, CAST(event_date AS VARCHAR) AS event_date, venue_lat, venue_lng, category, price, shortcode AS source_post_shortcode, post_url AS source_post_url
FROM fx_event e LEFT JOIN fx_source_post p ON e.source_post_id = p.id
WHERE event_status = 'confirmed' AND event_date >= DATE '{AS_OF}' AND venue_lat IS NOT NULL AND venue_lng IS NOT NULL""", "event", "source_post")
def events_map(spark, d) -> DataFrame:
    e, p = fx(spark, d, "event", "source_post")
    return catalog.map_events(e, p, AS_OF).select("id", "title", *_day("event_date"), "venue_lat", "venue_lng", "category", "price", "source_post_shortcode", "source_post_url")


@query("""WITH pick AS (SELECT * FROM fx_event WHERE event_status = 'confirmed' ORDER BY event_date, event_time NULLS LAST, id LIMIT 100)
SELECT e.id, v.city AS venue_city, p.shortcode, (SELECT count(*) FROM fx_sub_event s WHERE s.event_id = e.id) AS n_sub_events,
  coalesce((SELECT string_agg(s.title, ';' ORDER BY s.id, s.title) FROM fx_sub_event s WHERE s.event_id = e.id), '') AS acts
FROM pick e LEFT JOIN fx_venue v ON e.venue_id = v.id LEFT JOIN fx_source_post p ON e.source_post_id = p.id""", "event", "source_post", "sub_event")
def event_detail_nested(spark, d) -> DataFrame:
    e, v, p, s = fx(spark, d, "event", "venue", "source_post", "sub_event")
    out = catalog.nest(catalog.page(catalog.filter_events(e), 1, 100), v, p, s)
    acts = F.array_join(F.transform("sub_events", lambda x: x["title"]), ";")
    return out.select("id", F.col("venue.city").alias("venue_city"), "source_post.shortcode", F.size("sub_events").cast("long").alias("n_sub_events"), acts.alias("acts"))


@query("SELECT id, title, CAST(event_date AS VARCHAR) AS event_date, venue_name, event_status FROM fx_event WHERE id = 7", "event")
def event_by_id(spark, d) -> DataFrame:
    return catalog.by_id(fx(spark, d, "event"), 7).select("id", "title", *_day("event_date"), "venue_name", "event_status")


@query("SELECT id, name, city, lat, lng FROM fx_venue WHERE id = 7", "venue")
def venue_by_id(spark, d) -> DataFrame:
    return catalog.by_id(fx(spark, d, "venue"), 7).select("id", "name", "city", "lat", "lng")


@query(f"""SELECT CAST(e.id AS VARCHAR) AS id, CASE WHEN e.id % 5 = 0 THEN 'Untitled Event' ELSE title END AS event_title, CASE WHEN e.id % 7 = 0 THEN NULL ELSE nullif(e.venue_lat, 0) END AS location_lat, nullif(e.venue_lng, 0) AS location_lng,
  CASE WHEN e.id % 3 = 0 THEN 'other' ELSE category END AS category, coalesce(is_free, true) AS is_free, CASE WHEN e.id % 4 = 0 THEN NULL ELSE price END AS price, post_url
FROM fx_event e LEFT JOIN fx_source_post p ON e.source_post_id = p.id WHERE event_status = 'confirmed' AND event_date >= DATE '{AS_OF}' AND venue_lat IS NOT NULL AND venue_lng IS NOT NULL""", "event", "source_post")
def event_markers(spark, d) -> DataFrame:
    e, p = fx(spark, d, "event", "source_post")
    i = F.col("id")
    spoiled = catalog.map_events(e, p, AS_OF).withColumns({
        "title": F.when(i % 5 != 0, F.col("title")), "venue_lat": F.when(i % 7 == 0, 0.0).otherwise(F.col("venue_lat")), "category": F.when(i % 3 == 0, "").otherwise(F.col("category")),
        "price": F.when(i % 4 == 0, 0.0).otherwise(F.col("price")),
    })
    return catalog.event_markers(spoiled).select("id", "event_title", "location_lat", "location_lng", "category", "is_free", "price", "post_url")


@query("SELECT count(*) AS total, count(CASE WHEN venue_lat IS NOT NULL AND venue_lng IS NOT NULL THEN 1 END) AS located FROM fx_event", "event")
def located_count(spark, d) -> DataFrame:
    return spatial.located_count(fx(spark, d, "event"))


@query(f"""SELECT v.id, v.name, city, count(e.id) AS upcoming_events FROM fx_venue v
LEFT JOIN fx_event e ON e.venue_id = v.id AND e.event_status = 'confirmed' AND e.event_date >= DATE '{AS_OF}' GROUP BY v.id, v.name, city""", "event")
def venue_directory(spark, d) -> DataFrame:
    v, e = fx(spark, d, "venue", "event")
    return catalog.venue_directory(v, e, AS_OF).select("id", "name", "city", "upcoming_events")


@query(f"""SELECT e.id, v.name, CAST(event_date AS VARCHAR) AS event_date, event_time FROM fx_event e JOIN fx_venue v ON v.id = e.venue_id
WHERE v.id = 7 AND event_status = 'confirmed' AND event_date >= DATE '{AS_OF}'""", "event")
def venue_events(spark, d) -> DataFrame:
    v, e = fx(spark, d, "venue", "event")
    own = catalog.in_order(catalog.upcoming(catalog.filter_events(e, venue_id=7), AS_OF))
    return own.join(F.broadcast(v.where("id = 7").limit(1).select(F.col("id").alias("venue_id"), "name")), "venue_id").select("id", "name", *_day("event_date"), "event_time")


@query("""SELECT id, name, city FROM fx_venue WHERE contains(lower(name), '01') OR contains(lower(city), '01') OR contains(lower(city), 'nation_1') ORDER BY name, id LIMIT 50""", "venue")
def venue_search(spark, d) -> DataFrame:
    v = fx(spark, d, "venue").withColumn("aliases", F.array("city"))
    a, b = (catalog.search_venues(v, q, ("name", "city")) for q in ("01", "nation_1"))
    return a.union(b).distinct().orderBy("name", "id").limit(50).select("id", "name", "city")


@query(f"""WITH dim AS (SELECT * FROM (VALUES (0,'nightlife','Nightlife'),(1,'music','Music'),(2,'arts','Arts'),(3,'film','Film'),(4,'comedy','Comedy'),(5,'food','Food'),(6,'markets','Markets'),(7,'sports','Sports'),(8,'fitness','Fitness'),(9,'workshops','Workshops'),(10,'tech','Tech'),(11,'community','Community')) t(ord, value, label))
SELECT ord, value, label, count(e.id) AS count FROM dim LEFT JOIN fx_event e ON e.category = value AND event_status = 'confirmed' AND event_date >= DATE '{AS_OF}' GROUP BY ord, value, label""", "event")
def category_counts(spark, d) -> DataFrame:
    return catalog.category_counts(fx(spark, d, "event"), AS_OF).select("ord", "value", "label", "count")


def _kept_counts(spark, d) -> DataFrame:
    """Daily counts through three batches: events come early with other values, then as they are; days pass meanwhile."""
    e = cut(fx(spark, d, "event"), "all")
    odd = e.withColumns({"category": F.lit("film"), "venue_id": F.col("venue_id") % 3, "event_date": F.date_add("event_date", 400)})
    now, counts = e.limit(0), catalog.daily_counts(e.limit(0))
    steps = ((odd.where("id % 3 = 0").unionByName(e.where("id % 3 = 1")), "1996-01-01"), (e.where("id % 6 = 0").unionByName(odd.where("id % 3 = 2")), "1997-01-01"), (e.where("id % 6 = 3 or id % 3 = 2"), AS_OF))
    for batch, day in steps:
        old = now.join(batch.select("id"), "id", "left_semi").select(now.columns)
        counts = cut(catalog.changed_counts(counts, old, batch, day), "counts")
        now = cut(now.join(batch.select("id"), "id", "left_anti").unionByName(batch), "now")
    return counts


@query(QUERIES["category_counts"][1])
def category_counts_kept(spark, d) -> DataFrame:
    return catalog.category_counts_kept(_kept_counts(spark, d), AS_OF).select("ord", "value", "label", "count")


@query(QUERIES["venue_directory"][1])
def venue_directory_kept(spark, d) -> DataFrame:
    return catalog.venue_directory_kept(fx(spark, d, "venue"), _kept_counts(spark, d), AS_OF).select("id", "name", "city", "upcoming_events")


KM = "2 * 6371000e0 * atan2(sqrt(h), sqrt(1 - h)) / 1000"
HAV = "pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)"


@query(f"""WITH p AS (SELECT *, {HAV.format(a='14.55e0', b='venue_lat', c='121.0e0', d='venue_lng')} AS h FROM fx_event WHERE venue_lat <> 0 AND venue_lng <> 0 AND contains(lower(title), 'night')),
q AS (SELECT *, {KM} AS km FROM p)
SELECT id, title AS event_title, CAST(round(km, 6) AS DOUBLE) AS km, CASE WHEN km < 1 THEN CAST(CAST(round(km * 1000) AS INTEGER) AS VARCHAR) || 'm' ELSE printf('%.1f', km) || ' km' END AS distance_label, category
FROM q ORDER BY q.km, id LIMIT 40""", "event")
def feed_nearby(spark, d) -> DataFrame:
    near = catalog.nearest(fx(spark, d, "event"), 14.55, 121.0, 40, "night")
    cards = catalog.post_card(near, F.round("distance_km", 6).alias("km"), "distance_label")
    return cards.select(F.col("id").cast("long").alias("id"), "event_title", "km", "distance_label", "category")


@query(f"""WITH p AS (SELECT c_custkey AS point_id, 14.35e0 + CAST((c_custkey * 31) % 450 AS DOUBLE) / 1000e0 AS lat, 120.85e0 + CAST((c_custkey * 17) % 300 AS DOUBLE) / 1000e0 AS lng FROM customer),
v AS (SELECT id, venue_lat, venue_lng FROM (SELECT *, row_number() OVER (PARTITION BY venue_lat, venue_lng ORDER BY id) AS turn FROM fx_event WHERE venue_lat <> 0 AND venue_lng <> 0) WHERE turn <= 20),
d AS (SELECT point_id, id AS event_id, 2 * 6371e0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (SELECT *, {HAV.format(a='p.lat', b='v.venue_lat', c='p.lng', d='v.venue_lng')} AS h FROM p, v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY km, event_id) AS INTEGER) AS place FROM d)
SELECT point_id, event_id, place, CAST(round(km, 6) AS DOUBLE) AS km FROM r WHERE place <= 20""", "event")
def feeds_nearest(spark, d) -> DataFrame:
    """The nearest events of every account; accounts have places made from their number."""
    k = F.col("c_custkey")
    points = driver_table(spark, d, "customer").select(k.alias("id"), (14.35 + (k * 31 % 450).cast("double") / 1000).alias("lat"), (120.85 + (k * 17 % 300).cast("double") / 1000).alias("lng"))
    return spatial.nearest_for_each(points, fx(spark, d, "event")).withColumn("km", F.round("km", 6))


@query("SELECT id, title, venue_name FROM fx_event WHERE title ILIKE '%night%17%' OR venue_name ILIKE '%night%17%'", "event")
def events_search_indexed(spark, d) -> DataFrame:
    """A search by postings; the pattern's wildcard is checked on what they leave."""
    e = fx(spark, d, "event")
    postings = cut(catalog.text_postings(e, "title", "venue_name").repartitionByRange("gram").sortWithinPartitions("gram", "id"), "postings")
    return catalog.indexed_search(e, postings, "night%17", "title", "venue_name").select("id", "title", "venue_name")


@query(f"""WITH {SAVED_SQL} SELECT event_id, title, city AS venue_city, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at FROM saved JOIN fx_event e ON e.id = event_id LEFT JOIN fx_venue v ON v.id = venue_id WHERE account_id = 7""", "event", "toggle")
def saved_list(spark, d) -> DataFrame:
    t, e, v = fx(spark, d, "toggle", "event", "venue")
    out = catalog.saved_list(catalog.saved_state(t), e, v, 7)
    return out.select("event_id", "title", "venue_city", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"))


@query(f"WITH {SAVED_SQL} SELECT account_id, count(*) AS saved_events FROM saved GROUP BY account_id", "toggle")
def saved_counts(spark, d) -> DataFrame:
    return catalog.saved_counts(catalog.saved_state(fx(spark, d, "toggle")))


@query("""SELECT c_custkey AS account_id, coalesce(arg_max(event_type, (ts, event_id)), '') AS category, count(event_id) > 0 AS onboarded
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey""")
def account_preferences(spark, d) -> DataFrame:
    writes = driver_table(spark, d, "events").select(F.col("user_id").alias("account_id"), "ts", F.col("event_id").alias("seq"), F.array("event_type").alias("categories"))
    accounts = driver_table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"))
    out = catalog.account_preferences(accounts, catalog.last_preferences(writes))
    return out.select("account_id", F.array_join("categories", ",").alias("category"), "onboarded")


@query("""SELECT id, event_id, title FROM (SELECT *, count(*) OVER (PARTITION BY event_id, event_date) AS same_day FROM fx_sub_event)
WHERE description IN ('performer', 'live set') OR regexp_matches(description, '\\b(b2b|dj|set|live)\\b') OR (length(title) < 30 AND same_day >= 3)""", "sub_event")
def performers(spark, d) -> DataFrame:
    return catalog.performers(fx(spark, d, "sub_event")).select("id", "event_id", "title")


@query("""SELECT event_id, count(DISTINCT event_date) AS n_dates, count(*) AS n_slots, CAST(min(event_date) AS VARCHAR) AS first_day
FROM fx_sub_event WHERE description <> 'performer' AND event_date IS NOT NULL GROUP BY event_id""", "sub_event")
def schedule(spark, d) -> DataFrame:
    s = catalog.schedule(fx(spark, d, "sub_event"))
    return s.select("event_id", "n_dates", "n_slots", F.col("days")[0]["date"].cast("string").alias("first_day"))


SPOILED = """CASE WHEN id % 11 = 0 THEN '2026-02-29' WHEN id % 13 = 0 THEN '2026-3-1' WHEN id % 17 = 0 THEN '' WHEN id % 19 = 0 THEN NULL ELSE CAST(event_date AS VARCHAR) END"""


def _spoiled(e: DataFrame) -> DataFrame:
    i = F.col("id")
    return e.withColumn("day", F.when(i % 11 == 0, "2026-02-29").when(i % 13 == 0, "2026-3-1").when(i % 17 == 0, "").when(i % 19 == 0, None).otherwise(F.col("event_date").cast("string"))).withColumn("kind", F.when(i % 23 == 0, "unknown").when(i % 29 == 0, "").otherwise(F.col("category")))


@query(f"""SELECT id, {SPOILED} AS day, CASE WHEN id % 11 = 0 OR id % 13 = 0 OR id % 17 = 0 OR id % 19 = 0 THEN 'day not a date' END AS reject_reason FROM fx_event""", "event")
def quality_dates(spark, d) -> DataFrame:
    return quality.gate(_spoiled(fx(spark, d, "event")), dates=("day",)).select("id", "day", "reject_reason")


@query("""SELECT CASE WHEN id % 23 = 0 THEN 'unknown' WHEN id % 29 = 0 THEN 'other' ELSE category END AS kind, CASE WHEN id % 23 = 0 THEN 'kind not allowed' END AS reject_reason, count(*) AS n
FROM fx_event GROUP BY ALL""", "event")
def quality_domains(spark, d) -> DataFrame:
    from .schemas import CATEGORIES, LEGACY_CATEGORIES

    e = quality.with_defaults(_spoiled(fx(spark, d, "event")), {"kind": "other"})
    return quality.gate(e, required=("title",), domains={"kind": CATEGORIES + LEGACY_CATEGORIES}).groupBy("kind", "reject_reason").agg(F.count("*").alias("n"))


@query("SELECT title, CAST(event_date AS VARCHAR) AS event_date, count(*) AS rows FROM fx_event GROUP BY title, fx_event.event_date HAVING count(*) > 1", "event")
def quality_keys(spark, d) -> DataFrame:
    return quality.repeated_keys(fx(spark, d, "event"), "title", "event_date").select("title", *_day("event_date"), "rows")


@query("SELECT id, event_id FROM fx_sub_event WHERE event_id NOT IN (SELECT id FROM fx_event WHERE event_status = 'confirmed')", "event", "sub_event")
def quality_orphans(spark, d) -> DataFrame:
    s, e = fx(spark, d, "sub_event", "event")
    return quality.orphans(s, catalog.filter_events(e), "event_id").select("id", "event_id")


@query("""WITH v AS (SELECT lower(name) AS k, max(id) AS found_venue_id FROM fx_venue GROUP BY 1)
SELECT id, found_venue_id FROM fx_event LEFT JOIN v ON lower(venue_name) = k""", "event")
def key_lookup(spark, d) -> DataFrame:
    e, v = fx(spark, d, "event", "venue")
    return merge.venue_ids(e.withColumn("venue_name", F.upper("venue_name")), keys(v, "id", "name")).select("id", "found_venue_id")


@query("SELECT s.id, e.id AS event_id FROM fx_sub_event s JOIN fx_event e ON s.event_id = e.id WHERE e.id % 3 <> 0 AND event_status = 'confirmed'", "event", "sub_event")
def child_mapping(spark, d) -> DataFrame:
    e, s = fx(spark, d, "event", "sub_event")
    hashed = e.select("id", "event_status", F.when(F.col("id") % 3 != 0, F.concat(F.lit("h"), F.col("id").cast("string"))).alias("event_hash"))
    up = hashed.select(F.col("id").alias("ig_event_id"), "event_hash")
    return merge.child_mapping(s.select("id", F.col("event_id").alias("ig_event_id")), up, hashed.where("event_status = 'confirmed'")).select("id", "event_id")


def _batches(spark, d):
    e = fx(spark, d, "event").select(F.col("id").cast("string").alias("event_hash"), F.col("id").alias("n"), "title", "completeness_score", "price")
    one = e.where("n % 3 <> 0").withColumns({"load_seq": F.lit(0), "id": F.col("n") + 1_000_000})
    two = e.where("n % 2 = 0").withColumn("completeness_score", F.col("completeness_score") + 0.5).withColumn("title", F.concat("title", F.lit(" v2")))
    again = two.where("n % 7 = 0").withColumn("title", F.concat("title", F.lit("b"))).withColumn("completeness_score", F.col("completeness_score") - 1)
    return one.drop("n", "load_seq"), two.withColumn("load_seq", F.lit(1)).unionByName(again.withColumn("load_seq", F.lit(2))).drop("n")


MERGE_SQL = """WITH one AS (SELECT CAST(id AS VARCHAR) AS event_hash, title, completeness_score, price FROM fx_event WHERE id % 3 <> 0),
two AS (SELECT CAST(id AS VARCHAR) AS event_hash, concat(title, ' v2') AS title, completeness_score + 0.5e0 AS completeness_score, price, 1 AS load_seq FROM fx_event WHERE id % 2 = 0
  UNION ALL SELECT CAST(id AS VARCHAR), concat(title, ' v2b'), completeness_score + 0.5e0 - 1, price, 2 FROM fx_event WHERE id % 2 = 0 AND id % 7 = 0),
pick AS (SELECT *, row_number() OVER (PARTITION BY event_hash ORDER BY {order}) AS r FROM two)
SELECT coalesce(n.event_hash, o.event_hash) AS event_hash, {title} AS title, {score} AS completeness_score, coalesce(n.price, o.price) AS price
FROM one o FULL OUTER JOIN (SELECT * FROM pick WHERE r = 1) n ON o.event_hash = n.event_hash"""


@query(MERGE_SQL.format(order="load_seq DESC", title="coalesce(n.title, o.title)", score="coalesce(n.completeness_score, o.completeness_score)"), "event")
def merge_events_last(spark, d) -> DataFrame:
    one, two = _batches(spark, d)
    return merge.upsert(one, merge.last_or_best(two, ("event_hash",)).drop("load_seq"), ("event_hash",)).drop("id")


@query(MERGE_SQL.format(order="completeness_score DESC, load_seq DESC", title="coalesce(n.title, o.title)", score="coalesce(n.completeness_score, o.completeness_score)"), "event")
def merge_events_best(spark, d) -> DataFrame:
    one, two = _batches(spark, d)
    best = merge.last_or_best(two, ("event_hash",), "best_score").drop("load_seq")
    better = F.coalesce("new.completeness_score", F.lit(0.0)) >= F.coalesce("old.completeness_score", F.lit(0.0))
    return merge.upsert(one, best, ("event_hash",), better=better).drop("id")


@query("""WITH old AS (SELECT * FROM fx_source_post WHERE id % 3 <> 0), new AS (SELECT id, shortcode, concat(post_url, '?x') AS post_url, concat('c', id) AS caption, likes_count + 1 AS likes_count FROM fx_source_post WHERE id % 2 = 0)
SELECT coalesce(o.shortcode, n.shortcode) AS shortcode, coalesce(o.post_url, n.post_url) AS post_url, md5(coalesce(n.caption, o.caption)) AS caption_md5, coalesce(n.likes_count, o.likes_count) AS likes_count FROM old o FULL OUTER JOIN new n ON o.shortcode = n.shortcode""", "source_post")
def merge_posts_partial(spark, d) -> DataFrame:
    p = fx(spark, d, "source_post").drop("comments_count")
    new = p.where("id % 2 = 0").select("id", "shortcode", F.concat("post_url", F.lit("?x")).alias("post_url"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("caption"), (F.col("likes_count") + 1).alias("likes_count"))
    out = merge.upsert(p.where("id % 3 <> 0"), new, ("shortcode",), ("caption", "likes_count"))
    return out.select("shortcode", "post_url", F.md5("caption").alias("caption_md5"), "likes_count")


@query("""SELECT id, event_id, title FROM fx_sub_event WHERE event_id NOT IN (SELECT event_id FROM fx_sub_event WHERE id % 5 = 0)
UNION ALL SELECT id, event_id, concat(title, ' new') FROM fx_sub_event WHERE id % 5 = 0""", "sub_event")
def replace_children(spark, d) -> DataFrame:
    s = fx(spark, d, "sub_event").select("id", "event_id", "title")
    return merge.replace_children(s, s.where("id % 5 = 0").withColumn("title", F.concat("title", F.lit(" new"))), "event_id")


@query("""WITH e AS (SELECT id AS n, CASE WHEN id % 3 <> 0 THEN id END AS id FROM fx_event)
SELECT n, coalesce(id, (SELECT max(id) FROM e) + row_number() OVER (PARTITION BY id IS NULL ORDER BY n)) AS id FROM e""", "event")
def assign_ids(spark, d) -> DataFrame:
    e = fx(spark, d, "event").select(F.col("id").alias("n"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"))
    return merge.assign_ids(e, ("n",))


NORM = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '^the\\s+', ''), '\\s+', ' ', 'g'), ' *[-–—] *', ' ', 'g'), ' +at .*$', ''), ' +by @?[0-9A-Za-z_]+.*$', '')"""


@query(f"""WITH e AS (SELECT *, trim({NORM}) AS k FROM fx_dedup),
r AS (SELECT *, row_number() OVER (PARTITION BY k, event_date ORDER BY completeness_score DESC, title, id) AS r FROM e)
SELECT id FROM r WHERE r > 1""", "dedup")
def dedup_exact(spark, d) -> DataFrame:
    return dedup.exact_losers(fx(spark, d, "dedup"))


WORDS = """list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ('the','a','an','at','in','on','by','for','of','and','&','+','x','with','ft','feat','vs','to','from','is','are','was')))"""
ALIKE = """a.venue_name = b.venue_name AND a.event_date <= coalesce(b.event_end_date, b.event_date) AND b.event_date <= coalesce(a.event_end_date, a.event_date) AND (a.event_date, a.title, a.id) < (b.event_date, b.title, b.id)
  AND CASE WHEN len(list_distinct(list_concat(a.words, b.words))) = 0 THEN 1e0 ELSE CAST(len(list_intersect(a.words, b.words)) AS DOUBLE) / len(list_distinct(list_concat(a.words, b.words))) END >= 0.35e0"""


@query(f"WITH e AS (SELECT *, {WORDS} AS words FROM fx_dedup) SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON {ALIKE}", "dedup")
def dedup_pairs(spark, d) -> DataFrame:
    return dedup.similar_pairs(fx(spark, d, "dedup")).select("i", "j")


#: The passes as a loop over each venue's events in order: an event joins the first leader so far that it is similar to.
REMOVED_SQL = f"""WITH RECURSIVE k AS (SELECT *, trim({NORM}) AS k, {WORDS} AS words FROM fx_dedup),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, event_date ORDER BY completeness_score DESC, confidence DESC, event_date DESC, title, id) AS r FROM k),
rest AS (SELECT *, row_number() OVER (PARTITION BY venue_name ORDER BY event_date, title, id) AS n FROM ranked WHERE r = 1),
near AS (SELECT b.id, list(a.id ORDER BY a.n) AS earlier FROM rest a JOIN rest b ON {ALIKE} GROUP BY b.id),
loop AS (
  SELECT venue_name, n, id, id AS leader, [id] AS leaders FROM rest WHERE n = 1
  UNION ALL
  SELECT o.venue_name, o.n, o.id, coalesce(list_filter(near.earlier, lambda x: list_contains(l.leaders, x))[1], o.id),
         CASE WHEN len(list_filter(coalesce(near.earlier, []), lambda x: list_contains(l.leaders, x))) = 0 THEN list_append(l.leaders, o.id) ELSE l.leaders END
  FROM loop l JOIN rest o ON o.venue_name = l.venue_name AND o.n = l.n + 1 LEFT JOIN near ON near.id = o.id),
best AS (SELECT l.id, row_number() OVER (PARTITION BY leader ORDER BY completeness_score DESC, confidence DESC, event_date DESC, title, l.id) AS r FROM loop l JOIN rest USING (id)),
removed AS (SELECT id, 'exact' AS pass FROM ranked WHERE r > 1 UNION ALL SELECT id, 'fuzzy' FROM best WHERE r > 1)
"""


@query(REMOVED_SQL + "SELECT id, pass FROM removed", "dedup")
def dedup_full(spark, d) -> DataFrame:
    return dedup.deduplicate(fx(spark, d, "dedup"))[1]


@query(REMOVED_SQL + """SELECT total, exact, fuzzy, exact + fuzzy AS deleted, total - exact - fuzzy AS remaining
FROM (SELECT count(*) AS total FROM fx_dedup), (SELECT count(CASE WHEN pass = 'exact' THEN 1 END) AS exact, count(CASE WHEN pass = 'fuzzy' THEN 1 END) AS fuzzy FROM removed)""", "dedup")
def dedup_report(spark, d) -> DataFrame:
    e = fx(spark, d, "dedup")
    return dedup.report(e, cut(dedup.deduplicate(e)[1], "removed"))


@query(REMOVED_SQL + """SELECT 'event' AS kind, id FROM fx_dedup WHERE id NOT IN (SELECT id FROM removed)
UNION ALL SELECT 'sub_event', id FROM fx_sub_event WHERE event_id NOT IN (SELECT id FROM removed)
UNION ALL SELECT 'dry_run', count(*) FROM fx_sub_event""", "dedup", "sub_event")
def dedup_apply(spark, d) -> DataFrame:
    e, s = fx(spark, d, "dedup", "sub_event")
    removed = cut(dedup.deduplicate(e)[1], "removed")
    events, children = dedup.apply(e, s, removed, dry_run=False)
    _, untouched = dedup.apply(e, s, removed)
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), F.col("id").cast("long").alias("id"))
    return kind(events, "event").unionByName(kind(children, "sub_event")).unionByName(kind(untouched.agg(F.count("*").alias("id")), "dry_run"))


@query("""WITH n AS (SELECT id, CASE id % 7 WHEN 0 THEN '  Salcedo Market' WHEN 1 THEN 'GATEWAY MALL ' WHEN 2 THEN 'up diliman' ELSE venue_name END AS venue_name, venue_lat, venue_lng FROM fx_event)
SELECT id, venue_name, coalesce(CASE id % 7 WHEN 0 THEN 14.5609e0 WHEN 1 THEN 14.6182e0 WHEN 2 THEN 14.6538e0 END, venue_lat) AS venue_lat,
  coalesce(CASE id % 7 WHEN 0 THEN 121.0224e0 WHEN 1 THEN 121.0558e0 WHEN 2 THEN 121.0686e0 END, venue_lng) AS venue_lng,
  CASE WHEN id % 7 < 3 THEN 'confirmed' ELSE 'tba' END AS location_status,
  CASE id % 7 WHEN 0 THEN 'Jaime Velasquez Park, Salcedo Village, Makati' WHEN 1 THEN 'Araneta City, Cubao, Quezon City' WHEN 2 THEN 'University of the Philippines Diliman, Quezon City' ELSE 'old' END AS venue_address FROM n""", "event")
def geocode_manual(spark, d) -> DataFrame:
    i = F.col("id") % 7
    bare = lambda c: F.when(i >= 3, F.col(c))
    e = fx(spark, d, "event").withColumns({
        "venue_name": F.when(i == 0, "  Salcedo Market").when(i == 1, "GATEWAY MALL ").when(i == 2, "up diliman").otherwise(F.col("venue_name")),
        "venue_lat": bare("venue_lat"), "venue_lng": bare("venue_lng"), "location_status": F.lit("tba"), "venue_address": F.lit("old"),
    })
    return spatial.apply_geocodes(e, spatial.geocode(spatial.unlocated_names(e))).select("id", "venue_name", "venue_lat", "venue_lng", "location_status", "venue_address")


@query("""WITH found AS (SELECT name, min(s_suppkey) AS k FROM (SELECT concat(upper(name), ' ') AS name, id AS s_suppkey FROM fx_venue WHERE id % 20 = 10) GROUP BY name),
g AS (SELECT v.name, 14.5e0 + id % 100 / 1000e0 AS lat, 121.0e0 AS lng FROM fx_venue v WHERE id % 20 = 10)
SELECT e.id, coalesce(g.lat, e.venue_lat, v.lat) AS venue_lat, coalesce(g.lng, e.venue_lng, v.lng) AS venue_lng FROM fx_event e LEFT JOIN g ON e.venue_name = g.name LEFT JOIN fx_venue v ON v.id = e.venue_id AND v.lat IS NOT NULL""", "event")
def geocode_enrich(spark, d) -> DataFrame:
    e, v = fx(spark, d, "event", "venue")
    places = v.where("id % 20 = 10").select(F.concat(F.upper("name"), F.lit(" ")).alias("name"), (14.5 + (F.col("id") % 100) / 1000).alias("lat"), F.lit(121.0).alias("lng"), F.lit("a").alias("address"), F.col("id").alias("ord"))
    out = spatial.apply_geocodes(e, spatial.geocode(spatial.unlocated_names(e), places))
    return spatial.propagate_coordinates(out, with_coordinates(v)).select("id", "venue_lat", "venue_lng")


@query("""SELECT arg_min(venue_lat, (event_date, id)) AS lat, arg_min(venue_lng, (event_date, id)) AS lng, count(*) AS event_count, arg_min(category, (event_date, id)) AS category,
  printf('%.4f', arg_min(venue_lat, (event_date, id))) || ',' || printf('%.4f', arg_min(venue_lng, (event_date, id))) AS label
FROM fx_event WHERE venue_lat <> 0 AND venue_lng <> 0 GROUP BY round(venue_lat, 4), round(venue_lng, 4)""", "event")
def markers_grid(spark, d) -> DataFrame:
    return spatial.markers_by_grid(fx(spark, d, "event"))


METRES = "2 * 6371000e0 * atan2(sqrt({h}), sqrt(1 - ({h})))".format(h=HAV.format(a="a.lat", b="b.lat", c="a.lng", d="b.lng"))


@query(f"""WITH RECURSIVE u AS (SELECT * FROM fx_event WHERE event_status = 'confirmed' AND event_date >= DATE '{AS_OF}' AND venue_lat <> 0 AND venue_lng <> 0),
place AS (SELECT *, row_number() OVER (ORDER BY event_date, id) AS n FROM (SELECT venue_lat AS lat, venue_lng AS lng, min(event_date) AS event_date, arg_min(id, (event_date, id)) AS id FROM u GROUP BY venue_lat, venue_lng)),
far AS (SELECT a.id AS i, b.id AS j, a.n AS ni, b.n AS nj, {METRES} AS metres FROM place a JOIN place b ON a.id <> b.id AND {METRES} <= 500),
near AS (SELECT j AS id, list(i ORDER BY ni) AS earlier FROM far WHERE ni < nj GROUP BY j),
loop AS (
  SELECT n, id, true AS leads, [id] AS leaders FROM place WHERE n = 1
  UNION ALL
  SELECT p.n, p.id, NOT list_has_any(coalesce(near.earlier, []), l.leaders), CASE WHEN list_has_any(coalesce(near.earlier, []), l.leaders) THEN l.leaders ELSE list_append(l.leaders, p.id) END
  FROM loop l JOIN place p ON p.n = l.n + 1 LEFT JOIN near ON near.id = p.id),
home AS (
  SELECT lat, lng, loop.id, CASE WHEN leads THEN loop.id ELSE (SELECT arg_min(far.i, (far.metres, far.i)) FROM far JOIN loop m ON m.id = far.i AND m.leads WHERE far.j = loop.id) END AS cluster
  FROM loop JOIN place USING (id))
SELECT cluster, CAST(round(avg(venue_lat), 6) AS DOUBLE) AS lat, CAST(round(avg(venue_lng), 6) AS DOUBLE) AS lng, count(*) AS event_count, coalesce(arg_min(category, (event_date, u.id)), 'other') AS category
FROM u JOIN home ON venue_lat = lat AND venue_lng = home.lng GROUP BY cluster""", "event")
def markers_proximity(spark, d) -> DataFrame:
    m = spatial.markers(catalog.upcoming(fx(spark, d, "event"), AS_OF), 500)
    return m.select("cluster", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "event_count", "category")


#: Events in order, each with the list of all centres as it leaves them.
ONLINE_SQL = f"""WITH RECURSIVE u AS (SELECT id, venue_lat AS lat, venue_lng AS lng, row_number() OVER (ORDER BY event_date, id) AS k FROM fx_event WHERE event_status = 'confirmed' AND event_date >= DATE '{AS_OF}' AND venue_lat <> 0 AND venue_lng <> 0),
loop AS (
  SELECT k, id, id AS cluster, [struct_pack(lat := lat, lng := lng, n := 1e0, id := id)] AS centres FROM u WHERE k = 1
  UNION ALL
  SELECT k, id, CASE WHEN low <= {{radius}} THEN centres[best].id ELSE id END,
         CASE WHEN low <= {{radius}} THEN list_transform(centres, lambda c, i: CASE WHEN i = best THEN struct_pack(lat := c.lat + (lat - c.lat) / (c.n + 1), lng := c.lng + (lng - c.lng) / (c.n + 1), n := c.n + 1, id := c.id) ELSE c END)
              ELSE list_append(centres, struct_pack(lat := lat, lng := lng, n := 1e0, id := id)) END
  FROM (
    SELECT *, list_min(far) AS low, list_position(far, list_min(far)) AS best
    FROM (SELECT u.k, u.id, u.lat, u.lng, l.centres, list_transform(l.centres, lambda c: {METRES.replace('a.', 'u.').replace('b.', 'c.')}) AS far FROM loop l JOIN u ON u.k = l.k + 1)))
SELECT id, cluster FROM loop"""


@query(ONLINE_SQL.format(radius=100), "event")
def markers_online(spark, d) -> DataFrame:
    return spatial.proximity_clusters(catalog.upcoming(fx(spark, d, "event"), AS_OF), 100, "online")


@query(ONLINE_SQL.format(radius=2500), "event")
def markers_moving(spark, d) -> DataFrame:
    """Moving centres with a radius at which places link up far; a task holds a thousand events at a time."""
    return spatial.moving_clusters(catalog.upcoming(fx(spark, d, "event"), AS_OF), 2500, 1000)


@query("""SELECT id, CASE WHEN is_free THEN 'FREE' WHEN id % 4 = 1 AND id % 8 = 1 THEN '₱' || format('{:,}', id % 5000) || ' – ₱' || format('{:,}', id % 5000 + 100) WHEN id % 4 = 1 THEN '₱' || format('{:,}', id % 5000)
  WHEN id % 4 = 2 THEN '₱' || format('{:,}', id % 7000) ELSE 'Price TBA' END AS price_label, CASE WHEN id % 3000 >= 1000 THEN printf('%.1f', (id % 3000) / 1000e0 + 1e-9) || 'k' ELSE CAST(id % 3000 AS VARCHAR) END AS count_label FROM fx_event""", "event")
def labels_price(spark, d) -> DataFrame:
    i = F.col("id")
    low = F.when(i % 4 == 1, (i % 5000).cast("double"))
    high = F.when(i % 4 == 1, (i % 5000 + F.when(i % 8 == 1, 100).otherwise(0)).cast("double"))
    price = F.when(i % 4 == 2, (i % 7000).cast("double"))
    return fx(spark, d, "event").select("id", labels.price_label(F.col("is_free"), price, low, high).alias("price_label"), text.count_label(i % 3000).alias("count_label"))


@query("""SELECT id, CASE category WHEN 'music' THEN 'Music' WHEN 'nightlife' THEN 'Nightlife' WHEN 'food' THEN 'Food' WHEN 'markets' THEN 'Markets' ELSE 'Other' END AS category_label,
  CASE WHEN event_time IS NOT NULL THEN CAST((CAST(event_time[1:2] AS INTEGER) + 11) % 12 + 1 AS VARCHAR) || event_time[3:5] || CASE WHEN CAST(event_time[1:2] AS INTEGER) >= 12 THEN ' PM' ELSE ' AM' END || CASE WHEN id % 2 = 0 THEN ' – 11:30 PM' ELSE '' END END AS compact_time,
  CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a, b' ELSE 'a, b, +1' END AS aliases, CAST(event_date AS VARCHAR) AS day FROM fx_event""", "event")
def labels_names(spark, d) -> DataFrame:
    i = F.col("id")
    some = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (i % 4).cast("int"))
    return fx(spark, d, "event").select(
        "id", labels.category_label(F.col("category")).alias("category_label"), dates.compact_time_label(F.col("event_time"), F.when(i % 2 == 0, "23:30")).alias("compact_time"),
        text.alias_label(some).alias("aliases"), labels.strict_date(F.col("event_date").cast("string")).cast("string").alias("day"),
    )


@query("""WITH e AS (SELECT id, event_date AS a, event_date + CAST(id % 40 AS INTEGER) AS b, event_time AS t FROM fx_event)
SELECT id, CASE WHEN a = b THEN strftime(a, '%b %-d') WHEN date_trunc('month', a) = date_trunc('month', b) THEN strftime(a, '%b %-d') || '-' || strftime(b, '%-d')
  WHEN year(a) = year(b) THEN strftime(a, '%b %-d') || ' - ' || strftime(b, '%b %-d') ELSE strftime(a, '%b %-d, %Y') || ' - ' || strftime(b, '%b %-d, %Y') END AS range_label,
  CASE WHEN strftime(a, '%b') = strftime(b, '%b') THEN strftime(a, '%b %-d') || '–' || strftime(b, '%-d') ELSE strftime(a, '%b %-d') || ' – ' || strftime(b, '%b %-d') END AS compact_label,
  strftime(a, '%a, %b %-d') AS day_label,
  CASE WHEN t IS NULL THEN 'Time TBA' ELSE CAST((CAST(t[1:2] AS INTEGER) + 11) % 12 + 1 AS VARCHAR) || t[3:5] || CASE WHEN CAST(t[1:2] AS INTEGER) >= 12 THEN ' PM' ELSE ' AM' END END AS time_label,
  CAST(id % 40 + 1 AS INTEGER) AS span, id % 40 > 0 AS many_days FROM e""", "event")
def labels_dates(spark, d) -> DataFrame:
    a, b = F.col("event_date"), F.date_add("event_date", (F.col("id") % 40).cast("int"))
    return fx(spark, d, "event").select(
        "id", dates.date_range_label(a, b).alias("range_label"), dates.compact_range_label(a, b).alias("compact_label"), dates.day_label(a).alias("day_label"),
        dates.time_range_label(F.col("event_time"), F.lit(None).cast("string")).alias("time_label"), dates.day_span(a, b).alias("span"), dates.many_days(a, b).alias("many_days"),
    )


@query("""SELECT id, CASE event_status WHEN 'tentative' THEN 'Tentative' WHEN 'cancelled' THEN 'Cancelled' END AS status_label, CASE id % 4 WHEN 0 THEN 'SOLD OUT' WHEN 1 THEN 'Waitlist' END AS availability_label,
  CASE id % 5 WHEN 0 THEN 'Location TBA' WHEN 1 THEN 'Secret Location' WHEN 2 THEN 'DM for address' ELSE coalesce(venue_name, 'Location not specified') END AS location_label,
  CASE category WHEN 'music' THEN '#E74C3C' WHEN 'nightlife' THEN '#9B59B6' WHEN 'food' THEN '#FFEB3B' WHEN 'markets' THEN '#FF9800' ELSE '#9E9E9E' END AS color,
  CASE id % 6 WHEN 0 THEN 'Daily' WHEN 1 THEN 'Every Friday' WHEN 2 THEN 'second Monday monthly' WHEN 3 THEN 'sometimes' WHEN 4 THEN 'Every Someday' ELSE 'Recurring' END AS recurrence_label,
  event_status <> 'confirmed' OR id % 4 < 2 OR id % 6 = 0 AS shows_row FROM fx_event""", "event")
def labels_status(spark, d) -> DataFrame:
    i = F.col("id")
    state = F.when(i % 4 == 0, "sold_out").when(i % 4 == 1, "waitlist").otherwise("available")
    place = F.when(i % 5 == 0, "tba").when(i % 5 == 1, "secret").when(i % 5 == 2, "dm_for_details")
    pattern = F.when(i % 6 == 0, "daily").when(i % 6 == 1, "weekly:Friday").when(i % 6 == 2, "monthly:second-monday").when(i % 6 == 3, "sometimes").when(i % 6 == 4, "weekly:someday")
    return fx(spark, d, "event").select(
        "id", labels.status_label(F.col("event_status")).alias("status_label"), labels.availability_label(state).alias("availability_label"), labels.location_label(place, F.col("venue_name")).alias("location_label"),
        labels.category_color(F.col("category")).alias("color"), labels.recurrence_label(pattern).alias("recurrence_label"), labels.shows_status_row(F.col("event_status"), state, i % 6 == 0).alias("shows_row"),
    )


@query("""SELECT id, CASE id % 4 WHEN 0 THEN '__no_venue__' ELSE lower(name) END AS venue_key, id % 3 = 1 AS flag, CASE id % 3 WHEN 0 THEN '2026-01-02 03:04:05' END AS moment FROM fx_venue""", "venue")
def labels_keys(spark, d) -> DataFrame:
    i = F.col("id")
    spoiled = F.when(i % 4 == 0, "").when(i % 4 == 1, F.concat(F.lit("The  "), "name", F.lit(" Mall "))).when(i % 4 == 2, F.concat("name", F.lit(", Makati, Manila"))).otherwise(F.upper("name"))
    given = F.when(i % 3 == 0, "2026-01-02T03:04:05").when(i % 3 == 1, "soon")
    return fx(spark, d, "venue").select("id", text.normal_venue(spoiled).alias("venue_key"), labels.flag(i % 3).alias("flag"), F.date_format(labels.moment(given), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("""WITH d AS (SELECT event_id, list_sort(list_distinct(list(event_date))) AS days FROM fx_sub_event GROUP BY event_id),
c AS (SELECT *, len(days) AS n, days[1] AS a, days[len(days)] AS b, CAST(days[len(days)] - days[1] AS BIGINT) + 1 = len(days) AS run FROM d)
SELECT event_id, run AS consecutive, CASE WHEN n = 1 THEN strftime(a, '%b %-d') WHEN run AND date_trunc('month', a) = date_trunc('month', b) THEN strftime(a, '%b %-d') || '-' || strftime(b, '%-d')
  WHEN run AND year(a) = year(b) THEN strftime(a, '%b %-d') || ' - ' || strftime(b, '%b %-d') WHEN run THEN strftime(a, '%b %-d, %Y') || ' - ' || strftime(b, '%b %-d, %Y')
  ELSE strftime(a, '%b') || ' ' || array_to_string(list_transform(days, lambda x: strftime(x, '%-d')), ', ') END AS label FROM c""", "sub_event")
def labels_days(spark, d) -> DataFrame:
    days = fx(spark, d, "sub_event").groupBy("event_id").agg(F.collect_set("event_date").alias("days"))
    return days.select("event_id", dates.consecutive(F.col("days")).alias("consecutive"), dates.many_dates_label(F.col("days")).alias("label"))


@query("SELECT id, title, CAST(event_date AS VARCHAR) AS event_date, venue_id, venue_lat FROM fx_event WHERE event_status = 'confirmed'", "event")
def snapshot_read(spark, d) -> DataFrame:
    """A snapshot of the events, read again by the catalog's schema."""
    from .sources.tables import confirmed, snapshot

    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex[:12]}"
    snapshot(fx(spark, d, "event"), path)
    return confirmed(read(spark, path, "event")).select("id", "title", *_day("event_date"), "venue_id", "venue_lat")


@query("""SELECT id, regexp_extract(post_url, '/p/([^/?]+)', 1) AS code, '/api/images/proxy?url=' || url_encode('https://cdn.example.com/a b/' || id) || '&shortcode=' || shortcode AS image,
  coalesce(nullif(string_split(caption, chr(10))[1], ''), 'Instagram Post') AS display_title FROM fx_source_post""", "source_post")
def labels_links(spark, d) -> DataFrame:
    p = fx(spark, d, "source_post")
    cdn = F.concat(F.lit("https://cdn.example.com/a b/"), F.col("id").cast("string"))
    return p.select("id", text.shortcode(F.col("post_url")).alias("code"), F.regexp_replace(text.image_link(F.lit(None).cast("string"), cdn, F.col("post_url")), "\\+", "%20").alias("image"), text.display_title(F.lit(""), F.col("caption")).alias("display_title"))


@query("""SELECT id, CAST(unnest(generate_series(event_date, event_date + CAST(id % 4 AS INTEGER), INTERVAL 1 DAY)) AS DATE)::VARCHAR AS day FROM fx_event""", "event")
def event_days(spark, d) -> DataFrame:
    end = F.date_add("event_date", (F.col("id") % 4).cast("int"))
    return fx(spark, d, "event").select("id", F.explode(dates.days_between(F.col("event_date"), end)).alias("day")).select("id", *_day("day"))


@query("""WITH e AS (SELECT DISTINCT event_date AS a FROM fx_event)
SELECT CAST(a AS VARCHAR) AS as_of, CAST(a + 7 AS VARCHAR) AS week_end, CAST(a + CAST((12 - dayofweek(a)) % 7 AS INTEGER) AS VARCHAR) AS friday, CAST(a + CAST((12 - dayofweek(a)) % 7 + 2 AS INTEGER) AS VARCHAR) AS sunday, CAST(CAST(a + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_end FROM e""", "event")
def date_presets(spark, d) -> DataFrame:
    a = F.col("event_date")
    part = lambda n, k, name: dates.preset(n, a)[k].cast("string").alias(name)
    return fx(spark, d, "event").select("event_date").distinct().select(a.cast("string").alias("as_of"), part("week", "end", "week_end"), part("weekend", "start", "friday"), part("weekend", "end", "sunday"), part("month", "end", "month_end"))


@query("""WITH d AS (SELECT DISTINCT venue_id, event_date FROM fx_event), g AS (SELECT *, event_date - CAST(row_number() OVER (PARTITION BY venue_id ORDER BY event_date) AS INTEGER) AS g FROM d)
SELECT venue_id, CAST(min(event_date) AS VARCHAR) AS run_start, CAST(max(event_date) AS VARCHAR) AS run_end, count(*) AS n_days FROM g GROUP BY venue_id, g""", "event")
def consecutive_runs(spark, d) -> DataFrame:
    return spatial.runs_of_days(fx(spark, d, "event"), "venue_id").select("venue_id", *_day("run_start", "run_end"), "n_days")


@query("SELECT id, sha256(lower(trim(title)) || '|' || CAST(event_date AS VARCHAR) || '|' || lower(trim(venue_name))) AS event_hash FROM fx_event", "event")
def event_hash(spark, d) -> DataFrame:
    return fx(spark, d, "event").select("id", text.event_hash(F.col("title"), F.col("event_date"), F.col("venue_name")).alias("event_hash"))


@query("""SELECT event_id, round(12 + (value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) * 24, 6) AS size FROM events""")
def score_scaling(spark, d) -> DataFrame:
    return catalog.scaled_scores(driver_table(spark, d, "events"), "value").select("event_id", F.round("size", 6).alias("size"))


@query("SELECT id AS event_id, event_date::VARCHAR AS event_date, venue_name FROM fx_event", "event")
def rename_keys(spark, d) -> DataFrame:
    e = fx(spark, d, "event").select(F.struct(F.col("id").alias("eventId"), F.col("event_date").cast("string").alias("eventDate")).alias("eventInfo"), F.col("venue_name").alias("venueName"))
    return catalog.rename_keys(e).select("event_info.event_id", "event_info.event_date", "venue_name")


def bronze_tables(spark, d) -> dict[str, DataFrame]:
    """Upstream tables made from the test tables, for the ingest."""
    from .schemas import BRONZE, schema

    e, v, s = fx(spark, d, "event", "venue", "sub_event")
    made = {
        "known_venue": v.select(F.col("id").alias("known_venue_id"), "name", "city", "lat", "lng", F.lit('["x"]').alias("aliases")),
        "ig_account": driver_table(spark, d, "customer").select(F.col("c_custkey").alias("ig_account_id"), F.col("c_name").alias("username"), F.lit(1).alias("is_active")),
        "ig_post": fx(spark, d, "source_post").select(F.col("id").alias("ig_post_id"), (F.col("id") % 100 + 1).alias("ig_account_id"), "shortcode", "post_url", "caption", "likes_count", "comments_count", F.lit(1).alias("is_event")),
        "ig_event": _spoiled(e).select(F.col("id").alias("ig_event_id"), "source_post_id", F.col("source_account_id").alias("ig_account_id"), F.col("title").alias("event_title"), F.col("day").alias("event_date"), "event_time", "venue_name", "price", F.col("is_free").cast("int").alias("is_free"), F.col("kind").alias("category"), "completeness_score", F.col("id").cast("string").alias("event_hash")),
        "sub_event": s.select((F.col("id")).alias("sub_event_id"), F.col("event_id").alias("ig_event_id"), "title", F.col("event_date").cast("string").alias("event_date"), "description"),
    }
    return {n: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(n, "bronze").fields]) for n, df in made.items() if n in BRONZE}


INGEST_SQL = """SELECT CAST(id AS VARCHAR) AS event_hash, title, CAST(event_date AS VARCHAR) AS event_date, CASE WHEN id % 29 = 0 THEN 'other' ELSE category END AS category, is_free, v.name AS venue_name
FROM (SELECT e.*, e.venue_id AS vid FROM fx_event e) x JOIN (SELECT id AS vid, name FROM fx_venue) v USING (vid)
WHERE id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AND id % 19 <> 0 AND id % 23 <> 0"""


@query(INGEST_SQL, "event")
def ingest_full(spark, d) -> DataFrame:
    from .plans.ingest import empty_catalog, ingest

    out, _, _ = ingest(bronze_tables(spark, d), empty_catalog(spark), "run", "2026-01-01 00:00:00")
    v = out["venue"].select(F.col("id").alias("venue_id"), F.col("name").alias("found"))
    return out["event"].join(v, "venue_id").select("event_hash", "title", *_day("event_date"), "category", "is_free", F.col("found").alias("venue_name"))


GOOD = "id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AND id % 19 <> 0 AND id % 23 <> 0"


@query(f"""WITH n AS (SELECT (SELECT count(*) FROM fx_venue) AS venues, (SELECT count(*) FROM customer) AS accounts, (SELECT count(*) FROM fx_source_post WHERE id % 100 + 1 IN (SELECT c_custkey FROM customer)) AS posts,
  (SELECT count(*) FROM fx_event WHERE {GOOD}) AS events, (SELECT count(*) FROM fx_sub_event WHERE event_id IN (SELECT id FROM fx_event WHERE {GOOD})) AS sub_events)
SELECT 'one' AS run_id, 'completed' AS status, venues, accounts, posts, events, sub_events, NULL AS error FROM n
UNION ALL SELECT 'two', 'failed', NULL, NULL, NULL, NULL, NULL, 'policy must be ''last'' or ''best_score'''""", "event", "source_post", "sub_event")
def ingest_log(spark, d) -> DataFrame:
    from .plans.ingest import empty_catalog, logged_ingest, runs

    log, bronze = f"{shared_folder(spark)}/log-{uuid.uuid4().hex[:12]}", bronze_tables(spark, d)
    logged_ingest(bronze, empty_catalog(spark), "one", "2026-01-01 00:00:00", log)
    try:
        logged_ingest(bronze, empty_catalog(spark), "two", "2026-01-01 00:00:00", log, policy="none")
    except ValueError:
        pass  # the log tells
    return runs(read(spark, log, "sync_log")).drop("started_at", "finished_at")


@query("""SELECT s.id, v.name AS venue_name, c.c_name AS username, concat('P', e.source_post_id) AS shortcode, s.title
FROM fx_sub_event s JOIN fx_event e ON s.event_id = e.id JOIN fx_venue v ON v.id = e.venue_id LEFT JOIN customer c ON c.c_custkey = e.source_account_id
WHERE e.id % 11 <> 0 AND e.id % 13 <> 0 AND e.id % 17 <> 0 AND e.id % 19 <> 0 AND e.id % 23 <> 0""", "event", "sub_event")
def ingest_links(spark, d) -> DataFrame:
    """Children of the ingested catalog with the names that their ids lead to."""
    from .plans.ingest import empty_catalog, ingest

    out, _, _ = ingest(bronze_tables(spark, d), empty_catalog(spark), "run", "2026-01-01 00:00:00")
    named = lambda n, key, name: out[n].select(F.col("id").alias(key), F.col(name).alias("found_" + name))
    e = out["event"].select(F.col("id").alias("event_id"), "venue_id", "source_account_id", "source_post_id")
    e = e.join(named("venue", "venue_id", "name"), "venue_id").join(named("source_account", "source_account_id", "username"), "source_account_id", "left").join(named("source_post", "source_post_id", "shortcode"), "source_post_id", "left")
    return out["sub_event"].join(e, "event_id").select("id", F.col("found_name").alias("venue_name"), F.col("found_username").alias("username"), F.col("found_shortcode").alias("shortcode"), "title")


@query(MERGE_SQL.format(order="load_seq DESC", title="coalesce(n.title, o.title)", score="coalesce(n.completeness_score, o.completeness_score)"), "event")
def ingest_incremental(spark, d) -> DataFrame:
    from .streaming.live import incremental_upsert, table_now

    one, two = _batches(spark, d)
    rows = one.drop("id").withColumn("load_seq", F.lit(0))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    for name, batch in (("a", rows), ("b", two.drop("id").select(rows.columns))):  # the stream runs as each folder has landed
        batch.write.parquet(f"{folder}/in/{name}")
        incremental_upsert(spark, f"{folder}/in/*", rows.schema, f"{folder}/out", f"{folder}/state", ("event_hash",))
    return table_now(spark, f"{folder}/out", rows.drop("load_seq").schema)


def landed(spark, d, batches: dict[str, dict[str, DataFrame]], **options) -> str:
    """Ingest upstream batches one after another, as they land; gives the folder of the catalog."""
    from .streaming.catalog import announce, incremental_ingest

    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex[:12]}"
    for name, tables in batches.items():
        for t, rows in tables.items():
            rows.write.parquet(f"{folder}/in/{name}/{t}")
        announce(spark, f"{folder}/in", name)
        incremental_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", "2026-01-01 00:00:00", **options)
    return f"{folder}/out"


def three_batches(spark, d) -> dict[str, dict[str, DataFrame]]:
    """The upstream tables in three batches: some rows come early and again later, changed; children follow their events."""
    b = bronze_tables(spark, d)
    e, s = b["ig_event"], b["sub_event"]
    early = e.where("ig_event_id % 3 <> 0").withColumn("event_title", F.concat(F.lit("early "), "event_title"))
    gone = s.where("ig_event_id % 3 <> 0").withColumns({"sub_event_id": F.col("sub_event_id") + 100_000_000, "title": F.lit("gone")})
    return {
        "a": {"known_venue": b["known_venue"].where("known_venue_id % 2 = 0"), "ig_account": b["ig_account"], "ig_post": b["ig_post"].where("ig_post_id % 2 = 0"), "ig_event": early.where("ig_event_id % 2 = 0 and source_post_id % 2 = 0"), "sub_event": gone.where("ig_event_id % 2 = 0")},
        "b": {"known_venue": b["known_venue"], "ig_post": b["ig_post"].where("ig_post_id % 2 = 1"), "ig_event": early.where("ig_event_id % 2 = 1"), "sub_event": gone.where("ig_event_id % 2 = 1")},
        "c": {"known_venue": b["known_venue"].limit(0), "ig_account": b["ig_account"].where("ig_account_id % 5 = 0"), "ig_event": e, "sub_event": s},
    }


BATCHES_SQL = f"""SELECT 'event' AS kind, CAST(e.id AS VARCHAR) AS key, title, v.name AS venue_name, c_name AS username, concat('P', e.source_post_id) AS shortcode
FROM fx_event e JOIN fx_venue v ON v.id = e.venue_id LEFT JOIN customer ON c_custkey = e.source_account_id WHERE {GOOD.replace("id %", "e.id %")}
UNION ALL SELECT 'sub_event', CAST(s.id AS VARCHAR), s.title, v.name, NULL, NULL FROM fx_sub_event s JOIN fx_event e ON s.event_id = e.id JOIN fx_venue v ON v.id = e.venue_id WHERE {GOOD.replace("id %", "e.id %")}"""


@query(BATCHES_SQL, "event", "sub_event")
def ingest_batches(spark, d) -> DataFrame:
    """All five tables after three batches, by the names that their ids lead to."""
    from .streaming.catalog import table_now

    now = lambda n: table_now(spark, target, n)
    target = landed(spark, d, three_batches(spark, d))
    named = lambda n, key, name, out: now(n).select(F.col("id").alias(key), F.col(name).alias(out))
    e = now("event").join(named("venue", "venue_id", "name", "found"), "venue_id").join(named("source_account", "source_account_id", "username", "username"), "source_account_id", "left")
    e = e.join(named("source_post", "source_post_id", "shortcode", "shortcode"), "source_post_id", "left")
    events = e.select(F.lit("event").alias("kind"), F.col("event_hash").alias("key"), "title", F.col("found").alias("venue_name"), "username", "shortcode")
    none = F.lit(None).cast("string")
    children = now("sub_event").join(e.select(F.col("id").alias("event_id"), "found"), "event_id")
    return events.unionByName(children.select(F.lit("sub_event").alias("kind"), F.col("id").cast("string").alias("key"), "title", F.col("found").alias("venue_name"), none.alias("username"), none.alias("shortcode")))


@query(REMOVED_SQL + "SELECT id, pass FROM removed", "dedup")
def dedup_batches(spark, d) -> DataFrame:
    """De-duplication after each of three batches, of the touched blocks only; some events come early, with another title, venue or score."""
    e = cut(fx(spark, d, "dedup"), "all")
    odd = e.withColumns({"title": F.concat(F.lit("early "), "title"), "venue_name": F.when(F.col("id") % 50 != 0, F.col("venue_name")), "completeness_score": F.lit(0.5)})
    now, removed = e.limit(0), spark.createDataFrame([], "block string, id long, pass string")
    for batch in (odd.where("id % 3 = 0").unionByName(e.where("id % 3 = 1")), e.where("id % 6 = 0").unionByName(odd.where("id % 7 = 2 and id % 3 = 2")), e.where("id % 6 = 3 or id % 3 = 2")):
        batch = cut(batch, "batch")
        old = cut(now.join(batch.select("id"), "id", "left_semi"), "old")
        now = cut(now.join(batch.select("id"), "id", "left_anti").unionByName(batch), "now")
        found = cut(dedup.touched_duplicates(now, old, batch, removed), "found")
        removed = cut(removed.join(found.select("block").distinct(), "block", "left_anti").unionByName(found.where("id is not null")), "removed")
    return removed.select("id", "pass")


@query(f"WITH {SAVED_SQL} SELECT account_id, event_id FROM saved", "toggle")
def saved_live(spark, d) -> DataFrame:
    from .streaming.live import saved_now, saved_sink, saved_stream

    t = fx(spark, d, "toggle").select("action_id", "account_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex[:12]}"
    for n in range(4):  # each lands after the one before was processed
        t.where(F.pmod(F.xxhash64("action_id"), F.lit(4)) == n).drop("action_id").write.parquet(f"{folder}/in/{n}")
        live = saved_stream(spark.readStream.schema(t.drop("action_id").schema).parquet(f"{folder}/in/*"))
        writer = live.writeStream.outputMode("update").foreachBatch(saved_sink(spark, f"{folder}/out", 2)).option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return saved_now(spark, f"{folder}/out").select("account_id", "event_id")


@query("""SELECT id, CASE id % 5 WHEN 0 THEN 'a|b' WHEN 1 THEN 'é' ELSE '' END AS image_urls, CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM fx_source_post""", "source_post")
def labels_arrays(spark, d) -> DataFrame:
    """Arrays of JSON texts, some of which aren't any."""
    i = F.col("id") % 5
    given = F.when(i == 0, '["a","b"]').when(i == 1, '["é"]').when(i == 2, '["a"').when(i == 3, "nope")
    array = labels.json_array(given)
    return fx(spark, d, "source_post").select("id", F.array_join(array, "|").alias("image_urls"), F.size(array).alias("n"))


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: body for name, (_, body) in QUERIES.items() if body}
