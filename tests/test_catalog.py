"""Edge rows of expressions and gates, and plain models of the greedy operators."""

import datetime
import random
import shutil

from pyspark.sql import functions as F

from gatherlake.functions import dates, labels, text
from gatherlake.operators import catalog, dedup, merge, spatial
from gatherlake.schemas import BRONZE, schema

D = datetime.date


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def column(spark, values, kind, make):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_dates(spark):
    given = ["2026-02-28", "2026-02-29", "2026-13-01", "2026-3-1", "", None, " 2026-03-01"]
    assert column(spark, given, "string", labels.strict_date) == [D(2026, 2, 28), None, None, None, None, None, None]
    d = lambda x: F.lit(x).cast("date")
    assert one(spark, dates.date_range_label(d("2026-06-15"), d("2026-06-17"))) == "Jun 15-17"
    assert one(spark, dates.date_range_label(d("2026-06-15"), d("2026-07-01"))) == "Jun 15 - Jul 1"
    assert one(spark, dates.date_range_label(d("2026-12-31"), d("2027-01-01"))) == "Dec 31, 2026 - Jan 1, 2027"
    assert one(spark, dates.days_between(d("2026-01-02"), d("2026-01-01"))) == []
    days = F.array(d("2026-06-20"), d("2026-06-15"), d("2026-06-17"))
    assert one(spark, dates.many_dates_label(days)) == "Jun 15, 17, 20"
    assert one(spark, dates.many_dates_label(F.array(d("2026-06-16"), d("2026-06-15")))) == "Jun 15-16"
    assert one(spark, dates.consecutive(F.array(d("2026-06-15"), d("2026-06-15")))) is False
    assert one(spark, dates.preset("month", d("2026-01-31"))["end"]) == D(2026, 2, 28)
    for day, friday in ((2, 2), (3, 9), (4, 9), (5, 9)):  # 2 January 2026 is a Friday
        assert one(spark, dates.preset("weekend", d(f"2026-01-0{day}"))["start"]) == D(2026, 1, friday)


def test_times(spark):
    t = lambda a, b: one(spark, dates.time_range_label(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert [t(None, None), t("00:05", None), t(None, "12:00"), t("12:00", "12:00"), t("19:00", "22:30")] == ["Time TBA", "12:05 AM", "12:00 PM", "12:00 PM", "7:00 PM - 10:30 PM"]


def test_text(spark):
    titles = ["The Jazz Night at 70s Bistro", "Jazz – Night", "Set by @dj_x", "  A   B ", "Theatre"]
    assert column(spark, titles, "string", text.normal_title) == ["jazz night", "jazz night", "set", "a b", "theatre"]
    assert column(spark, ["The Bench Tower, BGC", "Gateway Mall", None, ""], "string", text.normal_venue) == ["bench tower", "gateway", "__no_venue__", "__no_venue__"]
    assert column(spark, ["café the of"], "string", text.title_words) == [["caf"]]
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert column(spark, ['["a","b"]', "[]", "nope", "", None, "[1"], "string", labels.json_array) == [["a", "b"], [], [], [], [], []]
    assert column(spark, [1, 0, 2, None], "int", labels.flag) == [True, False, False, False]
    assert column(spark, ["weekly:friday", "monthly:second-MONDAY", "x", None], "string", labels.recurrence_label) == ["Every Friday", "second Monday monthly", "x", "Recurring"]
    assert column(spark, [0.35, 1.24, None], "double", text.distance_label) == ["350m", "1.2 km", None]


def test_pages():
    assert [catalog.page_bounds(p, n) for p, n in ((1, 0), (1, 500), (0, 20), ("x", "y"), (3, 10))] == [(0, 20), (0, 100), (0, 20), (0, 20), (20, 10)]


def test_search_wildcards(spark):
    df = spark.createDataFrame([("100% fun", None), ("100 fun", "x"), (None, "a_b")], "title string, description string")
    assert df.where(catalog.pattern_search("100%f", "title", "description")).count() == 2
    assert df.where(catalog.literal_search("100%", "title", "description")).count() == 1


def test_toggles(spark):
    rows = [(1, 1, 1, 1), (2, 2, 1, 1), (3, 2, 1, 2), (4, 3, 1, 1), (5, 3, 1, 2), (6, 3, 1, 3), (6, 3, 1, 3)]
    actions = spark.createDataFrame(rows, "action_id long, account_id long, event_id long, ts long")
    assert sorted((r.account_id, r.saved_at) for r in catalog.saved_state(actions).collect()) == [(1, 1), (3, 3)]


def test_merge_twice_is_merge_once(spark):
    old = spark.createDataFrame([(1, "a", "x", 1)], "id long, k string, v string, w long")
    new = spark.createDataFrame([("a", "y", 2), ("b", "z", 3)], "k string, v string, w long")
    once = merge.assign_ids(merge.upsert(old, new, ("k",), ("v",)), ("k",))
    assert sorted(map(tuple, once.collect())) == [(1, "a", "y", 1), (2, "b", "z", 3)]
    assert sorted(map(tuple, merge.upsert(once, new, ("k",), ("v",)).collect())) == sorted(map(tuple, once.collect()))


def model(rows):
    """The greedy pass as a loop: leaders in order take later events that are similar to them."""
    stop = set(text.STOP_WORDS)
    words = lambda t: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split() if len(w) > 1 and w not in stop}
    rows = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    lead = {}
    for n, a in enumerate(rows):
        if a[0] in lead:
            continue
        lead[a[0]] = a[0]
        for b in rows[n + 1 :]:
            x, y = words(a[1]), words(b[1])
            if b[0] not in lead and a[3] == b[3] and a[2] <= (b[4] or b[2]) and b[2] <= (a[4] or a[2]) and (100 * len(x & y) >= 35 * len(x | y)):
                lead[b[0]] = a[0]
    return lead


def test_fuzzy_is_the_greedy_loop(spark):
    rng = random.Random(3)
    words = ["jazz", "night", "market", "open", "mic", "show", "rooftop", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))), D(2026, 1, rng.randint(1, 6)), rng.choice(["v", "w"])) for i in range(90)]
    rows = [(*r, rng.choice([None, r[2], r[2] + datetime.timedelta(days=2)])) for r in rows]
    df = spark.createDataFrame(rows, "id long, title string, event_date date, venue_name string, event_end_date date")
    df = df.selectExpr("*", "'confirmed' event_status")
    assert {r.id: r.leader for r in dedup.fuzzy_clusters(df).collect()} == model(rows)


def test_survivors_and_removed(spark):
    rows = [(i, f"Show {i // 2}", D(2026, 1, 1), "v", 0.1 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, title string, event_date date, venue_name string, completeness_score double")
    df = df.selectExpr("*", "cast(null as date) event_end_date", "cast(null as double) confidence", "cast(null as timestamp) created_at", "'confirmed' event_status")
    kept, removed = dedup.deduplicate(df)
    assert kept.count() + removed.count() == 10
    assert dedup.exact_losers(df).count() == 5


def haversine(a, b, c, d):
    from math import atan2, cos, radians, sin, sqrt

    h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * atan2(sqrt(h), sqrt(1 - h))


def points(spark, n=80, seed=1):
    rng = random.Random(seed)
    rows = [(i, D(2026, 1, 1 + i % 3), 14.5 + rng.randint(0, 40) / 10_000, 121 + rng.randint(0, 40) / 10_000, "music") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, event_date date, venue_lat double, venue_lng double, category string")


def test_leaders_by_distance(spark):
    rows, df = points(spark)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    leaders = []
    for r in order:
        if not any(haversine(r[2], r[3], x[2], x[3]) <= 100 for x in leaders):
            leaders.append(r)
    want = {r[0]: min((round(haversine(r[2], r[3], x[2], x[3]), 6), x[0]) for x in leaders)[1] for r in rows}
    assert {r.id: r.cluster for r in spatial.proximity_clusters(df, 100).collect()} == want
    assert spatial.markers(df, 100).agg(F.sum("event_count")).first()[0] == len(rows)


def test_moving_centres(spark):
    rows, df = points(spark, seed=2)
    centres = []
    want = {}
    for i, _, a, b, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        near = [(haversine(a, b, c[0], c[1]), k) for k, c in enumerate(centres)]
        best = min(near, default=(1e9, 0))
        if best[0] <= 100:
            c = centres[best[1]]
            c[2] += 1
            c[0] += (a - c[0]) / c[2]
            c[1] += (b - c[1]) / c[2]
        else:
            centres.append([a, b, 1, i])
            c = centres[-1]
        want[i] = c[3]
    assert {r.id: r.cluster for r in spatial.proximity_clusters(df, 100, "online").collect()} == want
    for most in (10,):  # rounds follow each other from the centres of those before
        assert {r.id: r.cluster for r in spatial.moving_clusters(df, 100, most).collect()} == want


def test_moving_centres_in_few_rounds(spark, monkeypatch):
    """Linked events take rounds by ``a_round``, not by what a task holds; rounds start from the centres of those before."""
    _, df = points(spark, 300, seed=2)
    written = []
    monkeypatch.setattr(spatial, "cut", lambda rows, name="step", write=spatial.cut: written.append(name) or write(rows, name))
    want = {r.id: r.cluster for r in spatial.moving_clusters(df, 100).collect()}
    for most, a_round, rounds in ((7, 500_000, 1), (7, 120, 3)):
        written.clear()
        options = {} if rounds == 1 else {"a_round": a_round}
        assert {r.id: r.cluster for r in spatial.moving_clusters(df, 100, most, **options).collect()} == want
        assert rounds <= written.count("moved") <= 2 * rounds - 1
    assert len(set(want.values())) > 5


def test_rename_keys(spark):
    df = spark.sql("select named_struct('eventId', 1, 'subItems', array(named_struct('itemName', 'x'))) as eventInfo, 2 as pageNo")
    out = catalog.rename_keys(df)
    assert out.columns == ["event_info", "page_no"] and out.first().event_info.sub_items[0].item_name == "x"


def test_many_equal_titles_make_one_row_of_the_join(spark):
    rows = [(i, "Jazz Night" if i % 3 else "night, JAZZ", D(2026, 1, 1), "v") for i in range(400)] + [(1000, "Jazz Night Special", D(2026, 1, 1), "v")]
    df = spark.createDataFrame(rows, "id long, title string, event_date date, venue_name string").selectExpr("*", "cast(null as date) event_end_date", "'confirmed' event_status")
    got = {r.id: r.leader for r in dedup.fuzzy_clusters(df).collect()}
    assert len(got) == 401 and set(got.values()) == {1}


def test_merges_touch_few_parts(spark, tmp_path):
    from gatherlake.streaming.live import incremental_upsert, table_now

    kind = "k string, v long, load_seq long"
    target, want = f"file://{tmp_path}/t", {}
    assert table_now(spark, target, "k string, v long").count() == 0
    for n, keys in enumerate((range(40), range(30, 60), [5], [5, 61], [5])):
        rows = [(f"k{k}", 100 * n + k, s) for k in keys for s in (0, 1)]
        rows = [(k, v + s, s) for k, v, s in rows] + [(None, 1, 1)]
        want |= {k: v for k, v, s in rows if k and s == 1}
        spark.createDataFrame(rows, kind).write.parquet(f"file://{tmp_path}/in/{n}")
        for _ in range(2):  # nothing new the second time
            incremental_upsert(spark, f"file://{tmp_path}/in/*", kind, target, f"file://{tmp_path}/state", ("k",), parts=8)
        assert {r.k: r.v for r in table_now(spark, target, "k string, v long").collect()} == want
    parts = [p.name for p in (tmp_path / "t" / "data").glob("v=*/part=*")]
    assert len(set(parts)) == 8 and len(parts) <= 8 + 2 and len(list((tmp_path / "t" / "commits").glob("c=*"))) == 2


def test_run_log(spark, tmp_path):
    import pytest

    from gatherlake.plans.ingest import empty_catalog, logged_ingest, runs
    from gatherlake.sources.tables import read

    bronze = {name: spark.createDataFrame([], schema(name, "bronze")) for name in BRONZE}
    log = f"file://{tmp_path}/log"
    logged_ingest(bronze, empty_catalog(spark), "a", "2026-01-01 00:00:00", log)
    with pytest.raises(ValueError):
        logged_ingest(bronze, empty_catalog(spark), "b", "2026-01-01 00:00:00", log, policy="?")
    rows = read(spark, log, "sync_log")
    assert sorted((r.run_id, r.status) for r in rows.collect()) == [("a", "completed"), ("a", "running"), ("b", "failed"), ("b", "running")]
    assert {r.run_id: (r.status, r.events, r.error is None) for r in runs(rows).collect()} == {"a": ("completed", 0, True), "b": ("failed", None, False)}


def test_counts_of_empty_tables(spark):
    """An upstream table without rows, read before a slower catalog table, counts as 0."""
    import time

    from gatherlake.plans.ingest import empty_catalog, ingest

    def slowly(name):
        time.sleep(2)
        return name

    bronze = {name: spark.createDataFrame([], schema(name, "bronze")) for name in BRONZE}
    silver = empty_catalog(spark)
    kinds = silver["venue"].schema.fields
    given = {"id": F.lit(7), "name": F.udf(slowly, "string")(F.concat(F.lit("v"), F.col("id")))}
    silver["venue"] = spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
    out, _, log = ingest(bronze, silver, "a", "2026-01-01 00:00:00")
    assert [(r.id, r.name) for r in out["venue"].collect()] == [(7, "v0")]
    assert log.select("status", "venues", "accounts", "posts", "events", "sub_events").first() == ("completed", 0, 0, 0, 0, 0)


def test_quick_keys_and_dates(spark):
    """Plain texts take a shorter way to the same keys; dates as before."""
    rng = random.Random(1)
    parts = [" ", "  ", "-", " - ", "at", "by", "the", "The ", "x-at y", "Jazz", "mall", " Mall", "building", ",", "@", "é", "–", "\t", "\n", "\u3000", "\u0085", "7", "by ", "at ", "\r\n"]
    rows = [("".join(rng.choices(parts, k=rng.randint(1, 6))),) for _ in range(5000)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    low = text._trim(F.lower("s"))
    title = text._strip_rules(low, [(f"^the{text.SPACE}+", ""), (f"{text.SPACE}+", " "), (" *[-–—] *", " "), (" +at .*$", ""), (" +by @?\\w+.*$", "")])
    venue = text._strip_rules(low, [(f"^the{text.SPACE}+", ""), (f"{text.SPACE}+", " "), (", *.*$", ""), (f" +({'|'.join(text.VENUE_ENDINGS)})$", "")])
    venue = F.when(F.coalesce("s", F.lit("")) == "", F.lit(text.NO_VENUE)).otherwise(venue)
    assert df.where(~text.normal_title(F.col("s")).eqNullSafe(title) | ~text.normal_venue(F.col("s")).eqNullSafe(venue)).count() == 0
    given = ["0000-02-29", "1582-10-10", "2023-02-29", "9999-12-31", "2026-01-01\n", "2026-01-00"]
    was = lambda c: F.when(c.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))
    assert column(spark, given, "string", lambda c: labels.strict_date(c).cast("string")) == column(spark, given, "string", lambda c: was(c).cast("string"))


def test_touched_blocks_read_events_once(spark):
    """The events after a change are made, and their keys, once for all steps of the de-duplication."""
    seen = spark.sparkContext.accumulator(0)

    def read(title):
        seen.add(1)
        return title

    rows = [(i, f"Show {i // 2}", D(2026, 1, 1), f"v{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, title string, event_date date, venue_name string")
    df = df.selectExpr("*", "cast(null as date) event_end_date", "'confirmed' event_status", "id / 100 completeness_score", "cast(null as double) confidence", "cast(null as timestamp) created_at")
    events = df.withColumn("title", F.udf(read, "string")("title"))
    none = spark.createDataFrame([], "block string, id long, pass string")
    got = {r.id for r in dedup.touched_duplicates(events, df.limit(0), df, none).where("id is not null").collect()}
    assert got == {r.id for r in dedup.deduplicate(df)[1].collect()} and len(got) >= 30
    assert seen.value == 60


def test_a_batch_writes_its_rows_once(spark, tmp_path, monkeypatch):
    """Changed rows go straight into their version; of each key the newest of several versions counts."""
    from gatherlake import queries
    from gatherlake.streaming import catalog as store

    copied = []
    monkeypatch.setattr(store, "cut", lambda rows, name="step", write=store.cut: copied.append(name) or write(rows, name))
    batch = queries.three_batches(spark, "/root/testdata/sf0.001")["b"]
    batch = {t: batch[t] if t in batch else spark.createDataFrame([], schema(t, "bronze")) for t in BRONZE}
    target, want, kept = f"file://{tmp_path}/t", {}, {}
    for number in range(3):
        some = {"ig_event": batch["ig_event"].where(f"ig_event_id % 10 >= {3 * number}").withColumn("event_title", F.lit(f"t{number}")), "sub_event": batch["sub_event"].where(f"ig_event_id % 4 >= {number}").withColumn("title", F.lit(f"s{number}"))}
        store.merge_batch(spark, batch | some, target, number, "2026-01-01 00:00:00")
        events = store.table_now(spark, target, "event").select("event_hash", "title", "id").collect()
        want |= {r.event_hash: f"t{number}" for r in events if int(r.event_hash) % 10 >= 3 * number}
        assert {r.event_hash: r.title for r in events} == want and len(events) == len(want)
        assert all(kept.setdefault(r.event_hash, r.id) == r.id for r in events)
        hashes = {r.id: int(r.event_hash) for r in events}
        titles = {(r.event_id, r.title) for r in store.table_now(spark, target, "sub_event").collect()}
        assert titles and all(t == f"s{min(number, hashes[e] % 4)}" for e, t in titles)
    assert not copied


def test_batches_replayed_and_compacted(spark, tmp_path):
    """Batches give what one ingest gives, also where one is killed between two tables and where versions are compacted."""
    from gatherlake import queries
    from gatherlake.plans.ingest import empty_catalog, ingest, without_duplicates
    from gatherlake.streaming import catalog as store

    sf = "/root/testdata/sf0.001"
    batches = {name: given for name, given in queries.three_batches(spark, sf).items() if name != "b"}
    tables = {}
    for name in batches:
        tables[name] = {t: batches[name][t] if t in batches[name] else spark.createDataFrame([], schema(t, "bronze")) for t in BRONZE}
    target = f"file://{tmp_path}/one"
    for number, name in enumerate(batches):
        store.merge_batch(spark, tables[name], target, number, "2026-01-01 00:00:00", compact_after=1)
        if number == 1:  # killed before its commit: tables are written, the commit isn't
            want = {t: sorted(map(str, store.table_now(spark, target, t).collect())) for t in store.KEYS}
            shutil.rmtree(tmp_path / "one" / "commits" / "c=1")
            shutil.rmtree(tmp_path / "one" / "data" / "sub_event" / "v=1")
            store.merge_batch(spark, tables[name], target, number, "2026-01-01 00:00:00", compact_after=1)
            assert want == {t: sorted(map(str, store.table_now(spark, target, t).collect())) for t in store.KEYS}
    events, children = store.survivors(spark, target)
    out, _, _ = ingest(queries.bronze_tables(spark, sf), empty_catalog(spark), "full", "2026-01-01 00:00:00")
    row = lambda df: sorted(map(str, df.select("event_hash", "title", "event_date", "venue_name").collect()))
    assert row(store.table_now(spark, target, "event")) == row(out["event"])
    ids = store.table_now(spark, target, "event").select("id").collect()
    assert len({r.id for r in ids}) == len(ids)
    assert events.count() < len(ids) and children.count() == children.join(events.withColumnRenamed("id", "event_id"), "event_id", "left_semi").count()
    again = sorted(r.event_hash for r in without_duplicates(out | {"event": store.table_now(spark, target, "event")})[0]["event"].collect())
    assert sorted(r.event_hash for r in events.collect()) == again
    assert len(store.last_commit(spark, target).versions["event"]) == 1
