"""Spatial grouping into map markers, and venue coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import EARTH_METRES, located, metres
from ..functions.text import coordinate_label
from ..schemas import BOX, manual_geocodes
from ..sources.tables import cut
from .graph import followers, groups, join_by_share
from .merge import numbered


def markers_by_grid(events: DataFrame, digits: int = 4) -> DataFrame:
    """One marker for each rounded coordinate, at its first event's place."""
    e = events.where(located(F.col("venue_lat"), F.col("venue_lng")))
    first = F.struct("event_date", "id")
    out = e.groupBy(F.round("venue_lat", digits).alias("cell_lat"), F.round("venue_lng", digits).alias("cell_lng")).agg(
        F.min_by(F.struct("venue_lat", "venue_lng"), first).alias("at"), F.count("*").alias("event_count"), F.min_by("category", first).alias("category")
    )
    label = F.concat(coordinate_label(F.col("at.venue_lat")), F.lit(","), coordinate_label(F.col("at.venue_lng")))
    return out.select(F.col("at.venue_lat").alias("lat"), F.col("at.venue_lng").alias("lng"), "event_count", F.coalesce("category", F.lit("other")).alias("category"), label.alias("label"))


def _cells(radius: float) -> list[Column]:
    """Cube of ``radius`` metres that holds a point of the sphere; near points lie in neighbouring cubes everywhere."""
    lat, lng = F.radians("lat"), F.radians("lng")
    axes = (F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat))
    return [F.floor(a * EARTH_METRES / radius) for a in axes]


def within(points: DataFrame, radius: float) -> DataFrame:
    """i, j, metres: pairs of points (id, lat, lng) at most ``radius`` metres apart, both ways."""
    x, y, z = _cells(radius)
    p = points.select("id", "lat", "lng", x.alias("x"), y.alias("y"), z.alias("z"))
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("pqr", (a, b, c), strict=True)]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    wide = p.withColumn("s", F.explode(steps)).select(F.col("id").alias("i"), F.col("lat").alias("lat_i"), F.col("lng").alias("lng_i"), (F.col("x") + F.col("s.p")).alias("x"), (F.col("y") + F.col("s.q")).alias("y"), (F.col("z") + F.col("s.r")).alias("z"))
    far = metres(F.col("lat_i"), F.col("lng_i"), F.col("lat"), F.col("lng"))
    return wide.join(p, ["x", "y", "z"]).where(F.col("i") != F.col("id")).select("i", F.col("id").alias("j"), far.alias("metres")).where(F.col("metres") <= radius)


_STEPS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def _cube(lat: str, lng: str, edge: float, step: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """A number of the cube of ``edge`` metres that a place lies in, or of a neighbour of it."""
    a, b = F.radians(lat), F.radians(lng)
    axes = (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))
    return F.xxhash64(*[(F.floor(x * EARTH_METRES / edge) + s).cast("long") for x, s in zip(axes, step, strict=True)])


def _around(lat: str, lng: str, edge: float) -> Column:
    return F.explode(F.array_distinct(F.array(*[_cube(lat, lng, edge, s) for s in _STEPS])))


def _cube_groups(places: DataFrame, edge: float) -> DataFrame:
    """cube, root: cubes that hold places, those next to each other in one group. Places at most ``edge``
    apart are in one group; no pairs of places are made."""
    cubes = cut(places.select("cube", "lat", "lng").dropDuplicates(["cube"]), "cubes")
    near = cubes.select(F.col("cube").alias("i"), _around("lat", "lng", edge).alias("j")).where("i <> j")
    links = near.join(cubes.select(F.col("cube").alias("j")), "j", "left_semi").select("i", "j")
    return cubes.select("cube").join(groups(links).withColumnRenamed("node", "cube"), "cube", "left").select("cube", F.coalesce("root", "cube").alias("root"))


_CENTRE = "c_lat double, c_lng double, members long, first long"


def _online(radius: float, most: int):
    def run(batches):
        """Rows by group, of each its centres and then its events in order: an event joins the nearest centre in
        reach (of equally near ones that which began first), which then moves. Centres are kept by the cube of the
        sphere they lie in, so an event meets only those near by. Out come the events with their cluster, and
        at a group's end the centres that are new or have moved."""
        from math import atan2, cos, floor, radians, sin, sqrt

        import pyarrow as pa

        kinds = pa.schema([("id", pa.int64()), ("cluster", pa.int64()), ("c_lat", pa.float64()), ("c_lng", pa.float64()), ("members", pa.int64()), ("began", pa.int64())])
        root, held, cubes, changed = None, [], {}, set()  # a centre: lat, lng, events, first event, cube, turn of the first event

        def cube(lat, lng):
            a, b = radians(lat), radians(lng)
            return tuple(floor(v * EARTH_METRES / radius) for v in (cos(a) * cos(b), cos(a) * sin(b), sin(a)))

        def far(lat, lng, c):
            h = sin(radians(c[0] - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(c[0])) * sin(radians(c[1] - lng) / 2) ** 2
            return 2 * EARTH_METRES * atan2(sqrt(h), sqrt(1 - h))

        def add(lat, lng, n, first, began):
            held.append([lat, lng, n, first, cube(lat, lng), began])
            cubes.setdefault(held[-1][4], set()).add(len(held) - 1)

        def moved():
            order = sorted(changed)
            for at in range(0, len(order), most):
                some = [held[i] for i in order[at : at + most]]
                yield pa.record_batch([[None] * len(some), *[[c[k] for c in some] for k in (3, 0, 1, 2, 5)]], schema=kinds)

        for rows in (batch.slice(at, most) for batch in batches for at in range(0, batch.num_rows, most)):
            done, home = [], []
            for group, lat, lng, k, turn, members in zip(*[rows.column(c).to_pylist() for c in ("root", "lat", "lng", "id", "turn", "members")], strict=True):
                if group != root:
                    yield from moved()
                    root, held, cubes, changed = group, [], {}, set()
                if members:  # a centre of the rounds before
                    add(lat, lng, members, k, turn)
                    continue
                done.append(k)
                x, y, z = cube(lat, lng)
                near = [i for p in (x - 1, x, x + 1) for q in (y - 1, y, y + 1) for r in (z - 1, z, z + 1) for i in cubes.get((p, q, r), ())]
                metres_, _, best = min(((far(lat, lng, held[i]), held[i][5], i) for i in near), default=(radius + 1, 0, -1))
                if metres_ > radius:
                    add(lat, lng, 1, k, turn)
                    changed.add(len(held) - 1)
                    home.append(k)
                    continue
                c = held[best]
                c[2] += 1
                c[0] += (lat - c[0]) / c[2]
                c[1] += (lng - c[1]) / c[2]
                changed.add(best)
                now = cube(c[0], c[1])
                if now != c[4]:
                    cubes[c[4]].discard(best)
                    cubes.setdefault(now, set()).add(best)
                    c[4] = now
                home.append(c[3])
            none = [None] * len(done)
            yield pa.record_batch([done, home, none, none, none, none], schema=kinds)
        yield from moved()

    return run


def moving_clusters(events: DataFrame, radius: float = 100, most: int = 50_000, a_round: int = 500_000) -> DataFrame:
    """id, cluster (the id of the cluster's first event): in order of date and id each located event joins
    the nearest centre within ``radius`` metres, which moves to the mean of its events, or begins a cluster.

    What an event does depends on centres within the radius, before and after; so events more than twice the
    radius apart can go in any order, and groups of neighbouring cubes of that edge are independent. A
    group of one place is one cluster. Of any other group a round decides its earliest ``a_round`` events,
    grouped again by themselves (few events link up less far than all do), from the centres of the rounds
    before. A task reads them in order, ``most`` at a time, and keeps only centres: those near the events of its
    round and those that begin in it. Rounds are as many as the events of the largest group have such parts. Only
    counts reach the driver. Coordinates are averaged as numbers: centres don't cross the antimeridian.
    """
    e = events.where(located(F.col("venue_lat"), F.col("venue_lng"))).select("id", "event_date", F.col("venue_lat").alias("lat"), F.col("venue_lng").alias("lng"))
    edge = 2 * radius * (1 + 1e-6)
    e = cut(numbered(e, ("event_date", "id"), "turn").select("id", "turn", "lat", "lng", _cube("lat", "lng", edge).alias("cube")), "turns")
    shape = e.groupBy("cube").agg(F.count("*").alias("n"), F.min("lat").alias("lat"), F.max("lat").alias("lat_to"), F.min("lng").alias("lng"), F.max("lng").alias("lng_to"), F.min(F.struct("turn", "id")).alias("first"))
    shape = cut(shape, "shape")
    roots = cut(shape.join(_cube_groups(shape, edge), "cube"), "roots")
    single = (F.col("lat") == F.col("lat_to")) & (F.col("lng") == F.col("lng_to"))
    sizes = roots.groupBy("root").agg(F.sum("n").alias("n"), F.min("first").alias("first"), (F.count("*") == 1).alias("one_cube"), F.min(single).alias("single"))
    alone = F.col("one_cube") & F.col("single")
    root = cut(roots.select("cube", "root", F.col("n").alias("in_cube")).join(sizes.select("root", "n", alone.alias("alone"), F.col("first.id").alias("first")), "root"), "root")
    placed = join_by_share(e, root, ["cube"], "in_cube")
    done = [placed.where("alone").select("id", F.col("first").alias("cluster"))]
    left = cut(placed.where("not alone").select("id", "turn", "lat", "lng", "cube", "root"), "undecided")
    centres = cut(e.sparkSession.createDataFrame([], f"{_CENTRE}, began long"), "centres")
    last = left.isEmpty()
    while not last:
        batch = _earliest(left, a_round)
        last = batch is left
        if not last:  # by themselves they may fall apart
            batch = cut(batch, "batch")
            counts = cut(batch.groupBy("cube").agg(F.count("*").alias("n")).join(_cube_groups(batch, edge), "cube"), "parts")
            batch = cut(join_by_share(batch.drop("root"), counts, ["cube"], "n"), "batch")
        reach = batch.select("cube", F.col("root").alias("of")).distinct()
        near = centres.select("*", _around("c_lat", "c_lng", edge).alias("cube")).join(reach, "cube").drop("cube").distinct()
        rows = near.select(F.col("of").alias("root"), F.col("c_lat").alias("lat"), F.col("c_lng").alias("lng"), F.col("first").alias("id"), F.col("began").alias("turn"), "members")
        rows = rows.unionByName(batch.select("root", "lat", "lng", "id", "turn", F.lit(0).cast("long").alias("members")))
        step = rows.repartition("root").sortWithinPartitions("root", F.col("members") == 0, "turn").mapInArrow(_online(radius, most), "id long, cluster long, c_lat double, c_lng double, members long, began long")
        step = cut(step, "moved")
        done.append(step.where("id is not null").select("id", "cluster"))
        if not last:
            moved = step.where("id is null").select("c_lat", "c_lng", "members", F.col("cluster").alias("first"), "began")
            centres = cut(centres.join(moved.select("first"), "first", "left_anti").select(moved.columns).unionByName(moved), "centres")
            left = cut(left.join(step.where("id is not null").select("id"), "id", "left_anti"), "undecided")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _earliest(rows: DataFrame, most: int) -> DataFrame:
    """The earliest rows of every group that has more than ``most``, about so many; ``rows`` itself if none has."""
    sizes = rows.groupBy("root").agg(F.count("*").alias("rows"))
    large = sizes.where(F.col("rows") > most)
    if large.isEmpty():
        return rows
    large = cut(large, "large")
    hot = rows.join(F.broadcast(large), "root")  # fewer groups than rows / most
    share = hot.groupBy("root").agg(F.max("rows").alias("rows"), F.percentile_approx("turn", [k / 1024 for k in range(1, 1024)], F.lit(10_000)).alias("marks"))
    at = F.greatest(F.lit(1), F.least(F.lit(1023), F.floor(F.lit(1024 * most) / F.col("rows")))).cast("int")
    to = share.select("root", F.element_at("marks", at).alias("to"))
    return rows.join(F.broadcast(to), "root", "left").where("to is null or turn <= to").drop("to")


def proximity_clusters(events: DataFrame, radius: float = 100, mode: str = "leader") -> DataFrame:
    """id, cluster (the id of the cluster's first event) of located events.

    ``leader``: centres stay at the first event, in order of date and id; a follower goes to its
    nearest leader. Events of one place are grouped first and links are made between places.
    ``online`` moves a centre to the mean of its events after each, see :func:`moving_clusters`.
    """
    if mode == "online":
        return moving_clusters(events, radius)
    e = events.where(located(F.col("venue_lat"), F.col("venue_lng"))).select("id", "event_date", "venue_lat", "venue_lng")
    places = e.groupBy(F.col("venue_lat").alias("lat"), F.col("venue_lng").alias("lng")).agg(F.min(F.struct("event_date", "id")).alias("first"))
    points = places.select(F.col("first.id").alias("id"), "first", "lat", "lng")
    home = e.join(points.select(F.col("lat").alias("venue_lat"), F.col("lng").alias("venue_lng"), F.col("id").alias("place")), ["venue_lat", "venue_lng"])
    if mode != "leader":
        raise ValueError("mode must be 'leader' or 'online'")
    order = points.select("id", "first")
    pairs = cut(within(points, radius), "within")
    near = pairs.join(order.select(F.col("id").alias("i"), F.col("first").alias("fi")), "i").join(order.select(F.col("id").alias("j"), F.col("first").alias("fj")), "j").where("fi < fj")
    later = followers(near)
    leads = pairs.join(later, "j", "left_semi").join(later.withColumnRenamed("j", "i"), "i", "left_anti")
    nearest = leads.groupBy("j").agg(F.min(F.struct("metres", "i")).alias("to")).select(F.col("j").alias("place"), F.col("to.i").alias("cluster"))
    return home.join(nearest, "place", "left").select("id", F.coalesce("cluster", "place").alias("cluster"))


def markers(events: DataFrame, radius: float = 100, mode: str = "leader", members: bool = False) -> DataFrame:
    """cluster, lat, lng (mean of the members), event_count, category of the first event; with ``members``
    also their dates and ids in order, an array that grows with a hot place."""
    e = events.join(proximity_clusters(events, radius, mode), "id")
    first = F.struct("event_date", "id")
    return e.groupBy("cluster").agg(
        F.avg("venue_lat").alias("lat"), F.avg("venue_lng").alias("lng"), F.count("*").alias("event_count"),
        F.coalesce(F.min_by("category", first), F.lit("other")).alias("category"), *([F.array_sort(F.collect_list(first)).alias("members")] if members else []),
    )


def nearest_for_each(points: DataFrame, events: DataFrame, k: int = 20, start: float = 500.0) -> DataFrame:
    """point_id, event_id, place (1 to k), km: the k located events nearest to every point (id, lat, lng), ties
    by event id.

    Equal points search once, and events of one place come as its first k. A point looks into the cubes
    around it, first of ``start`` metres; what lies within that distance is surely among them. Only points
    that have fewer than k events there look further, twice as far each time. Points without coordinates
    have no events; with fewer than k events in all, every point gets all of them.
    """
    e = events.where(located(F.col("venue_lat"), F.col("venue_lng"))).select(F.col("id").alias("event_id"), F.col("venue_lat").alias("e_lat"), F.col("venue_lng").alias("e_lng"))
    best = e.withColumn("turn", F.row_number().over(Window.partitionBy("e_lat", "e_lng").orderBy("event_id"))).where(F.col("turn") <= k)  # cut before the shuffle as well
    best = cut(best.select("event_id", "e_lat", "e_lng"), "best")
    places = cut(best.groupBy("e_lat", "e_lng").agg(F.count("*").alias("n")), "places")
    spots = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("lat", "lng").distinct()
    left = cut(spots.withColumn("spot", F.monotonically_increasing_id()), "spots")
    where = left
    need = min(k, places.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    found, edge = None, start
    while need and not left.isEmpty():
        looks = left.select("spot", "lat", "lng", _around("lat", "lng", edge).alias("cube"))
        far = metres(F.col("lat"), F.col("lng"), F.col("e_lat"), F.col("e_lng"))
        near = looks.join(places.withColumn("cube", _cube("e_lat", "e_lng", edge)), "cube").select("spot", "e_lat", "e_lng", "n", far.alias("metres"))
        if edge < 2 * EARTH_METRES:  # cubes of that size and their neighbours hold all
            near = near.where(F.col("metres") <= edge)
        # places, nearest first, as far as k events take; equally far ones together
        at = Window.partitionBy("spot").orderBy("metres")
        before = F.sum("n").over(at) - F.sum("n").over(Window.partitionBy("spot", "metres"))
        near = cut(near.withColumn("before", before).where(F.col("before") < k).drop("before"), "near")
        enough = near.groupBy("spot").agg(F.sum("n").alias("n")).where(F.col("n") >= need).select("spot")
        done = near.join(enough, "spot", "left_semi").select("spot", "e_lat", "e_lng", "metres")
        found = done if found is None else found.unionByName(done)
        left = cut(left.join(enough, "spot", "left_anti"), "spots")
        edge *= 2
    if found is None:
        return points.select(F.col("id").alias("point_id"), F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("place"), F.lit(0.0).alias("km")).limit(0)
    ranked = found.join(best, ["e_lat", "e_lng"]).withColumn("place", F.row_number().over(Window.partitionBy("spot").orderBy("metres", "event_id"))).where(F.col("place") <= k)
    ranked = ranked.select("spot", "event_id", "place", (F.col("metres") / 1000).alias("km")).join(where, "spot")
    return points.select(F.col("id").alias("point_id"), "lat", "lng").join(ranked, ["lat", "lng"]).select("point_id", "event_id", "place", "km")


def located_count(events: DataFrame) -> DataFrame:
    """total and located: all events, and those with coordinates."""
    return events.agg(F.count("*").alias("total"), F.count_if(F.col("venue_lat").isNotNull() & F.col("venue_lng").isNotNull()).alias("located"))


def unlocated_names(events: DataFrame) -> DataFrame:
    """Distinct venue names of events without coordinates."""
    return events.where(F.col("venue_lat").isNull() & (F.coalesce("venue_name", F.lit("")) != "")).select("venue_name").distinct()


def geocode(names: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """venue_name, lat, lng, address: fixed coordinates first, then the first match inside the box
    of a places table (name, lat, lng, address, ord); a name that neither knows stays null."""
    key = F.lower(F.trim("venue_name"))
    fixed = F.broadcast(manual_geocodes(names.sparkSession))
    out = names.join(fixed, key == fixed["place"], "left").drop("place")
    if places is None:
        return out
    west, south, east, north = BOX
    inside = places.where(F.col("lng").between(west, east) & F.col("lat").between(south, north))
    first = inside.groupBy(F.lower(F.trim("name")).alias("place")).agg(F.min_by(F.struct("lat", "lng", "address"), "ord").alias("found"))
    out = out.join(first, key == F.col("place"), "left")
    return out.select("venue_name", *[F.coalesce(F.col(c), F.col(f"found.{c}")).alias(c) for c in ("lat", "lng", "address")])


def apply_geocodes(events: DataFrame, found: DataFrame) -> DataFrame:
    """All events of a found name take its coordinates and are confirmed; without an address the old one stays."""
    f = found.where(F.col("lat").isNotNull()).select("venue_name", F.col("lat").alias("new_lat"), F.col("lng").alias("new_lng"), F.col("address").alias("new_address"))
    out = events.join(f, "venue_name", "left")
    known = F.col("new_lat").isNotNull()
    changes = {"venue_lat": F.coalesce("new_lat", "venue_lat"), "venue_lng": F.when(known, F.col("new_lng")).otherwise(F.col("venue_lng"))}
    if "location_status" in events.columns:
        changes["location_status"] = F.when(known, F.lit("confirmed")).otherwise(F.col("location_status"))
    if "venue_address" in events.columns:
        changes["venue_address"] = F.coalesce("new_address", "venue_address")
    return out.withColumns(changes).select(events.columns)


def propagate_coordinates(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events without coordinates take those of their venue."""
    v = venues.where(F.col("lat").isNotNull()).select(F.col("id").alias("venue_id"), F.col("lat").alias("of_lat"), F.col("lng").alias("of_lng"))
    out = events.join(v, "venue_id", "left")
    bare = F.col("venue_lat").isNull()
    return out.withColumns({"venue_lng": F.when(bare, F.col("of_lng")).otherwise(F.col("venue_lng")), "venue_lat": F.when(bare, F.col("of_lat")).otherwise(F.col("venue_lat"))}).select(events.columns)


def runs_of_days(events: DataFrame, key: str) -> DataFrame:
    """key, run_start, run_end, n_days: runs of consecutive days with events."""
    days = events.select(key, "event_date").distinct()
    w = Window.partitionBy(key).orderBy("event_date")
    start = F.coalesce(F.datediff("event_date", F.lag("event_date").over(w)) != 1, F.lit(True))
    runs = days.withColumn("run", F.sum(start.cast("int")).over(w))
    return runs.groupBy(key, "run").agg(F.min("event_date").alias("run_start"), F.max("event_date").alias("run_end"), F.count("*").alias("n_days")).drop("run")
