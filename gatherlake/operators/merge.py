"""Merges into snapshot tables: upsert by natural key, partial update, child replace, surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def last_or_best(incoming: DataFrame, keys: tuple[str, ...], policy: str = "last", seq: str = "load_seq", score: str = "completeness_score") -> DataFrame:
    """One row of each key: ``last``: the row loaded last wins; ``best_score``: the best score, then the
    last. Rows without a key are left out. The winner is aggregated before the shuffle, so that a
    key with many rows needn't be sorted in one task."""
    if policy not in ("last", "best_score"):
        raise ValueError("policy must be 'last' or 'best_score'")
    for k in keys:
        incoming = incoming.where(F.col(k).isNotNull())
    order = F.struct(F.col(seq)) if policy == "last" else F.struct(F.coalesce(score, F.lit(0.0)), F.col(seq))
    return incoming.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("merge_row")).select("merge_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...], update: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("id", "created_at"), better: Column | None = None, touched: bool = False) -> DataFrame:
    """A new snapshot: known keys are updated, new ones added.

    ``update`` lists the columns that an update replaces (default: all but ``keep``); new rows bring all.
    ``better`` may say, from columns ``old.x`` and ``new.x``, which updates apply. ``incoming`` must
    hold a key once (see :func:`last_or_best`). One shuffle on the key, none if both sides lie by it.
    With ``touched`` only the rows of ``incoming`` come out.
    """
    columns = existing.columns
    update = update or tuple(c for c in columns if c not in (*keys, *keep))
    old, new = existing.withColumn("here", F.lit(True)).alias("old"), incoming.withColumn("here", F.lit(True)).alias("new")
    both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "right" if touched else "full_outer")
    fresh, given = F.col("old.here").isNull(), F.col("new.here").isNotNull()
    changes = given if better is None else given & better

    def value(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"old.{c}")
        if c in keys:
            return F.coalesce(f"old.{c}", f"new.{c}")
        return F.when(fresh, F.col(f"new.{c}")).when(changes, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in update else F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    return both.select(*[value(c).alias(c) for c in columns])


def numbered(rows: DataFrame, order: tuple[str, ...], number: str, start: int = 1) -> DataFrame:
    """``rows`` with their number in ``order``, from ``start`` on.

    Rows are numbered within ranges of the order; the sizes of the ranges, one number for each,
    give the offsets. No task holds all rows.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    new = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    new = cut(new.withColumn("at", F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)), "new")  # ranges are sampled: once
    sizes = new.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))  # a row for each range
    return new.join(F.broadcast(offsets), "part").withColumn(number, (F.col("before") + F.col("at") + start).cast("long")).drop("part", "at", "before")


def assign_ids(merged: DataFrame, order: tuple[str, ...], id: str = "id", top: int | None = None) -> DataFrame:
    """Ids for rows without one, in ``order``, above ``top`` (default: above all given ones, which takes a
    pass over the table); see :func:`numbered`."""
    if top is None:
        top = merged.agg(F.coalesce(F.max(id), F.lit(0)).alias("top")).first()["top"]
    return merged.where(F.col(id).isNotNull()).unionByName(numbered(merged.where(F.col(id).isNull()), order, id, top + 1).select(merged.columns))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of every parent that ``incoming`` names are replaced; others stay."""
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def remove(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``ids`` (a column id)."""
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def venue_ids(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Venue name to id, whatever the case; of venues with one name the largest id counts, so rows aren't multiplied."""
    one = venues.groupBy(F.lower("name").alias("venue_key")).agg(F.max("id").alias("found_venue_id"))
    return events.withColumn("venue_key", F.lower("venue_name")).join(one, "venue_key", "left").drop("venue_key")


def child_mapping(children: DataFrame, upstream: DataFrame, events: DataFrame) -> DataFrame:
    """Upstream child to catalog event by two hops: upstream id, then natural key; misses are dropped.
    The hops are joined first, so that the children are shuffled once."""
    keys = upstream.select("ig_event_id", "event_hash").where(F.col("event_hash").isNotNull())
    ids = events.select(F.col("id").alias("event_id"), "event_hash")
    return children.join(keys.join(ids, "event_hash").drop("event_hash"), "ig_event_id")
