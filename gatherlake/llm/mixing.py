"""Mixing sources to target weights by Pareto order sampling, as DataFrame expressions.

Every document of a source is taken as often as the source's target holds its size. The rest of the
target is a sample without replacement: a document of n words has the inclusion probability
``min(1, c n / (n + 200))``, so that short texts are drawn less often, with the c for which the
expected words are the rest; documents with probability 1 are certain. Pareto order sampling ranks
the others by random odds over inclusion odds and takes them in that order.

Only a table without texts is ranked, and of that only one slice a source: slices of a source's
ranking are summed up, those before the slice where the rest is reached are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_share, n_words, row_hash

#: Rows of a slice of a source's ranking, about.
SLICE_ROWS = 4096
#: Words at which a document's weight is half of that of a very long one.
HALF_WORDS = 200
#: A table of sources is broadcast up to so many rows.
MOST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Column | None = None, most: int = 3, share: float = 1.0) -> DataFrame:
    """source, source_size, target and rows of each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating (or ``weights``, an expression of
    the source's place from 0) and share ``share`` of all sizes. No target passes ``most`` times
    its source's size; the excess goes to the others by weight until none is above. In the order
    of size per weight the sources that reach their limit come first, so running sums find the level.
    The table has one row for each source; only that table is ranked in one task.
    """
    one = F.lit(0)
    place = F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    s = s.withColumn("place", place).withColumn("weight", weights if weights is not None else F.col("place") % 3 + 1)
    by_room = Window.partitionBy(one).orderBy((most * F.col("source_size") / F.col("weight")).asc(), F.col("place"))
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy(one)) - F.coalesce(F.sum(most * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("turn", F.row_number().over(by_room))
    # the first source below its limit fixes the level; those before it are full
    open_ = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct("turn", "level"))
    s = s.withColumn("first", F.min(open_).over(Window.partitionBy(one)))
    full = F.col("turn") < F.col("first.turn")
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"), "rows")


def _measure(size: Column) -> Column:
    return size / (size + float(HALF_WORDS))


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with what is planned for their source."""
    by = ["key", "none"]
    return rows.join(F.broadcast(plan.drop("rows")), by) if few else join_by_share(rows, plan, by, "rows")


def _ranked(d: DataFrame) -> DataFrame:
    """Columns inclusion, rank (null: never drawn; 0: certain) and slice, which grows with rank."""
    chance = F.least(F.lit(1.0), F.col("level") * _measure(F.col("size")))
    odds = F.col("inclusion") / (1 - F.col("inclusion"))
    rank = F.when(F.col("inclusion") >= 1, 0.0).when(F.col("inclusion") > 0, F.col("u") / (1 - F.col("u")) / odds)
    p = F.col("more") / F.col("source_size")
    even = F.col("rank") * p / (1 - p)  # about as even as u / (1 - u)
    return d.withColumn("inclusion", F.coalesce(chance, F.lit(0.0))).withColumn("rank", rank).withColumn("slice", F.floor(F.col("slices") * even / (1 + even)))


def _drawn(docs: DataFrame, weights: Column | None, most: int, share: float, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """The table of sizes; the plan of each source: level (the c of the inclusion probabilities), border
    (the slice where its rest is reached), earlier (words before that); and if the plan has few rows."""
    base = cut(docs.select("doc_id", *_sizes(seed)), "sizes")
    targets = source_targets(base, weights, most, share)
    plan = targets.select(
        F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), "source_size", "target", "rows",
        F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long").alias("whole"),
    )
    plan = cut(plan.withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("slices", F.ceil(F.col("rows") / SLICE_ROWS)), "plan")
    few = plan.count() <= MOST_SOURCES
    # one row for each size of a source; from the longest on, sizes are certain while c times their measure is 1 or more
    by = Window.partitionBy("key", "none").orderBy(F.col("size").desc())
    each = base.where("size > 0").groupBy("key", "none", "size").agg(F.count("*").alias("n"))
    each = each.join(plan.select("key", "none", "more"), ["key", "none"])
    longer = F.coalesce(F.sum(F.col("size") * F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(_measure(F.col("size")) * F.col("size") * F.col("n")).over(by.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("level", (F.col("more") - longer) / left).where(F.col("level") * _measure(F.col("size")) < 1)
    levels = each.groupBy("key", "none").agg(F.max_by("level", "size").alias("level"))
    plan = cut(plan.join(levels, ["key", "none"], "left").withColumn("level", F.coalesce("level", F.lit(0.0))), "plan")
    ranked = _ranked(_with_plan(base, plan, few)).where("rank is not null")
    sums = ranked.groupBy("key", "none", "slice").agg(F.sum("size").alias("words"), F.first("more").alias("more"))
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("key", "none").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("earlier", earlier).where(F.col("earlier") + F.col("words") > F.col("more"))
    border = sums.groupBy("key", "none").agg(F.min("slice").alias("border"), F.min_by("earlier", "slice").alias("earlier"))
    return base, cut(plan.join(border, ["key", "none"], "left"), "plan"), few


def _sizes(seed: int) -> list[Column]:
    """source, key and none (a key that is never null), size and u of a document."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return [F.col("source"), F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), n_words(F.col("text")).alias("size"), u.alias("u")]


def _at_border(ranked: DataFrame) -> DataFrame:
    """Rows of the slices where rests are reached, with drawn: taken while that brings the words nearer to the rest."""
    within = Window.partitionBy("key", "none").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return ranked.where("slice = border").withColumn("drawn", before + F.col("size") / 2 <= F.col("more"))


#: Before the border, or in a source that takes all it can; null ranks are never drawn.
_BEFORE = "rank is not null and (border is null or slice < border)"


def mix(docs: DataFrame, weights: Column | None = None, most: int = 3, share: float = 1.0, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, inclusion, copies and taken of every document.

    size is the number of words (null: 0). A source of target t and size s takes every document
    ``floor(t / s)`` times; the rest of its target is drawn without replacement by Pareto order
    sampling. inclusion is a document's probability in that draw; u is uniform from a hash of seed,
    doc_id and text, and documents are taken in the order of ``u / (1 - u)`` over the odds of
    inclusion until the words taken are nearest to the rest. So taken is at most ``most`` times
    size, and a source misses its target by half a document at most. Reruns agree; equal rows are
    drawn one by one. Null texts and doc_ids are documents like others; a source of no words takes
    none, and a document of no words is never drawn. Other columns are not read. An empty table
    gives an empty result.
    """
    base, plan, few = _drawn(docs, weights, most, share, seed)
    ranked = _ranked(_with_plan(base, plan, few))
    inside = _at_border(ranked)
    outside = ranked.where("slice is null or border is null or slice <> border").withColumn("drawn", F.expr(_BEFORE))
    d = inside.unionByName(outside).withColumn("copies", F.col("whole") + F.col("drawn").cast("long"))
    return d.select("doc_id", "source", "size", "source_size", "target", "inclusion", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Column | None = None, most: int = 3, share: float = 1.0, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns.

    A row's copies follow from its text and its source's plan, where it is read; only rows of the
    slices at a border are shuffled. Rows of one doc_id and one text are drawn one by one but stand
    for one document: of those at a border one, by a fixed
    choice, is repeated as often as all were drawn.
    """
    base, plan, few = _drawn(docs, weights, most, share, seed)
    border = _at_border(_ranked(_with_plan(base, plan.where("border is not null"), few)))
    counts = border.groupBy("key", "none", "rank", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "size", "u")
    counts = cut(counts.agg(F.sum(F.col("whole") + F.col("drawn").cast("long")).alias("copies")).where("copies > 0"), "border")

    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source").select("row", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), *_sizes(seed))
    ranked = _ranked(_with_plan(rows, plan, few))
    often = ranked.where("slice is null or border is null or slice <> border").select("row", (F.col("whole") + F.when(F.expr(_BEFORE), 1).otherwise(0)).alias("copies"))
    by = ["key", "none", "rank", "name", "size", "u"]
    one = ranked.where("slice = border").groupBy(*by).agg(F.min_by("row", row_hash(docs.schema)).alias("row")).join(counts, by).select("row", "copies")
    taken = often.where("copies > 0").unionByName(one)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
