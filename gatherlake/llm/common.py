"""Helpers shared by the training-data operators: lineage cuts, text words, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of our own
    only where the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The table survives the loss of executors, its plan is one scan, and what is
    computed once is not computed again by each reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if more than one row in so many has it; there are fewer hot keys than this.
HOT_SHARE = 1000


def join_by_share(rows: DataFrame, classes: DataFrame, by: list[str], weight: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with a table of their classes, ``weight`` of which tells how many rows each
    has (``total`` together).

    Hot classes are broadcast, so that no task gets all their rows; the others are joined by a
    shuffle. Null keys join nothing. Both tables are read twice: cut them before.
    """
    total = total if total is not None else classes.agg(F.sum(weight).alias("n")).first()["n"] or 0
    often = F.col(weight) * HOT_SHARE > total
    hot = F.broadcast(classes.where(often).drop(weight))
    rest = rows.join(F.broadcast(classes.where(often).select(*by)), by, "left_anti").join(classes.where(~often).drop(weight), by)
    return rows.join(hot, by).unionByName(rest)


def hot_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """key and deals: the keys that more than one row in HOT_SHARE has in any of ``columns``, and over
    how many deals their rows should go. A small table, to be broadcast."""
    total = rows.count() or 1
    counts = rows.select(F.explode(F.array(*columns)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > total)
    return cut(counts.select("key", F.ceil(F.col("n") * HOT_SHARE / total).alias("deals")).coalesce(1), "hot")


def join_salted(rows: DataFrame, wide: DataFrame, key: str, other: str, hot: DataFrame) -> DataFrame:
    """Inner join of rows with one wide row (texts, say) for each key.

    Rows of a hot key (see :func:`hot_keys`) are dealt out by ``other`` and its wide row is repeated
    for each deal, a few times HOT_SHARE repetitions for all hot keys, so nothing wide is broadcast.
    """
    hot = F.broadcast(hot.withColumnRenamed("key", key))
    dealt = rows.join(hot, key, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64(other), F.col("deals")), F.lit(0))).drop("deals")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)) - 1))
    return dealt.join(wide.join(hot, key, "left").withColumn("deal", every).drop("deals"), [key, "deal"]).drop("deal")


def row_hash(schema, row: str = "row"):
    """A hash of the fields of a struct column of this schema, for a choice among rows on which reruns
    agree. Fields that can't be hashed (maps, variants) are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    return F.xxhash64(F.lit(0), *[F.col(f"{row}.`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind])


def words_array(text):
    """The words of a text column as an array; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text):
    """Number of words of a text column; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# ---------------------------------------------------------------- numpy on Arrow text

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


#: Bytes of text that numpy works on at a time; its arrays hold some 100 bytes for each.
SLICE_BYTES = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables are kept and grow by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    last = offsets[-1] if len(offsets) else 0
    return raw[first:last], offsets - first


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word
    (one more entry than rows)."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | breaks[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | breaks[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BYTE_BASE = 0x9E3779B97F4A7C15
_BYTE_INVERSE = pow(_BYTE_BASE, -1, 1 << 64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums of a polynomial in the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * powers(_BYTE_BASE, len(raw)), out=total[1:])
    own = (total[ends] - total[starts]) * powers(_BYTE_INVERSE, len(raw))[starts]
    return mix(own + (ends - starts).astype(np.uint64) * _MIX2)


def slices(offsets: np.ndarray, most: int):
    """Row ranges whose texts hold about ``most`` bytes each (a longer text stands alone)."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(offsets) - 1)
        yield at, to
        at = to
