"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct two-word shingles. One pass hashes every shingle once: the top
bits choose one of 256 registers, and a register keeps the smallest of the rest in compressed
form, a leading-zero count and ten mantissa bits. Documents of equal sets become one class at
once. Classes that agree on any band of six registers (of 42) are candidates; the share of equal
registers, corrected for chance collisions of compressed values, drops candidates far below the
threshold; the others are compared on their full sets of words.

A band shared by many classes is never expanded into all pairs. First every member is compared
with two hubs of its band, and their links are joined into components. Where a band still holds
several components, those of its members outside the largest are searched for among the others:
registers show, inside the task of a block of the band, which components an outsider could belong
to, and only outsider and component come out. Each outsider is then compared on full sets with
the members of such a component, both in blocks, until one links. That finds every link that could
still join two components; no candidate is dropped for being many.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, SLICE_BYTES, WORD, cut, hot_keys, join_by_share, join_salted, mix, row_hash, slices, text_buffer, word_bounds, word_hashes
from .components import components
from .substring_dedup import with_key

REGISTER_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << REGISTER_BITS
ROWS = 6
BANDS = REGISTERS // ROWS
#: Candidates are kept down to so many standard deviations below the threshold.
SIGMAS = 5
_LEFT, _RIGHT, _ALONE = _U(0x8CB92BA72F3D8DD7), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def registers_of(ordered: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of ascending 64-bit hashes; 0 is an empty register."""
    out = np.zeros(REGISTERS, "<u2")
    home = (ordered >> _U(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(home, prepend=-1))  # ascending: the first of a register is its least
    rest = (ordered[first] << _U(REGISTER_BITS)) >> _U(16)  # 48 bits, exact as doubles
    exponent = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bits in use
    zeros = np.minimum(48 - exponent, 38)
    mantissa = (rest << (zeros + 1 + 16).astype(np.uint64)) >> _U(64 - MANTISSA_BITS)
    out[home[first]] = ((zeros + 1) << MANTISSA_BITS) | mantissa.astype(np.int64)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, and how many registers either side uses.

    Two unrelated minima fall into one cell with the probability
    ``2**-MANTISSA_BITS / (2 ln 2) * x y / (x + y)**2`` for x and y elements a register: cells
    are about ``t * 2**-MANTISSA_BITS`` wide at t, and both minima are exponential.
    """
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1) / np.maximum(used, 1)
    chance = 2.0**-MANTISSA_BITS / (2 * np.log(2)) * n_a * n_b / np.maximum((n_a + n_b) ** 2.0, 1)
    return (same - chance) / (1 - chance), used


def _sketch(batches):
    import pyarrow as pa

    for batch in batches:
        raw, offsets = text_buffer(batch.column(batch.num_columns - 1))
        counts, keys, sketches = [], [], []
        for a, b in slices(offsets, SLICE_BYTES):
            base = offsets[a]
            own, own_offsets = raw[base : offsets[b]], offsets[a : b + 1] - base
            own = np.where((own >= 65) & (own <= 90), own + np.uint8(32), own)
            starts, ends, firsts = word_bounds(own, own_offsets)
            words = word_hashes(own, starts, ends)
            pairs = mix(words[:-1] * _LEFT + words[1:] * _RIGHT) if len(words) > 1 else words[:0]
            for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                if j - i == 1:
                    found = mix(words[i:j] * _ALONE)
                else:
                    found = np.unique(pairs[i : j - 1]) if j > i else words[:0]
                counts.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketches.append(registers_of(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=[*batch.schema.names[:-1], "n_shingles", "set_key", "registers"])


def _estimated(threshold: int):
    def run(batches):
        """Keep the pairs whose estimate isn't clearly below the threshold."""
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            found, used = estimate(a, b, n_a, n_b)
            t = threshold / 100
            near = found >= t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))

    return run


def _shingles(text: str) -> set:
    words = text.encode().translate(_LOWER).split()
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)}


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _linked(threshold: int):
    def run(batches):
        """Keep the pairs that link on their full sets."""
        import pyarrow as pa

        for batch in batches:
            keep, last, left = [], None, set()
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if a != last:
                    last, left = a, _shingles(x.as_py())
                right = _shingles(y.as_py())
                both = len(left & right)
                keep.append(100 * both >= threshold * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _like(n, m, threshold: int):
    """Sets of too different sizes can't link."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The links among candidate pairs (a, b) of classes, written as a table."""
    binary = "a binary, b binary"
    side = lambda n: classes.select(F.col("set_key").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("registers").alias(f"r{n}"))
    pairs = cut(pairs, "pairs")
    hot = hot_keys(pairs, "a", "b")  # hubs are in many pairs
    near = join_salted(join_salted(pairs, side("a"), "a", "b", hot), side("b"), "b", "a", hot)
    near = near.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(threshold), binary)
    both = join_salted(near, texts.select(F.col("set_key").alias("b"), F.col("text").alias("tb")), "b", "a", hot)
    both = join_salted(both, texts.select(F.col("set_key").alias("a"), F.col("text").alias("ta")), "a", "b", hot)
    return cut(both.mapInArrow(_linked(threshold), binary), "verified")


def _fixed(column, width: int) -> np.ndarray:
    """A binary column of values of one width as rows of bytes."""
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    return raw[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def _possible(threshold: int):
    """a, b: an outsider and a component, where the estimate lets it link with a member of its block.
    Rows come sorted by block; the last block of a batch waits for the next batch."""
    import pyarrow as pa

    t = threshold / 100

    def blocks(part):
        n = part.num_rows
        keys = np.ascontiguousarray(_fixed(part.column("set_key"), 16)).view("V16").ravel()
        homes = np.ascontiguousarray(np.concatenate([_fixed(part.column("component"), 16), _fixed(part.column("main"), 16)])).view("V16").ravel()
        comps, codes = np.unique(homes, return_inverse=True)
        home, main = codes[:n], codes[n:]
        regs = _fixed(part.column("registers"), 2 * REGISTERS).view("<u2")
        sizes = part.column("n_shingles").to_numpy().astype(float)
        asks, member, native = (part.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "member", "native"))
        bands = part.column("k").to_numpy()
        edges = np.flatnonzero(_changes(part))
        found = []
        for lo, hi in zip(edges, [*edges[1:], n], strict=True):
            asking, theirs = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(member[lo:hi])
            for s in range(0, len(asking), 256):
                own = asking[s : s + 256, None]
                # of two outsiders one asks
                open_ = ((home[theirs] == main[lo]) | (home[theirs] > home[own])) & (home[theirs] != home[own])
                open_ &= 100 * np.minimum(sizes[theirs], sizes[own]) >= threshold * np.maximum(sizes[theirs], sizes[own])
                open_ &= native[theirs] | native[own]
                x, y = np.nonzero(open_)
                x, y = own[x, 0], theirs[y]
                for k in range(0, len(x), 4096):
                    i, j = x[k : k + 4096], y[k : k + 4096]
                    guess, used = estimate(regs[i], regs[j], sizes[i], sizes[j])
                    near = guess >= t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
                    i, j = i[near], j[near]
                    # a pair counts in the first band it shares
                    shared = (regs[i, : BANDS * ROWS] == regs[j, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
                    shared &= (regs[i, : BANDS * ROWS] > 0).reshape(-1, BANDS, ROWS).any(axis=2)
                    first = shared.argmax(axis=1) == bands[lo]
                    found.append(np.stack([i[first], home[j[first]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in keys[pairs[:, 0]]], pa.binary()), pa.array([x.tobytes() for x in comps[pairs[:, 1]]], pa.binary())], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            last = int(np.flatnonzero(_changes(batch))[-1])
            if last:
                yield from blocks(batch.slice(0, last))
            held = batch.slice(last)
        if held is not None and held.num_rows:
            yield from blocks(held)

    return run


def _changes(part) -> np.ndarray:
    """True where a row begins another block."""
    out = np.zeros(part.num_rows, bool)
    for name in ("band", "x", "y"):
        values = part.column(name).to_numpy()
        out[1:] |= values[1:] != values[:-1]
    out[:1] = True
    return out


def _hashed(texts) -> list[np.ndarray]:
    """Ascending hashes of each text's set."""
    import pyarrow as pa

    out = []
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    for a, b in slices(offsets, SLICE_BYTES):
        base = offsets[a]
        own, own_offsets = raw[base : offsets[b]], offsets[a : b + 1] - base
        own = np.where((own >= 65) & (own <= 90), own + np.uint8(32), own)
        starts, ends, firsts = word_bounds(own, own_offsets)
        words = word_hashes(own, starts, ends)
        pairs = mix(words[:-1] * _LEFT + words[1:] * _RIGHT) if len(words) > 1 else words[:0]
        for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            out.append(mix(words[i:j] * _ALONE) if j - i == 1 else np.unique(pairs[i : j - 1]) if j > i else words[:0])
    return out


def _any_link(threshold: int):
    def run(members, asking):
        """a, b: outsiders that link with a member of this block of their component."""
        import pandas as pd

        out = []
        if len(members) and len(asking):
            sets = _hashed(members["text"])
            sizes = np.array([len(x) for x in sets])
            for key, comp, text, ask in zip(asking["asks"], asking["of"], asking["ask_text"], _hashed(asking["ask_text"]), strict=True):
                for i in np.flatnonzero(100 * np.minimum(sizes, len(ask)) >= threshold * np.maximum(sizes, len(ask))):
                    at = np.minimum(np.searchsorted(sets[i], ask), len(sets[i]) - 1)
                    both = int((sets[i][at] == ask).sum())
                    if 100 * both >= threshold * (len(ask) + sizes[i] - both):
                        x, y = _shingles(text), _shingles(members["text"].iloc[i])  # hashes agree; so must the words
                        if 100 * len(x & y) >= threshold * len(x | y):
                            out.append((key, comp))
                            break
        return pd.DataFrame(out, columns=["a", "b"])

    return run


#: Rows of a task that compares outsiders with members of their band, and of a block of a component or of those that ask for it.
BLOCK_ROWS, BLOCK_MEMBERS = 4096, 512


def _left_apart(bands: DataFrame, found: DataFrame, classes: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """a, b: links that join an outsider (a class) with a component the hubs left it out of."""
    placed = bands.where("size > 3").join(found.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band").agg(F.count("*").alias("parts"), F.max_by("component", "n").alias("main"), F.sum("n").alias("rows"))
    mixed = mixed.where("parts > 1")  # of three members the two hubs have met each
    rows = placed.join(mixed.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS)), "band")  # narrow rows: adaptive execution may split a hot band
    # a block of outsiders meets every block of members; in a band of one block each row comes once
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    row = ["set_key", "n_shingles", "component", "main", "band", "k", "native"]
    asks = F.col("component") != F.col("main")
    small = rows.where("blocks = 1").select(*row, asks.alias("asks"), F.lit(True).alias("member"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    large = rows.where("blocks > 1")
    asking = large.where(asks).select(*row, F.lit(True).alias("asks"), F.lit(False).alias("member"), own.alias("x"), other.alias("y"))
    members = large.select(*row, F.lit(False).alias("asks"), F.lit(True).alias("member"), other.alias("x"), own.alias("y"))
    seen = small.unionByName(asking).unionByName(members).join(classes.select("set_key", "registers"), "set_key")
    seen = seen.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    possible = cut(seen.mapInArrow(_possible(threshold), "a binary, b binary").distinct(), "possible")

    home = texts.join(found.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", F.coalesce("component", "set_key").alias("b"), "text")
    # a block of a component's members meets every block of those that ask for it
    shape = home.groupBy("b").agg(F.count("*").alias("members")).join(possible.groupBy("b").agg(F.count("*").alias("askers")), "b")
    shape = cut(shape.withColumns({"blocks": F.ceil(F.col("members") / BLOCK_MEMBERS), "parts": F.ceil(F.col("askers") / BLOCK_MEMBERS)}), "shape")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    home = join_by_share(home, shape, ["b"], "members")
    home = home.select("b", F.pmod(F.xxhash64("set_key"), F.col("blocks")).alias("block"), every("parts").alias("part"), "text")
    asking = join_by_share(possible, shape, ["b"], "askers")
    asking = asking.select("a", "b", every("blocks").alias("of_block"), F.pmod(F.xxhash64("a"), F.col("parts")).alias("of_part"))
    asking = asking.join(texts.withColumnRenamed("set_key", "a"), "a").select(F.col("a").alias("asks"), F.col("b").alias("of"), F.col("text").alias("ask_text"), "of_block", "of_part")
    pairs = home.groupBy("b", "block", "part").cogroup(asking.groupBy("of", "of_block", "of_part"))
    return cut(pairs.applyInPandas(_any_link(threshold), "a binary, b binary").distinct(), "joined")


def near_duplicates(docs: DataFrame, threshold: int = 80, keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the near-duplicate component of every document.

    ``A-Z`` are lower-cased and words are runs of anything but space, \\t, \\n, \\v, \\f, \\r. Two
    documents link if ``100 * intersection >= threshold * union`` of their sets of two-word
    shingles; a text of one word has that word as its set. Null, empty and blank texts have empty
    sets (n_shingles 0) and link with nothing. component_id is the smallest doc_id reachable;
    kept is ``doc_id = component_id``. One row comes out for each that goes in. Rows of one doc_id
    are separate documents that may be in one component, and are then both kept; a null doc_id
    counts as larger than any (component_id is null if no other is there) and is kept only if its
    component has no doc_id. Other columns are not read. An empty table gives an empty result.
    ``keys`` adds k1 and k2 (see ``with_key``) and component, which names the component whatever
    its doc_ids and is null for empty sets.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = cut(
        with_key(docs).select("doc_id", "k1", "k2", "text").mapInArrow(_sketch, f"doc_id {kind}, k1 long, k2 long, n_shingles long, set_key binary, registers binary"), "sketches"
    )
    sets = sketches.where("n_shingles > 0")
    classes = sets.groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("k1", "k2")).alias("key"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"), F.count("*").alias("copies")
    )
    classes = cut(classes.select("set_key", "doc_id", "key.k1", "key.k2", "n_shingles", "registers", "copies"), "classes")

    width = 2 * ROWS
    band = lambda i: F.substring("registers", i * width + 1, width)
    full = [F.when(band(i) != F.lit(bytes(width)), F.struct(F.lit(i).alias("k"), F.xxhash64(F.lit(i), band(i)).alias("band"))) for i in range(BANDS)]
    bands = classes.select("set_key", "n_shingles", F.explode(F.array_compact(F.array(*full))).alias("b")).select("set_key", "n_shingles", "b.k", "b.band")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    # within a band, classes of like sizes: each is in its own cell and visits the next, and a pair
    # that sizes allow meets once where one of the two is native
    cell = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / threshold))
    places = F.array(F.struct(F.lit(True).alias("native"), F.xxhash64("band", cell).alias("band")), F.struct(F.lit(False).alias("native"), F.xxhash64("band", cell + 1).alias("band")))
    cells = bands.join(shared, "band").select("set_key", "n_shingles", "k", F.explode(places).alias("p")).select("set_key", "n_shingles", "k", "p.native", "p.band")
    cells = cut(cells, "cells")
    size = cells.groupBy("band").agg(F.count("*").alias("size"), F.max("native").alias("any")).where("size > 1 and any").select("band", "size")
    bands = cut(cells.join(size, "band"), "bands")

    # only texts of classes that share a band with another move on; one document stands for each
    reps = classes.select("set_key", "k1", "k2").join(bands.select("set_key").distinct(), "set_key", "left_semi")
    texts = cut(with_key(docs).join(reps, ["k1", "k2"]).groupBy("set_key").agg(F.min("text").alias("text")), "texts")
    one = F.struct("set_key", "n_shingles", "native")
    hubs = bands.groupBy("band").agg(F.min(one).alias("lo"), F.max(one).alias("hi"))
    star = bands.join(hubs, "band").where(F.col("set_key") != F.col("lo.set_key"))
    star = star.select("set_key", "n_shingles", "native", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("hub")).where(F.col("set_key") != F.col("hub.set_key"))
    pairs = (
        star.where((F.col("native") | F.col("hub.native")) & _like(F.col("n_shingles"), F.col("hub.n_shingles"), threshold))
        .select(F.least("set_key", "hub.set_key").alias("a"), F.greatest("set_key", "hub.set_key").alias("b"))
        .distinct()
    )
    links = _verified(pairs, classes, texts, threshold)
    found = cut(components(links), "components")
    more = _left_apart(bands, found, classes, texts, threshold)
    if not more.isEmpty():
        found = cut(components(links.union(more)), "components")

    grouped = classes.select("set_key", "doc_id", "copies").join(found.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    grouped = cut(grouped, "grouped")
    least = cut(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes")), "least")
    of_class = cut(join_by_share(grouped, least, ["component"], "classes", grouped.count()).select("set_key", "component", "component_id", "copies"), "of_class")
    columns = ("doc_id", "n_shingles", "component_id", "k1", "k2", "component")
    filled = join_by_share(sketches.where("n_shingles > 0").drop("registers"), of_class, ["set_key"], "copies").select(*columns)
    empty = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "k1", "k2", F.lit(None).cast("binary").alias("component"))
    out = filled.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(("k1", "k2", "component") if keys else ()))


def without_near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate component, and all without words.

    The document with the smallest doc_id stays; among several of that doc_id (or where none has a
    doc_id) the one with the smallest key of doc_id and text, and of rows equal in both the one
    whose columns hash least, so that reruns agree. All columns stay.
    """
    found = cut(near_duplicates(docs, threshold, keys=True).where("kept"), "kept")
    stay = found.where("component is not null").groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("key")).select("key.k1", "key.k2")
    d = docs.select(F.struct("*").alias("row"), "doc_id", "text").withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id").cast("long")})
    one = d.where(_has_words("text")).join(stay, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("row", row_hash(docs.schema)).alias("row"))
    return one.select("row.*").unionByName(d.where(~_has_words("text")).select("row.*"))


def _has_words(text: str):
    return F.coalesce(F.col(text).rlike(WORD), F.lit(False))
