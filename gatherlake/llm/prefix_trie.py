"""Prefix trie of conversations, from the longest common prefixes (LCP) of sorted neighbours.

Turns become 128-bit keys and a conversation the concatenation of its keys. Conversations are sorted
by those (range partitions, so that copies of one conversation may lie in several), and every sorted
neighbour pair is an edge of the depth of their LCP. Union-find joins the edges of a block of rows in
descending depth: a component is a stretch of rows that share a prefix, the depths between two merges
of a component are a chain of nodes with the same members, and each merge creates, or widens, a
branching node.

Only nodes on the first or last row's path, as deep as the neighbouring block shares it, can go on
outside the block. A block's forest is contracted to those before it leaves the task: they come out
once for each block with what the block adds to their sums, under a hash of the prefix, and are
added up; every other node is complete. All sums are over rows, so that they add up in any order:

* a row begins the nodes deeper than its LCP with the row before;
* a row ends a leaf if its LCP with the row after is shorter than itself;
* tokens saved below a node are the words that its rows share with the row before, less the words
  above the node, over all its rows but the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_share, n_words

#: Bytes of a turn's key.
KEY = 16
#: Rows of a block; an Arrow batch has no more in any case.
BLOCK_ROWS = 10_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """conv_id, keys (array of binary) and words (array of long): the turns of every conversation, the
    first h of which are those of the first conversation of its family, h = crc32(conv_id) % most."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), key.alias("key"), n_words(text).alias("words")).alias("t"))
    # sorted by turn, nulls first, then by key
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.withColumns({"home": F.col("conv_id") - F.col("conv_id") % family, "h": (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")})
    first = own.where("conv_id = home").select("home", F.slice("t", 1, most - 1).alias("start"))
    both = own.join(first, "home", "left")
    start = F.slice(F.coalesce("start", F.array().cast(both.schema["start"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(start, rest).alias("t")).select("conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


def _lcp(left: bytes, right: bytes) -> int:
    """Keys that two conversations share from the start."""
    a, b = (np.frombuffer(x, "V16") for x in (left, right))
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _lcps(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LCP of each row but the first with the row before; ``flat`` holds two words a key."""
    sizes = np.diff(starts)
    short = np.minimum(sizes[1:], sizes[:-1])
    edges = np.concatenate([[0], np.cumsum(short)])
    at = np.arange(edges[-1]) - np.repeat(edges[:-1], short)
    same = (flat[np.repeat(starts[:-2], short) + at] == flat[np.repeat(starts[1:-1], short) + at]).all(axis=1)
    out = short.copy()
    wrong = np.flatnonzero(~same)
    rows = np.searchsorted(edges, wrong, side="right") - 1
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    out[rows[first]] = at[wrong[first]]
    return out


_BLOCK = "part int, block int, conv_ids array<long>, sizes array<int>, seqs binary, words array<long>, lcps array<int>, after int, first binary, last binary"


def _blocks(block_rows: int):
    def run(batches):
        """Sorted rows as blocks of one row each, with the LCP of every row and the row before (of the
        first: -1 in the first block) and of the last and the row after (null in the last block)."""
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, number, last = None, 0, b""
        for batch in batches:
            for s in range(0, len(batch), block_rows):
                own = batch.slice(s, block_rows)
                seqs = [b"".join(x) for x in own.column("keys").to_pylist()]
                sizes = np.array([len(x) // KEY for x in seqs])
                flat = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2)
                before = _lcp(last, seqs[0]) if number else -1
                if held is not None:
                    held["after"] = before
                    yield pa.RecordBatch.from_pylist([held], schema=schema)
                lcps = _lcps(flat, np.concatenate([[0], np.cumsum(sizes)])) if len(seqs) > 1 else np.zeros(0, np.int64)
                words = own.column("words").flatten().to_pylist()
                last = seqs[-1]
                held = {"part": part, "block": number, "conv_ids": own.column("conv_id").to_pylist(), "sizes": sizes.tolist(), "seqs": b"".join(seqs), "words": words, "lcps": [before, *lcps.tolist()], "after": None, "first": None if number else seqs[0], "last": None}
                number += 1
        if held is not None:
            held["last"] = last
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    import pyarrow as pa

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("conv_ids", longs), ("sizes", ints), ("seqs", pa.binary()), ("words", longs), ("lcps", ints), ("after", pa.int32()), ("first", pa.binary()), ("last", pa.binary())])
    return run


def _forest(sizes: np.ndarray, lcps: list[int], after: int, ids: list[int]):
    """Chains of nodes with the same members, by union-find over LCP edges in descending depth.

    Element 0 stands for the rows before the block, element n + 1 for those after. A chain is
    (first row, last row, top depth, lowest depth, least id, children at the top, side, parent chain):
    side is 0 if all members are in the block, 1 if some are before, 2 if some are only after. Chains
    come after those below them; the parent is -1 for the root.
    """
    n = len(sizes)
    edge = [*lcps, after]
    parent = list(range(n + 2))
    end = list(range(n + 2))
    top = [edge[0], *sizes.tolist(), after]
    least = [None, *ids, None]
    kids = [0] * (n + 2)
    below: list[list[int]] = [[] for _ in range(n + 2)]  # chains whose parent is the next one of this component
    chains: list[list] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def close(c: int, depth: int) -> int:
        """Emit the component's chain down to above ``depth``; 1 if it begins a node there."""
        if top[c] <= depth:
            return 0
        chain = len(chains)
        for k in below[c]:
            chains[k][7] = chain
        side = 1 if c == 0 else 2 if end[c] == n + 1 else 0
        chains.append([max(c, 1), min(end[c], n), top[c], depth + 1, least[c], kids[c], side, -1])
        kids[c], below[c], top[c] = int(c > 0), [chain], depth
        return 1

    depths = np.array(edge)
    for e in np.argsort(-depths, kind="stable").tolist():
        depth = edge[e]
        if depth < 0:
            break
        a, b = find(e), find(e + 1)
        close(a, depth)
        close(b, depth)
        kids[a] += kids[b]
        below[a] += below[b]
        below[b] = []
        parent[b] = a
        end[a] = end[b]
        if least[a] is None or least[b] is not None and least[b] < least[a]:
            least[a] = least[b]
    close(find(1), -1)
    return chains


_NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, above long, ends string, ids string, part int, block int"


def _path_keys(seq: bytes, depth: int) -> list[bytes]:
    """Hashes of the first 0, 1, ... ``depth`` turns."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for d in range(depth):
        h.update(seq[d * KEY : (d + 1) * KEY])
        out.append(h.copy().digest())
    return out


def _nodes(batches):
    """The nodes of each block: complete ones, and with a key the block's part of those that go on outside."""
    import pyarrow as pa

    longs = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "above")
    for batch in batches:
        for r in batch.to_pylist():
            sizes, ids = np.array(r["sizes"]), r["conv_ids"]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            lcps = np.array([*r["lcps"], r["after"]])
            words = np.concatenate([[0], np.cumsum(r["words"], dtype=np.int64)])
            shared = words[starts[:-1] + np.maximum(lcps[:-1], 0)] - words[starts[:-1]]  # with the row before
            sums = np.concatenate([[0], np.cumsum(shared)])
            leaves = np.concatenate([[0], np.cumsum(lcps[1:] < sizes)])
            paths = {1: _path_keys(r["seqs"][: int(sizes[0]) * KEY], int(lcps[0])), 2: _path_keys(r["seqs"][int(starts[-2]) * KEY :], int(lcps[-1]))}
            out: dict[str, list] = {c: [] for c in (*longs, "key", "parent_key", "ends", "ids")}
            chains = _forest(sizes, r["lcps"], r["after"], ids)
            for first, final, top, low, least, kids, side, parent in chains:
                f, depth = first - 1, np.arange(top, low - 1, -1)
                n, size = final - f, len(depth)
                above = words[starts[f] + np.maximum(depth - 1, 0)] - words[starts[f]]
                total = int(sums[final] - sums[f if side == 1 else f + 1])
                saved = np.full(size, total) if side else total - (n - 1) * above
                children = [kids] + [int(side != 1)] * (size - 1)
                if top == sizes[f]:  # the rows that end here come first
                    last = f + 1
                    while last < final and sizes[last] == top:
                        last += 1
                    said = ",".join(map(str, ids[f:last]))
                else:
                    said = None
                out["conv_id"] += [least] * size
                out["depth"] += depth.tolist()
                out["n_convs"] += [n] * size
                out["n_children"] += children
                out["n_leaves"] += [int(leaves[final] - leaves[f])] * size
                out["saved_tokens"] += saved.tolist()
                out["above"] += above.tolist()
                if side:
                    path = paths[side]
                    out["key"] += [path[d] for d in depth.tolist()]
                    out["parent_key"] += [path[d - 1] if d else None for d in depth.tolist()]
                    out["parent_conv_id"] += [None] * size
                    out["ends"] += [None] * size
                    out["ids"] += [said] + [None] * (size - 1)
                else:
                    up = chains[parent] if parent >= 0 else None
                    out["key"] += [None] * size
                    out["parent_key"] += [None] * (size - 1) + [paths[up[6]][low - 1] if up and up[6] else None]
                    out["parent_conv_id"] += [least] * (size - 1) + [up[4] if up and not up[6] else None]
                    out["ends"] += [hashlib.sha256((said or "").encode()).hexdigest()] + [_EMPTY] * (size - 1)
                    out["ids"] += [None] * size
            size = len(out["depth"])
            binary = [pa.array(out[c], pa.binary()) for c in ("key", "parent_key")]
            rest = [pa.array(out[c], pa.int64()) for c in longs] + [pa.array(out[c], pa.string()) for c in ("ends", "ids")] + [pa.array(np.full(size, r[c], np.int32)) for c in ("part", "block")]
            yield pa.RecordBatch.from_arrays([*binary, *rest], names=[c.split()[0] for c in _NODE.split(", ")])


def _joined_hash(batches):
    """key, ends: SHA-256 of each key's ids, whose rows come in order; only its state is held."""
    import pyarrow as pa

    key, state, done = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist([{"key": k, "ends": e} for k, e in done])
            done = []
    if state:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends": state.hexdigest()}])


def _boundary(batches):
    import pyarrow as pa

    for batch in batches:
        lcp = [_lcp(a, b) for a, b in zip(batch.column("last").to_pylist(), batch.column("first").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("next"), pa.array(lcp, pa.int32())], names=["part", "next", "lcp"])


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each distinct sequence of first turns (role, text) of the rebuilt conversations:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Turns come by their number, null first; those of one number by a fixed hash of role and text. Null
    roles and texts are empty. A conversation starts with the first h turns of the first of its
    family (none if that has no rows) and goes on with its own after the first h. Rows without conv_id
    belong to no conversation and are left out; repeated rows are repeated turns. A conversation is
    held in memory as one row of 24 bytes a turn. Other columns are not read. An empty table gives an empty result.
    """
    spark = conversations.sparkSession
    rows = rebuilt(conversations, family, most).repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    blocks = cut(rows.mapInArrow(_blocks(block_rows), _BLOCK), "blocks")
    # neighbours across partitions: one row a partition
    parts = sorted(r["part"] for r in blocks.where("block = 0").select("part").collect())
    after = F.broadcast(spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, next int"))
    ends = blocks.where("last is not null").select("part", "last").join(after, "part").join(blocks.where("block = 0").select(F.col("part").alias("next"), "first"), "next")
    lcp = cut(ends.select("part", "next", "last", "first").mapInArrow(_boundary, "part int, next int, lcp int"), "boundaries")
    down, up = F.broadcast(lcp.select("part", F.col("lcp").alias("down"))), F.broadcast(lcp.select(F.col("next").alias("part"), F.col("lcp").alias("up")))
    blocks = blocks.join(down, "part", "left").join(up, "part", "left")
    first = F.when(F.col("block") == 0, F.coalesce("up", F.lit(-1))).otherwise(F.col("lcps")[0])
    blocks = blocks.select("part", "block", "conv_ids", "sizes", "seqs", "words", F.concat(F.array(first), F.expr("slice(lcps, 2, size(lcps) - 1)")).alias("lcps"), F.coalesce("after", "down", F.lit(-1)).alias("after"))
    nodes = cut(blocks.mapInArrow(_nodes, _NODE), "nodes")

    open_ = nodes.where("key is not null")
    merged = open_.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min("above").alias("above"),
    ).withColumn("saved_tokens", F.col("saved_tokens") - (F.col("n_convs") - 1) * F.col("above"))
    said = open_.where("ids is not null").select("key", "part", "block", "ids").repartition("key").sortWithinPartitions("key", "part", "block")
    merged = cut(merged.join(said.mapInArrow(_joined_hash, "key binary, ends string"), "key", "left").withColumn("ends", F.coalesce("ends", F.lit(_EMPTY))), "merged")

    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    whole = nodes.where("key is null")
    hung = whole.where("parent_key is not null").select("parent_key", *columns).unionByName(merged.where("parent_key is not null").select("parent_key", *columns))
    hung = cut(hung, "hung")
    share = hung.groupBy("parent_key").agg(F.count("*").alias("n"))
    above = cut(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")).join(share, "parent_key"), "above")
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    none = F.lit(None).cast("long").alias("parent_conv_id")
    return (
        whole.where("parent_key is null").select("parent_conv_id", *columns).select(*out)
        .unionByName(join_by_share(hung, above, ["parent_key"], "n").select(*out))
        .unionByName(merged.where("parent_key is null").select(none, *columns).select(*out))
    )
