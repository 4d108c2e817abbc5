"""Near-duplicate embeddings by a robust-pruned flat graph, built on overlapping cluster shards.

Equal vectors become one class. Vectors are dealt to shards by k-means, those near borders to
two or three; a shard too large is split again. Each shard's task inserts its vectors into a graph
in growing batches: a greedy beam search from the medoid finds candidates, robust pruning keeps a
few diverse neighbours. The adjacency lists of all shards are united by vector. A second task for
each shard searches the united graph from the medoid for every member and then expands through all
neighbours in range; every pair found is verified in double precision. A pair that two shards share
is counted in the first. Links are rows of bits inside a task; only their numbers and spanning
forests leave it, so no pairs are emitted. A group of distinct vectors too large for a shard, all in
half the range of a leader, makes a ball: its pairs all link, and only those near by are compared
with it, in blocks. A ball holds pairs as a shard does, and a pair that two of either hold counts in the
first of them. Recall is audited against brute force for a bounded set of queries, in blocks; below the
aim every shard compares all its vectors instead, then with wider overlaps, and at last blocks of all
vectors are compared with each other.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_share
from .components import components, union_all

SHARD = 4096
SAMPLE = 20_000
LEVELS = 4
DEGREE = 24
BEAM, SEARCH_BEAM = 48, 16
ALPHA = 1.2
AUDIT = 200
#: Vectors searched for at once, and pairs compared at once, in a shard's task.
QUERIES, PAIRS = 256, 1 << 16


# ------------------------------------------------------------------------- graph in numpy


def _pairs_similar(x: np.ndarray, queries: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Similarities of queries[q] and x[v], some pairs at a time."""
    out = np.empty(len(q), x.dtype)
    for s in range(0, len(q), PAIRS):
        out[s : s + PAIRS] = np.einsum("pd,pd->p", queries[q[s : s + PAIRS]], x[v[s : s + PAIRS]])
    return out


def greedy(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, start: int, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once: ids (-1: none) and similarities. Each round expands the
    ``wide`` best of every beam that weren't yet, and no vector is compared with a query twice."""
    n, wide = len(queries), min(wide, beam)
    ids, sims = np.full((n, beam), -1), np.full((n, beam), -np.inf, x.dtype)
    done, seen = np.ones((n, beam), bool), np.zeros((n, len(x)), bool)
    ids[:, 0], sims[:, 0], done[:, 0], seen[:, start] = start, queries @ x[start], False, True
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        at = np.argpartition(-open_, wide - 1, axis=1)[:, :wide]
        row, col = np.nonzero(np.take_along_axis(open_, at, 1) > -np.inf)
        col = at[row, col]
        done[live[row], col] = True
        v = adj[ids[live[row], col]]
        fresh = np.zeros((len(live), len(x)), bool)
        row, v = np.repeat(row, adj.shape[1])[v.ravel() >= 0], v.ravel()[v.ravel() >= 0]
        fresh[row, v] = True
        fresh &= ~seen[live]
        row, v = np.nonzero(fresh)
        seen[live[row], v] = True
        counts = np.bincount(row, minlength=len(live))
        new_ids = np.full((len(live), max(1, counts.max(initial=0))), -1)
        new_sims = np.full(new_ids.shape, -np.inf, x.dtype)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        new_ids[row, place], new_sims[row, place] = v, _pairs_similar(x, queries, live[row], v)
        every = np.concatenate([sims[live], new_sims], axis=1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(every, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new_ids], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], new_ids < 0], axis=1), best, 1)
        live = live[~done[live].all(axis=1)]
    return ids, sims


def prune(x: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: nearest first, dropping candidates much nearer to a kept one than to the owner."""
    own = x[owners]
    gap = (candidates < 0) | (candidates == owners[:, None])
    vectors = x[np.where(gap, 0, candidates)]
    far = np.where(gap, np.inf, 2 - 2 * np.einsum("qcd,qd->qc", vectors, own))
    # a candidate named twice counts once
    order = np.argsort(candidates, axis=1, kind="stable")
    ranked = np.take_along_axis(candidates, order, 1)
    twice = np.zeros(gap.shape, bool)
    twice[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    double = np.zeros_like(twice)
    np.put_along_axis(double, order, twice, 1)
    far[double] = np.inf
    out = np.full((len(owners), degree), -1)
    rows = np.arange(len(owners))
    for k in range(degree):
        pick = far.argmin(axis=1)
        found = np.isfinite(far[rows, pick])
        if not found.any():
            break
        out[found, k] = candidates[found, pick[found]]
        between = 2 - 2 * np.einsum("qcd,qd->qc", vectors, vectors[rows, pick])
        far[found[:, None] & (ALPHA**2 * between <= far)] = np.inf
        far[rows, pick] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """Adjacency (rows of ids, -1: none) of a shard's vectors and the place of their medoid."""
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    adj = np.full((n, degree), -1)
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    at, size = 1, 16
    while at < n:
        batch = order[at : at + size]
        found, _ = greedy(x, adj, x[batch], medoid, beam)
        # those of one batch can't reach each other yet: the nearest of them are candidates too
        mates = x[batch] @ x[batch].T
        np.fill_diagonal(mates, -np.inf)
        most = min(degree, len(batch))
        found = np.concatenate([found, batch[np.argpartition(-mates, most - 1, axis=1)[:, :most]]], axis=1)
        if at < 4 * degree:  # too few for a beam to reach them all
            found = np.concatenate([found, np.broadcast_to(order[: at + len(batch)], (len(batch), at + len(batch)))], axis=1)
        adj[batch] = prune(x, batch, found, degree)
        # links back, pruned where a vector has too many
        a, b = np.repeat(batch, degree), adj[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        heads, first, counts = np.unique(b, return_index=True, return_counts=True)
        for s in range(0, len(heads), 256):
            h, f, c = heads[s : s + 256], first[s : s + 256], counts[s : s + 256]
            most = min(int(c.max()), 4 * degree)
            back = np.full((len(h), most), -1)
            for i, (u, v) in enumerate(zip(f, np.minimum(c, most), strict=True)):
                back[i, :v] = a[u : u + v]
            every = np.concatenate([adj[h], back], axis=1)
            free = (adj[h] >= 0).sum(axis=1) + c <= degree
            if free.any():
                tidy = np.sort(-(every[free] + 1), axis=1)[:, :degree]
                adj[h[free]] = -tidy - 1
            if (~free).any():
                adj[h[~free]] = prune(x, h[~free], every[~free], degree)
        at += len(batch)
        size = min(2 * size, 512)
    return adj, medoid


def in_range(x: np.ndarray, adj: np.ndarray, medoid: int, least: float, beam: int):
    """Blocks of vectors (their first place) and, as rows of bits, the others found with a similarity
    of at least ``least``: greedy search from the medoid, then expansion through every neighbour in
    range, from the vector itself as well."""
    for s in range(0, len(x), QUERIES):
        queries = x[s : s + QUERIES]
        m = len(queries)
        ids, sims = greedy(x, adj, queries, medoid, beam)
        seen, hit = np.zeros((m, len(x)), bool), np.zeros((m, len(x)), bool)
        q, k = np.nonzero(ids >= 0)
        seen[q, ids[q, k]] = True
        q, k = np.nonzero((ids >= 0) & (sims >= least))
        hit[q, ids[q, k]] = True
        seen[np.arange(m), s + np.arange(m)] = hit[np.arange(m), s + np.arange(m)] = True
        q, v = np.nonzero(hit)
        while len(q):
            fresh = np.zeros((m, len(x)), bool)
            for k in range(0, len(q), PAIRS):
                near = adj[v[k : k + PAIRS]]
                rows = np.repeat(q[k : k + PAIRS], adj.shape[1])[near.ravel() >= 0]
                fresh[rows, near.ravel()[near.ravel() >= 0]] = True
            fresh &= ~seen
            seen |= fresh
            q, v = np.nonzero(fresh)
            ok = _pairs_similar(x, queries, q, v) >= least
            q, v = q[ok], v[ok]
            hit[q, v] = True
        hit[np.arange(m), s + np.arange(m)] = False
        yield s, hit


def all_in_range(x: np.ndarray, least: float):
    """As :func:`in_range`, by comparing all vectors of the shard in blocks."""
    for s in range(0, len(x), QUERIES):
        hit = x[s : s + QUERIES] @ x.T >= least
        hit[np.arange(len(hit)), s + np.arange(len(hit))] = False
        yield s, hit


def labels_of(links: np.ndarray) -> np.ndarray:
    """The smallest place of each row's component, of symmetric rows of bits."""
    n = len(links)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i], frontier = i, np.array([i])
            while len(frontier):
                reached = np.zeros(n, bool)
                for s in range(0, len(frontier), QUERIES):
                    reached |= links[frontier[s : s + QUERIES]].any(axis=0)
                frontier = np.flatnonzero(reached & (label < 0))
                label[frontier] = i
    return label


# ------------------------------------------------------------------------------ shards in Spark


def _vectors(column) -> np.ndarray:
    """Unit rows in double precision of a column of float lists (all of one length)."""
    rows = np.array([np.asarray(v, dtype=np.float64) for v in column])
    return rows / np.linalg.norm(rows / np.abs(rows).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(rows).max(axis=1, keepdims=True)


def _half(least: float) -> float:
    """Vectors at least so similar to one leader are at least ``least`` similar to each other: half the angle."""
    return float(np.sqrt((1 + least) / 2)) + 1e-9


def _centres(shard_size: int, least: float):
    def run(key, pdf):
        """Centres of a shard too large, and leaders of its balls: groups too large for a shard, all in
        half the range of a leader."""
        import pandas as pd

        x = _vectors(pdf.sort_values("cid")["embedding"])
        k = int(min(64, len(x), max(2, np.ceil(4 * pdf["n"].iloc[0] / shard_size))))
        rng = np.random.default_rng(0)
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            home = (2 * x @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, home, x)
            counts = np.bincount(home, minlength=k)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        some = centres[np.linalg.norm(centres, axis=1) > 0]
        some = some / np.linalg.norm(some, axis=1, keepdims=True)
        free, leaders = x @ some.T >= _half(least), []
        while free.size and free.sum(axis=0).max() * pdf["n"].iloc[0] / len(x) > shard_size / 2:
            leaders.append(some[free.sum(axis=0).argmax()])
            free = free & ~(x @ leaders[-1] >= _half(least))[:, None]
        return pd.DataFrame({"shard": [key[0]], "centres": [centres.tobytes()], "leaders": [np.array(leaders).tobytes()]})

    return run


def _assign(least: float, wide: int, reach: float):
    def run(batches):
        """Each vector to its nearest centre, and to others of the ``wide`` nearest where a neighbour could
        lie beyond the border. A vector of a ball goes to the ball (role 1) only; each vector that could
        link with a member of a ball goes there as well (role 2)."""
        import pyarrow as pa

        angle = float(np.arccos(least))
        for batch in batches:
            shards, cids, vectors, roles, kept = [], [], [], [], {}
            cid_in, shard_in, centre_in, leader_in = (batch.column(c).to_pylist() for c in ("cid", "shard", "centres", "leaders"))
            for i in range(len(cid_in)):
                kept.setdefault(shard_in[i], (centre_in[i], leader_in[i], []))[2].append(i)
            embeddings = batch.column("embedding")
            for shard, (raw, led, rows) in kept.items():
                x = _vectors(embeddings.take(pa.array(rows)).to_pylist())
                centres, leaders = np.frombuffer(raw).reshape(-1, x.shape[1]), np.frombuffer(led).reshape(-1, x.shape[1])
                near = x @ leaders.T
                ball = np.where((near >= _half(least)).any(axis=1), (near >= _half(least)).argmax(axis=1), len(leaders)) if len(leaders) else np.zeros(len(x), int)
                # of two balls the later one's vectors ask
                asks = (near >= np.cos(min(np.pi, 1.5 * angle)) - 1e-9) & (np.arange(len(leaders)) < ball[:, None])
                far = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
                order = np.argsort(far, axis=1)[:, :wide]
                gap = np.take_along_axis(far, order, 1) - np.take_along_axis(far, order[:, :1], 1)
                border = gap <= reach * np.linalg.norm(centres[order] - centres[order[:, :1]], axis=2)
                for i, row in enumerate(rows):
                    own = [(f"{shard}.{c}", 0) for c in order[i, border[i]]] if ball[i] == len(leaders) else [(f"{shard}/{ball[i]}", 1)]
                    for name, role in own + [(f"{shard}/{j}", 2) for j in np.flatnonzero(asks[i])]:
                        shards.append(name)
                        roles.append(role)
                        cids.append(cid_in[row])
                        vectors.append(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids, pa.int64()), pa.array(shards, pa.string()), pa.array(roles, pa.int32()), embeddings.take(pa.array(vectors, pa.int64()))], names=["cid", "shard", "role", "embedding"]
            )

    return run


def shards_of(classes: DataFrame, least: float, shard_size: int = SHARD, sample: int = SAMPLE, wide: int = 3, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """cid, shard, embedding of the shards that each class belongs to (vectors of one length share
    shards), and cid, shard, role, embedding of balls.

    A class lies in up to ``wide`` shards. Many distinct vectors that all lie close together fit no
    shard, and any cut would part linked pairs: those in half the range of a leader link with each
    other without being compared. They make a ball (role 1), with those that could link with a
    member (role 2). What is too large after ``levels`` cuts is compared in pairs of blocks.
    """
    members = classes.select("cid", F.concat(F.lit("d"), F.size("embedding").cast("string")).alias("shard"), "embedding")
    reach = float(np.sqrt(2 - 2 * least)) * (1 if wide <= 3 else 2)
    done, balls = [], [members.limit(0).select("cid", "shard", F.lit(0).alias("role"), "embedding")]
    for _ in range(levels):
        sizes = cut(members.groupBy("shard").agg(F.count("*").alias("n")), "sizes")
        if not sizes.where(F.col("n") > shard_size).head(1):
            break
        members = members.join(sizes, "shard")
        done.append(members.where(F.col("n") <= shard_size).drop("n"))
        large = members.where(F.col("n") > shard_size)
        # about ``sample`` rows of each shard, by a hash that says nothing of where they lie
        some = large.where(F.pmod(F.xxhash64("cid", "shard"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * sample / F.col("n"))
        centres = cut(some.groupBy("shard").applyInPandas(_centres(shard_size, least), "shard string, centres binary, leaders binary"), "centres")
        dealt = cut(large.drop("n").join(centres, "shard").mapInArrow(_assign(least, wide, reach), "cid long, shard string, role int, embedding array<float>"), "members")
        balls.append(dealt.where("role > 0"))
        members = dealt.where("role = 0").drop("role")
    else:
        sizes = members.groupBy("shard").agg(F.count("*").alias("n"))
        members = members.join(sizes, "shard")
        done.append(members.where(F.col("n") <= shard_size).drop("n"))
        # what stays too large is cut into blocks; each pair of blocks makes a shard
        blocks = F.ceil(2 * F.col("n") / shard_size)
        own = F.pmod(F.xxhash64("cid"), blocks)
        pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.concat_ws("-", F.col("shard"), F.least(own, other).cast("string"), F.greatest(own, other).cast("string")))
        members = members.where(F.col("n") > shard_size).select("cid", F.explode(pair).alias("shard"), "embedding")
    for part in done:
        members = members.unionByName(part)
    return members.select("cid", "shard", "embedding"), union_all(balls)


def _earlier(a, b, name: str) -> np.ndarray:
    """Which pairs of rows a home before ``name`` holds as well. Rows come with their homes, each a role
    and a name: a shard holds all pairs of its members, a ball those of which one is of role 1."""
    names = {h[1:] for rows in (a, b) for row in rows for h in row if h[1:] < name}
    code = {h: i for i, h in enumerate(sorted(names))}

    def marks(rows):
        inside, asking = np.zeros((len(rows), len(code)), np.float32), np.zeros((len(rows), len(code)), np.float32)
        for i, row in enumerate(rows):
            for h in row:
                if h[1:] in code:
                    inside[i, code[h[1:]]] = 1
                    asking[i, code[h[1:]]] = h[0] == "2"
        return inside, asking

    (x, x2), (y, y2) = marks(a), marks(b)
    return x @ y.T - x2 @ y2.T > 0.5


def _asked(least: float):
    def run(key, pdf):
        """Links between a block of a ball and a block of those that ask."""
        import pandas as pd

        pdf = pdf.sort_values("cid")
        inside, outside = pdf[pdf["role"] == 1], pdf[pdf["role"] == 2]
        if inside.empty or outside.empty:
            return pd.DataFrame({"cid": [], "n": [], "root": []}).astype("int64")
        x, y = _vectors(inside["embedding"]), _vectors(outside["embedding"])
        homes_x, homes_y = inside["homes"].tolist(), outside["homes"].tolist()
        of_x, of_y, linked = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), np.zeros(len(y), bool)
        for s in range(0, len(y), QUERIES):
            hit = y[s : s + QUERIES] @ x.T >= least
            linked[s : s + QUERIES] = hit.any(axis=1)
            hit &= ~_earlier(homes_y[s : s + QUERIES], homes_x, key[0])
            of_x += outside["weight"].to_numpy()[s : s + QUERIES] @ hit
            of_y[s : s + QUERIES] = hit @ inside["weight"].to_numpy()
        out = [inside.assign(n=of_x), outside.assign(n=of_y, root=np.where(linked, outside["root"], outside["cid"]))]
        return pd.concat(out)[["cid", "n", "root"]]

    return run


def _twice(key, pdf):
    """Of two blocks of a ball's members: how many of its pairs an earlier home counts, as negative numbers.
    The first block asks."""
    import pandas as pd

    asks, others = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    held = _earlier(asks["homes"].tolist(), others["homes"].tolist(), key[0]) & (asks["cid"].to_numpy()[:, None] != others["cid"].to_numpy())
    return pd.DataFrame({"cid": asks["cid"], "n": -(held @ others["weight"].to_numpy()), "root": asks["cid"]})


def ball_links(balls: DataFrame, weights: DataFrame, homes: DataFrame, least: float, block: int = SHARD // 2) -> DataFrame:
    """cid, n, root of the links that balls hold: all pairs inside one, found by its size, and those
    with vectors near by, compared in blocks. Pairs that an earlier home holds don't count: only members with
    such a home are looked at, in blocks. ``weights`` has cid and weight, ``homes`` cid and homes."""
    named = balls.join(weights, "cid").join(homes, "cid").withColumn("mixed", F.exists("homes", lambda h: F.substring(h, 2, 1 << 20) < F.col("shard")) & (F.col("role") == 1))
    sizes = named.groupBy("shard").agg(
        F.sum(F.when(F.col("role") == 1, F.col("weight"))).alias("all"), F.min(F.when(F.col("role") == 1, F.col("cid"))).alias("root"),
        F.ceil(F.count_if(F.col("role") == 1) / block).alias("inside"), F.ceil(F.count_if(F.col("role") == 2) / block).alias("outside"), F.count("*").alias("rows"),
        F.ceil(F.count_if("mixed") / block).alias("parts"),
    )
    rows = cut(join_by_share(named, cut(sizes, "sizes"), ["shard"], "rows").where("all is not null"), "balls")
    own = rows.where("role = 1").select("cid", (F.col("all") - F.col("weight")).alias("n"), "root")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("long")
    columns = ("cid", "shard", "role", "weight", "root", "embedding", "homes")
    met = rows.where("role = 1 and outside > 0").select(*columns, part("inside").alias("x"), every("outside").alias("y"))
    met = met.unionByName(rows.where("role = 2").select(*columns, every("inside").alias("x"), part("outside").alias("y")))
    out = own.unionByName(met.groupBy("shard", "x", "y").applyInPandas(_asked(least), "cid long, n long, root long"))
    few = ("cid", "shard", "weight", "homes")
    mixed = rows.where("mixed")
    pairs = mixed.select(*few, F.lit(True).alias("asks"), part("parts").alias("x"), every("parts").alias("y"))
    pairs = pairs.unionByName(mixed.select(*few, F.lit(False).alias("asks"), every("parts").alias("x"), part("parts").alias("y")))
    return out.unionByName(pairs.groupBy("shard", "x", "y").applyInPandas(_twice, "cid long, n long, root long"))


def _build(key, pdf):
    import pandas as pd

    pdf = pdf.sort_values("cid")
    cids = pdf["cid"].to_numpy()
    adj, _ = build(_vectors(pdf["embedding"]).astype(np.float32))
    return pd.DataFrame({"cid": cids, "near": [cids[a[a >= 0]].tolist() for a in adj]})


def _search(least: float, beam: int | None):
    def run(key, pdf):
        """cid, n (weight of the links this shard counts), root (of its tree in the shard)."""
        import pandas as pd

        pdf = pdf.sort_values("cid")
        cids, weights = pdf["cid"].to_numpy(), pdf["weight"].to_numpy()
        exact = _vectors(pdf["embedding"])
        x = exact.astype(np.float32)
        medoid = int((x @ x.mean(axis=0)).argmax())
        links = np.zeros((len(x), len(x)), bool)
        for s, hit in in_range(x, _adjacency(cids, pdf["near"]), medoid, least - 1e-4, beam) if beam else all_in_range(x, least - 1e-4):
            q, v = np.nonzero(hit)
            if len(q) > 0.05 * hit.size:
                hit &= exact[s : s + len(hit)] @ exact.T >= least
                q, v = np.nonzero(hit)
            else:
                ok = _pairs_similar(exact, exact[s : s + len(hit)], q, v) >= least
                q, v = q[ok], v[ok]
            links[s + q, v] = True
            links[v, s + q] = True  # found from either side
        # a pair that an earlier shard or ball holds as well is counted there
        homes = pdf["homes"].tolist()
        n = np.zeros(len(x), np.int64)
        for s in range(0, len(x), QUERIES):
            n[s : s + QUERIES] = (links[s : s + QUERIES] & ~_earlier(homes[s : s + QUERIES], homes, key[0])) @ weights
        return pd.DataFrame({"cid": cids, "n": n, "root": cids[labels_of(links)]})

    return run


def _adjacency(cids: np.ndarray, near) -> np.ndarray:
    """Rows of places (-1: none) of united lists; members of other shards are left out. ``cids`` ascend."""
    sizes = near.str.len().to_numpy()
    flat = np.concatenate([np.asarray(row, np.int64) for row in near]) if sizes.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(cids)), sizes)
    at = np.minimum(np.searchsorted(cids, flat), len(cids) - 1)
    here = cids[at] == flat
    at, owner = at[here], owner[here]
    counts = np.bincount(owner, minlength=len(cids))
    adj = np.full((len(cids), max(1, counts.max())), -1)
    adj[owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)] = at
    return adj


def _truth(queries: dict[int, tuple[np.ndarray, np.ndarray]], least: float):
    def run(batches):
        """q, n: the weight of true links of each query among the rows of a batch; queries come by length."""
        import pyarrow as pa

        for batch in batches:
            vectors, weight = batch.column("embedding").to_pylist(), batch.column("weight").to_numpy(zero_copy_only=False)
            for width, (names, x) in queries.items():
                rows = [i for i, v in enumerate(vectors) if len(v) == width]
                if rows:
                    hit = _vectors([vectors[i] for i in rows]) @ x.T >= least
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array((hit * weight[rows][:, None]).sum(axis=0))], names=["q", "n"])

    return run


def audit(classes: DataFrame, counted: DataFrame, least: float, most: int = AUDIT) -> float:
    """Share of true links that were found, for at most ``most`` classes compared with all others."""
    some = classes.orderBy(F.xxhash64("cid"), "cid").limit(most).select("cid", "weight", "embedding").toPandas()
    if some.empty:
        return 1.0
    queries = {int(width): (part["cid"].to_numpy(), _vectors(part["embedding"])) for width, part in some.groupby(some["embedding"].str.len())}
    true = classes.select("weight", "embedding").mapInArrow(_truth(queries, least), "q long, n long")
    true = true.groupBy("q").agg(F.sum("n").alias("n")).toPandas().set_index("q")["n"] - some.set_index("cid")["weight"]
    mine = counted.join(F.broadcast(classes.sparkSession.createDataFrame(some[["cid"]])), "cid").groupBy("cid").agg(F.sum("n").alias("n")).toPandas().set_index("cid")["n"]
    mine = mine.reindex(true.index, fill_value=0)
    if (mine > true).any():
        raise RuntimeError("links were counted twice")  # all are verified and counted in one home
    return float(mine.sum() / true.sum()) if true.sum() else 1.0


def near_vectors(vectors: DataFrame, least: float = 0.9, shard_size: int = SHARD, beam: int = SEARCH_BEAM, aim: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors link if their cosine in double precision is at least ``least``. n_links counts the
    other rows linked directly, copies included; component_id is the smallest vec_id reachable;
    kept is ``vec_id = component_id``. A vector that is null, empty, all zeros or holds a null, NaN
    or infinite component links with nothing, and vectors of different lengths don't link. One row
    comes out for each that goes in; rows of one vec_id are separate vectors, and a null vec_id
    counts as larger than any. Other columns are not read. An empty table gives an empty result.
    If the audited recall is below ``aim`` every shard is searched again by comparing all its
    vectors, then once more with wider overlaps, and at last blocks of all vectors are compared with each
    other: exact, but in time that grows with the square of the table. That brings a warning.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    fit = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = v.where(fit)
    classes = good.groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    weights = classes.select("cid", "weight")
    ready = plan = None
    for width, overlap, levels in ((beam, 3, LEVELS), (None, 3, LEVELS), (None, 8, LEVELS), (None, 8, 0)):
        if not levels:
            warnings.warn(f"audited recall {recall:.3f} is below {aim}: all vectors are compared", stacklevel=2)
        if plan != (overlap, levels):
            ready, inside, plan = *_graph(classes, weights, least, shard_size, overlap, levels, width is not None), (overlap, levels)
        found = ready.groupBy("shard").applyInPandas(_search(least, width), "cid long, n long, root long")
        counted = cut(found.unionByName(inside), "counted")
        recall = audit(classes, counted, least)
        if recall >= aim:
            break
    roots = components(counted.where("cid <> root"), "cid", "root")
    n = counted.groupBy("cid").agg(F.sum("n").alias("n"))
    placed = cut(classes.join(n, "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "placed")
    smallest = cut(placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("classes")), "smallest")
    of_class = cut(join_by_share(placed, smallest, ["component"], "classes"), "of_class")
    of_class = of_class.select("embedding", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id", "weight")
    linked = join_by_share(good, of_class, ["embedding"], "weight").select("vec_id", "n_links", "component_id")
    out = linked.unionByName(v.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _graph(classes: DataFrame, weights: DataFrame, least: float, shard_size: int, wide: int, levels: int, searched: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members of shards with the united graph's lists (empty if it won't be searched), and the links of balls."""
    members, balls = shards_of(classes, least, shard_size, wide=wide, levels=levels)
    members, balls = cut(members, "members"), cut(balls, "balls")
    united = members.select("cid").distinct().withColumn("near", F.array().cast("array<long>"))
    if searched:
        united = members.groupBy("shard").applyInPandas(_build, "cid long, near array<long>").groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    named = members.select("cid", F.concat(F.lit("0"), "shard").alias("home")).unionByName(balls.select("cid", F.concat(F.col("role").cast("string"), "shard").alias("home")))
    homes = cut(named.groupBy("cid").agg(F.collect_set("home").alias("homes")), "homes")
    ready = cut(members.join(united, "cid").join(homes, "cid").join(weights, "cid"), "graph")
    return ready, cut(ball_links(balls, weights, homes, least, max(1, shard_size // 2)), "inside")
