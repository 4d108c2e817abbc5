"""Links of vectors where balls of several shards overlap, against brute force."""

import numpy as np

from gatherlake.llm import embedding_dedup as E


def clouds(seed, n, dims, k, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(k, dims))[rng.integers(0, k, n)] + spread * rng.normal(size=(n, dims))
    return x.astype(np.float32)


def truth(x, least=0.9):
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = y @ y.T >= least
    np.fill_diagonal(hit, False)
    return hit


def test_each_pair_counts_once(spark):
    x = clouds(1, 400, 4, 4, 0.3)
    hit = truth(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    classes = df.selectExpr("vec_id cid", "1L weight", "embedding")
    members, balls = E.shards_of(classes, 0.9, 32)
    held = balls.select("cid", "shard").union(members.select("cid", "shard")).distinct().groupBy("cid").count().where("count > 1")
    assert held.join(balls, "cid", "left_semi").count() > 50  # some vectors lie in a ball and elsewhere
    ready, inside = E._graph(classes, classes.select("cid", "weight"), 0.9, 32, 3, E.LEVELS)
    found = ready.groupBy("shard").applyInPandas(E._search(0.9, None), "cid long, n long, root long").unionByName(inside)
    n = {r.cid: r.n for r in found.groupBy("cid").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert all(n[i] <= hit[i].sum() for i in range(len(x))) and sum(n.values()) >= 0.8 * hit.sum()
    few, near = df.where("vec_id < 150"), hit[:150, :150]
    got = {r.vec_id: r.n_links for r in E.near_vectors(few, shard_size=48, aim=1.01).collect()}  # at last in blocks
    assert got == dict(enumerate(near.sum(axis=1).tolist()))
