"""The toxicity tagger: marginals against brute force over all taggings, planted words, spans, edge rows."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatherlake.llm import toxic_spans as T
from gatherlake.llm.common import text_buffer
from gatherlake.llm.queries import table

SF = "/root/testdata/sf0.01"


def brute(push, fresh, moves):
    """Probability of the second tag by adding up all taggings."""
    n = len(push)
    total, hit = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        w = 0.0
        for i, t in enumerate(tags):
            w += push[i] * t
            if fresh[i] or i == 0:
                w += moves[0] * t
            else:
                w += {(0, 0): 0.0, (0, 1): moves[1], (1, 0): moves[2], (1, 1): moves[3]}[tags[i - 1], t]
        total += math.exp(w)
        hit += math.exp(w) * np.array(tags)
    return hit / total


def test_marginals(monkeypatch):
    rng = np.random.default_rng(1)
    for stretch, n in ((64, 9), (3, 11), (2, 1), (4, 8)):
        monkeypatch.setattr(T, "STRETCH", stretch)
        push, fresh, moves = rng.normal(0, 2, n), rng.random(n) < 0.3, rng.normal(0, 1, 4)
        assert np.allclose(T.marginals(push, fresh, moves), brute(push, fresh, moves))
    assert len(T.marginals(np.zeros(0), np.zeros(0, bool), np.zeros(4))) == 0


def test_tokens_and_features():
    given = ["Idiot!! naïve-x", "", None, "A1 ÉTÉ", "...", "idiot"]
    raw, offsets = text_buffer(pa.array(given, pa.string()))
    starts, ends, firsts = T.token_bounds(raw, offsets)
    words = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in given for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
    assert np.diff(firsts).tolist() == [3, 0, 0, 2, 0, 1]
    fresh = np.zeros(len(words), bool)
    fresh[[0, 3, 5]] = True
    f = T.token_features(raw, starts, ends, fresh)
    assert f[0, 0] == f[5, 0] and (f[0, 3:-1] == f[5, 3:-1]).all() and f[0, -1] != f[5, -1]
    assert f[0, 1] == f[3, 1] == f[5, 1] and f[2, 2] == f[5, 2] and f[0, 2] != f[5, 2] and len(set(f[:, 0].tolist())) == 5


def planted(n=400, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeiou", k=1) + rng.choices("bcdfglmnprst", k=rng.randint(2, 6))) for _ in range(500)] + ["the", "of"] * 40
    bad, rows = ["vile", "rotten", "creep", "lout"], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 150))
        toxic = i % 8 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), int(toxic)))
    for i in range(30):  # copies of a wrongly labelled text don't make its words toxic
        rows.append((n + i, "odd words alone here stay " * 3 + "odd end", 1))
    return bad, rows


def test_planted_words(spark):
    bad, rows = planted()
    df = spark.createDataFrame([(d, t, "clash") for d, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, v) for d, _, v in rows] + [(1, 0), (2, 1), (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    field = T.train(df, labels)
    got = {r.doc_id: r for r in T.toxic_spans(df, field).collect()}
    assert len(got) == len(rows)
    for d, t, v in rows[:400]:
        words = [(m.start(), m.end()) for m in re.finditer("|".join(rf"\b{w}\b" for w in bad), t)]
        assert got[d].predicted == v, (d, got[d])
        covered = [any(s.start <= a and b <= s.end for s in got[d].spans) for a, b in words]
        assert all(covered) and all(any(s.start <= a and b <= s.end for a, b in words) or s.end - s.start > 8 for s in got[d].spans)
    assert all(got[400 + i].predicted == 0 for i in range(30))


def test_edges(spark):
    bad, rows = planted(160)
    field = T.fit([t for _, t, _ in rows], np.array([v for _, _, v in rows]))
    long = "the of " * 200_000
    given = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long + "you vile creep, rotten lout"), (None, "🎵 rotten creep"), (5, "x"), (5, "x"), (6, "vile" * 100_000)]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in given], "doc_id long, text string, spans string, held_out int")
    got = T.toxic_spans(df, field)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "spans"] and T.toxic_spans(df.where("false"), field).count() == 0
    rows_ = got.collect()
    by = {(r.doc_id, r.predicted) for r in rows_}
    assert len(rows_) == 9 and {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (5, 1), (None, 1), (6, 0)} == by
    found = next(r for r in rows_ if r.doc_id is None)
    assert found.held_out and found.spans[0].start == 2 and found.spans[-1].end == 14
    none = T.train(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.toxic_spans(df, none).where("predicted = 1").count() == 0


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    done = T.toxic_spans(docs, T.train(docs, labels)).join(labels, "doc_id").where("held_out")
    tp, fp, fn = done.select(*[F.sum(F.expr(x).cast("int")) for x in ("predicted = 1 and toxic = 1", "predicted = 1 and toxic = 0", "predicted = 0 and toxic = 1")]).first()
    assert fp <= 1 and tp >= 3 * fn  # some labels of the table are noise: no word tells
