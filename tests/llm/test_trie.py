"""The prefix trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from gatherlake.llm.prefix_trie import prefix_trie

OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
KIND = "conv_id long, turn long, role string, text string, key string, part int"


def plain(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    total = {}
    for p in sorted(members, key=len, reverse=True):
        below = [total[k] for k in kids[p]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        total[p] = (sum(x[0] for x in below) or (0 if below else 1), sum(x[1] for x in below) + (len(members[p]) - 1) * words)
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(built[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)


def check(spark, rows, **options):
    got = prefix_trie(table(spark, rows), **options)
    assert tuple(got.columns) == OUT
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


def test_against_plain_python(spark):
    rng = random.Random(5)
    for convs, vocabulary, block in ((60, 2, 1), (150, 3, 3), (90, 40, 10_000)):
        rows = []
        for c in range(convs):
            for t in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                rows.append((c, rng.choice([t, t, t, None, t // 2]), rng.choice(["user", "assistant", None, "", "us"]), rng.choice([None, "", "a b", "er a", *(f"word {i} \n more" for i in range(vocabulary))])))
        rows += [(None, 0, "user", "x"), (7, 1, "user", "x"), (7, 1, "user", "x")]
        check(spark, rows, block_rows=block)


def test_copies_and_long_ones(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)]  # copies over all partitions
    rows += [(1000 + c, t, "user", f"turn {t} {'x' if t > 2 + c else ''}") for c in range(30) for t in range(c % 7)]
    rows += [(2000, t, "user", "again and again") for t in range(3000)] + [(2001, t, "user", "again and again") for t in range(2990)]
    check(spark, rows, block_rows=7)
    check(spark, [(40, 0, "user", "only")])
    assert prefix_trie(table(spark, [(1, 1, "a", "b")]).where("false")).count() == 0
    check(spark, [(27, 0, "user", "gone"), (None, 1, "user", "y")])
