"""Features of the quality classifier in plain Python, and its scores as sums of lookups."""

import math
import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa

from gatherlake.llm import quality_model as Q
from gatherlake.llm.common import text_buffer

GAP = b" \t\n\x0b\x0c\r"


def plain(text):
    raw = (text or "").encode()
    words = raw.split()
    n, solid = max(1, len(words)), max(1, sum(map(len, words)))
    count = lambda chars: sum(b in chars.encode() for b in raw) / solid
    mean = sum(map(len, words)) / n
    lines = [x for x in raw.split(b"\n") if x]
    punctuation = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    share = lambda x: sum(b in punctuation.encode() for b in x) / len(x)
    out = {
        "log_words": math.log1p(len(words)), "mean_word": mean, "sd_word": math.sqrt(max(0, sum(len(w) ** 2 for w in words) / n - mean**2)), "long_words": sum(len(w) > 14 for w in words) / n,
        "upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": count("0123456789"), "symbol": count("#*$%&<>@^~={}[]\\"), "punctuation": count(punctuation), "bang": count("!"), "bar": count("|"),
        "non_ascii": sum(b >= 128 for b in raw) / solid, "distinct_words": len(set(words)) / n if words else 0.0, "top_word": max(Counter(words).values()) / n if words else 0.0,
        "repeated_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "stop_like": sum(len(w) <= 3 for w in words) / n,
        "mean_line": math.log1p(sum(map(len, lines)) / max(1, len(lines))), "duplicate_lines": 1 - len(set(lines)) / max(1, len(lines)) if words else 0.0,
        "ended_lines": sum(chr(x[-1]) in ".!?\"')" for x in lines) / max(1, len(lines)), "worst_line_punctuation": max((share(x) for x in lines if len(x) >= 20), default=0.0),
    }
    assert tuple(out) == Q.FEATURES
    return list(out.values())


def texts():
    rng = random.Random(3)
    pieces = ["the ", "Market ", "naïve ", "!!", "|", "a\n", "\n", "THE END.\n", "1234 ", "#", " ", "\t", "extraordinarily-long ", "🎵 ", "same same ", "Menu item here, and more\n"]
    return ["".join(rng.choices(pieces, k=rng.randint(1, 80))) for _ in range(80)] + ["", None, " \n ", "x", "a\na\na", "\n\n", "one line without an end"]


def test_features():
    given = texts()
    raw, offsets = text_buffer(pa.array(given, pa.string()))
    got = Q.features(raw, offsets)
    want = np.array([plain(t) for t in given])
    for j, name in enumerate(Q.FEATURES):
        assert np.allclose(got[:, j], want[:, j]), (name, [(t, a, b) for t, a, b in zip(given, got[:, j], want[:, j], strict=True) if not np.isclose(a, b)][:2])
    for i in range(len(given)):  # alone as among others
        one, edges = text_buffer(pa.array(given[i : i + 1], pa.string()))
        assert np.allclose(Q.features(one, edges)[0], got[i])


def test_scores_are_sums_of_lookups():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(Q.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    model = Q.fit(x, y, rounds=30, pair_rounds=20)
    assert model.pairs
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base + sum(values[bisect_right(edge.tolist(), v)] for edge, values, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(values[bisect_right(model.coarse[i].tolist(), row[i]), bisect_right(model.coarse[j].tolist(), row[j])] for i, j, values in model.pairs)
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert (Q.fit(x[:0], y[:0]).score(x[:5]) == Q.fit(x[:0], y[:0]).score(x[:1])[0]).all()
