"""Toxic spans by a linear-chain conditional random field of two tags.

Labels are given for documents; tokens get theirs in the training sample: words that more toxic
documents have, and next to no others, than chance allows are toxic there. Only a word's places (pairs
of neighbouring words) that are new count, so that copies of a text count once. The field is
trained on those tags with features of a token and its neighbours, so that it also tags
words like them and weighs their surroundings. Its marginals, by forward-backward, give the
offending spans; the sum of a document's marginals is turned into a score by a curve fitted on the
document labels.

With two tags the forward message is one ratio, and a step is a Moebius map, a 2 x 2 matrix. All
tokens of a slice of text form one chain with fresh starts at documents; the chain is cut into
stretches whose matrices are multiplied at once in numpy, then chained.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _U, SLICE_BYTES, mix, slices, text_buffer, word_hashes

#: Bytes of the stems that may tag a token, and of the prefixes among a token's features.
STEMS, PREFIXES = (4, 5, 6, 7, 8), (4, 5, 6, 8)
#: Kinds of features of a token: itself, its neighbours, its first and last bytes, its form.
KINDS = ("word", "before", "after", *(f"prefix {n}" for n in PREFIXES), "suffix", "form")
_SALT = [_U(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(len(KINDS))]
#: Tokens of a stretch of the chain.
STRETCH = 64
#: Marginals from which a token is part of a span, and below which it adds nothing to a score.
SPAN, NOISE = 0.5, 0.1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of ASCII letters, digits and other bytes from 128 on, and for each
    row the index of its first token (one more entry than rows)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _LETTER[raw]
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | breaks))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | breaks[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def token_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """A row of hashes, one for each of KINDS, for every token; ``fresh`` marks first tokens of a text."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    word = word_hashes(low, starts, ends)
    out = np.empty((len(starts), len(KINDS)), np.uint64)
    out[:, 0] = word
    out[:, 1], out[1:, 1] = 0, word[:-1]
    out[fresh, 1] = 0
    last = np.append(fresh[1:], True)[: len(word)]
    out[:, 2], out[:-1, 2] = 0, word[1:]
    out[last, 2] = 0
    for k, size in enumerate(PREFIXES):
        out[:, 3 + k] = word_hashes(low, starts, np.minimum(starts + size, ends))
    out[:, -2] = word_hashes(low, np.maximum(ends - 4, starts), ends)
    capital = (raw[starts] >= 65) & (raw[starts] <= 90) if len(starts) else np.zeros(0, bool)
    shout = capital & (ends - starts > 1) & (raw[ends - 1] >= 65) & (raw[ends - 1] <= 90) if len(starts) else capital
    out[:, -1] = np.minimum(ends - starts, 15).astype(np.uint64) * _U(4) + capital.astype(np.uint64) + shout.astype(np.uint64)
    for k, salt in enumerate(_SALT):
        out[:, k] = mix(out[:, k] + salt)
    return out


def marginals(push: np.ndarray, fresh: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the second tag for each token of a chain.

    ``push`` is the token's log weight of the second tag against the first; ``fresh`` marks tokens
    before which the chain starts anew; ``moves`` holds the log weights start -> 2, 1 -> 2, 2 -> 1
    and 2 -> 2, against start -> 1 and 1 -> 1.
    """
    n = len(push)
    if not n:
        return np.zeros(0)
    width = -(-n // STRETCH)
    start, up, down, stay = np.exp(moves)
    pad = width * STRETCH - n
    e = np.exp(np.clip(np.append(push, np.zeros(pad)), -30, 30)).reshape(width, STRETCH)
    new = np.append(fresh, np.ones(pad, bool)).reshape(width, STRETCH)
    new[0, 0] = True

    def sweep(steps, ratio):
        """Ratios after every step of a map r -> (a + b r) / (c + d r), given as arrays by position."""
        a, b, c, d = (np.broadcast_to(x, (width, 1))[:, 0].copy() for x in (0.0, 1.0, 1.0, 0.0))
        for t in range(STRETCH):  # the map of each stretch
            p, q, r, s = steps(t)
            a, b, c, d = p * c + q * a, p * d + q * b, r * c + s * a, r * d + s * b
            top = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / top, b / top, c / top, d / top
        at = np.empty(width)
        for i, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
            at[i] = ratio
            ratio = (p + q * ratio) / (r + s * ratio)
        out = np.empty((width, STRETCH))
        for t in range(STRETCH):
            p, q, r, s = steps(t)
            at = (p + q * at) / (r + s * at)
            out[:, t] = at
        return out

    # forward: r' = e (up + stay r) / (1 + down r); a fresh token has r' = e start whatever r is
    def ahead(t):
        f = new[:, t]
        return np.where(f, e[:, t] * start, e[:, t] * up), np.where(f, 0.0, e[:, t] * stay), np.ones(width), np.where(f, 0.0, down)

    forward = sweep(ahead, 1.0).ravel()
    # backward, from the end: b' = (down + stay e b) / (1 + up e b), where the token after isn't fresh
    after = np.append(new.ravel()[1:], True)
    weight = np.append(e.ravel()[1:], 1.0)
    f_, w_ = after[::-1].reshape(width, STRETCH), weight[::-1].reshape(width, STRETCH)

    def behind(t):
        f = f_[:, t]
        return np.where(f, 1.0, down), np.where(f, 0.0, stay * w_[:, t]), np.ones(width), np.where(f, 0.0, up * w_[:, t])

    backward = sweep(behind, 1.0).ravel()[::-1]
    both = (forward * backward)[:n]
    return both / (1 + both)


@dataclass
class Field:
    """Weights of features by hash (ascending), of the tag, of moves, and the curve of document scores."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    curve: tuple[float, float]

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)  # most tokens are sorted out by their low bits
        self.seen[(self.keys & _U((1 << 20) - 1)).astype(np.int64)] = True

    def push(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.bias)
        if not len(self.keys):
            return out
        for k in range(hashes.shape[1]):
            own = hashes[:, k]
            some = np.flatnonzero(self.seen[(own & _U((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, own[some]), len(self.keys) - 1)
            out[some] += np.where(self.keys[at] == own[some], self.weights[at], 0.0)
        return out

    def tag(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and marginals of the tokens, and for each row the index of its first token."""
        starts, ends, firsts = token_bounds(raw, offsets)
        fresh = np.zeros(len(starts), bool)
        fresh[firsts[:-1][firsts[:-1] < firsts[1:]]] = True
        return starts, ends, marginals(self.push(token_features(raw, starts, ends, fresh)), fresh, self.moves), firsts

    def scores(self, p: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(np.where(p >= NOISE, p, 0.0))])
        return self.curved(total[firsts[1:]] - total[firsts[:-1]])

    def curved(self, mass: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(np.maximum(mass, 0)))))


def _per_text(keys: np.ndarray, places: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how many texts (``home``, ascending) have each in a place that no earlier text has."""
    _, first = np.unique(mix(keys + mix(places)), return_index=True)
    keys, home = keys[first], home[first]
    _, one = np.unique(mix(keys + mix(home.astype(np.uint64))), return_index=True)
    return np.unique(keys[one], return_counts=True)


def _telling(bad: tuple, good: tuple, share: float) -> np.ndarray:
    """Keys that are more often on the toxic side than chance explains, given how many keys there are."""
    keys, n = bad
    at = np.minimum(np.searchsorted(good[0], keys), max(len(good[0]) - 1, 0))
    other = np.where(good[0][at] == keys, good[1][at], 0) if len(good[0]) else np.zeros(len(keys), int)
    chance = math.log(2 * max(1, len(np.union1d(keys, good[0]))))
    q = n / (n + other)
    # a bound of the logarithm of the chance that so large a part falls on toxic texts (Chernoff)
    rest = np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - share)), 0.0)
    surprise = (n + other) * (q * np.log(q / share) + rest)
    return keys[(n >= 3) & (q > share) & (n > 10 * other * share / (1 - share)) & (surprise > chance)]


def toxic_tokens(raw: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of some texts are tagged: those of toxic texts whose word, or whose first bytes, more
    toxic texts have than chance explains.

    A text has a word if the word stands in a place that no earlier text has, so copies count once. In
    a sample too small for any word to be in enough texts, places are counted instead of texts.
    """

    def hashed(size: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens (of their first bytes), and which are longer than that."""
        out, longer = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for a, b in slices(offsets, SLICE_BYTES):
            own = raw[offsets[a] : offsets[b]]
            low = np.where((own >= 65) & (own <= 90), own + np.uint8(32), own)
            starts, ends, _ = token_bounds(low, offsets[a : b + 1] - offsets[a])
            out.append(word_hashes(low, starts, ends) if size is None else mix(word_hashes(low, starts, np.minimum(starts + size, ends)) + _U(size)))
            longer.append(ends - starts > (size or 0))
        return np.concatenate(out), np.concatenate(longer)

    word = hashed(None)[0]
    sizes = [np.diff(token_bounds(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2]) for a, b in slices(offsets, SLICE_BYTES)]
    home = np.repeat(np.arange(len(toxic)), np.concatenate([np.zeros(0, int), *sizes]))
    before, after = np.append(_U(0), word[:-1])[: len(word)], np.append(word[1:], _U(0))[: len(word)]
    edge = np.diff(home, prepend=-1) != 0
    before[edge] = 0
    after[np.append(edge[1:], True)[: len(word)]] = 0
    places = mix(before * _SALT[0] + after)
    bad = toxic.astype(bool)[home]
    out = np.zeros(len(word), bool)
    by_text, by_place = (toxic.sum() + 1) / (len(toxic) + 2), (bad.sum() + 1) / (len(bad) + 2)
    for share, count in ((by_text, lambda k, p, h: _per_text(k, p, h)), (by_place, lambda k, p, h: _per_text(k, p, np.arange(len(k))))):
        for size in (None, *STEMS):
            keys, use = hashed(size)
            sides = [count(keys[side], places[side], home[side]) for side in (use & bad, use & ~bad)]
            out |= bad & use & np.isin(keys, _telling(*sides, share))
        if out.any():
            break
    return out


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 60, rate: float = 0.5, ridge: float = 2e-6, rarest: int = 2) -> Field:
    """Train the field on texts with document labels; without toxic words everything scores low.

    Weights climb the regularised log likelihood of the tags by gradient steps scaled by their past
    squares; features met fewer than ``rarest`` times get none.
    """
    import pyarrow as pa

    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    rows, counts = [np.zeros((0, len(KINDS)), np.uint64)], [np.zeros(0, int)]
    for a, b in slices(offsets, SLICE_BYTES):
        own = raw[offsets[a] : offsets[b]]
        starts, ends, at = token_bounds(own, offsets[a : b + 1] - offsets[a])
        first = np.zeros(len(starts), bool)
        first[at[:-1][at[:-1] < at[1:]]] = True
        rows.append(token_features(own, starts, ends, first))
        counts.append(np.diff(at))
    firsts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    n = int(firsts[-1])
    fresh = np.zeros(n, bool)
    fresh[firsts[:-1][firsts[:-1] < firsts[1:]]] = True
    tags = toxic_tokens(raw, offsets, toxic)
    if not tags.any():
        empty = np.zeros(0)
        return Field(empty.astype(np.uint64), empty, -20.0, np.array([-3.0, -3.0, 0.0, -1.0]), _curve(np.zeros(len(texts)), toxic))
    keys, place, width = [], [], 0  # a feature's number in each column; those left out have the last one
    for k, kind in enumerate(KINDS):
        own, at, often = np.unique(np.concatenate([r[:, k] for r in rows]), return_inverse=True, return_counts=True)
        # rare features of untagged tokens would get no large weight; rare neighbours would explain what the word itself should
        use = (often >= rarest) & ((np.bincount(at, tags, len(own)) > 0) & (kind not in ("before", "after")) | (often >= 20))
        place.append(np.where(use[at], (np.cumsum(use) - 1 + width)[at], -1).astype(np.int32))
        keys.append(own[use])
        width += int(use.sum())
    del rows
    keys = np.concatenate(keys)
    before = np.append(False, tags[:-1]) & ~fresh
    inner = ~fresh
    seen = np.array([(tags & fresh).sum(), (tags & inner & ~before).sum(), (~tags & inner & before).sum(), (tags & inner & before).sum()], float)
    free = np.array([fresh.sum(), (inner & ~before).sum(), (inner & before).sum(), (inner & before).sum()], float)
    # moves by their counts (the share of each way of going on); they stay, weights of features are trained
    p_start, p_up, p_stay = (seen[0] + 0.5) / (free[0] + 1), (seen[1] + 0.5) / (free[1] + 1), (seen[3] + 0.5) / (free[3] + 1)
    moves = np.array([math.log(p_start / (1 - p_start)), math.log(p_up / (1 - p_up)), math.log((1 - p_stay) / (1 - p_up)), math.log(p_stay / (1 - p_up))])
    weights, bias, past, past_bias = np.zeros(width + 1), 0.0, np.full(width + 1, 1e-8), 1e-8

    def chances():
        push = np.full(n, bias)
        for at in place:
            push += weights[at]
        return marginals(push, fresh, moves)

    for _ in range(rounds):
        gap = tags - chances()
        slope = -ridge * n * weights
        for at in place:
            slope += np.bincount(np.where(at < 0, width, at), gap, width + 1)
        slope[width] = 0
        past += slope**2
        past_bias += gap.sum() ** 2
        weights += rate * slope / np.sqrt(past)
        bias += rate * gap.sum() / math.sqrt(past_bias)
    p = chances()
    total = np.concatenate([[0.0], np.cumsum(np.where(p >= NOISE, p, 0.0))])
    keep = np.abs(weights[:-1]) > 1e-3
    order = np.argsort(keys[keep])
    return Field(keys[keep][order], weights[:-1][keep][order], bias, moves, _curve(total[firsts[1:]] - total[firsts[:-1]], toxic))


def _curve(mass: np.ndarray, toxic: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Logistic curve from log(1 + mass) to the label, never falling; Newton steps with a small ridge."""
    x, y = np.log1p(mass), toxic.astype(float)
    a, b = 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p)
        g = np.array([(y - p).sum() - 1e-2 * a, ((y - p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], max(0.0, b + step[1])
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def held_out(doc_id):
    """Rows that no label is learned from: crc32 of doc_id as text, modulo 3, is 1 (a null doc_id: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 3000, most_bytes: int = 4 << 20, **options) -> Field:
    """Fit on labelled rows that aren't held out: at most ``most_rows`` of each label, of together at
    most ``most_bytes`` of text for each, in the order of a hash of doc_id.

    Labels that are null, and labels of doc_ids that disagree or that no document has, aren't used; a
    repeated label counts once. Of several documents of one doc_id the one with the least text counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).where("label = other")
    known = known.select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("turn"))
    some = [known.where(F.col("label") == v).orderBy("turn", "doc_id").limit(most_rows) for v in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * most_rows small rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"))
    # of the bounded sample
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("turn", "doc_id"))
    sample = rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).orderBy("turn", "doc_id").select("text", "label").toPandas()
    return fit(sample["text"].tolist(), sample["label"].to_numpy(), **options)


_SPANS = "array<struct<start: int, end: int, score: double>>"


def _spans(raw: np.ndarray, offsets: np.ndarray, starts, ends, p, firsts) -> list[list[dict]]:
    """Runs of neighbouring tokens of at least SPAN, in code points of their text."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    hit = np.flatnonzero(p >= SPAN)
    if not len(hit):
        return out
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    home = np.searchsorted(firsts, hit, side="right") - 1
    begins = np.flatnonzero((np.diff(hit, prepend=-2) > 1) | (np.diff(home, prepend=-1) != 0))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(hit)], strict=True):
        base = points[offsets[home[a]]]
        out[home[a]].append({"start": int(points[starts[hit[a]]] - base), "end": int(points[ends[hit[b - 1]]] - base), "score": float(p[hit[a:b]].max())})
    return out


def _score_rows(shared):
    def run(batches):
        import pyarrow as pa

        field = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            raw, offsets = text_buffer(batch.column(batch.num_columns - 1))
            scores, spans = [np.zeros(0)], []
            for a, b in slices(offsets, SLICE_BYTES):
                own, own_offsets = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, p, firsts = field.tag(own, own_offsets)
                scores.append(field.scores(p, firsts))
                spans += _spans(own, own_offsets, starts, ends, p, firsts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores)), pa.array(spans, kind)], names=[*batch.schema.names[:-1], "score", "spans"])

    return run


def toxic_spans(docs: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document.

    score is from 0 to 1, higher where label 1 is likelier, from the whole text alone; null and empty
    texts have no tokens and score as texts without any toxic one. predicted is 1 where score >=
    ``threshold``. spans are the offending stretches: start and end in code points (end exclusive) and
    the largest marginal. One row comes out for each that goes in; a null doc_id is held out. Other
    columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the training sample
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score_rows(shared), f"doc_id {kind}, held_out boolean, score double, spans {_SPANS}")
    return d.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
