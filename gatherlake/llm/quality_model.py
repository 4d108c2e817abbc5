"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature in cycles, then for the strongest pairs of features.
All trees of a feature add up to one lookup table over its bins, so that a score is a sum of
lookups and the model can be read. Texts become features in numpy inside tasks; the fit takes
a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, text_buffer, word_bounds, word_hashes

FEATURES = (
    "log_words", "mean_word", "sd_word", "long_words", "upper", "digit", "symbol", "punctuation", "bang", "bar", "non_ascii",
    "distinct_words", "top_word", "repeated_next", "stop_like", "mean_line", "duplicate_lines", "ended_lines", "worst_line_punctuation",
)
MOST_BINS = 64


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.float64)
    table[[ord(c) for c in chars]] = 1
    return table


_TABLES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _class("0123456789"),
    "symbol": _class("#*$%&<>@^~={}[]\\"),
    "punctuation": _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"),
    "bang": _class("!"),
    "bar": _class("|"),
}
_END = _class(".!?\"')")


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text (empty texts: zeros)."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    starts, ends, firsts = word_bounds(raw, offsets)
    counts = np.diff(firsts)
    some = np.maximum(counts, 1)

    def total(values, edges):
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[edges[1:]] - sums[edges[:-1]]

    lengths = (ends - starts).astype(np.float64)
    solid = np.maximum(total(lengths, firsts), 1)
    put = {"log_words": np.log1p(counts), "mean_word": total(lengths, firsts) / some}
    put["sd_word"] = np.sqrt(np.maximum(total(lengths**2, firsts) / some - put["mean_word"] ** 2, 0))
    put["long_words"] = total(lengths > 14, firsts) / some
    for name, table in _TABLES.items():
        put[name] = total(table[raw], offsets) / solid
    put["non_ascii"] = total(raw >= 128, offsets) / solid
    words = word_hashes(raw, starts, ends)
    same = np.zeros(len(words))
    same[1:] = words[1:] == words[:-1]
    same[firsts[:-1][counts > 0]] = 0  # the word before is another text's
    put["repeated_next"] = total(same, firsts) / some
    put["stop_like"] = total(lengths <= 3, firsts) / some
    # lines: breaks inside a text, and the end of each text
    breaks = np.flatnonzero(raw == 10)
    line_ends = np.unique(np.concatenate([breaks, offsets[1:][offsets[1:] > offsets[:-1]]]))
    line_starts = np.concatenate([[0], np.where(raw[np.minimum(line_ends[:-1], len(raw) - 1)] == 10, line_ends[:-1] + 1, line_ends[:-1])]) if len(line_ends) else line_ends
    home = np.searchsorted(offsets, line_starts, side="right") - 1
    mark = np.concatenate([[0.0], np.cumsum(_TABLES["punctuation"][raw])])
    size = np.maximum(line_ends - line_starts, 0)
    full = size > 0
    home, line_starts, line_ends, size = home[full], line_starts[full], line_ends[full], size[full]
    n_lines = np.bincount(home, minlength=n)[:n].astype(float)
    lines = np.maximum(n_lines, 1)
    put["mean_line"] = np.log1p(np.bincount(home, size, minlength=n)[:n] / lines)
    put["ended_lines"] = np.bincount(home, _END[raw[line_ends - 1]], minlength=n)[:n] / lines
    share = (mark[line_ends] - mark[line_starts]) / size
    worst = np.zeros(n)
    np.maximum.at(worst, home, np.where(size >= 20, share, 0))
    put["worst_line_punctuation"] = worst
    keys = word_hashes(raw, line_starts, line_ends)
    top, distinct, repeats = np.zeros(n), np.zeros(n), np.zeros(n)
    edges = np.searchsorted(home, np.arange(n + 1))
    for i in np.flatnonzero(counts):
        own = np.sort(words[firsts[i] : firsts[i + 1]])
        change = np.flatnonzero(own[1:] != own[:-1]) + 1
        runs = np.diff(np.concatenate([[0], change, [len(own)]]))
        distinct[i], top[i] = len(runs) / len(own), runs.max() / len(own)
        repeats[i] = 1 - len(np.unique(keys[edges[i] : edges[i + 1]])) / max(1, edges[i + 1] - edges[i])
    put["distinct_words"], put["top_word"], put["duplicate_lines"] = distinct, top, repeats
    for j, name in enumerate(FEATURES):
        out[:, j] = put[name]
    return out


@dataclass
class Model:
    """Bin edges and a table of additions for each feature and for each chosen pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edge, x[:, j], side="right")]
        for i, j, values in self.pairs:
            total += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """Values by bin of a tree on one binned feature, grown by its best splits."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            gl, hl = g[a + 1 : b] - g[a], h[a + 1 : b] - h[a]
            gr, hr = g[b] - g[a + 1 : b], h[b] - h[a + 1 : b]
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + 1 + k)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, least: float, ridge: float) -> tuple[np.ndarray, float]:
    """Values of the best tree that cuts one feature and then the other on each side, and its gain."""
    best, out = 0.0, np.zeros(grad.shape)
    for turn in (False, True):
        g, h = (grad.T, hess.T) if turn else (grad, hess)
        down_g, down_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
        for cut in range(1, len(g)):
            gain, values = 0.0, np.zeros(g.shape)
            for rows, sg, sh in ((slice(0, cut), down_g[cut - 1], down_h[cut - 1]), (slice(cut, None), down_g[-1] - down_g[cut - 1], down_h[-1] - down_h[cut - 1])):
                cg, ch = np.cumsum(sg), np.cumsum(sh)
                lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
                each = np.where((lh >= least) & (rh >= least), lg**2 / (lh + ridge) + rg**2 / (rh + ridge), cg[-1] ** 2 / (ch[-1] + ridge))
                k = int(each.argmax()) + 1
                gain += each[k - 1]
                if lh[k - 1] >= least and rh[k - 1] >= least:
                    values[rows, :k], values[rows, k:] = -lg[k - 1] / (lh[k - 1] + ridge), -rg[k - 1] / (rh[k - 1] + ridge)
                else:
                    values[rows] = -cg[-1] / (ch[-1] + ridge)
            if gain > best:
                best, out = gain, values.T if turn else values
    return out, best - grad.sum() ** 2 / (hess.sum() + ridge)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 40, most_pairs: int = 6, rate: float = 0.1, leaves: int = 3, least: float = 3.0, ridge: float = 1.0) -> Model:
    """Boost shallow trees feature by feature in cycles; then the strongest pairs the same way.

    With no rows the score is 0.5 everywhere; with one class only it is near that class.
    """
    n, width = x.shape
    edges = [_edges(x[:, j], MOST_BINS) for j in range(width)]
    coarse = [_edges(x[:, j], 8) for j in range(width)]
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, tables, [], coarse)
    if not n:
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(n, base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[j], g, len(tables[j])), np.bincount(bins[j], h, len(tables[j])), leaves, least, ridge)
            tables[j] += step
            total += step[bins[j]]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    g, h = slopes()
    gains = []
    for i in range(width):
        for j in range(i):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            if min(shape) < 2:
                continue
            both = rough[i] * shape[1] + rough[j]
            gains.append((_pair_tree(np.bincount(both, g, shape[0] * shape[1]).reshape(shape), np.bincount(both, h, shape[0] * shape[1]).reshape(shape), least, ridge)[1], i, j))
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in sorted(gains, reverse=True)[:most_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, values in chosen:
            g, h = slopes()
            both = rough[i] * values.shape[1] + rough[j]
            step = rate * _pair_tree(np.bincount(both, g, values.size).reshape(values.shape), np.bincount(both, h, values.size).reshape(values.shape), least, ridge)[0]
            values += step
            total += step.ravel()[both]
    model.pairs = chosen
    return model


def _feature_rows(column: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offsets = text_buffer(batch.column(column))
            rows = [features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SLICE_BYTES)]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:column], pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(FEATURES), dtype=np.int32), flat.ravel())], names=[*batch.schema.names[:column], "features"])

    return run


def _score_rows(model: Model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offsets = text_buffer(batch.column(batch.num_columns - 1))
            scores = [model.score(features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets, SLICE_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names[:-1], "score"])

    return run


def held_out(doc_id):
    """Rows that no label is learned from: crc32 of doc_id as text, modulo 5, is 0 (a null doc_id: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> Model:
    """Fit on at most ``most_rows`` labelled rows that aren't held out.

    The rows are those with the smallest hashes of doc_id, so the choice doesn't depend on how
    the input is dealt out. Labels that are null, and labels of doc_ids that disagree or that no
    document has, aren't used; a repeated label counts once. Of several documents of one doc_id
    the one with the smallest features counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select("doc_id", F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    sample = rows.select("doc_id", "label", "text").mapInArrow(_feature_rows(2), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, features array<double>")
    sample = sample.groupBy("doc_id", "label").agg(F.min("features").alias("features")).select("label", "features").toPandas()  # at most most_rows
    x = np.array(sample["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = sample["label"].to_numpy(dtype=float)
    order = np.lexsort([*x.T, y])  # sums come out the same however the rows arrive
    return fit(x[order], y[order], **options)


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    score is from 0 to 1, higher where label 1 is likelier, from whole texts alone; null and
    empty texts are scored as texts without words. predicted is 1 where score >= ``threshold``.
    One row comes out for each that goes in; a null doc_id is held out. Other columns are not
    read. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score_rows(model), f"doc_id {kind}, held_out boolean, score double")
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            scores = [model.score(features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets, SLICE_BYTES)]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold)) if scores else batch

    return docs.mapInArrow(run, docs.schema)
