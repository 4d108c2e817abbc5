"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

How the work is spread. A task reads documents in chunks of about ``chunk_windows`` windows,
hashes every window with two rolling polynomials (one gives 64 bits to compare, the other the
bucket), and sends each bucket the chunk's distinct hashes. One shuffle deals the buckets out;
a bucket's task sorts its hashes and answers every chunk whose hash another chunk also holds.
Hashes that repeat inside a chunk are known there and are sent once, so a window that a third
of all documents hold costs a bucket one entry for each chunk, not one for each document.
The number of buckets follows the bytes of text, so a bucket's task stays the same size. Windows
are taken for equal by their 64 bits and the bits that choose the bucket: of n distinct windows about
``n * n / 2 / 2 ** (64 + log2(buckets))`` pairs agree by chance, 1e-6 at 0.5 GB and 2 at 100 TB
(1.7e13 windows, 2 ** 22 buckets). Answers go back to their chunk, which turns
them into maximal removal intervals of its documents. Texts are shuffled once, for the cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, mix, powers, slices, text_buffer, word_bounds, word_hashes

WINDOW = 35
#: Text bytes that one bucket of hashes stands for; a bucket's task holds about 2 bytes for each.
BUCKET_BYTES = 32 << 20
_A, _B = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_A_INVERSE, _B_INVERSE = pow(_A, -1, 1 << 64), pow(_B, -1, 1 << 64)
_SENT = "bucket int, chunk long, hashes binary, places binary, rows binary"
_ANSWER = "chunk long, places binary, rows binary"


def _rolling(words: np.ndarray, window: int, base: int, inverse: int) -> np.ndarray:
    """Rabin-Karp hash of the words i .. i+window-1 for each i, modulo 2**64."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=total[1:])
    n = len(words) - window + 1
    return mix((total[window:] - total[:n]) * powers(inverse, n))


def _planes(x: np.ndarray) -> bytes:
    """Steps of ascending places as four byte planes; the high planes are zeros and compress away."""
    return np.ascontiguousarray(np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def _chunk_rows(parts, buckets: int):
    """What one chunk sends: distinct hashes for each bucket, and one row with its documents."""
    import pyarrow as pa

    keys = np.concatenate([p[0] for p in parts])  # rows x 2: the key of each document
    counts = np.concatenate([p[1] for p in parts])  # windows of each document
    hashes = np.concatenate([p[2] for p in parts])
    bucket = np.concatenate([p[3] for p in parts])
    order = np.argsort(hashes, kind="stable")
    ordered, homes = hashes[order], bucket[order]
    again = np.zeros(len(order), bool)
    again[1:] = (ordered[1:] == ordered[:-1]) & (homes[1:] == homes[:-1])
    repeated = again.copy()
    repeated[:-1] |= again[1:]
    local = np.sort(order[repeated])
    first = np.sort(order[~again])
    # by the content of the chunk: an attempt that saw other rows can't be taken for this one
    digest = hashlib.blake2b(keys.tobytes() + counts.tobytes(), digest_size=8).digest()
    chunk = int.from_bytes(digest, "little", signed=True)
    rows = np.concatenate([keys.ravel(), counts]).astype("<i8").tobytes()
    out = {"bucket": [buckets + chunk % buckets], "chunk": [chunk], "hashes": [None], "places": [_planes(local)], "rows": [rows]}
    by = np.argsort(bucket[first], kind="stable")
    first = first[by]
    homes = bucket[first]
    edges = np.flatnonzero(np.diff(homes, prepend=-1)) if len(homes) else np.zeros(0, np.int64)
    for a, b in zip(edges, [*edges[1:], len(first)], strict=True):
        out["bucket"].append(int(homes[a]))
        out["chunk"].append(chunk)
        out["hashes"].append(hashes[first[a:b]].astype("<u8").tobytes())
        out["places"].append(_planes(first[a:b]))
        out["rows"].append(None)
    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary()), ("rows", pa.binary())]))


def _hash_windows(window: int, buckets: int, chunk_windows: int):
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
            for a, b in slices(offsets, 2 << 20):
                base = offsets[a]
                own, own_offsets = raw[base : offsets[b]], offsets[a : b + 1] - base
                starts, ends, firsts = word_bounds(own, own_offsets)
                counts = np.diff(firsts)
                windows = np.maximum(counts - window + 1, 0)
                if not windows.any():
                    continue
                words = word_hashes(own, starts, ends)
                inside = np.arange(len(words)) <= np.repeat(firsts[1:] - window, counts)
                inside = inside[: len(words) - window + 1]
                hashes = _rolling(words, window, _A, _A_INVERSE)[inside]
                homes = (_rolling(words, window, _B, _B_INVERSE)[inside] & _U(buckets - 1)).astype(np.int32)
                some = windows > 0
                parts.append((keys[a:b][some], windows[some], hashes, homes))
                held += len(hashes)
                if held >= chunk_windows:
                    yield from _chunk_rows(parts, buckets)
                    parts, held = [], 0
        if parts:
            yield from _chunk_rows(parts, buckets)

    return run


def _count_bucket(pdf):
    """Answers of one bucket: for each chunk, the places of hashes that another chunk also holds."""
    import pandas as pd

    if pdf["hashes"].isna().any():  # a bucket of documents' rows, which only pass through
        return pdf[["chunk", "places", "rows"]]
    hashes = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["hashes"]])
    sizes = pdf["hashes"].str.len().to_numpy() // 8
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    hit = np.zeros(len(hashes), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    ends = np.cumsum(sizes)
    out = []
    for chunk, places, a, b in zip(pdf["chunk"], pdf["places"], ends - sizes, ends, strict=True):
        own = hit[a:b]
        if own.any():
            out.append((chunk, _planes(_from_planes(places)[own]), None))
    return pd.DataFrame(out, columns=["chunk", "places", "rows"])


def _intervals(window: int):
    def run(pdf):
        """Maximal removal intervals of a chunk's documents, as pairs of word places."""
        import pandas as pd

        homes = pdf[pdf["rows"].notna()]
        if homes.empty:
            raise RuntimeError("a chunk of documents changed between two attempts of its task; write the input as a table first")
        rows = np.frombuffer(homes["rows"].iloc[0], "<i8")
        n = len(rows) // 3
        keys, counts = rows[: 2 * n].reshape(n, 2), rows[2 * n :]
        firsts = np.concatenate([[0], np.cumsum(counts)])
        hit = np.unique(np.concatenate([_from_planes(x) for x in pdf["places"]]))
        doc = np.searchsorted(firsts, hit, side="right") - 1
        at = hit - firsts[doc]
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)
        lead = np.flatnonzero(fresh)
        last = np.concatenate([lead[1:], [len(hit)]]) - 1 if len(lead) else lead
        begin, end, owner = at[lead], at[last] + window, doc[lead]
        edges = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else []
        out = []
        for a, b in zip(edges, [*edges[1:], len(owner)], strict=True):
            spans = np.stack([begin[a:b], end[a:b]], axis=1).ravel()
            out.append((keys[owner[a], 0], keys[owner[a], 1], spans.astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=["k1", "k2", "spans"])

    return run


def _keep(batches):
    """Cut the removal intervals out of whole texts."""
    import pyarrow as pa

    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans")
        words_n, removed_n, kept, intervals = [], [], [], []
        for i in range(len(texts)):
            text = texts[i].as_py()
            words = (text or "").encode().split()
            cuts = np.frombuffer(spans[i].as_py() or b"", "<i4").reshape(-1, 2).tolist()
            words_n.append(len(words))
            removed_n.append(sum(b - a for a, b in cuts))
            if cuts:
                stay, at = [], 0
                for a, b in cuts:
                    stay += words[at:a]
                    at = b
                words = stay + words[at:]
            kept.append(b" ".join(words).decode())
            intervals.append([{"start": a, "end": b} for a, b in cuts])
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(kept, pa.string()), pa.array(intervals, span)],
            names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
        )


def removal_spans(docs: DataFrame, window: int = WINDOW, chunk_windows: int = 2_000_000) -> DataFrame:
    """k1, k2 (a document's key, see :func:`with_key`) and its removal intervals, for documents that have any."""
    if window < 1:
        raise ValueError("window must be at least 1")
    bytes_ = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(256, 1 << max(0, int(bytes_ // BUCKET_BYTES)).bit_length())
    sent = with_key(docs).select("k1", "k2", "text").mapInArrow(_hash_windows(window, buckets, chunk_windows), _SENT)
    answers = sent.groupBy("bucket").applyInPandas(_count_bucket, _ANSWER)
    spans = answers.groupBy("chunk").applyInPandas(_intervals(window), "k1 long, k2 long, spans binary")
    # each chunk knows all of a document's intervals, so copies in several chunks say the same
    return spans.groupBy("k1", "k2").agg(F.first("spans").alias("spans"))


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a key of 96 bits: rows of one key are copies of one row."""
    return docs.select("doc_id", "text").withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id").cast("long")})


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_windows: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed (intervals of word places, end exclusive).

    Every word covered by a ``window``-word sequence that also starts at any other place of
    any document goes; windows are judged on the input. Texts that are null, empty or shorter
    than the window lose nothing; a null text has no words and an empty kept text. One row comes
    out for each row that goes in: rows with equal doc_id are separate documents (equal rows
    are copies of each other and lose what they share), and a null doc_id stays null. Other
    columns are not read. An empty table gives an empty result.
    """
    spans = removal_spans(docs, window, chunk_windows)
    return (
        with_key(docs)
        .join(spans, ["k1", "k2"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_keep, docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", n_words long, n_removed long, kept_text string, removed array<struct<start: int, end: int>>")
    )
