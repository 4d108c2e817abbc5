"""Cross-tokenizer alignment: how the tokens of two tokenizers cover the same bytes of every text.

Byte offsets where tokens of A and B both end cut a text into groups, and each such offset links
the A token and the B token that end there. Most groups are one A token and one B token of the same
bytes. For those an identity map, an array from A id to the B id of the same bytes, makes the pair a
function of the A id: they are counted in vectors of the vocabulary's length, one a task, and looked
up again by their id. Links of other, irregular groups are pairs: those that hold more than one in
``HOT_PAIRS`` of all irregular links (fewer than HOT_PAIRS of them) are looked up in the task like the
vector, and only the rest are shuffled by pair.

Neither tokenizer joins what a run of spaces, tabs and newlines separates from the word before, so
a text is encoded and aligned word by word, and what is known of a word is kept within a bound of
bytes. A text with other white space, or a word whose bytes don't come back, is aligned as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, slices, text_buffer

#: How byte-level merge vocabularies split a text before merging; a fixed value of that format.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: An irregular pair is looked up in the task if more than one in so many irregular links is one of it.
HOT_PAIRS = 1 << 18
#: Bytes of alignments that a worker keeps, about, in each of two generations; longer words aren't kept.
KEPT_BYTES, KEPT_WORD = 80 << 20, 96

_CHUNK = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
_OTHER_SPACE = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MARK = "\u2581"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones of Latin-1 stand
    for themselves, the others in order for the letters from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Files:
    """Contents of the two vocabulary files; bounded by the vocabularies."""

    a: bytes
    b: bytes


def read_files(spark: SparkSession, path_a: str, path_b: str) -> Files:
    """Read a byte-level vocabulary (a ``tokenizers`` JSON file) and a SentencePiece model. Plain paths
    are the driver's, URIs are read by Spark."""

    def content(path: str) -> bytes:
        if "://" in path:
            return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
        with open(path, "rb") as file:
            return file.read()

    return Files(content(path_a), content(path_b))


@dataclass
class Aligner:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    files: Files
    kept: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)
    held: int = 0

    def __post_init__(self):
        import sentencepiece

        self.encode_a, self.bytes_a = _byte_level(self.files.a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.files.b)
        size = self.b.get_piece_size()
        self.bytes_b = []
        for i in range(size):
            piece = self.b.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode()
            self.bytes_b.append(b"" if self.b.is_control(i) else raw)
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        # words may be cut off before spaces, tabs and newlines if no piece goes on over such a place
        self.by_word = not any(re.search(f"[^{_MARK}]{_MARK}|.[\t\n]|[\t\n].", p, re.S) for p in pieces) and self.encode_a.__name__ == "encode_ordinary"
        self.code = np.dtype("<u4" if len(self.bytes_a) * size <= 1 << 32 else "<u8")
        self.small = np.dtype("<u2" if len(self.bytes_a) <= 1 << 16 else "<u4")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.words = [b"%d%s" % (i, end) for i in range(len(self.bytes_a)) for end in (b",", b"|")] + [b"%d%s" % (i, end) for i in range(size) for end in (b",", b";", b"\n")]
        # of B ids of the same bytes the whole piece counts, then the smallest id
        own = {}
        for i in sorted(range(size), key=lambda i: (self.b.is_byte(i), i)):
            own.setdefault(self.bytes_b[i], i)
        own.pop(b"", None)
        self.identity = np.array([own.get(x, -1) for x in self.bytes_a], np.int64)

    @property
    def n_b(self) -> int:
        return len(self.bytes_b)

    def _aligned(self, raws: list[bytes], a: list[list[int]], b: list[list[int]]) -> list:
        """What is known of each of some stretches of bytes and their tokens: numbers of tokens and groups,
        the groups as text, the A ids of regular links, and the codes (A id * size of B + B id) of
        irregular ones. None for a stretch if the bytes of its tokens aren't its own."""
        if not raws:
            return []
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        sizes_a, sizes_b = self.sizes_a[flat_a], self.sizes_b[flat_b]
        ends = np.cumsum([len(r) for r in raws])
        n_a, n_b = (np.array([len(x) for x in y]) for y in (a, b))
        total_a, total_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        whole = b"".join(raws)
        same = n_a.all() and n_b.all() and (total_a[np.cumsum(n_a) - 1] == ends).all() and (total_b[np.cumsum(n_b) - 1] == ends).all()
        same = same and all(b"".join([of[i] for i in ids]) == whole for of, ids in ((self.bytes_a, flat_a.tolist()), (self.bytes_b, flat_b.tolist())))
        if not same:
            half = len(raws) // 2
            return self._aligned(raws[:half], a[:half], b[:half]) + self._aligned(raws[half:], a[half:], b[half:]) if half else [None]
        at = np.searchsorted(total_b, total_a)
        closes = total_b[at] == total_a
        last_a = np.flatnonzero(closes)
        last_b = at[last_a]
        x, y = flat_a[last_a], flat_b[last_b]
        single = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1) & (self.identity[x] == y)
        regular, irregular = x[single].astype(self.small).tobytes(), (x[~single] * self.n_b + y[~single]).astype(self.code).tobytes()
        groups = np.searchsorted(total_a[last_a], ends, side="right")  # how many end so far
        n_regular = np.concatenate([[0], np.cumsum(single)])[groups]
        # groups as text: A tokens end in a comma or a bar, B tokens in a comma, a semicolon or, last of a stretch, a new line
        closes_b = np.zeros(len(flat_b), np.int64)
        closes_b[last_b] = 1
        home_a, home_b = np.cumsum(closes) - closes, np.cumsum(closes_b) - closes_b
        closes_b[last_b[groups - 1]] = 2
        order = np.empty(len(flat_a) + len(flat_b), np.int64)
        order[np.arange(len(flat_a)) + np.concatenate([[0], last_b + 1])[home_a]] = 2 * flat_a + closes
        order[np.arange(len(flat_b)) + last_a[home_b] + 1] = 2 * len(self.bytes_a) + 3 * flat_b + closes_b
        words = self.words
        said = b"".join([words[i] for i in order.tolist()]).split(b"\n")
        edges = zip(n_regular.tolist(), groups.tolist(), n_a.tolist(), n_b.tolist(), said[:-1], strict=True)
        out, r0, g0, wide, narrow = [], 0, 0, self.code.itemsize, self.small.itemsize
        for r, g, k, m, text in edges:
            out.append((k, m, g - g0, text, regular[r0 * narrow : r * narrow], irregular[(g0 - r0) * wide : (g - r) * wide]))
            r0, g0 = r, g
        return out

    def whole(self, text: str):
        """The alignment of one whole text, or None."""
        return self._aligned([b" " + text.encode()], [list(self.encode_a(" " + text))], [self.b.encode(text, num_threads=1)])[0]

    def _learn(self, words: set) -> dict:
        """Make sure that these words are kept, and return those that aren't to be."""
        if self.held > KEPT_BYTES:
            self.kept, self.older, self.held = {}, self.kept, 0
        kept, older = self.kept, self.older
        missing = [w for w in words if w not in kept]
        again = {w: older[w] for w in missing if w in older}
        new = [w for w in missing if w not in again]
        # B puts a marker in front: the word's own space, or one to be dropped
        ids_b = self.b.encode([w[1:] if w[0] == " " else w for w in new], num_threads=1)
        found = self._aligned([w.encode() for w in new], [self.encode_a(w) for w in new], [b if w[0] == " " else b[1:] for w, b in zip(new, ids_b, strict=True)])
        learned = dict(zip(new, found, strict=True))
        extra = {w: x for w, x in learned.items() if x is None or len(w) > KEPT_WORD}
        for w in extra:
            del learned[w]
        for more in (again, learned):
            kept.update(more)
            self.held += sum([len(w) + len(x[3]) for w, x in more.items()]) + 500 * len(more)
        return extra

    def align(self, texts: list[str | None]) -> list:
        """An alignment, or None for a text without tokens, of each text."""
        plain = [bool(t) and self.by_word and not _OTHER_SPACE.search(t) for t in texts]
        split = [_CHUNK.findall(" " + t) if p else () for t, p in zip(texts, plain, strict=True)]
        extra = self._learn(set().union(*split))
        kept, out = self.kept, []
        for text, words in zip(texts, split, strict=True):
            if not text:
                out.append(None)
                continue
            found = [kept[w] if w in kept else extra[w] for w in words] if extra else [kept[w] for w in words]
            if not found or None in found:
                out.append(self.whole(text))
                continue
            a, b, n, groups, regular, irregular = zip(*found, strict=True)
            out.append((sum(a), sum(b), sum(n), b";".join(groups), b"".join(regular), b"".join(irregular)))
        return out


def _byte_level(raw: bytes):
    """An encoder of a byte-level merge vocabulary without special tokens, and the bytes of each id."""
    given = json.loads(raw)
    model, split, letters = given["model"], given.get("pre_tokenizer") or {}, byte_letters()
    special = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    size = 1 + max([*vocab.values(), *special.values()])
    out = [b""] * size
    for t, i in vocab.items():
        out[i] = bytes(letters[c] for c in t)
    for t, i in special.items():
        out[i] = t.encode()
    ranked = [vocab["".join(m)] for m in merges]
    simple = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not given.get("normalizer")
    if simple and ranked == sorted(set(ranked)) and not model.get("ignore_merges"):  # ids in the order of merges are ranks
        import tiktoken

        fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks={out[i]: i for i in vocab.values()}, special_tokens={})
        return fast.encode_ordinary, out
    from tokenizers import Tokenizer

    slow = Tokenizer.from_buffer(raw)
    slow.encode_special_tokens = True
    return (lambda text: slow.encode(text, add_special_tokens=False).ids), out


_READY: dict = {}


def _ready(shared) -> Aligner:
    files = shared.value
    key = hashlib.sha256(files.a + files.b).digest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Aligner(files)
    return _READY[key]


_LINKS = "n_a long, n_b long, n_groups long, groups_sha256 string, regular binary, irregular binary"


def _align_rows(shared):
    def run(batches):
        import pyarrow as pa

        aligner = _ready(shared)
        for batch in batches:
            texts = batch.column(1)
            for at, to in slices(text_buffer(texts)[1], SLICE_BYTES):
                found = aligner.align(texts.slice(at, to - at).to_pylist())
                rows = [(0, 0, 0, "", b"", b"") if f is None else (*f[:3], hashlib.sha256(f[3]).hexdigest() if f[0] else "", *f[4:]) for f in found]
                n_a, n_b, n, sha, regular, irregular = zip(*rows, strict=True)
                arrays = [batch.column(0).slice(at, to - at), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n)), pa.array(sha, pa.string()), pa.array(regular, pa.binary()), pa.array(irregular, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "regular", "irregular"])

    return run


def _count_rows(size_a: int, small: str, code: str, most: int = 1 << 22):
    def run(batches):
        """Counts of a task: one row an A id of regular links, one row a pair of irregular links."""
        import pyarrow as pa

        def rows(kind, keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["regular", "code", "n"])

        vector, codes, counts, held = np.zeros(size_a, np.int64), [], [], 0

        def merged():
            every, place = np.unique(np.concatenate(codes), return_inverse=True)
            return every, np.bincount(place, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            vector += np.bincount(np.frombuffer(b"".join(batch.column("regular").to_pylist()), small), minlength=size_a)
            own, n = np.unique(np.frombuffer(b"".join(batch.column("irregular").to_pylist()), code), return_counts=True)
            codes.append(own)
            counts.append(n)
            held += len(own)
            if held > most:
                every, n = merged()
                codes, counts, held = [every], [n], len(every)
                if held > most // 2:
                    yield rows(False, every, n)
                    codes, counts, held = [], [], 0
        used = np.flatnonzero(vector)
        yield rows(True, used, vector[used])
        if codes:
            yield rows(False, *merged())

    return run


@dataclass
class Known:
    """Counts that tasks look up: of regular links by A id, and of the frequent irregular pairs."""

    vector: np.ndarray
    vector_best: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    best: np.ndarray


def _sum_rows(shared, small: str, code: str):
    def run(batches):
        import pyarrow as pa

        k = shared.value
        for batch in batches:
            best, total, rare, times = [], [], [], []
            for regular, irregular in zip(batch.column("regular").to_pylist(), batch.column("irregular").to_pylist(), strict=True):
                ids = np.frombuffer(regular, small)
                pairs, n = np.unique(np.frombuffer(irregular, code), return_counts=True)
                pairs = pairs.astype(np.int64)
                at = np.minimum(np.searchsorted(k.codes, pairs), max(len(k.codes) - 1, 0))
                hot = k.codes[at] == pairs if len(k.codes) else np.zeros(len(pairs), bool)
                total.append(int(k.vector[ids].sum() + (k.counts[at[hot]] * n[hot]).sum()))
                best.append(int(k.vector_best[ids].sum() + n[hot][k.best[at[hot]]].sum()))
                rare.append(pairs[~hot])
                times.append(n[~hot])
            ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))) for x in (rare, times)]
            keep = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(best, pa.int64()), pa.array(total, pa.int64()), *lists], names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum", "rare", "times"])

    return run


def aligned_documents(docs: DataFrame, files: Files) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, and as bytes the links of each text: ``regular`` (A ids)
    and ``irregular`` (A id * size of B's vocabulary + B id), little-endian integers."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # bounded by the vocabularies
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_align_rows(shared), f"doc_id {kind}, {_LINKS}")


def align_tokenizers(docs: DataFrame, files: Files, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    A encodes a space and the text, B the text (it adds the space), both without special tokens.
    A link is an A token and a B token that end at one byte; the count of an id pair is how many links
    of all documents hold it. n_best counts the links whose pair has the largest count among the pairs of
    its B id (ties included), count_sum adds up the counts. groups_sha256 is the hash of the groups
    as ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and those whose tokens' bytes differ from the text
    (a literal U+2581, say), have no tokens: zeros and an empty string, and no share in the counts. One
    row comes out for each that goes in, whatever its doc_id (null and repeated ones too); copies
    count as often as they are there. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    both = Aligner(files)
    size_a, n_b, small, code = len(both.bytes_a), both.n_b, both.small.str, both.code.str
    table = cut(aligned_documents(docs, files).withColumn("row", F.monotonically_increasing_id()), "aligned")

    counts = table.select("regular", "irregular").mapInArrow(_count_rows(size_a, small, code), "regular boolean, code long, n long")
    counts = cut(counts.groupBy("regular", "code").agg(F.sum("n").alias("n")), "pair-counts")
    pairs = counts.where(~F.col("regular")).select("code", "n")
    vector = np.zeros(size_a, np.int64)
    single = counts.where("regular").select("code", "n").toPandas()  # at most one row an A id
    vector[single["code"].to_numpy(np.int64)] = single["n"].to_numpy(np.int64)
    best = np.zeros(n_b, np.int64)
    top = pairs.groupBy((F.col("code") % n_b).alias("b")).agg(F.max("n").alias("n")).toPandas()  # at most one row a B id
    best[top["b"].to_numpy(np.int64)] = top["n"].to_numpy(np.int64)
    has = both.identity >= 0
    np.maximum.at(best, both.identity[has], vector[has])
    total = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") * hot_pairs > total
    often = pairs.where(hot).orderBy("code").toPandas()  # fewer than hot_pairs rows
    codes, n = often["code"].to_numpy(np.int64), often["n"].to_numpy(np.int64)
    vector_best = has & (vector == best[np.where(has, both.identity, 0)])
    known = spark.sparkContext.broadcast(Known(vector, vector_best, codes, n, n == best[codes % n_b]))

    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, rare array<long>, times array<long>"
    done = cut(table.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "regular", "irregular").mapInArrow(_sum_rows(known, small, code), schema), "aligned-sums")
    asked = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("code"), F.col("p.times").alias("times"))
    of_b = spark.createDataFrame([(b, x) for b, x in enumerate(best.tolist()) if x], "b long, best long")
    rest = pairs.where(~hot).withColumn("b", F.col("code") % n_b).join(F.broadcast(of_b), "b").select("code", "n", (F.col("n") == F.col("best")).alias("is_best"))
    more = asked.join(rest, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"))
    out = done.drop("rare", "times").join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")
