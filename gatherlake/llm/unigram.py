"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a SentencePiece model file, whose path is a parameter; nothing is trained.
White space is written as a marker before each word, so no piece crosses the border before a
marker, and a text is encoded word by word with the best segmentation of each distinct word kept.
Characters that no piece covers are encoded as their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of segmentations that one task keeps, about; the table is emptied when full.
KEPT_BYTES = 64 << 20
#: Bytes of a word from which it is cut where no piece goes on, and that are cut at once.
LONG, STRETCH = 96, 1 << 18
#: Words that are segmented at once, and bytes of text that are encoded at once, about.
TOGETHER, SLICE = 8192, 4 << 20


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(raw: bytes):
    """Field number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def read_pieces(raw: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type of each id of a SentencePiece model."""
    out = []
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for inner, x in _fields(value):
                if inner == 1:
                    piece = x.decode()
                elif inner == 2:
                    score = float(np.frombuffer(x, "<f4")[0])
                elif inner == 3:
                    kind = x
            out.append((piece, score, kind))
    return out


@dataclass
class Vocabulary:
    """A double-array trie over the UTF-8 bytes of the pieces (a space for the marker), their scores, and byte pieces."""

    base: list[int]
    check: list[int]
    value: list[int]
    scores: list[float]
    pieces: list[str]
    kinds: list[int]
    bytes_: list[int]
    unknown: int
    floor: float  # score of a character without a piece: worse than any piece
    kept: dict = field(default_factory=dict)  # segmentations of words met so far in this process
    held: int = 0  # bytes of those
    raws: list[bytes] = field(default_factory=list)  # what each id decodes to

    def __post_init__(self):
        text = {NORMAL: lambda p: p.replace(MARK, " ").encode(), USER: lambda p: p.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: b" \xe2\x81\x87 "}
        self.raws = [text[k](p) if k in text else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.trie = tuple(np.array(x, dtype=t) for x, t in ((self.base, np.int32), (self.check, np.int32), (self.value, np.int32), (self.scores, np.float64)))
        self.spelling = np.frombuffer(b"".join(self.raws), np.uint8), np.cumsum([0, *map(len, self.raws)])


def double_array(keys: list[bytes], values: list[int]) -> tuple[list[int], list[int], list[int]]:
    """base, check and value of a trie: the child of s by byte b is ``base[s] + b + 1`` if its check is s."""
    children: list[dict[int, int]] = [{}]
    found = [-1]
    for key, value in zip(keys, values, strict=True):
        node = 0
        for b in key:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                found.append(-1)
            node = children[node][b]
        found[node] = value
    size = 2 * len(children) + 512
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    place = {0: 0}
    hint = {True: 0, False: 0}  # where the search for one child, or for several, goes on
    queue = [0]
    for node in queue:
        own = place[node]
        value[own] = found[node]
        below = children[node]
        if not below:
            continue
        at, steps = hint[len(below) == 1], 0
        while any(check[at + b + 1] >= 0 for b in below):
            at, steps = at + 1, steps + 1
            if at + 258 >= len(check):
                base += [0] * 4096
                check += [-1] * 4096
                value += [-1] * 4096
        if steps > 32:
            hint[len(below) == 1] = at
        base[own] = at
        for b, child in below.items():
            check[at + b + 1] = own
            place[child] = at + b + 1
            queue.append(child)
    return base, check, value


def vocabulary(raw: bytes, scores: str = "zipf") -> Vocabulary:
    """Vocabulary of a model file's bytes.

    ``scores="stored"`` takes the file's scores as log probabilities. Files of merge models store
    the rank of each merge instead; ``"zipf"`` turns the order of those scores into log
    probabilities by Zipf's law, ``-ln(rank + 2.7)`` less the log of their sum.
    """
    listed = read_pieces(raw)
    pieces, kinds = [p for p, _, _ in listed], [k for _, _, k in listed]
    log = [s for _, s, _ in listed]
    if scores == "zipf":
        normal = sorted((i for i, k in enumerate(kinds) if k in (NORMAL, USER)), key=lambda i: (-log[i], i))
        total = math.log(sum(1 / (r + 2.7) for r in range(len(normal))) or 1)
        for r, i in enumerate(normal):
            log[i] = -math.log(r + 2.7) - total
    elif scores != "stored":
        raise ValueError("scores must be 'zipf' or 'stored'")
    ids = [i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (NORMAL, USER) and p and " " not in p]  # no text holds a space: it is a marker
    if any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in ids):
        raise ValueError("a piece crosses the border before a word")
    base, check, value = double_array([pieces[i].replace(MARK, " ").encode() for i in ids], ids)
    bytes_ = [-1] * 256
    for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
        if k == BYTE:
            bytes_[int(p[3:5], 16)] = i
    unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
    own = [log[i] if k in (NORMAL, USER) else 0.0 for i, k in enumerate(kinds)]
    return Vocabulary(base, check, value, own, pieces, kinds, bytes_, unknown, min(own) - 10.0)


def spelled(char: bytes, v: Vocabulary) -> list[int]:
    """Ids of a character without a piece: its bytes, or the unknown piece where one of them has none."""
    own = [v.bytes_[b] for b in (MARK.encode() if char == b" " else char)]
    return own if min(own) >= 0 else [v.unknown]


def segment(word: str, v: Vocabulary) -> tuple[int, ...]:
    """Ids of the best segmentation of one word: the largest sum of log scores, and of equal
    sums the one found first from the left. A character without a piece becomes its bytes."""
    return tuple(_segment(word.replace(MARK, " ").encode(), v))


def _segment(raw: bytes, v: Vocabulary) -> list[int]:
    n = len(raw)
    best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    base, check, value, scores, floor = v.base, v.check, v.value, v.scores, v.floor
    size = len(check)
    for i in range(n):
        if best[i] == -math.inf or raw[i] & 0xC0 == 0x80:
            continue
        width = 1 if raw[i] < 128 else 2 if raw[i] < 224 else 3 if raw[i] < 240 else 4
        node, covered = 0, False
        for j in range(i, n):
            child = base[node] + raw[j] + 1
            if child >= size or check[child] != node:
                break
            node = child
            piece = value[node]
            if piece >= 0:
                covered |= j + 1 - i == width
                total = best[i] + scores[piece]
                if total > best[j + 1]:
                    best[j + 1], back[j + 1] = total, (i, piece)
        if not covered:
            total = best[i] + floor
            if total > best[i + width]:
                best[i + width], back[i + width] = total, (i, -1)
    out: list[int] = []
    at = n
    while at:
        start, piece = back[at]
        out += (piece,) if piece >= 0 else reversed(spelled(raw[start:at], v))
        at = start
    return out[::-1]


def cut_word(word: str, v: Vocabulary) -> list[str]:
    """A long word in parts that can be segmented by themselves: cut wherever no piece that matches goes
    on, which any segmentation has as a border. All characters of a stretch walk the trie at once."""
    return [part.decode().replace(" ", MARK) for part in _cut(word.replace(MARK, " ").encode(), v)]


def _widths(first: np.ndarray) -> np.ndarray:
    """Bytes of the characters that begin with these bytes."""
    return np.where(first < 128, 1, np.where(first < 224, 2, np.where(first < 240, 3, 4)))


def _cut(whole: bytes, v: Vocabulary) -> list[bytes]:
    out, begin = [], 0
    while len(whole) - begin > LONG:
        raw = np.frombuffer(whole, np.uint8, min(STRETCH, len(whole) - begin), begin)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        reach = starts + _widths(raw[starts])
        live, node, at = np.arange(len(starts)), np.zeros(len(starts), np.int64), starts.copy()
        while len(live):
            ended = at[live] >= len(raw)
            reach[live[ended]] = len(raw) + 1  # may go on in the next stretch
            live = live[~ended]
            child = np.minimum(v.trie[0][node[live]] + raw[at[live]] + 1, len(v.check) - 1)
            fits = v.trie[1][child] == node[live]
            live = live[fits]
            node[live] = child[fits]
            at[live] += 1
            has = live[v.trie[2][node[live]] >= 0]
            reach[has] = np.maximum(reach[has], at[has])
        free = starts[1:][np.maximum.accumulate(reach)[:-1] <= starts[1:]]
        if begin + len(raw) == len(whole):
            free = np.append(free, len(raw))
        if not len(free):
            break
        edges = [0, *free.tolist()]
        out += [whole[begin + a : begin + b] for a, b in zip(edges, edges[1:], strict=False)]
        begin += edges[-1]
    return out + ([whole[begin:]] if begin < len(whole) else [])


def _matches(buf: np.ndarray, starts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and id of every piece that begins at one of ``starts``, and of every character there
    without a piece of its own (id -1). ``buf`` holds bytes, 256 behind each word."""
    base, check, value, _ = v.trie
    bare = np.ones(len(buf), bool)
    width = np.zeros(len(buf), np.int8)
    width[starts] = _widths(buf[starts])
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    live, node, size = starts, np.zeros(len(starts), np.int32), 0
    while len(live):
        child = base[node] + buf[live + size] + 1
        fits = np.flatnonzero(check[child] == node)
        live, node, size = live[fits], child[fits], size + 1
        piece = value[node]
        has = np.flatnonzero(piece >= 0)
        own = live[has]
        found.append((own, size, piece[has]))
        if size <= 4:
            bare[own[width[own] == size]] = False
    alone = starts[bare[starts]]
    start = np.concatenate([alone, *(s for s, _, _ in found)])
    length = np.concatenate([width[alone].astype(np.int16), *(np.full(len(s), n, np.int16) for s, n, _ in found)])
    return start, length, np.concatenate([np.full(len(alone), -1, np.int32), *(p for _, _, p in found)])


def segment_many(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """What :func:`segment` gives for each word (UTF-8, spaces for markers), as 32-bit integers. All words
    walk the trie at once, then each place of all words takes its best piece at once."""
    out = [b""] * len(words)
    short = []
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = array("i", _segment(w, v)).tobytes()
        else:
            short.append(i)
    for s in range(0, len(short), TOGETHER):
        rows = short[s : s + TOGETHER]
        sizes = np.array([len(words[i]) for i in rows])
        last = np.cumsum(sizes + 1) - 1  # place behind each word
        joined = b"\n".join([*(words[i] for i in rows), b""])
        buf = np.frombuffer(joined, np.uint8).astype(np.int32)
        buf[last] = 256  # no piece goes on
        starts = np.flatnonzero((buf & 0xC0 != 0x80) & (buf < 256))
        start, length, piece = _matches(buf, starts, v)
        own = np.repeat(np.arange(len(rows), dtype=np.int32), sizes + 1)[start]
        place = (start - (last - sizes)[own]).astype(np.int16)
        order = np.argsort(place * np.int16(LONG + 1) + length, kind="stable")  # places from the left: all that end at one are in before it is left
        own, place, length, piece = own[order], place[order], length[order], piece[order]
        score = np.where(piece >= 0, v.trie[3][piece], v.floor)
        group = place * np.int16(LONG + 1) + length
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        best = np.full((int(sizes.max()) + 1, len(rows)), -np.inf)
        back = np.zeros(best.shape, np.int32)
        best[0] = 0.0
        for a, b in zip(edges, edges[1:], strict=False):  # one place and length: a word at most once
            i, j, w = int(place[a]), int(place[a]) + int(length[a]), own[a:b]
            total = best[i].take(w) + score[a:b]
            better = np.flatnonzero(total > best[j].take(w))
            w = w.take(better)
            best[j][w] = total.take(better)
            back[j][w] = better + a
        taken, at, live = [], sizes.copy(), np.flatnonzero(sizes)
        while len(live):
            edge = back[at[live], live]
            taken.append((live, edge))
            at[live] = place[edge]
            live = live[at[live] > 0]
        # pieces come from the last to the first of each word
        whose = np.concatenate([w for w, _ in taken])[::-1]
        edge = np.concatenate([e for _, e in taken])[::-1]
        order = np.argsort(whose, kind="stable")
        whose, edge = whose[order], edge[order]
        ids, many = piece[edge], np.ones(len(edge), np.int64)
        alone = np.flatnonzero(ids < 0)
        if len(alone):
            begin = (last - sizes)[whose[alone]] + place[edge[alone]]
            chars = [spelled(joined[a : a + n], v) for a, n in zip(begin.tolist(), length[edge[alone]].tolist(), strict=True)]
            many[alone] = [len(c) for c in chars]
            ids = np.repeat(ids, many)
            ids[ids < 0] = [i for c in chars for i in c]
        raw = ids.astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(whose, many, len(rows)))).astype(np.int64).tolist()
        for i, a, b in zip(rows, [0, *ends], ends, strict=False):
            out[i] = raw[a:b]
    return out


def _ends(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _gather(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` that begin there, one after the other."""
    return pool[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])]


def encode_array(texts, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of an Arrow array of texts one after the other, and where those of each text end (from 0 on): one
    marker in front of each text, and one for each space. Words are told apart by Arrow, so that Python
    meets each distinct word once; segmentations are kept as bytes, a fraction of what lists of numbers take."""
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = pc.replace_substring(texts.fill_null(""), MARK, " ")
    marked = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
    marked.validate(full=True)  # UTF-8
    bounds = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1] if len(marked) else np.zeros(1, np.int32)
    if bounds[0] == bounds[-1]:
        return np.zeros(0, np.int32), np.zeros(len(marked) + 1, np.int64)
    space = np.frombuffer(marked.buffers()[2], np.uint8)[: bounds[-1]] == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    begins[: bounds[0]] = False
    begins = np.flatnonzero(begins)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.append(begins, bounds[-1]).astype(np.int32)), marked.buffers()[2]])
    words = words.dictionary_encode()
    index, table = words.indices.to_numpy(), words.dictionary
    whole, places = table.buffers()[2].to_pybytes(), np.frombuffer(table.buffers()[1], np.int32)[: len(table) + 1].tolist()
    distinct = [whole[a:b] for a, b in zip(places, places[1:], strict=False)]  # many times faster than to_pylist

    kept = v.kept
    if v.held > KEPT_BYTES:
        kept.clear()
        v.held = 0
    found = [kept.get(w) for w in distinct]
    missing = [i for i, ids in enumerate(found) if ids is None]
    parts = {i: _cut(distinct[i], v) for i in missing if len(distinct[i]) > LONG}
    new = [distinct[i] for i in missing if i not in parts]
    new += {w for own in parts.values() for w in own if w not in kept}.difference(new)
    once = {}  # too long to be kept
    for w, ids in zip(new, segment_many(new, v), strict=True):
        if len(w) > LONG:
            once[w] = ids
        else:
            kept[w] = ids
            v.held += 200 + len(w) + len(ids)
    for i in missing:
        found[i] = b"".join([once[w] if len(w) > LONG else kept[w] for w in parts[i]]) if i in parts else kept[distinct[i]]

    sizes = np.array(list(map(len, found))) // 4
    each = sizes[index]
    ends = _ends(each)
    return _gather(np.frombuffer(b"".join(found), np.int32), _ends(sizes)[index], each, ends), ends[np.searchsorted(begins, bounds)]


def encode_texts(texts: list[str | None], v: Vocabulary) -> list[list[int]]:
    """Ids of texts, see :func:`encode_array`."""
    import pyarrow as pa

    ids, ends = encode_array(pa.array(texts, pa.string()), v)
    return [own.tolist() for own in np.split(ids, ends[1:-1])] if texts else []


def decode_ids(ids, v: Vocabulary) -> str:
    """Text of ids: byte pieces are joined as UTF-8, markers become spaces, the first is dropped."""
    raws = v.raws
    return b"".join([raws[i] for i in ids]).decode(errors="replace").removeprefix(" ")


def decode_array(ids: np.ndarray, ends: np.ndarray, v: Vocabulary):
    """What :func:`decode_ids` gives for each text of :func:`encode_array`, as an Arrow array."""
    import pyarrow as pa

    pool, places = v.spelling
    sizes = np.diff(places)[ids]
    behind = _ends(sizes)
    data = _gather(pool, places[ids], sizes, behind)
    bounds = behind[ends]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    first = first[data[first] == 32]  # the marker before a text
    bounds -= np.searchsorted(first, bounds)
    data = np.delete(data, first)
    out = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:  # byte pieces that aren't UTF-8
        out = pa.array([decode_ids(ids[a:b].tolist(), v) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.string())
    return out


_BUILT: dict = {}


def load(spark: SparkSession, path: str, scores: str = "zipf") -> Vocabulary:
    """Read a model file and build its vocabulary on the driver: a plain path is the driver's, a URI is
    read by Spark (any store it reads). Its size is that of the file's vocabulary, whatever the corpus."""
    if "://" in path:
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    else:
        with open(path, "rb") as file:
            raw = file.read()
    key = hashlib.sha256(raw).digest(), scores
    if key not in _BUILT:  # the last one is kept: building takes many times the memory of the vocabulary
        _BUILT.clear()
        _BUILT[key] = vocabulary(raw, scores)
    return _BUILT[key]


def _slices(batch):
    """A record batch in slices of at most some bytes in the last column, or one row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < max(len(ends), 1):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        yield batch.slice(a, b - a)
        a = b


def _coder(shared, decode: bool, back: bool = False):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        v = shared.value
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            if decode:
                out = pa.array([None if ids is None else decode_ids(ids, v) for ids in values.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "text"])
                continue
            for part in _slices(batch):
                texts = part.column(part.num_columns - 1)
                raw, ends = encode_array(texts, v)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(raw))
                columns, names = [*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"]
                if back:
                    decoded = decode_array(raw, ends, v)
                    same = pc.equal(decoded, pc.replace_substring(texts.fill_null(""), MARK, " "))
                    columns, names = [*columns, decoded, same], [*names, "decoded", "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _key_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, v: Vocabulary, back: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every text; with ``back`` also decoded, the text that the ids
    decode to, and round_trip, whether that is the text.

    Texts are encoded as they are: the normalisation that a model file may ask for (Unicode forms,
    dropping of repeated spaces) isn't applied, only the marker before the text. Null and empty texts have no ids. One row comes out for each that goes in, whatever its
    doc_id; other columns are not read; an empty table gives an empty result. Decoding gives
    the text back exactly, except that a marker character in a text becomes a space.
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)  # bounded by the vocabulary
    return docs.select("doc_id", "text").mapInArrow(_coder(shared, False, back), f"doc_id {_key_type(docs)}, ids array<int>" + (", decoded string, round_trip boolean" if back else ""))


def decode(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id and text of encoded rows; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(v)
    return encoded.select("doc_id", "ids").mapInArrow(_coder(shared, True), f"doc_id {_key_type(encoded)}, text string")
