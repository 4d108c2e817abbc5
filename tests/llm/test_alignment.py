"""Cross-tokenizer alignment against the tokenizer libraries and a plain count."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gatherlake.llm.tokenizer_alignment import Aligner, align_tokenizers, read_files

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """Ids of both tokenizers and the end byte of each, or nothing."""
    a, b = libraries
    letters = {}
    n = 0
    for i in range(256):
        plain = 33 <= i <= 126 or 161 <= i <= 172 or i >= 174
        letters[chr(i if plain else 256 + n)] = i
        n += not plain
    if not text:
        return None
    raw = (" " + text).encode()
    out = []
    for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))), (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        parts = [of(i) for i in ids]
        if b"".join(parts) != raw:
            return None
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        out.append((ids, ends))
    return out


def plain(libraries, given):
    found, count = [tokens(libraries, t) for t in given], Counter()
    links = []
    for f in found:
        own = []
        if f is not None:
            at = {e: y for y, e in zip(*f[1], strict=True)}
            own = [(x, at[e]) for x, e in zip(*f[0], strict=True) if e in at]
        links.append(own)
        count.update(own)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for f, own in zip(found, links, strict=True):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        (a, ea), (b, eb) = f
        cuts = sorted(set(ea) & set(eb))
        groups, last = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, e in zip(a, ea, strict=True) if last < e <= c) + "|" + ",".join(str(x) for x, e in zip(b, eb, strict=True) if last < e <= c))
            last = c
        out.append((len(a), len(b), len(cuts), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def texts(seed=0):
    rng = random.Random(seed)
    pieces = ["the ", "market", " jazz", "Über", "naïve ", "é", "🎵", "日本語", " ", "  ", "\n", "\t", "x1", "<|endoftext|>", "<s>", "</s>", "''", "don't", ";", "}\n", "ﬁ", "\u00a0", "\r\n", "unbelievableness ", "12345 ", "ẞ", "<0x41>", "\u2003", "\x1c"]
    out = ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(120)]
    out += ["".join(rng.choices(pieces, k=3000)), "x" * 5000, "日本" * 2000, " ", "\n", "  ", " a", "a ", "▁", "a▁b", "", None, "same words here", "same words here", "x" * 5000]
    return out


def test_against_the_libraries(spark, libraries):
    given = texts()
    df = spark.createDataFrame([(None if i == 3 else i // 2 * 2, t, "clash", i) for i, t in enumerate(given)], "doc_id long, text string, row string, n_a int")
    files = read_files(spark, A, B)
    want = plain(libraries, given)
    for hot in (1, 1 << 18):
        got = align_tokenizers(df, files, hot)
        assert got.columns == ["doc_id", *COLUMNS]
        rows = sorted(map(str, ((r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect())))
        assert rows == sorted(map(str, ((None if i == 3 else i // 2 * 2, *w) for i, w in enumerate(want))))
    assert align_tokenizers(df.where("false"), files).count() == 0
    assert align_tokenizers(df.where("text = '' or text is null"), files).agg(F.sum("n_a")).first()[0] == 0


def test_words_are_whole_texts(spark):
    both = Aligner(read_files(spark, A, B))
    assert both.by_word
    given = [t for t in texts(1) if t]
    assert both.align(given) == [both.whole(t) for t in given]
    size = len(both.kept)
    both.held = 1 << 40  # kept alignments make way, and come back
    assert both.align(given) == [both.whole(t) for t in given] and len(both.kept) == size


def test_long_texts_in_time(spark):
    import time

    both = Aligner(read_files(spark, A, B))
    began = time.process_time()
    both.align(["日本語文章" * 60_000, "ab " * 300_000, "y" * 300_000])
    assert time.process_time() - began < 30
