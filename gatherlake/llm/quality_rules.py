"""Line-first quality rules as DataFrame expressions: lines are judged before the document is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words_array

SYMBOLS = "#*$%&|<>"
GAPS = "\x20\t\n\x0b\x0c\r"
#: Characters that a punctuation rule counts.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Marks that part the entries of a menu or a table.
SEPARATORS = "|>»•·"
#: Phrases of page furniture in four languages, matched in lower-cased lines.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "enable javascript", "powered by wordpress", "our newsletter", "click here to", "skip to content",
    "share on facebook", "datenschutzerklärung", "alle rechte vorbehalten", "zum inhalt springen", "newsletter abonnieren", "politique de confidentialité", "tous droits réservés",
    "aller au contenu", "aviso legal", "todos los derechos reservados", "política de privacidad", "saltar al contenido",
)
#: A line of at most so many words without an end mark is short; so many short lines in a row are a menu of one entry a line.
SHORT_WORDS, SHORT_LINES = 3, 4
BLOCK = 8


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, most_punctuation: float = 0.2, most_separators: float = 0.25, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """True for a line that a rule removes: too large a share of punctuation among its
    non-blank characters, a menu (separators against words), or a phrase of page furniture."""
    solid = F.length(F.translate(line, GAPS, ""))
    # the lower-cased line once for all phrases
    boiler = F.exists(F.array(F.lower(line)), lambda low: reduce(lambda found, phrase: found | low.contains(phrase), phrases, F.lit(False)))
    seps = _count(line, SEPARATORS)
    menu = (seps >= 3) & (seps >= most_separators * F.regexp_count(line, F.lit(WORD)))
    return (_count(line, PUNCTUATION) > most_punctuation * solid) | menu | boiler


def short_line(line: Column) -> Column:
    """True for a line of few words that doesn't end like a sentence."""
    return (F.length(line) <= 60) & ~line.rlike(r"[.!?:;,…\"'”»)][\x20\x09-\x0D]*$") & (F.regexp_count(line, F.lit(WORD)) <= SHORT_WORDS)


def in_menu(short: Column, i: Column) -> Column:
    """True where the line of place i is one of SHORT_LINES or more short lines in a row."""
    at = lambda k: F.coalesce(F.when(i + k >= 0, F.get(short, i + k)), F.lit(False))
    out = F.lit(False)
    for first in range(1 - SHORT_LINES, 1):
        run = F.lit(True)
        for k in range(first, first + SHORT_LINES):
            run = run & at(k)
        out = out | run
    return F.get(short, i) & out


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text and its measures.

    Hashes of all 8-word windows show whether any repeats in a text. Only then are its windows
    compared as words, sorted with their places, and the places of equal neighbours joined into
    covered words. Clashing columns of ``docs`` other than doc_id and text are not read."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", "text", words_array(F.col("text")).alias("words"))
    d = d.select("*", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"))
    at = lambda i: F.xxhash64(*[F.get("word_hashes", i + k) for k in range(BLOCK)])
    d = d.select("*", F.when(F.col("n") >= BLOCK, F.transform(F.sequence(F.lit(0), F.col("n") - BLOCK), at)).alias("rolled"))
    d = d.select("*", F.coalesce(F.size("rolled") != F.size(F.array_distinct("rolled")), F.lit(False)).alias("repeats"))
    window = lambda i: F.struct(F.array_join(F.slice("words", i, BLOCK), " ").alias("w"), i.alias("p"))
    d = d.select("*", F.when(F.col("repeats"), F.sort_array(F.transform(F.sequence(F.lit(1), F.col("n") - BLOCK + 1), window))).alias("ordered"))
    kept = F.filter("ordered", lambda x, i: F.coalesce((i > 0) & (x["w"] == F.get("ordered", i - 1)["w"]), F.lit(False)) | F.coalesce(x["w"] == F.get("ordered", i + 1)["w"], F.lit(False)))
    d = d.select("*", F.when(F.col("repeats"), F.sort_array(F.transform(kept, lambda x: x["p"]))).alias("places"))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + BLOCK - F.greatest(acc["end"], p)).alias("n"), (p + BLOCK).alias("end")), lambda acc: acc["n"],
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, GAPS, "")) > 0)
    d = d.select("doc_id", "text", "n", "places", lines.alias("lines"))
    return d.select(
        "doc_id", "text", "lines",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", GAPS, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def quality_rules(docs: DataFrame, least_words: int = 20, most_repeated: int = 30, most_lost: float = 0.4, phrases: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """doc_id, text measures, base_failed, kept, chars_removed and clean_text.

    Base rules fail a document of fewer than ``least_words`` words or with more than
    ``most_repeated`` per cent of its words in repeated 8-word windows. Of the rest, lines that
    fail a rule of :func:`line_fails`, and runs of short lines (:func:`in_menu`), are removed, and a document is rejected if more than
    ``most_lost`` of its non-blank characters went. clean_text is what is left of it, joined by \\n.
    Null and blank texts have no words and fail the base rules; one row comes out for each that
    goes in, whatever its doc_id. Other columns are not read. An empty table gives an empty result.
    """
    d = measures(docs)
    d = d.select("*", F.when(F.size("lines") >= SHORT_LINES, F.transform("lines", short_line)).alias("short"))
    menus = F.coalesce(F.exists("short", lambda x: x), F.lit(False))
    good = F.filter("lines", lambda x: ~line_fails(x, phrases=phrases))
    d = d.select("*", F.when(menus, F.filter("lines", lambda x, i: ~(in_menu(F.col("short"), i) | line_fails(x, phrases=phrases)))).otherwise(good).alias("good"))
    d = d.select("*", F.array_join("good", "\n").alias("clean_text"))
    d = d.select("*", (F.col("word_chars") - F.length(F.translate("clean_text", GAPS, ""))).cast("long").alias("chars_removed"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("chars_removed") <= most_lost * F.col("word_chars"))).alias("kept"), "chars_removed", "clean_text",
    )
