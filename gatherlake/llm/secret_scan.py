"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Patterns come first. Other long tokens are scored by the mean log-likelihood ratio per character
step of two first-order Markov models, one of random strings and one of ordinary identifiers, both
trained from labelled samples: strings drawn by a hash in the alphabets that keys are written in,
and words of a bounded sample of the corpus joined as identifiers, paths and compounds are.
Positions come from the texts between matches: ``split`` gives those, ``regexp_extract_all`` the
matches, and running lengths in code points place both. All of it is DataFrame expressions, and
the work on a text is in proportion to its length, however many matches it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of at least so many hexadecimal digits, as a pattern: shorter runs needn't be listed to be dropped.
HEX_RUN, ACCESS_RUN = "(?<![0-9a-f])[0-9a-f]{24,}", "AKIA[A-Z0-9]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters that the models know; tokens consist of them.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST_TOKEN = 16
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
_N = len(ALPHABET)
#: Steps that a character's own frequency counts for among the steps seen after another.
BACKOFF = 5.0
#: Elements folded at a time by :func:`running`, and code points of a piece of text.
CHUNK, PIECE = 128, 1024
#: Least mean log-likelihood ratio of a secret; chosen on labelled samples, see the README.
THRESHOLD = 1.0
#: Names of the forms of random samples.
FORMS = ("hex", "base64", "base64url", "base62", "lower", "upper", "lower_digits")
_SPANS = "array<struct<start: int, end: int, found: string, value: string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, largest: bool = False) -> Column:
    """For each element the sum (or the largest, 0 at least) of those before it, and of all as a last
    element. Chunks are folded by themselves and then moved by the fold of the chunks before, since
    an array that grows element by element is copied each time."""
    op = F.greatest if largest else (lambda x, y: x + y)
    start = F.array(F.lit(0))
    fold = lambda chunk: F.aggregate(chunk, start, lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))

    def moved(folds: Column) -> Column:
        before = F.aggregate(folds, start, lambda acc, f: F.array_append(acc, op(F.element_at(acc, -1), F.element_at(f, -1))))
        parts = let(before, lambda at: F.transform(folds, lambda f, i: F.transform(F.slice(f, 1, F.size(f) - 1), lambda x: op(x, F.get(at, i)))))
        return F.array_append(F.flatten(parts), F.element_at(before, -1))

    firsts = lambda v: F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return let(values, lambda v: let(F.transform(firsts(v), lambda i: fold(F.slice(v, i, F.lit(CHUNK)))), moved))


def matches(text: Column, pattern: str, group: int = 0, guard: str | None = None) -> Column:
    """Leftmost non-overlapping matches: start and end in code points, the match and one group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), values.alias("value"))

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0))))

        def span(x, at):
            start = at + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["found"])).alias("end"), x["found"].alias("found"), x["value"].alias("value"))

        # the text after the last match has no match
        return let(before, lambda at: F.filter(F.transform(p, lambda x, i: span(x, F.get(at, i))), lambda x: x["found"].isNotNull()))

    return F.when(text.rlike(guard or pattern), let(parts, placed)).otherwise(F.array().cast(_SPANS))


def _kept(spans: Column, kind: int) -> Column:
    """The spans with the place of their kind in KINDS."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _base() -> Column:
    assign = F.filter(matches(F.col("text"), ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    return F.array_sort(F.concat(_kept(assign, 0), _kept(matches(F.col("text"), ACCESS_RUN), 1), _kept(matches(F.col("text"), HEX_RUN), 2)))


def _tokens() -> Column:
    return F.filter(matches(F.col("text"), TOKEN), lambda s: s["value"].rlike("[A-Za-z]"))


def _clear(base: Column, tokens: Column) -> Column:
    """Tokens (as spans of kind 3) that overlap no base span, in one sweep over both by their starts:
    a token is hit by a base span that began before and goes on, or by the next that begins."""

    def swept(events: Column) -> Column:
        ends = running(F.transform(events, lambda e: F.when(e["kind"] < 3, e["end"]).otherwise(0)), largest=True)

        def keep(e, i, at):
            later = F.get(events, i + 1)["start"]
            return F.when((e["kind"] == 3) & (F.get(at, i) <= e["start"]) & (later.isNull() | (later >= e["end"])), e)

        return let(ends, lambda at: F.array_compact(F.transform(events, lambda e, i: keep(e, i, at))))

    own = _kept(tokens, 3)
    return F.when(F.size(tokens) == 0, own).when(F.size(base) == 0, own).otherwise(let(F.array_sort(F.concat(base, own)), swept))


def base_and_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and other long tokens (spans of kind 3) of every document."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", _base().alias("base"), _tokens().alias("tokens"))
    return d.select("doc_id", "base", _clear(F.col("base"), F.col("tokens")).alias("tokens"))


def _pairs(tokens: DataFrame) -> DataFrame:
    """label, pair (a place in the table of both characters) and how often it occurs."""
    t = tokens.select("label", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    t = t.select("label", F.instr(F.lit(ALPHABET), F.expr("substring(token, i, 1)")).alias("x"), F.instr(F.lit(ALPHABET), F.expr("substring(token, i + 1, 1)")).alias("y"))
    return t.where("x > 0 and y > 0").groupBy("label", ((F.col("x") - 1) * _N + F.col("y") - 1).alias("pair")).count()


def train(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character steps from labelled samples (token, label).

    label 1 marks random strings, 0 ordinary identifiers. Only counts of character pairs reach
    the driver, at most twice the square of the alphabet. ``smooth`` is added to the count of each
    character, and a character's steps fall back on the frequencies of single characters with a
    weight of BACKOFF steps. Without samples every ratio is 0.
    """
    counts = {0: [0.0] * (_N * _N), 1: [0.0] * (_N * _N)}
    rows = _pairs(labelled.where(F.length("token") > 1)).collect()
    for r in rows:
        counts[1 if r["label"] == 1 else 0][r["pair"]] += r["count"]
    # how often a character comes at all: what a step falls back on where its first character is rare
    single = {k: [sum(c[y::_N]) + smooth for y in range(_N)] for k, c in counts.items()}
    single = {k: [c / sum(v) for c in v] for k, v in single.items()}
    out = []
    for x in range(_N):
        row = {}
        for k in (0, 1):
            own = counts[k][x * _N : (x + 1) * _N]
            row[k] = [math.log((c + BACKOFF * p) / (sum(own) + BACKOFF)) for c, p in zip(own, single[k], strict=True)]
        # signs part the words of an identifier and say nothing by themselves
        out += [row[1][y] - row[0][y] if x < 62 and y < 62 else 0.0 for y in range(_N)]
    return out


def score(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character steps; above 0 a random string is likelier."""
    table = F.from_json(F.lit("[" + ",".join(f"{v:.6f}" for v in model) + "]"), "array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.arrays_zip(F.slice(places, 1, F.size(places) - 1).alias("x"), F.slice(places, 2, F.size(places) - 1).alias("y"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + F.coalesce(F.get(table, s["x"] * _N + s["y"]), F.lit(0.0))) / F.greatest(F.length(token) - 1, F.lit(1))


def random_samples(spark: SparkSession, n: int = 6000, salt: str = "train") -> DataFrame:
    """token, form: ``n`` strings drawn by a hash: hexadecimal, base64, base64 for links, base62, and
    letters of one case with and without digits, of 20 to 43 characters."""
    d = spark.range(n).select("id", F.sha2(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")), 256).alias("h"), (F.col("id") % 7).alias("form"))
    b64 = F.substring(F.base64(F.unhex("h")), 1, 43)
    # a base64 sign past the wanted alphabet is folded on it
    low = F.translate(F.lower(b64), "+/0123456789", "qzabcdefghij")
    forms = [F.col("h"), b64, F.translate(b64, "+/", "-_"), F.translate(b64, "+/", "k7"), low, F.upper(low), F.translate(F.lower(b64), "+/", "x3")]
    token = F.element_at(F.array(*forms), (F.col("form") + 1).cast("int"))
    size = (20 + F.pmod(F.xxhash64("h"), F.lit(24))).cast("int")
    return d.select(token.substr(F.lit(1), size).alias("token"), F.element_at(F.array(*[F.lit(x) for x in FORMS]), (F.col("form") + 1).cast("int")).alias("form"))


def ordinary_samples(docs: DataFrame, sample_docs: int = 500) -> DataFrame:
    """token: words of ``sample_docs`` documents, those whose doc_id has the smallest hashes, three by
    three, joined as identifiers, file names, paths and compounds are. The documents are chosen
    before any text is read; rows of a chosen doc_id all count."""
    some = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    d = texts.select(words.alias("w")).where("size(w) >= 3").select(F.explode(F.expr("transform(sequence(1, size(w) - 2, 3), i -> slice(w, i, 3))")).alias("w"))
    h = F.pmod(F.xxhash64("w"), F.lit(1 << 40))
    lower, camel = F.transform("w", lambda x: F.lower(x)), F.transform("w", lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x)))))
    number = (h % 1000).cast("string")
    forms = [
        F.array_join("w", ""), F.array_join(lower, "_"), F.array_join(lower, "-"), F.array_join(lower, "/"), F.array_join(camel, ""), F.array_join(lower, ""),
        F.upper(F.array_join("w", "_")), F.concat(F.array_join(lower, "_"), number), F.concat(F.array_join(camel, ""), number), F.concat(F.lit("20"), F.lpad(number, 2, "1"), F.lit("-"), F.array_join(lower, "-")),
    ]
    return d.select(F.element_at(F.array(*forms), (h % len(forms) + 1).cast("int")).alias("token"))


def labelled_samples(docs: DataFrame, sample_docs: int = 500) -> DataFrame:
    """token and label: :func:`random_samples` are 1, :func:`ordinary_samples` 0."""
    return random_samples(docs.sparkSession).select("token", F.lit(1).alias("label")).union(ordinary_samples(docs, sample_docs).select("token", F.lit(0).alias("label")))


def _spans(model: list[float], threshold: float) -> Column:
    """All spans of the columns base and tokens."""
    extra = F.filter(_clear(F.col("base"), F.col("tokens")), lambda t: score(t["value"], model) >= threshold)
    return F.array_sort(F.concat("base", extra))


def find_secrets(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD, sample_docs: int = 500) -> DataFrame:
    """doc_id and spans (array of start, kind, end, value; kind is a place in KINDS) of every document.

    Base kinds: ``assign`` is a key word, a sign and a value of 6 or more characters, ``access`` is
    AKIA and 16 or more capitals or digits, ``hex`` a run of 24 or more lower-case hexadecimal
    digits; each is leftmost and non-overlapping within its kind. The method adds tokens of
    16 or more characters with a letter whose :func:`score` is at least ``threshold`` and that
    overlap no base span. ``model`` is trained on :func:`labelled_samples` if not given
    (``sample_docs`` bounds the documents that identifiers are taken from). Spans are in code
    points, end exclusive, ordered by start, then kind. Null and empty texts have none; one row
    comes out for each that goes in, whatever its doc_id; other columns are not read. An empty
    table gives an empty result.
    """
    if model is None:
        model = train(labelled_samples(docs, sample_docs))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", _base().alias("base"), _tokens().alias("tokens")).select("doc_id", _spans(model, threshold).alias("spans"))


def redact_secrets(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD, sample_docs: int = 500) -> DataFrame:
    """``docs`` with every secret span of its texts replaced by a mark; all columns and rows stay.

    Texts are scanned and replaced in one pass and never shuffled. Null texts stay null.
    """
    if model is None:
        model = train(labelled_samples(docs, sample_docs))
    d = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("row", "text", _base().alias("base"), _tokens().alias("tokens")).select("row", "text", _spans(model, threshold).alias("spans"))
    clean = F.when(F.col("row.text").isNotNull(), redact(F.col("text"), F.col("spans")))
    return d.select(*[clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap count as one.

    The text is cut into pieces first, so that taking a part out of it doesn't walk the whole text."""

    def part(pieces, a, b):
        """Code points a to b of the text."""
        one, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        of = lambda i, x, y: F.coalesce(F.get(pieces, i), F.lit("")).substr(x + 1, y - x)
        between = F.when(last > one + 1, F.array_join(F.slice(pieces, one + 2, last - one - 1), "")).otherwise("")
        across = F.concat(of(one, a - one * PIECE, F.lit(PIECE)), between, of(last, F.lit(0), b - last * PIECE))
        return F.when(one == last, of(one, a - one * PIECE, b - one * PIECE)).otherwise(across)

    def done(pieces):
        ends = running(F.transform(spans, lambda s: s["end"]), largest=True)

        def each(at):
            cut = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(part(pieces, F.get(at, i), s["start"]), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(cut, ""), part(pieces, F.element_at(at, -1), F.length(text)))

        return let(ends, each)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(pieces, done)).otherwise(text)
