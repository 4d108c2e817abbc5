"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    done = substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN rep USING (s), range(0, 35) AS t(k)),
each_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
cut AS (
  SELECT e.doc_id, count(c.p) AS n_removed, string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE c.p IS NULL) AS kept
  FROM each_word e LEFT JOIN cov c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(digest(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
"""


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import read_packages, write_packages

    return read_packages(write_packages(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 160, 5), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           ((CAST('0x' || hex[i // 4 + 1:i // 4 + 2] AS BIGINT) >> (3 - i % 4)) & 31) + 1]), '') AS payload_digest
  FROM p),
m AS (SELECT payload_digest, max(page_id) AS response FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM d JOIN m USING (payload_digest)
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import find_licenses, license_digest

    return license_digest(find_licenses(table(spark, sf_dir, "documents")))


def model_path() -> str:
    """The public SentencePiece model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import encode, load

    docs = table(spark, sf_dir, "documents")
    v = load(spark, model_path())
    done = encode(docs, v, back=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import quality_scores, train

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0 AS u
  FROM documents),
s AS (
  SELECT *, place % 3 + 1 AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM base GROUP BY source)),
l AS (
  SELECT *, ((SELECT CAST(sum(size) AS DOUBLE) FROM base)
             - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place) AS turn
  FROM s),
o AS (SELECT min(turn) AS turn, arg_min(level, turn) AS level FROM l WHERE level * weight <= 3 * source_size),
t AS (
  SELECT source, source_size, CASE WHEN l.turn < o.turn THEN CAST(3 * source_size AS DOUBLE) ELSE o.level * weight END AS target FROM l, o),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
m AS (SELECT *, target - whole * source_size AS more, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size END AS p FROM p),
z AS (
  SELECT base.source, size, count(*) AS n, any_value(more) AS more, size / (size + 200e0) AS w FROM base JOIN m ON base.source IS NOT DISTINCT FROM m.source WHERE size > 0 GROUP BY base.source, size),
v AS (
  SELECT source, size, w, (more - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w * size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM z),
c AS (SELECT source, arg_max(level, size) AS level FROM v WHERE level * w < 1 GROUP BY source),
r AS (
  SELECT base.doc_id, size, source_size, target, whole, more, base.source, u, least(1e0, c.level * (size / (size + 200e0))) AS inclusion
  FROM base JOIN m ON base.source IS NOT DISTINCT FROM m.source LEFT JOIN c ON base.source IS NOT DISTINCT FROM c.source),
k AS (SELECT *, CASE WHEN inclusion >= 1 THEN 0e0 WHEN inclusion > 0 THEN u / (1 - u) / (inclusion / (1 - inclusion)) END AS rank FROM r),
o2 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rank IS NOT NULL AND before + size / 2e0 <= more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o2
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN rep USING (doc_id, s), range(0, 8) AS t(k) GROUP BY doc_id),
line0 AS (
  SELECT doc_id, x, i, regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') AS solid, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(1, len(lines) + 1)) AS i FROM w)),
line1 AS (
  SELECT *, length(x) - length(regexp_replace(x, '[!-/:-@\[-`{-~]', '', 'g')) AS punct, length(x) - length(translate(x, '|>»•·', '')) AS seps,
         CAST(length(x) <= 60 AND n <= 3 AND NOT regexp_matches(x, '[.!?:;,…"''”»)][\x20\x09-\x0D]*$') AS INTEGER) AS short
  FROM line0),
line2 AS (SELECT *, sum(short) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS four FROM line1),
line AS (SELECT *, max(four) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 AS in_menu FROM line2),
bad AS (
  SELECT doc_id, sum(length(solid)) AS removed FROM line
  WHERE punct > 0.2e0 * length(solid) OR (seps >= 3 AND seps >= 0.25e0 * n) OR in_menu
     OR regexp_matches(lower(x), 'cookie policy|privacy policy|terms of use|terms of service|all rights reserved|lorem ipsum|enable javascript|powered by wordpress|our newsletter|click here to|skip to content|share on facebook|datenschutzerklärung|alle rechte vorbehalten|zum inhalt springen|newsletter abonnieren|politique de confidentialité|tous droits réservés|aller au contenu|aviso legal|todos los derechos reservados|política de privacidad|saltar al contenido')
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS chars_removed
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN bad USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND chars_removed <= 0.4e0 * word_chars AS kept FROM f
"""


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenizer_alignment import align_tokenizers, read_files

    return align_tokenizers(table(spark, sf_dir, "documents"), read_files(spark, public_tokenizers.path("byte_bpe_50k.json"), model_path()))


def op12_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxic_spans import toxic_spans, train

    docs = table(spark, sf_dir, "documents")
    return toxic_spans(docs, train(docs, table(spark, sf_dir, "labels")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws FROM t GROUP BY conv_id),
bits AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM own),
h AS (
  SELECT conv_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
  FROM bits),
built AS (
  SELECT o.conv_id, list_concat(coalesce(f.ks, [])[1:h], o.ks[h + 1:]) AS ks, list_concat(coalesce(f.ws, [])[1:h], o.ws[h + 1:]) AS ws
  FROM own o JOIN h USING (conv_id) LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
member AS (SELECT conv_id, ks, ws, len(ks) AS size, unnest(range(0, len(ks) + 1)) AS d FROM built),
node AS (
  SELECT ks[1:d] AS p, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE ws[d] END) AS w,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends
  FROM member GROUP BY ks[1:d]),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY p[1:d - 1]),
up AS (SELECT p, n, w, d, unnest(range(0, d + 1)) AS e, p NOT IN (SELECT p FROM kids) AS leaf FROM node),
below AS (SELECT p[1:e] AS p, sum(CAST(leaf AS BIGINT)) AS leaves, sum((n - 1) * w) AS saved FROM up GROUP BY p[1:e])
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below USING (p) LEFT JOIN kids USING (p) LEFT JOIN node parent ON node.d > 0 AND parent.p = node.p[1:node.d - 1]
"""


QUERIES = {"op1_substring_dedup": (op1_substring_dedup, OP1_SQL), "op2_secret_scan": (op2_secret_scan, None), "op3_minhash_near_dedup": (op3_minhash_near_dedup, OP3_SQL), "op4_warc_zip": (op4_warc_zip, OP4_SQL), "op5_license_scan": (op5_license_scan, None), "op6_sentencepiece": (op6_sentencepiece, None), "op7_quality_model": (op7_quality_model, None), "op8_mixing": (op8_mixing, OP8_SQL), "op9_quality_rules": (op9_quality_rules, OP9_SQL), "op10_embedding_near_dedup": (op10_embedding_near_dedup, OP10_SQL), "op11_tokenizer_alignment": (op11_tokenizer_alignment, None), "op12_toxic_spans": (op12_toxic_spans, None), "op13_prefix_trie": (op13_prefix_trie, OP13_SQL)}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
