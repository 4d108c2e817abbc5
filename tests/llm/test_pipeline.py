"""The corpus pipeline against plain versions of its stages."""

from pyspark.sql import functions as F

import corpus_pipeline
from gatherlake.llm.common import cut
from gatherlake.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = cut(corpus_pipeline.quality(spark, docs, SF), "q")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = [d for d, v in labels.items() if v == 1]
    assert kept.columns == docs.columns and sum(d in ids for d in good) >= 0.97 * len(good)
    one = cut(corpus_pipeline.near_dedup(spark, kept, SF), "n")
    rows = {r.doc_id: r.text for r in kept.collect()}
    sets = {d: {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if (w := t.lower().split()) else set() for d, t in rows.items()}
    left = {r.doc_id for r in one.collect()}
    for d in rows:  # whoever went has a near copy, and those left have none among each other
        near = [e for e in rows if e != d and sets[d] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])]
        assert (d in left) or near
        assert d not in left or not any(e in left for e in near)
    clean = cut(corpus_pipeline.secrets(spark, one, SF), "s")
    assert clean.columns == docs.columns and clean.count() == one.count() and not clean.where("text like '%AKIA%'").count()
    mixed = cut(corpus_pipeline.mixing(spark, clean, SF), "m")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    done = corpus_pipeline.tokens(spark, mixed, SF)
    assert done.count() == mixed.count()


def test_edges(spark):
    long = " ".join(f"A long text of words, number {i}, that goes on about jazz nights and open markets." for i in range(12_000))
    fair = "The market opens at noon, and a band plays in the yard until the evening comes. Everyone is welcome to stay."
    rows = [(1, fair, "a"), (2, fair, "a"), (3, fair + " Bring your friends along.", "b"), (4, None, "a"), (5, "", None), (None, fair.replace("band", "choir of old sailors who sing loudly"), None)]
    rows += [(6, long, "b"), (7, "Another fair text about the weather of the coast, with password=abc12345 in it. It ends here.", "c")]
    rows += [(8, "Rows of one number tell of two things. This one speaks of trains and of stations.", "c"), (8, "Here is the other of them, about gardens, trees and the long rain of April.", "c")] * 2
    docs = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "k1", "size", "rank", "copies", "base", "spans", "kept", "score"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:  # the classifier of these labels may reject any of these texts
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    scored = corpus_pipeline.quality(spark, docs, SF)
    assert scored.columns == docs.columns and scored.count() <= docs.count()
    one = cut(corpus_pipeline.near_dedup(spark, docs, SF), "n")
    kept = sorted(((r.doc_id or 0, r.text) for r in one.collect()), key=str)
    assert one.columns == docs.columns and len(kept) == 8 and sum(d == 8 for d, _ in kept) == 2 and [d for d, t in kept if t and t.startswith("The market opens at noon, and a band")] == [1]
    clean = cut(corpus_pipeline.secrets(spark, one, SF), "s")
    assert clean.columns == docs.columns and clean.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert clean.where("doc_id = 7").first().text.count("[SECRET]") == 1 and clean.where("doc_id = 4").first().text is None
    mixed = cut(corpus_pipeline.mixing(spark, clean, SF), "m")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id", "text").count().where("count > 3").count() == 0 and mixed.where("text is null or text = ''").count() <= 6
    done = corpus_pipeline.tokens(spark, mixed, SF)
    assert done.count() == mixed.count() and done.where("n_tokens <> size(ids)").count() == 0
