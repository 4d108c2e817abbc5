"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherlake.llm.common import cut
from gatherlake.llm.minhash_dedup import without_near_duplicates
from gatherlake.llm.mixing import mixed_documents
from gatherlake.llm.quality_model import good_documents, train
from gatherlake.llm.queries import model_path, table
from gatherlake.llm.secret_scan import redact_secrets
from gatherlake.llm.unigram import encode, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return good_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id; of rows of that doc_id
    one, by a fixed choice. Documents without words link with nothing and all stay."""
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars, where it is given, is that of the new text."""
    done = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return done
    kind = docs.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0))).cast(kind))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    v = load(spark, model_path())
    return encode(docs, v).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]
#: Trained scores and pieces aren't SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return cut(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
