"""The corpus pipeline: stages that call operators of lodegraph.llm, each on what the one before it kept.

Language ID, near duplicates, secrets, mixing, packing. Each stage is written as Parquet in the shared folder and read
again as the next one's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import jaccard, langid, mix, packing, secrets
from lodegraph.llm.common import documents, drop_stored, stored, stored_so_far

#: Texts whose n-grams are ranked like those of no known language score below this; prose scores over 0.4.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; ``lang`` becomes what was found where it was null.

    Documents whose text is null, empty or without a letter are in none, and go. Each row is judged by its own text, whether
    its id is null or repeated. An empty table, or one without a labelled document to learn from, keeps nothing.
    """
    found = langid.identify(docs, langid.learned(docs))
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once where rows repeat an id.

    Documents without words are no duplicates and stay, and so do rows with a null id.
    """
    return jaccard.dedup_near(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars is counted anew. Documents without one, null and empty texts among them, stay as
    they are, and no row goes."""
    clean = secrets.redact(secrets.find_secrets(docs))
    clean = clean.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes near its target; a document may be taken twice, or not at all. A null source is a source, the last one.

    Documents without words add nothing to a source's size and are taken at its rate; rows with null or repeated ids are
    taken each on its own.
    """
    return mix.take(mix.mix_sources(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; a document that is taken twice, or rows that repeat an id, are packed as
    often. A null or empty text is the closing id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mixture", mixture),
    ("packing", packed),
]
#: Languages, groups and packing are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Tables that a stage and its operator stored go when the next one's result is there."""
    docs, mark = documents(spark, sf_dir), stored_so_far(spark)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        drop_stored(spark, mark, keep=1)
    return docs
