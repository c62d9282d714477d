"""The corpus pipeline: documents that are clean, of a known language, unlike each other and free of secrets, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import langid, ngram_join, packing, secret_scan, toxicity
from quire.llm.common import materialize
from quire.llm.queries import language_model, toxicity_model, vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more by the labelled examples go.

    Null and empty texts score like texts without a word of an example, and stay where clean labels outnumber toxic ones.
    """
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir))


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty texts among them, or of no language that was learned, go."""
    return langid.keep_known(docs, language_model(spark, sf_dir))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity, the one with the smallest doc_id stays.

    Documents without words or without doc_id link with nothing and stay; of rows that repeat an id and a text, one stays.
    """
    return ngram_join.one_of_each(docs, ngram_join.ngram_jaccard_join(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars of those counted anew; every document stays, null texts stay null."""
    return secret_scan.redacted_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with the sequence and offset of each; a null or empty text is one piece, the end id."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("language ID", of_known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Models and packing have no SQL form: tests hold run() against its operators one row at a time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that all stages keep.

    Every stage reads whole texts, however long, and all rows that the one before kept: rows repeat and ids may be null, as
    their stages say. All but the last keep the table's columns, whatever their names, and tie by doc_id. An empty
    table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
