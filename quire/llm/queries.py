"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, embed_dedup, fingerprints, langid, licenses, lm_score, packing, periodic, secret_scan, toxicity, url_filter
from .ngram_join import ngram_jaccard_join
from .oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(column: str, folds: int) -> F.Column:
    return F.crc32(F.col(column).cast("string")) % folds


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents"), with_text=False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Index:
    """Learned from rows outside the held-out fold only."""
    labels = _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return toxicity.fit_on(_table(spark, sf_dir, "documents"), labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scores.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(_table(spark, sf_dir, "documents").where(fold("doc_id", 4) != 2))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict_language(_table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(lm_score.marked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_digest(periodic.periodic_runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), audit.quality_conditions(F.col("text")), duplicate="E")


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_url_filter, op3_fingerprints, op4_embedding_dedup, op5_best_fit_packing, op6_secret_scan, op7_toxicity, op8_bpe, op9_language_id, op10_lm_score, op11_periodic_runs, op12_license_scan, op13_filter_audit)
}
