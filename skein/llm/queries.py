"""Registered queries of the training-data operators: thin callers that derive the contract's digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import automata, blocks, iblt, jaccard, packing, resample, secrets, suffixes, templates, tokencount, toxicity, vptree, whitening
from skein.llm.common import table


def op1_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_recurrent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_finite_state_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count_tokens(table(spark, sf_dir, "documents"))
    return out.select("*", (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.scores(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = automata.remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iblt.compare_versions(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=4).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_bracketed_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=10, least_words=20, buckets=10_000, longest=1, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_blob_ledger_secrets, op2_heavy_light_jaccard, op3_recurrent_blocks, op4_template_decontamination, op5_finite_state_tokens, op6_positive_unlabelled, op7_suffix_automata, op8_mixture_packing, op9_suffix_array, op10_lookup_sketch, op11_vantage_point_trees, op12_exact_whitening, op13_bracketed_resampling)}

ORACLES: dict[str, str] = {"op1_blob_ledger_secrets": secrets.ORACLE, "op11_vantage_point_trees": vptree.ORACLE, "op13_bracketed_resampling": resample.ORACLE}
