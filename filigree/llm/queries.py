"""The registered query of each text operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, decontaminate, exact_dedup, line_dedup, oracles, pii, quality, sharding, simhash, spelling, substring_dedup, token_counts, toxicity


SHARE_5 = quality.RiskControl(share=0.05)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_rules_share_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 with up to 5 % of good documents at risk, for which labels in the hundreds certify cutoffs."""
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), control=SHARE_5)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.Tree.even(24))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("scored")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), word_tokenizer(), digests=True)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings")).drop("n_measured")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_decontamination, op4_simhash, op5_quality_rules, op6_sharding, op7_line_dedup, op8_pii, op9_bpe, op10_substring_dedup, op11_spelling_variants, op12_exact_dedup, op13_centroid_clustering, quality_rules_share_5)}
#: Hashes, tokenizers and fitted models have no counterpart in SQL; the tests hold those queries against brute force.
ORACLES: dict[str, str] = {"op3_decontamination": oracles.DECONTAMINATION, "op5_quality_rules": oracles.quality_rules(), "quality_rules_share_5": oracles.quality_rules(SHARE_5), "op7_line_dedup": oracles.LINE_DEDUP, "op11_spelling_variants": oracles.SPELLING, "op12_exact_dedup": oracles.EXACT_DEDUP, "op13_centroid_clustering": oracles.clustering()}
