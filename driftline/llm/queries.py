"""The queries of this folder's operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import collocations, decontaminate, embedding_dedup, html_text, lm_ctw, merkle, mixing, near_dedup, quality_crf, suffix_dedup, token_counts, token_files, toxicity_fm
from driftline.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ctw.score_texts(table(spark, sf_dir, "documents"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_digests(spark, files)


def op7_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_item", "n_shared")


def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_odd_sketch,
        op2_site_template_removal,
        op3_token_counts,
        op4_context_tree_weighting,
        op5_quality_crf,
        op6_token_files,
        op7_sorted_projections,
        op8_weighted_fair_mix,
        op9_bm25_decontamination,
        op10_toxicity_fm,
        op11_collocations,
        op12_merkle_manifest,
        op13_suffix_repeats,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_odd_sketch": near_dedup.ORACLE_SQL,
    "op7_sorted_projections": embedding_dedup.ORACLE_SQL,
    "op8_weighted_fair_mix": mixing.ORACLE_SQL,
    "op9_bm25_decontamination": decontaminate.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
