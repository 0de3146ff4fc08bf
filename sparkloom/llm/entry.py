"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import contexts, counts, divergence, exact, licenses, near, packing, pieces, repair, repeats, resample, toxicity, vectors
from sparkloom.llm.common import read_table


def vocabulary(name: str) -> str:
    """Place of a vocabulary file of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(fn: Callable[..., DataFrame], *args: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(read_table(spark, sf_dir, "documents"), *map(vocabulary, args))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": _documents(pieces.encode_documents, "piece_bpe_32k.model"),
    "op2_best_fit_packing": _documents(packing.pack_documents, "byte_bpe_50k.json"),
    "op3_repair_token_files": _documents(repair.token_files, "byte_bpe_50k.json"),
    "op4_exact_dedup": _documents(exact.exact_dedup),
    "op5_context_tree_weighting": _documents(contexts.log_scores),
    "op6_suffix_dedup": _documents(repeats.removal),
    "op7_ivf_pq_search": lambda spark, sf_dir: vectors.search(read_table(spark, sf_dir, "embeddings")),
    "op8_token_counts": _documents(counts.token_counts, "word_bpe_49k.json"),
    "op9_toxicity": lambda spark, sf_dir: toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
    "op10_near_dedup": _documents(near.near_duplicates),
    "op11_source_divergence": _documents(divergence.divergence),
    "op12_importance_resampling": lambda spark, sf_dir: resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
    "op13_license_scan": _documents(licenses.license_scan),
}

ORACLES: dict[str, str] = {"op4_exact_dedup": exact.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_importance_resampling": resample.ORACLE}
