"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversation_repair,
    conversation_trie,
    decontamination,
    language_model,
    line_quality,
    minhash_dedup,
    mixing,
    pii,
    quality_rules,
    simhash_dedup,
    token_counts,
    toxicity,
    warc,
)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the entry module; it imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_semi_markov": pii.op1,
    "op2_source_mixing": mixing.op2,
    "op3_toxicity_string_kernel": toxicity.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_benchmark_decontamination": decontamination.op5,
    "op6_simhash_near_dedup": simhash_dedup.op6,
    "op7_token_counts": token_counts.op7,
    "op8_warc": warc.op8,
    "op9_line_quality": line_quality.op9,
    "op10_language_model": language_model.op10,
    "op11_minhash_near_dedup": minhash_dedup.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_conversation_prefix_trie": conversation_trie.op13,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {"op8_warc": warc.OP8_SQL}
