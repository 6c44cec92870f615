"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdex.llm import chat_format, decontaminate, divergence, exact_dedup, importance, kneser_ney, ngram_join, packing, pii, sentencepiece_codec, sharding, stages, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kneser_ney": kneser_ney.op1_kneser_ney,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_pii": pii.op4_pii,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_packing": packing.op11_packing,
        "op12_divergence": divergence.op12_divergence,
        "op13_importance": importance.op13_importance,
        "pipeline": stages.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat_format.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op8_sharding": sharding.ORACLE, "op9_ngram_join": ngram_join.ORACLE, "op12_divergence": divergence.ORACLE, "op13_importance": importance.ORACLE}
