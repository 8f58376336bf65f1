"""Training-data operators: each module holds one operator and its query.

Modules are imported when asked for, so a Python worker only loads what its function uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from edgeloom.llm import collocations, language_id, line_dedup, packing, parity_join, pieces, quality_rules, resampling, secret_scan, sharding, substring_dedup, surrogates, vector_dedup

    return {
        "op1_extendible_sharding": sharding.op1_extendible_sharding,
        "op2_packing": packing.op2_packing,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_surrogates": surrogates.op4_surrogates,
        "op5_language_id": language_id.op5_language_id,
        "op6_parity_join": parity_join.op6_parity_join,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_vector_dedup": vector_dedup.op8_vector_dedup,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    """Queries that DuckDB can state; the others are tested against brute force."""
    from edgeloom.llm import collocations, line_dedup, parity_join, quality_rules, sharding, substring_dedup, vector_dedup

    return {
        "op1_extendible_sharding": sharding.OP1_SQL,
        "op6_parity_join": parity_join.OP6_SQL,
        "op8_vector_dedup": vector_dedup.OP8_SQL,
        "op9_quality_rules": quality_rules.OP9_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
        "op12_substring_dedup": substring_dedup.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
