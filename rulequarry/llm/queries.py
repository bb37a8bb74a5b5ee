"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, graph, jaccard, lattice, mixing, quality, secrets, sharding, suffixes, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_quality": quality.op3_quality,
    "op4_embeddings": graph.op4_embeddings,
    "op5_lattice": lattice.op5_lattice,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_secrets": secrets.op8_secrets,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_mixing": mixing.op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op1_sharding": sharding.sql(), "op2_jaccard": jaccard.class_sql(), "op4_embeddings": graph.CLASS_SQL, "op9_suffix_dedup": suffixes.sql(), "op10_mixing": mixing.SQL}
