"""Registered queries of this subpackage: name -> function, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from shiftspark.llm import (
    cuckoo, decontaminate, divergence, grid_codes, language, main_text, mixing, near_dup, private_data, suffixes, toxicity, url_filter, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": language.op1_language_id,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_suffix_repeats": suffixes.op3_suffix_repeats,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_main_text": main_text.op7_main_text,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_dedup": near_dup.op9_near_dedup,
    "op10_cuckoo_dedup": cuckoo.op10_cuckoo_dedup,
    "op11_vector_codes": grid_codes.op11_vector_codes,
    "op12_private_data": private_data.op12_private_data,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op10_cuckoo_dedup": cuckoo.OP10_SQL,
    "op11_vector_codes": grid_codes.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
