"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Query name to the module that holds the function of that name.
MODULES = {
    "op1_suffix_array_dedup": "substring_exact",
    "op2_benchmark_decontamination": "decontaminate",
    "op3_prefix_target_chat": "chat_format",
    "op4_quality_rules": "quality",
    "op5_language_spans": "language",
    "op6_parity_sketch_join": "jaccard_join",
    "op7_chunk_dedup": "chunk_dedup",
    "op8_line_window_dedup": "line_dedup",
    "op9_secret_randomness": "secret_scan",
    "op10_bpe_prefix_dp": "bpe",
    "op11_periodic_runs": "periodic_runs",
    "op12_main_text": "main_text",
    "op13_centroid_clustering": "centroids",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", {}).get(name)
        if sql:
            out[name] = sql
    return out
