"""The queries of this folder and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module; the module has a function of that name and perhaps ORACLE.
MODULES = {
    "op1_quality_classifier": "nbsvm",
    "op2_hilbert_neighbours": "hilbert_knn",
    "op3_license_scan": "licenses",
    "op4_ngram_lm": "ngram_lm",
    "op5_sharding": "sharding",
    "op6_jaccard_join": "parity_join",
    "op7_sentencepiece": "pieces",
    "op8_temperature_mixing": "mixing",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_quality_rules": "quality_rules",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
