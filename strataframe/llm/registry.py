"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: (module, query); a module's ORACLE, if any, is the query's SQL.
MODULES = {
    "op1_mixing": "mixing",
    "op2_token_counts": "token_counts",
    "op3_chat_formatting": "chat",
    "op4_license_scan": "licenses",
    "op5_toxicity": "toxicity",
    "op6_pii": "pii",
    "op7_sentencepiece": "sentencepieces",
    "op8_jpeg": "jpeg",
    "op9_quality_rules": "quality",
    "op10_near_duplicates": "neardup",
    "op11_resampling": "resampling",
    "op12_fingerprints": "fingerprints",
    "op13_prefix_trie": "trie",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
