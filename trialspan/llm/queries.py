"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = ["exact_dedup", "pieces", "secrets", "near_dedup", "fingerprints", "html_text", "mixing", "quality", "licenses", "line_dedup",
           "token_counts", "merkle", "prefix_trie"]


def load() -> tuple[dict, dict]:
    """(name -> query, name -> SQL) of all operators here."""
    queries, oracles = {"pipeline": corpus_pipeline.run}, {}
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    for m in MODULES:
        module = import_module(f"{__package__}.{m}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
