"""Registered queries and their oracles."""

from importlib import import_module

MODULES = ["cleaning", "timelines", "tables", "matrices", "studies"]


def load():
    from . import base

    for m in MODULES:
        import_module(f"checks.{m}")
    return base.QUERIES, base.ORACLES
