"""Queries registered for checking, with their SQL twins."""

from importlib import import_module

MODULES = ["insights", "ingest", "store", "report", "score"]


def all_checks():
    """The registry with every check module loaded."""
    for m in MODULES:
        import_module(f"taxatrend.checks.{m}")
    return import_module("taxatrend.checks.registry")
