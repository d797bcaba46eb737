"""Operators for preparing large text corpora, and their queries."""

from importlib import import_module


def load() -> None:
    """Fill the registry with the queries of this subpackage."""
    for name in ("queries", "pipeline_query"):
        import_module(f"{__name__}.{name}")
