"""Registered queries: the engine's operators applied to the given tables."""

from importlib import import_module

MODULES = (
    "text_queries",
    "similarity_queries",
    "relational_queries",
    "file_queries",
    "evaluation_queries",
    "model_queries",
)


def load() -> None:
    """Fill the registry."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
