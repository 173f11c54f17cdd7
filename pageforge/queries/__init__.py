"""Driver queries, one module per family."""

from importlib import import_module

FAMILIES = ("urls", "text", "product", "html", "content", "tables", "jobs", "robots", "streams")


def load():
    """Import every family and return the registry."""
    for family in FAMILIES:
        import_module(f"pageforge.queries.{family}")
    return import_module("pageforge.queries.base")
