"""Queries over the given tables, each with an equivalent SQL text where SQL can express it."""

from importlib import import_module

_MODULES = ("statements", "quality", "chunks", "search", "frames", "texts",
            "storage")


def _load():
    for name in _MODULES:
        import_module(f"checks.{name}")
    from checks import registry
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
