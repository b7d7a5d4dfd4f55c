"""Bindings of the library to the given test tables."""


def load():
    """(queries, checking SQL) after importing every binding module."""
    from lexspark.registry import evaluation, relational, retrieval, steps, storage  # noqa: F401
    from lexspark.registry.base import CHECKS, QUERIES, complete

    return QUERIES, {name: complete(sql) for name, sql in CHECKS.items()}
