"""Registered queries, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.registry.views import VIEWS, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}  # may use steps; ``complete`` spells them out
_STEPS: dict[str, str] = {f"v_{name}": check_sql(name) for name in VIEWS}


def quoted(text: str) -> str:
    """A fixed value as an SQL string."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def filled(template: str, **values: str) -> str:
    """SQL for a fixed wording with expressions in its ``{name}`` places; NULL counts as empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(
        f"coalesce(({values[part]})::varchar, '')" if k % 2 else quoted(part) for k, part in enumerate(parts) if part) + ")"


def step(name: str, sql: str) -> None:
    """A named intermediate result for checking SQL."""
    _STEPS[name] = sql


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in dict.fromkeys(re.findall(r"\b[vc]_\w+", sql)):
        if name in _STEPS and name not in seen:
            _needed(_STEPS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def complete(sql: str) -> str:
    """Checking SQL with every step it needs spelled out in front."""
    steps = [f"{name} AS MATERIALIZED (\n{_STEPS[name].strip()}\n)" for name in _needed(sql, [])]
    return ("WITH " + ",\n".join(steps) + "\n" if steps else "") + sql.strip()


def query(name: str, sql: str | None = None):
    """Register a callable under its key; ``sql`` may use the steps."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return register
