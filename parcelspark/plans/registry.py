"""Registered queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    ids: tuple[str, ...]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def with_views(body: str) -> str:
    """Prepend the domain views the text mentions (and those they mention) as CTEs."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


def query(ids: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name; ``ids`` are inventory ids."""

    def add(fn):
        CATALOG[fn.__name__] = Query(
            fn.__name__, fn, tuple(ids.split()), with_views(oracle) if oracle else None)
        return fn

    return add
