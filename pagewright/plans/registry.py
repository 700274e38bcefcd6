"""Registered queries of the core and their SQL twins; modules of this folder add theirs."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules with QUERIES and SQL.
MODULES: tuple[str, ...] = ("retrieval", "evaluation", "audit", "cases")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= import_module(f"{__package__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"{__package__}.{m}").SQL
    return out
