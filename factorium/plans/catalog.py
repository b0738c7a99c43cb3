"""The registered queries over the driver's tables and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "supplier_fit"
MODULES = ("q_algebra", "q_geometry", "q_dataset", "q_graph", "q_solve", "q_stream", "q_spatial")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out = {}
    for name in MODULES:
        out |= import_module(f".{name}", __package__).QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
