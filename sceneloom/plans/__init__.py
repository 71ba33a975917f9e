"""Named queries over the tables, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _registry() -> dict[str, tuple]:
    from . import builds, exports, markup, relations, texts  # noqa: F401
    from .base import REGISTRY

    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registry().items() if sql}
