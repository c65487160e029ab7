"""Catalog of named queries over the driver tables, each with its DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (summation order differs between engines)."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def load_all() -> None:
    """Import every query module so that its ``@register`` calls run."""
    from fidelis.plans import (  # noqa: F401
        q_profile,
        q_review,
        q_rules,
        q_similarity,
        q_stats,
        q_synth,
    )
    from fidelis.plans import q_layers  # noqa: F401  (composes the oracles above)
