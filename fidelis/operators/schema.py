"""Projections and predicates (P1-P5); schema-level helpers resolve at plan time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Keep a feature list (column pruning reaches the scan)."""
    return df.select(*[F.col(f"`{c}`") for c in features])


def numeric_columns(df: DataFrame) -> DataFrame:
    """Numeric columns only."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


def common_columns(a: DataFrame, b: DataFrame, features: list[str] | None = None) -> list[str]:
    """Features present in both tables (in ``a``'s order); plan-time only."""
    names = features if features is not None else a.columns
    bs = set(b.columns)
    return [c for c in names if c in set(a.columns) and c in bs]


def common_columns_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """P3 as a DataFrame: each common column and how many values either table has in it."""
    names = common_columns(a, b)

    def counted(df, value):
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)])
        return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias(value)) for i, c in enumerate(names)])).alias("e")).select("e.*")
    if not names:
        return a.sparkSession.createDataFrame([], "column string, values_a bigint, values_b bigint")
    return counted(a, "values_a").join(counted(b, "values_b"), "column")  # one row a column


def filter_class(df: DataFrame, label: str, value) -> DataFrame:
    """Rows of one class (pushed to the scan when ``label`` is a stored column)."""
    return df.where(F.col(f"`{label}`") == F.lit(value))


def filter_range(df: DataFrame, label: str, value, amount: str, below: float) -> DataFrame:
    """P5: one class and ``amount < below``."""
    return df.where((F.col(f"`{label}`") == F.lit(value)) & (F.col(f"`{amount}`") < F.lit(below)))
