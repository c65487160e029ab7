"""Scans and sinks (S1-S7).  Everything is lazy until a sink is called."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def card_schema(with_row_id: bool = True) -> T.StructType:
    """The 31-column transaction schema (explicit: no type inference at scale)."""
    fields = [T.StructField("row_id", T.LongType())] if with_row_id else []
    fields.append(T.StructField("Time", T.DoubleType()))
    fields += [T.StructField(f"V{i}", T.DoubleType()) for i in range(1, 29)]
    fields += [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())]
    return T.StructType(fields)


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               header: bool = True) -> DataFrame:
    """CSV (header, explicit schema preferred) or Parquet scan."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", header).option("inferSchema", schema is None).csv(path)
    return reader.format(fmt).load(path)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None) -> None:
    """Write a table (no index column exists in Spark, so none is written)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def to_report_row(df: DataFrame, name: str = "report") -> DataFrame:
    """S3: fold a (small, aggregated) result into one JSON text column per row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def sink_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: nested report write (structs/maps/arrays kept) as JSON lines."""
    df.write.mode(mode).json(path)


def load_baseline(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """Read a stored baseline profile (JSON); ``None`` when absent so callers go on without it.

    With its ``schema`` (else it is inferred) numbers that no entry has, which JSON leaves out, are read as null."""
    try:
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # a missing baseline is allowed, a damaged one is not
            return None
        raise


def baseline_section_sizes(baseline: DataFrame) -> DataFrame:
    """Number of entries per top-level section of a baseline profile."""
    exprs = []
    for f in baseline.schema.fields:
        if isinstance(f.dataType, (T.StructType,)):
            exprs.append(F.struct(F.lit(f.name).alias("section"), F.lit(len(f.dataType.fields)).cast("long").alias("entries")))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            exprs.append(F.struct(F.lit(f.name).alias("section"), F.size(f"`{f.name}`").cast("long").alias("entries")))
        else:
            exprs.append(F.struct(F.lit(f.name).alias("section"), F.lit(1).cast("long").alias("entries")))
    return baseline.select(F.explode(F.array(*exprs)).alias("s")).select("s.section", "s.entries")


def _values(df: DataFrame, names: list[str], value: str) -> DataFrame:
    """(column, <value>): how many rows have a value in each column (one aggregate)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias(value)) for i, c in enumerate(names)])).alias("e")).select("e.*")


def schema_match(real: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per column name: present in real / candidate, same position in both, and how many
    values either side has there (0 where the column is missing)."""
    r, c = real.columns, candidate.columns
    names = list(dict.fromkeys(r + c))
    rows = [(n, n in r, n in c, (n in r and n in c and r.index(n) == c.index(n))) for n in names]
    out = real.sparkSession.createDataFrame(rows, "column string, in_real boolean, in_candidate boolean, position_equal boolean")
    for df, value in ((real, "real_values"), (candidate, "candidate_values")):
        out = out.join(_values(df, df.columns, value), "column", "left").fillna(0, [value])  # one row a column
    return out


def infer_types(df: DataFrame, max_categorical: int = 10) -> DataFrame:
    """Per column storage type, approximate distinct count and numeric/categorical label
    (one aggregate over the table)."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    agg = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"d{i}").alias("n_distinct"),
                        F.when(F.lit(c in numeric) & (F.col(f"d{i}") > max_categorical), F.lit("numerical"))
                        .otherwise(F.lit("categorical")).alias("sdtype"))
               for i, (c, t) in enumerate(df.dtypes)]
    return agg.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def sink_pair(candidate: DataFrame, reference: DataFrame, base: str, fmt: str = "parquet") -> tuple[str, str]:
    """Write candidate and reference side by side; returns both paths."""
    a, b = f"{base}/candidate", f"{base}/reference"
    sink_table(candidate, a, fmt)
    sink_table(reference, b, fmt)
    return a, b
