"""Generic distributed building blocks used by several operator families.

* :func:`long_form`      - unpivot a feature list to ``(feature, value)`` once.
* :func:`bucketed_running` - exact running sums per group without putting a whole
  group into one task: rows are range-partitioned once by (group, order) and kept in the
  shared folder, each range cumulates locally and the totals of the ranges before it make
  the sums global.  One plan at every size.
* :func:`dense_index`    - 0..N-1 numbering per group (same plan, counting ones).
* :func:`top_k_per_group` - first ``k`` rows per group by an order, two-level
  (salted) so a hot group is ranked by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.functions.columns import clean
from fidelis.session import cut_lineage


def long_form(df: DataFrame, features: list[str], id_cols: list[str] | None = None,
              var: str = "feature", val: str = "value", drop_null: bool = True) -> DataFrame:
    """Unpivot ``features`` into ``(id_cols..., feature, value double)``; NaN becomes NULL."""
    id_cols = list(id_cols or [])
    cols = [F.col(f"`{c}`") for c in id_cols] + [clean(F.col(f"`{f}`").cast("double")).alias(f) for f in features]
    out = df.select(*cols).unpivot(id_cols, features, var, val)
    if drop_null:
        out = out.where(F.col(val).isNotNull())
    return out


def bucketed_running(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                     prefix: str = "cum_", totals: bool = False) -> DataFrame:
    """Add inclusive running sums of ``sum_cols`` per ``group_cols`` ordered by ``order_col``.

    ``order_col`` must be unique within a group (aggregate duplicates first).  Rows go to
    ``spark.sql.shuffle.partitions`` ranges of (group, order), so a range shrinks with that
    setting whatever the size of a group; the ranges are checkpointed, so ``df`` runs once and
    every later step sees the same ranges.  The offsets table has a row per range and group
    in it (ranges + groups at most).  ``totals`` also adds the group totals ``total_<col>``.
    """
    group_cols = list(group_cols)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *[F.col(f"`{c}`") for c in [*group_cols, order_col]]).withColumn("_range", F.spark_partition_id()))
    keys = [*group_cols, "_range"]
    w_local = Window.partitionBy(*keys).orderBy(F.col(order_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(F.col(c)).over(w_local).alias(f"_loc_{c}") for c in sum_cols])
    range_totals = ranged.groupBy(*keys).agg(*[F.sum(F.col(c)).alias(f"_tot_{c}") for c in sum_cols])
    w_group = Window.partitionBy(*(group_cols or [F.lit(0)]))  # over the ranges of a group, not its rows
    w_before = w_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = range_totals.select(
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)],
        *[F.coalesce(F.sum(f"_tot_{c}").over(w_before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
        *[F.sum(f"_tot_{c}").over(w_group).alias(f"total_{c}") for c in sum_cols])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = local.join(offsets, on)
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{prefix}{c}") for c in sum_cols],
        *([F.col(f"total_{c}") for c in sum_cols] if totals else []),
    )


def dense_index(df: DataFrame, order_col: str, group_cols: list[str] | None = None, name: str = "idx") -> DataFrame:
    """Number rows 0..N-1 within each group by ``order_col`` (unique per group)."""
    tmp = df.withColumn("_ones", F.lit(1).cast("long"))
    out = bucketed_running(tmp, list(group_cols or []), order_col, ["_ones"], prefix="_cum")
    return out.withColumn(name, F.col("_cum_ones") - 1).drop("_ones", "_cum_ones")


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salt_col: Column | None = None, salts: int = 32, rank_name: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (deterministic when ``order`` is total).

    Stage 1 ranks inside ``(group, salt)`` so a group holding a third of all rows
    is spread over ``salts`` tasks; stage 2 ranks the at most ``salts*k`` survivors.
    """
    salt = salt_col if salt_col is not None else F.abs(F.xxhash64(*[F.col(c) for c in df.columns])) % salts
    staged = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    pre = staged.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return pre.withColumn(rank_name, F.row_number().over(w2).cast("long")).where(F.col(rank_name) <= k)


def _with_group(df: DataFrame, group_cols: list[str]) -> tuple[DataFrame, list[str]]:
    if group_cols:
        return df, list(group_cols)
    return df.withColumn("_g", F.lit(0)), ["_g"]


def exact_quantiles(long_df: DataFrame, group_cols: list[str], value_col: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / numpy default) per group.

    Unlike ``percentile`` (whose buffer holds every distinct value of a group in
    one task) the values are counted per ``(group, value)`` and cumulated with
    :func:`bucketed_running`, which also carries the group total ``n``.  Each running
    row then knows whether it holds the order statistics around ``h = (n-1) p``
    (ranks ``floor(h)+1`` and ``ceil(h)+1``), so one grouped aggregate of conditional
    maxima picks them - no second pass, no join.  Output: ``(group..., p, q)``.
    """
    df, gcols = _with_group(long_df.where(F.col(value_col).isNotNull()), list(group_cols))
    counts = df.groupBy(*gcols, value_col).agg(F.count(F.lit(1)).alias("_n"))
    run = bucketed_running(counts, gcols, value_col, ["_n"], totals=True)
    first = F.col("cum__n") - F.col("_n")  # ranks (first, cum] live in this row
    aggs = []
    for k, p in enumerate(probs):
        h = (F.col("total__n") - 1) * F.lit(float(p))
        lo = F.floor(h) + 1
        hi = F.least(F.ceil(h) + 1, F.col("total__n"))
        aggs += [F.max(F.when((first < lo) & (lo <= F.col("cum__n")), F.col(value_col))).alias(f"_lo{k}"),
                 F.max(F.when((first < hi) & (hi <= F.col("cum__n")), F.col(value_col))).alias(f"_hi{k}"),
                 F.max(h - F.floor(h)).alias(f"_fr{k}")]
    picked = run.groupBy(*gcols).agg(*aggs)
    rows = [F.struct(F.lit(float(p)).alias("p"),
                     (F.col(f"_lo{k}") + F.col(f"_fr{k}") * (F.col(f"_hi{k}") - F.col(f"_lo{k}"))).alias("q"))
            for k, p in enumerate(probs)]
    out = picked.select(*gcols, F.explode(F.array(*rows)).alias("_r")).select(*gcols, "_r.p", "_r.q")
    return out.drop("_g") if not group_cols else out


def quantile_columns(long_df: DataFrame, group_cols: list[str], value_col: str, probs: dict[str, float],
                     exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """Quantiles as named columns per group: ``probs = {"q25": .25, ...}``.

    ``exact=False`` uses ``percentile_approx`` (one pass, bounded memory, rank
    error 1/accuracy) - the choice is the caller's, explicit.
    """
    names = list(probs)
    if exact:
        q = exact_quantiles(long_df, group_cols, value_col, [probs[n] for n in names])
        gcols = list(group_cols)
        pivot = q.groupBy(*gcols).agg(*[F.max(F.when(F.col("p") == F.lit(float(probs[n])), F.col("q"))).alias(n) for n in names]) \
            if gcols else q.agg(*[F.max(F.when(F.col("p") == F.lit(float(probs[n])), F.col("q"))).alias(n) for n in names])
        return pivot
    agg = F.percentile_approx(F.col(value_col), [probs[n] for n in names], accuracy).alias("_qs")
    base = long_df.groupBy(*group_cols).agg(agg) if group_cols else long_df.agg(agg)
    return base.select(*group_cols, *[F.col("_qs")[i].cast("double").alias(n) for i, n in enumerate(names)])


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over the default parallelism when it has fewer partitions (a single
    row group read as one task) before per-row Python work; a no-op on real-size inputs,
    which already have at least that many partitions."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def packed(columns: list[Column]) -> Column:
    """Double columns as one array: a row goes to Python as one value, which costs about half of a value a column."""
    return F.array(*columns).cast("array<double>")


def unpacked(column: pa.Array, n: int) -> np.ndarray:
    """(rows, ``n``) of a ``packed`` column; null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), n)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame (an aggregate) to every row.

    The one-row side is broadcast through an equi-join on a constant key, so the
    big side is neither shuffled nor cross-joined.
    """
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")
