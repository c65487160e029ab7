"""Correlation structure (C1-C6) as a long ``(feature_a, feature_b, corr)`` table.

All pairs of a feature list come from one pass of cross products: each task adds up, for
every pair, the number of rows that have both values and their central sums, squares and
products (numpy matrix products over Arrow batches), and one small grouped sum joins the
tasks.  The result is pairwise complete like pandas; a constant column gives NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis import config
from fidelis.functions.columns import clean
from fidelis.operators.frames import packed, unpacked

#: Of one pair: rows with both values, their means, and the central sums of squares and products.
PRODUCTS = ("n", "mean_a", "mean_b", "m2_a", "m2_b", "c")
#: A spread below this share of the mean is rounding: the column counts as constant.
CONSTANT = 1e-12


def cross_products(df: DataFrame, features: list[str], part: str | None = None) -> DataFrame:
    """``([part], i, j, n, mean_a, mean_b, m2_a, m2_b, c)`` for every pair i < j of ``features``, pairwise
    complete: a row for each task (and value of the column ``part``), from one pass.

    A task takes the values less the first one it meets of their column, so that large means lose no
    digits; ``joined_products`` adds the tasks up.
    """
    upper = np.triu_indices(len(features), 1)
    key = [F.lit(None).cast("string").alias("part") if part is None else F.col(f"`{part}`").cast("string").alias("part")]
    read = df.select(*key, packed([clean(F.col(f"`{f}`").cast("double")) for f in features]).alias("_values"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str | None, list] = {}
        for b in it:
            parts = b.column(0).to_pylist()
            found = dict.fromkeys(parts)
            x = unpacked(b.column(1), len(features))
            for p in found:
                y = x if len(found) == 1 else x[[q == p for q in parts]]
                has = ~np.isnan(y)
                if p not in totals:
                    totals[p] = [np.full(len(features), np.nan), np.zeros((6, len(upper[0])))]
                shift, total = totals[p]
                new = np.isnan(shift) & has.any(0)
                shift[new] = y[has.argmax(0), np.arange(y.shape[1])][new]
                y = np.where(has, y - shift, 0.0)
                has = has.astype(float)
                s, q = y.T @ has, (y * y).T @ has
                total += np.stack([m[upper] for m in (has.T @ has, s, s.T, q, q.T, y.T @ y)])
        for p, (shift, (n, sa, sb, qa, qb, g)) in totals.items():
            some, shift = np.maximum(n, 1), np.nan_to_num(shift)
            columns = [n.astype(np.int64), shift[upper[0]] + sa / some, shift[upper[1]] + sb / some, qa - sa * sa / some, qb - sb * sb / some, g - sa * sb / some]
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(n), pa.string()), *[pa.array(u.astype(np.int32)) for u in upper], *map(pa.array, columns)],
                                             names=["part", "i", "j", *PRODUCTS])

    out = read.mapInArrow(batches, "part string, i int, j int, n bigint, " + ", ".join(f"{c} double" for c in PRODUCTS[1:]))
    return out.drop("part") if part is None else out


def joined_products(products: DataFrame, by: list[str]) -> DataFrame:
    """Cross products of disjoint rows joined per ``by``: with d the distance of a part's mean from
    the whole, C = sum(C_i + n_i da_i db_i)."""
    w = Window.partitionBy(*by)
    n = F.col("n")
    d = {s: F.col(f"mean_{s}") - F.try_divide(F.sum(n * F.col(f"mean_{s}")).over(w), F.sum("n").over(w)) for s in "ab"}
    p = products.where("n > 0").select(*by, *PRODUCTS, d["a"].alias("da"), d["b"].alias("db"))
    total = F.sum("n")
    return p.groupBy(*by).agg(
        total.alias("n"), (F.sum(n * F.col("mean_a")) / total).alias("mean_a"), (F.sum(n * F.col("mean_b")) / total).alias("mean_b"),
        F.sum(F.expr("m2_a + n * da * da")).alias("m2_a"), F.sum(F.expr("m2_b + n * db * db")).alias("m2_b"), F.sum(F.expr("c + n * da * db")).alias("c"))


def varies(m2, mean, n):
    """Whether a central sum of squares is more than the rounding of a constant."""
    return m2 > n * mean * mean * CONSTANT ** 2


def pearson():
    """The correlation of a row of cross products; NULL for a constant side."""
    n = F.col("n")
    some = varies(F.col("m2_a"), F.col("mean_a"), n) & varies(F.col("m2_b"), F.col("mean_b"), n)
    return F.when(some, F.col("c") / F.sqrt(F.col("m2_a")) / F.sqrt(F.col("m2_b")))


def corr_long(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every pair ``i < j`` (feature order), pairwise complete."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = joined_products(cross_products(df, features), ["i", "j"])
    every = df.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("j")).where("j > i")
    return every.join(F.broadcast(pairs), ["i", "j"], "left").select(  # pairs without a common row too
        names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"), "i", "j", pearson().alias("corr"))


def corr_difference(real: DataFrame, candidate: DataFrame, features: list[str]) -> DataFrame:
    """``R_real - R_candidate`` per pair (one pass a side, one row a pair)."""
    a = corr_long(real, features).withColumnRenamed("corr", "real_corr")
    b = corr_long(candidate, features).select("i", "j", F.col("corr").alias("candidate_corr"))
    return a.join(b, ["i", "j"]).select("feature_a", "feature_b", "i", "j", "real_corr", "candidate_corr",
                                        (F.col("real_corr") - F.col("candidate_corr")).alias("diff"))


def frobenius_from_diff(d: DataFrame, k: int, threshold: float = config.CORR_THRESHOLD) -> DataFrame:
    agg = d.agg(F.sum(F.pow("diff", 2)).alias("ss"), F.count_if(F.col("diff").isNull()).alias("n_undefined"))
    raw = F.when(F.col("n_undefined") > 0, F.lit(float("nan"))).otherwise(F.sqrt(F.lit(2.0) * F.coalesce(F.col("ss"), F.lit(0.0))))
    stat = raw / F.lit(math.sqrt(k))
    return agg.select(F.lit("correlation_frobenius").alias("test_name"), F.lit("all_features").alias("feature"),
                      F.coalesce(stat < threshold, F.lit(False)).alias("passed"), stat.alias("statistic"),
                      F.lit(float(threshold)).alias("threshold"), F.lit(None).cast("double").alias("p_value"),
                      raw.alias("raw_frobenius"), F.lit(k).alias("n_features"))


def corr_frobenius(real: DataFrame, candidate: DataFrame, features: list[str],
                   threshold: float = config.CORR_THRESHOLD) -> DataFrame:
    """||R_real - R_cand||_F / sqrt(k) over the full symmetric matrix; any undefined
    correlation makes the statistic NaN and the test fail."""
    return frobenius_from_diff(corr_difference(real, candidate, features), len(features), threshold)


def top_pairs_from_diff(d: DataFrame, top_n: int = config.CORR_TOP_N, threshold: float = config.CORR_THRESHOLD) -> DataFrame:
    d = d.where(F.col("real_corr").isNotNull())
    order = [F.desc(F.round(F.abs("real_corr"), 12)), F.asc("i"), F.asc("j")]
    first = d.orderBy(*order).limit(top_n)  # a top-n heap, not a sort of every pair
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))  # <= top_n rows
    diff = F.abs(F.abs("real_corr") - F.abs("candidate_corr"))
    return top.select(F.lit("pairwise_correlation").alias("test_name"),
                      F.concat("feature_a", F.lit("_vs_"), "feature_b").alias("feature"),
                      F.coalesce(diff < threshold, F.lit(False)).alias("passed"), diff.alias("statistic"),
                      F.lit(float(threshold)).alias("threshold"), F.lit(None).cast("double").alias("p_value"),
                      F.abs("real_corr").alias("real_correlation"), F.abs("candidate_corr").alias("candidate_correlation"),
                      "rank")


def corr_top_pairs(real: DataFrame, candidate: DataFrame, features: list[str], top_n: int = config.CORR_TOP_N,
                   threshold: float = config.CORR_THRESHOLD) -> DataFrame:
    """The ``top_n`` pairs by |r| in the real table (ties by rounded |r| then position),
    passed iff ||r_real| - |r_cand|| < threshold (the sign is ignored)."""
    return top_pairs_from_diff(corr_difference(real, candidate, features), top_n, threshold)


def corr_with_class(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """C4: correlation of each feature with the label, ranked ascending (``rank_asc``)."""
    pairs = corr_long(df, [*[f for f in features if f != label], label])
    out = pairs.where(F.col("feature_b") == label).select(F.col("feature_a").alias("feature"), "corr")
    w = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("corr"), "feature")  # one row per feature
    return out.withColumn("rank_asc", F.row_number().over(w).cast("long"))


def corr_pairs_baseline(df: DataFrame, features: list[str], places: int = 6) -> DataFrame:
    """Every upper-triangle pair, rounded (the baseline-profile section)."""
    return corr_long(df, features).select("feature_a", "feature_b", F.round("corr", places).alias("corr"))
