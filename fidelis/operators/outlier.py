"""Outlier checks (O1-O3); the isolation forest (O4) lives in :mod:`fidelis.operators.forest`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis import config
from fidelis.functions.columns import clean
from fidelis.operators.frames import attach, long_form, quantile_columns


def zscore_stat_aggs(features: list[str], tag: str = "") -> list:
    """Row count and per feature ``count``, mean and POPULATION std (to share a scan)."""
    cols = [clean(F.col(f"`{f}`").cast("double")) for f in features]
    return [F.count(F.lit(1)).alias(f"{tag}_n")] + [F.count(c).alias(f"{tag}_k{i}") for i, c in enumerate(cols)] + \
        [F.avg(c).alias(f"{tag}_m{i}") for i, c in enumerate(cols)] + [F.stddev_pop(c).alias(f"{tag}_s{i}") for i, c in enumerate(cols)]


def zscore_from_stats(df: DataFrame, stats: DataFrame, features: list[str], tag: str = "",
                      limit: float = config.ZSCORE_LIMIT, threshold: float = config.ZSCORE_RATE_THRESHOLD) -> DataFrame:
    cols = [clean(F.col(f"`{f}`").cast("double")) for f in features]
    st = stats.select(*[F.col(f"{tag}_n").alias("_n")] + [F.col(f"{tag}_{k}{i}").alias(f"_{k}{i}")
                                                        for k in "kms" for i in range(len(features))])
    j = attach(df.select(*[c.alias(f"_v{i}") for i, c in enumerate(cols)]), st)
    cnt = j.agg(*[F.count_if((F.col(f"_k{i}") == F.col("_n"))
                             & (F.abs(F.try_divide(F.col(f"_v{i}") - F.col(f"_m{i}"), F.col(f"_s{i}"))) > limit)).alias(f"o{i}")
                  for i in range(len(features))])
    cnt = attach(cnt, st.select(F.col("_n").alias("total_records")))
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"o{i}").alias("outlier_count")) for i, f in enumerate(features)]
    out = cnt.select("total_records", F.explode(F.array(*entries)).alias("e")).select("e.feature", "e.outlier_count", "total_records")
    rate = F.when(F.col("total_records") > 0, F.col("outlier_count") / F.col("total_records")).otherwise(F.lit(0.0))
    return out.select(F.lit("zscore_outliers").alias("test_name"), "feature", (rate < threshold).alias("passed"),
                      rate.alias("statistic"), F.lit(float(threshold)).alias("threshold"),
                      F.lit(None).cast("double").alias("p_value"), "outlier_count", "total_records")


def zscore_outlier_rate(df: DataFrame, features: list[str], limit: float = config.ZSCORE_LIMIT,
                        threshold: float = config.ZSCORE_RATE_THRESHOLD) -> DataFrame:
    """O1: share of rows with |z| > ``limit`` (population std), passed iff strictly below
    ``threshold``.  Like a NaN-propagating z-score, one missing value in a column makes
    every z undefined, so its rate is 0.  Two passes: one aggregate, one counting scan."""
    return zscore_from_stats(df, df.agg(*zscore_stat_aggs(features)), features, "", limit, threshold)


def zscore_extreme_counts(df: DataFrame, features: list[str], limit: float = config.ZSCORE_EXTREME,
                          k: int | None = 10) -> DataFrame:
    """O2: per feature number of |z| > ``limit`` with missing values omitted; top ``k``."""
    lf = long_form(df, features)
    st = lf.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    j = lf.join(F.broadcast(st), "feature")  # one row per feature
    out = j.groupBy("feature").agg(F.count_if(F.abs(F.try_divide(F.col("value") - F.col("m"), F.col("s"))) > limit).alias("n_extreme"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n_extreme"), "feature")  # one row per feature
    out = out.withColumn("rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def iqr_outliers(df: DataFrame, col: str, label: str | None = None, factor: float = config.IQR_FACTOR,
                 exact: bool = True) -> DataFrame:
    """O3: bounds q1 - 1.5 IQR / q3 + 1.5 IQR (strict), count, % of rows, positives among them."""
    lf = long_form(df, [col], [label] if label else [])
    qs = quantile_columns(lf, [], "value", {"q1": 0.25, "q3": 0.75}, exact=exact)
    qs = qs.select("q1", "q3", (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("lower"),
                   (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("upper"))
    j = attach(lf, qs)
    out_mask = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    aggs = [F.count_if(out_mask).alias("n_outliers"), F.count(F.lit(1)).alias("n")]
    if label:
        aggs.append(F.count_if(out_mask & (F.col(f"`{label}`") == 1)).alias("n_outliers_positive"))
    a = j.groupBy("q1", "q3", "lower", "upper").agg(*aggs)
    return a.withColumn("pct_outliers", F.col("n_outliers") * 100.0 / F.col("n"))
