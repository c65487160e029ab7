"""Table and column profiles.

Everything is one or two aggregate passes over a long ``(feature, value)`` form;
per-class variants are conditional aggregates or an extra grouping key, never a
second scan per class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.functions.columns import clean
from fidelis.operators.corr import varies
from fidelis.operators.dist import column_quantiles
from fidelis.operators.frames import attach, bucketed_running, long_form, packed, quantile_columns, unpacked


def _q(c: str) -> str:
    return f"`{c}`"


def table_profile(df: DataFrame) -> DataFrame:
    """A1: rows, columns, total missing cells (NULL or NaN), numeric / other column counts."""
    miss = []
    for f in df.schema.fields:
        c = F.col(_q(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss.append(F.count_if(clean(c).isNull()))
        else:
            miss.append(F.count_if(c.isNull()))
    total = miss[0]
    for m in miss[1:]:
        total = total + m
    n_num = sum(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("total_nulls")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "total_nulls",
        F.lit(n_num).cast("long").alias("numeric_columns"), F.lit(len(df.columns) - n_num).cast("long").alias("other_columns"))


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2: rows minus distinct rows (over ``cols`` or all columns).

    Rows are first grouped by a 256-bit digest of their values, so only digests are
    shuffled; the full values are shuffled and compared only for rows whose digest occurs
    more than once.  The count stays exact (digest collisions are re-checked on values),
    and long text columns are not moved unless they may be duplicates."""
    cols = cols or df.columns
    vals = df.select(*[F.col(_q(c)) for c in cols])
    digest = F.sha2(F.to_json(F.struct(*[F.col(_q(c)) for c in cols])), 256)
    tagged = vals.withColumn("_d", digest)
    per_digest = tagged.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    single = per_digest.where(F.col("_n") == 1).agg(F.count(F.lit(1)).alias("_single"))
    repeated = tagged.join(per_digest.where(F.col("_n") > 1).select("_d"), "_d", "left_semi")
    exact = repeated.groupBy(*[F.col(_q(c)) for c in cols]).agg(F.count(F.lit(1)).alias("_m")).agg(
        F.coalesce(F.sum(F.col("_m") - 1), F.lit(0)).cast("long").alias("duplicates"),
        F.count(F.lit(1)).alias("_groups"), F.coalesce(F.sum("_m"), F.lit(0)).cast("long").alias("_rows"))
    total = vals.agg(F.count(F.lit(1)).alias("total_rows"))
    out = attach(attach(exact, single), total)
    return out.select("duplicates", (F.col("_groups") + F.col("_single")).alias("distinct_rows"), "total_rows")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A3 + W2: count and share (%) per class; imbalance ratio = majority // minority."""
    counts = df.groupBy(F.col(_q(label)).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("_total"), F.max("count").alias("_max"), F.min("count").alias("_min"))
    return attach(counts, tot).select(
        "class", "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent"),
        F.expr("_max div _min").alias("imbalance_ratio"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Share of each key value in all rows."""
    counts = df.groupBy(F.col(_q(key)).alias(key)).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("_total"))  # one row, broadcast: no single-partition window
    return attach(counts, tot).select(key, "count", (F.col("count") / F.col("_total")).alias("share"))


def fraud_rate(df: DataFrame, label: str) -> DataFrame:
    """A4: mean and sum of a 0/1 label."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(_q(label))).cast("long").alias("n_positive"),
                  F.avg(F.col(_q(label)).cast("double")).alias("rate"))


def fraud_rate_match(real: DataFrame, candidate: DataFrame, label: str, tolerance: float = 0.0001) -> DataFrame:
    """A5: |rate_real - rate_candidate| < tolerance (two one-row aggregates, broadcast-joined)."""
    a = real.agg(F.avg(F.col(_q(label)).cast("double")).alias("real_rate"))
    b = candidate.agg(F.avg(F.col(_q(label)).cast("double")).alias("candidate_rate"))
    j = attach(a, b)
    d = F.abs(F.col("real_rate") - F.col("candidate_rate"))
    return j.select("real_rate", "candidate_rate", d.alias("abs_diff"), (d < F.lit(tolerance)).alias("matched"))


def describe(df: DataFrame, features: list[str], by: str | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, std (n-1), min, q25, q50, q75, max per feature (and per ``by`` value)."""
    ids = ["_by"] if by else []
    src = df.withColumn("_by", F.col(_q(by))) if by else df
    lf = long_form(src, features, ids)
    keys = ["feature"] + ids
    base = lf.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = quantile_columns(lf, keys, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact=exact)
    out = base.join(qs, keys, "left")
    out = out.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    return out.withColumnRenamed("_by", by) if by else out


MOMENTS = ("n", "missing", "mean", "m2", "m3", "m4", "min", "max")


def _central(x: np.ndarray) -> np.ndarray:
    """Rows (n, missing, mean, m2, m3, m4, min, max) of the columns of ``x``; NaN is missing.

    Values are taken less the first of their column, so a constant has a spread of exactly 0."""
    has = ~np.isnan(x)
    n = has.sum(0)
    some = np.maximum(n, 1)
    shift = np.where(n > 0, x[has.argmax(0), np.arange(x.shape[1])], 0.0)
    y = np.where(has, x - shift, 0.0)
    off = y.sum(0) / some
    y = np.where(has, y - off, 0.0)
    y2 = y * y
    return np.stack([n, len(x) - n, shift + off, y2.sum(0), (y2 * y).sum(0), (y2 * y2).sum(0), np.where(has, x, np.inf).min(0), np.where(has, x, -np.inf).max(0)])


def _central_joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_central`` of the rows of both."""
    (na, ka, ma, a2, a3, a4, la, ha), (nb, kb, mb, b2, b3, b4, lb, hb) = a, b
    n = np.maximum(na + nb, 1)
    d = np.where((na > 0) & (nb > 0), mb - ma, 0.0)
    e = d * nb / n
    return np.stack([na + nb, ka + kb, np.where(na > 0, ma + e, mb), a2 + b2 + d * e * na,
                     a3 + b3 + d * d * e * na * (na - nb) / n + 3 * d * (na * b2 - nb * a2) / n,
                     a4 + b4 + d ** 3 * e * na * (na * na - na * nb + nb * nb) / n ** 2 + 6 * d * d * (na * na * b2 + nb * nb * a2) / n ** 2 + 4 * d * (na * b3 - nb * a3) / n,
                     np.minimum(la, lb), np.maximum(ha, hb)])


def moment_rows(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., feature, n, missing, mean, m2, m3, m4, min, max): counts and central moments of each feature per task
    and value of ``keys`` (few), from one pass over Arrow batches; ``joined_moments`` adds the tasks up."""
    keys = list(keys or [])
    read = df.select(*[F.col(_q(c)) for c in keys], packed([clean(F.col(_q(f)).cast("double")) for f in features]).alias("_values"))
    kinds = "".join(f"`{c}` {t}, " for c, t in read.dtypes[:len(keys)])

    def batches(it):
        totals: dict[tuple, np.ndarray] = {}
        types = []
        for b in it:
            if not len(b):
                continue
            types = [c.type for c in b.columns[:len(keys)]]
            x = unpacked(b.column(len(keys)), len(features))
            code, names = np.zeros(len(b), np.int64), [()]
            for c in b.columns[:len(keys)]:
                e = c.dictionary_encode(null_encoding="encode")
                code = code * len(e.dictionary) + e.indices.to_numpy()
                names = [(*k, v) for k in names for v in e.dictionary.to_pylist()]
            for k in np.unique(code).tolist():
                own = _central(x if len(names) == 1 else x[code == k])
                totals[names[k]] = _central_joined(totals[names[k]], own) if names[k] in totals else own
        for name, t in totals.items():
            none = t[0] == 0
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(features), y) for v, y in zip(name, types)], pa.array(features, pa.string()), *[pa.array(t[i].astype(np.int64)) for i in (0, 1)],
                                              pa.array(t[2], mask=none), *[pa.array(t[i]) for i in (3, 4, 5)], *[pa.array(t[i], mask=none) for i in (6, 7)]], names=[*keys, "feature", *MOMENTS])

    return read.mapInArrow(batches, f"{kinds}feature string, n bigint, missing bigint, " + ", ".join(f"`{c}` double" for c in MOMENTS[2:]))


def joined_moments(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of disjoint rows joined over all columns but ``keys``: with d the distance of a
    part's mean from the whole, M2 = sum(M2_i + n d^2), M3 = sum(M3_i + 3 d M2_i + n d^3), M4 = sum(M4_i + 4 d M3_i + 6 d^2 M2_i + n d^4).
    A column ``sketch`` is merged too."""
    sketched = "sketch" in moments.columns
    w = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(w), F.sum("n").over(w))
    p = moments.select(*keys, *MOMENTS, *(["sketch"] if sketched else []), F.when(F.col("n") > 0, F.col("mean") - mean).otherwise(0.0).alias("d"))
    return p.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
        F.sum(F.expr("m2 + n * d * d")).alias("m2"), F.sum(F.expr("m3 + 3 * d * m2 + n * d * d * d")).alias("m3"),
        F.sum(F.expr("m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d")).alias("m4"),
        F.min("min").alias("min"), F.max("max").alias("max"), *([F.kll_merge_agg_double("sketch").alias("sketch")] if sketched else []))


def column_stats(df: DataFrame, features: list[str], exact: bool = True, places: int = 6) -> DataFrame:
    """Mean, std, min, max, median, q25, q75 and bias-corrected skewness (G1) and excess
    kurtosis (G2) per column, rounded; with the population forms g1, g2:
    G1 = g1 sqrt(n(n-1))/(n-2), G2 = (n-1)/((n-2)(n-3)) ((n+1) g2 + 6).  A constant column has neither."""
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    m = joined_moments(moment_rows(df, features), ["feature"]).where("n > 0")
    n, m2, m3, m4 = (F.col(c).cast("double") for c in ("n", "m2", "m3", "m4"))
    some = varies(m2, F.col("mean"), n) | F.isnan(m2)
    std = F.when(n > 1, F.sqrt(m2 / (n - 1)))
    g1 = F.when((n > 2) & some, F.sqrt(n) * m3 / F.pow(m2, 1.5) * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when((n > 3) & some, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6))
    qs = column_quantiles(df, features, probs) if exact else quantile_columns(long_form(df, features), ["feature"], "value", probs, exact=False)
    return m.withColumn("std", std).join(qs, "feature", "left").select(
        "feature", *[F.round(F.col(c), places).alias(c) for c in ("mean", "std", "min", "max", "median", "q25", "q75")],
        F.round(g1, places).alias("skewness"), F.round(g2, places).alias("kurtosis"))


def class_mean_diff(df: DataFrame, label: str, features: list[str], k: int | None = None) -> DataFrame:
    """|mean(x | label=1) - mean(x | label=0)| per feature, ranked descending."""
    lf = long_form(df, features, [label])
    g = lf.groupBy("feature").agg(
        F.avg(F.when(F.col(_q(label)) == 1, F.col("value"))).alias("mean_positive"),
        F.avg(F.when(F.col(_q(label)) == 0, F.col("value"))).alias("mean_negative"))
    g = g.withColumn("abs_diff", F.abs(F.col("mean_positive") - F.col("mean_negative")))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("abs_diff"), "feature")  # one row per feature
    g = g.withColumn("rank", F.row_number().over(w).cast("long"))
    return g.where(F.col("rank") <= k) if k else g


def class_quantiles(df: DataFrame, label: str, col: str,
                    probs=(0.25, 0.5, 0.75, 0.9, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """Quantiles of ``col`` per class (linear interpolation)."""
    lf = long_form(df, [col], [label])
    names = {f"p{int(round(p * 100))}": p for p in probs}
    return quantile_columns(lf, [label], "value", names, exact=exact).withColumnRenamed(label, "class")


def class_median(df: DataFrame, label: str, col: str, exact: bool = True) -> DataFrame:
    """A10: median of ``col`` per class."""
    lf = long_form(df, [col], [label])
    return quantile_columns(lf, [label], "value", {"median": 0.5}, exact=exact).withColumnRenamed(label, "class")


def class_moments(df: DataFrame, label: str, features: list[str], amount: str, time: str) -> DataFrame:
    """Per class and feature mean / std (n-1) and max, plus log1p(amount) per class and
    the overall time statistics (class NULL); one long table."""
    base = df.select(F.col(_q(label)).alias("_cls"), *[clean(F.col(_q(f))).alias(f) for f in features],
                     F.log1p(clean(F.col(_q(amount)))).alias("log1p_amount"), clean(F.col(_q(time))).alias("_time"))
    lf = base.unpivot(["_cls", "_time"], features + ["log1p_amount"], "feature", "value")
    per_class = lf.where(F.col("value").isNotNull()).groupBy(F.col("_cls").alias("class"), "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("max"))
    overall = base.agg(F.avg("_time").alias("mean"), F.stddev_samp("_time").alias("std"), F.max("_time").alias("max")).select(
        F.lit(None).cast(per_class.schema["class"].dataType).alias("class"), F.lit(time).alias("feature"), "mean", "std", "max")
    return per_class.unionByName(overall)


def lognormal_fit(df: DataFrame, amount: str) -> DataFrame:
    """Mean and std (n-1) of log1p(amount)."""
    v = F.log1p(clean(F.col(_q(amount))))
    return df.agg(F.avg(v).alias("log_mean"), F.stddev_samp(v).alias("log_std"))


def real_data_summary(df: DataFrame, label: str, amount: str, time: str, features: list[str], top: int = 5) -> DataFrame:
    """Long ``(metric, value, detail)`` summary: rows, features, positive rate (%),
    amount mean / median / max, median amount per class, time range, top discriminative features."""
    a = df.agg(F.count(F.lit(1)).cast("double").alias("n_rows"),
               (F.avg(F.col(_q(label)).cast("double")) * 100).alias("positive_rate_pct"),
               F.avg(clean(F.col(_q(amount)))).alias("amount_mean"), F.max(clean(F.col(_q(amount)))).alias("amount_max"),
               F.min(clean(F.col(_q(time)))).alias("time_min"), F.max(clean(F.col(_q(time)))).alias("time_max"))
    metrics = ["n_rows", "positive_rate_pct", "amount_mean", "amount_max", "time_min", "time_max"]
    head = a.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(None).cast("string").alias("detail"))
                                       for m in metrics])).alias("s")).select("s.*")
    nfeat = a.select(F.lit("n_features").alias("metric"), F.lit(float(len(features))).alias("value"), F.lit(None).cast("string").alias("detail"))
    med = quantile_columns(long_form(df, [amount]), [], "value", {"median": 0.5}).select(
        F.lit("amount_median").alias("metric"), F.col("median").alias("value"), F.lit(None).cast("string").alias("detail"))
    cmed = class_median(df, label, amount).select(
        F.concat(F.lit("amount_median_class_"), F.col("class").cast("string")).alias("metric"), F.col("median").alias("value"),
        F.lit(None).cast("string").alias("detail"))
    topf = class_mean_diff(df, label, features, top).select(
        F.concat(F.lit("top_feature_"), F.col("rank").cast("string")).alias("metric"), F.col("abs_diff").alias("value"),
        F.col("feature").alias("detail"))
    return head.unionByName(nfeat).unionByName(med).unionByName(cmed).unionByName(topf)


def histogram(df: DataFrame, col: str, bins: int = 50, lo: float | None = None, hi: float | None = None, log: bool = False) -> DataFrame:
    """H1: equal-width bins over [min, max] (or a given range), last bin closed like numpy;
    values outside a given range are dropped.  Every bin is listed (zero counts too).
    A constant column is binned over [x - 0.5, x + 0.5].  ``log`` bins the base-10 logarithm of the positive values.
    ``density = count / (n_in_range * width)``."""
    v = clean(F.col(_q(col)))
    if log:
        v = F.when(v > 0, F.log10(v))
    base = df.select(v.alias("v")).where(F.col("v").isNotNull())
    rng = base.agg(F.min("v").alias("lo"), F.max("v").alias("hi")) if lo is None or hi is None else \
        base.limit(0).agg(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    flat = F.col("hi") <= F.col("lo")
    rng = rng.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    rng = rng.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    tagged = attach(base, rng)
    tagged = tagged.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    b = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")).cast("int"), F.lit(bins - 1))
    counts = tagged.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "w")
    out = grid.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"), "w")
    tot = Window.partitionBy(F.lit(0))  # over the bins table (bounded by ``bins``)
    return out.select("bin", "bin_lo", "bin_hi", "count",
                      (F.col("count") / (F.sum("count").over(tot) * F.col("w"))).alias("density"))


def boxplot_stats(df: DataFrame, col: str, by: str | None = None, whis: float = 1.5, exact: bool = True) -> DataFrame:
    """H2: q1, median, q3, whiskers (most extreme data within q -/+ whis*IQR) and outlier count."""
    ids = [by] if by else []
    lf = long_form(df, [col], ids)
    qs = quantile_columns(lf, ids, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, exact=exact)
    if ids:
        j = lf.join(F.broadcast(qs), ids)
    else:
        j = attach(lf, qs)
    lo = F.col("q1") - whis * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + whis * (F.col("q3") - F.col("q1"))
    agg = j.groupBy(*ids, "q1", "median", "q3").agg(
        F.min(F.when(F.col("value") >= lo, F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("value") <= hi, F.col("value"))).alias("whisker_high"),
        F.count_if((F.col("value") < lo) | (F.col("value") > hi)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return agg


def ecdf(df: DataFrame, col: str, per_row: bool = False, linspace: bool = False) -> DataFrame:
    """Empirical CDF.

    * default: one row per distinct value with F(x) = #(v <= x) / n (tie-safe, ``cume_dist``);
    * ``per_row``: one row per input row with i/n by sorted position (``linspace``: (i-1)/(n-1)).
    Cumulative counts use the bucketed running sum, so no single-partition window.
    """
    v = clean(F.col(_q(col)))
    counts = df.select(v.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n_at"))
    run = bucketed_running(counts, [], "value", ["n_at"])
    total = counts.agg(F.sum("n_at").alias("_n"))
    j = attach(run, total)
    if not per_row:
        return j.select("value", "n_at", F.col("cum_n_at").alias("cum_count"), (F.col("cum_n_at") / F.col("_n")).alias("ecdf"))
    pos = j.select("value", "_n", F.explode(F.sequence(F.col("cum_n_at") - F.col("n_at") + 1, F.col("cum_n_at"))).alias("position"))
    if linspace:
        return pos.select("value", "position", F.when(F.col("_n") > 1, (F.col("position") - 1) / (F.col("_n") - 1))
                          .otherwise(F.lit(0.0)).alias("ecdf"))
    return pos.select("value", "position", (F.col("position") / F.col("_n")).alias("ecdf"))
