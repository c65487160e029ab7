"""Mergeable baseline profiles: a stored state per part that later parts join without a rescan.

The state of one part of a table (a day, a file) is three small tables: counts per class,
central moments with a quantile sketch per class and feature, and central cross products per
pair of features (the label is one of them).  States of disjoint parts add up exactly, by the
usual formulas for joining central moments, and quantile sketches merge within their error, so
the profile of A with B is that of their states.  The tables are Parquet, partitioned by
part: adding a part writes its own folders and reads no other, and adding it again replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelis.functions.columns import clean
from fidelis.operators import corr as C
from fidelis.operators.profile import joined_moments, moment_rows

#: Size of the quantile sketches; a rank is off by ``RANK_ERROR`` at most with 99 % probability.
KLL_K = 1024
RANK_ERROR = 0.005


@dataclass
class State:
    """``classes`` (part, class, n), ``moments`` (part, class, feature, ...), ``products`` (part, feature_a, feature_b, ...)."""

    classes: DataFrame
    moments: DataFrame
    products: DataFrame


def part_state(df: DataFrame, features: list[str], label: str, part: Column) -> State:
    """The state of every part of ``df`` (``part``: its name), from one pass for the moments and one for the products."""
    tagged = df.select(part.cast("string").alias("part"), F.col(f"`{label}`").alias("class"), *[clean(F.col(f"`{f}`").cast("double")).alias(f) for f in features if f != label],
                       *([F.col(f"`{label}`").cast("double").alias(label)] if label in features else []))
    classes = tagged.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    keys = ["part", "class"]
    rows = joined_moments(moment_rows(tagged, features, keys), [*keys, "feature"])
    # a sketch a column, so no row is copied for each feature
    wide = tagged.groupBy(*keys).agg(*[F.kll_sketch_agg_double(clean(F.col(f"`{f}`")), F.lit(KLL_K)).alias(f"_{i}") for i, f in enumerate(features)])
    sketches = wide.select(*[F.col(c).alias(f"_{c}") for c in keys], F.explode(F.array(*[F.struct(F.lit(f).alias("_feature"), F.col(f"_{i}").alias("sketch")) for i, f in enumerate(features)])).alias("x")).select("_part", "_class", "x.*")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "feature")]
    moments = rows.join(F.broadcast(sketches), same).drop("_part", "_class", "_feature")  # a row a part, class and feature
    names = list(dict.fromkeys([*features, label]))
    paired = tagged if label in features else tagged.withColumn(label, F.col("class").cast("double"))
    of = F.array(*[F.lit(f) for f in names])
    pairs = C.joined_products(C.cross_products(paired, names, "part"), ["part", "i", "j"])
    return State(classes, moments, pairs.select("part", of[F.col("i")].alias("feature_a"), of[F.col("j")].alias("feature_b"), *C.PRODUCTS))


def add_parts(folder: str, state: State) -> None:
    """Write the state's parts below ``folder``; a part that is there already is replaced, others stay unread."""
    for name in ("classes", "moments", "products"):
        getattr(state, name).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/{name}")


def read_state(spark: SparkSession, folder: str) -> State:
    """What ``add_parts`` has written below ``folder`` so far."""
    return State(*[spark.read.parquet(f"{folder}/{name}") for name in ("classes", "moments", "products")])


# ------------------------------------------------------------------ profile

def _rows(df: DataFrame, section: str, feature, other, cls, metrics: dict[str, Column]) -> DataFrame:
    null = F.lit(None).cast("string")
    pick = lambda c: null if c is None else F.col(c).cast("string")
    return df.select(F.lit(section).alias("section"), pick(feature).alias("feature"), pick(other).alias("other"), pick(cls).alias("class"),
                     F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])).alias("x")).select(
        "section", "feature", "other", "class", "x.metric", "x.value")


def _moment_metrics() -> dict[str, Column]:
    n, m2, m3, m4 = (F.col(c).cast("double") for c in ("n", "m2", "m3", "m4"))
    std = F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))
    some = C.varies(m2, F.col("mean"), n)
    g1 = F.when((n > 2) & some, F.sqrt(n * (n - 1)) / (n - 2) * F.sqrt(n) * m3 / F.pow(m2, 1.5))
    g2 = F.when((n > 3) & some, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6))
    return {"n": n, "missing": F.col("missing"), "mean": F.col("mean"), "std": std, "min": F.col("min"), "max": F.col("max"), "skewness": g1, "kurtosis": g2}


def profile(state: State, label: str) -> DataFrame:
    """The profile as long rows (section, feature, other, class, metric, value), all exact.

    Sections: ``table`` (rows, positive rate), ``class`` (rows, share), ``column`` and ``class_column``
    (count, missing, mean, std, min, max, bias-corrected skewness and kurtosis), ``correlation``
    of every pair and ``class_correlation`` of each feature with the label.
    """
    per_class = state.classes.groupBy("class").agg(F.sum("n").alias("n"))
    total = Window.partitionBy(F.lit(0))  # a row a class
    shares = per_class.withColumn("share", F.col("n") / F.sum("n").over(total))
    table = per_class.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("class").isNotNull(), F.col("n") * F.col("class"))).alias("positive"), F.sum(F.when(F.col("class").isNotNull(), F.col("n"))).alias("known"))
    pairs = C.joined_products(state.products, ["feature_a", "feature_b"]).withColumn("corr", C.pearson())
    own = pairs.where((F.col("feature_a") != label) & (F.col("feature_b") != label))
    with_label = pairs.where((F.col("feature_a") == label) | (F.col("feature_b") == label)).withColumn("feature", F.when(F.col("feature_a") == label, F.col("feature_b")).otherwise(F.col("feature_a")))
    parts = [_rows(table, "table", None, None, None, {"n_rows": F.col("n"), "positive_rate": F.try_divide(F.col("positive"), F.col("known"))}),
             _rows(shares, "class", None, None, "class", {"n_rows": F.col("n"), "share": F.col("share")}),
             _rows(joined_moments(state.moments, ["feature"]), "column", "feature", None, None, _moment_metrics()),
             _rows(joined_moments(state.moments, ["class", "feature"]), "class_column", "feature", None, "class", _moment_metrics()),
             _rows(own, "correlation", "feature_a", "feature_b", None, {"corr": F.col("corr")}),
             _rows(with_label, "class_correlation", "feature", None, None, {"corr": F.col("corr")})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_quantiles(state: State, probs: list[float], by_class: bool = False) -> DataFrame:
    """(feature, [class], p, q): quantiles from the merged sketches, each within ``RANK_ERROR`` of its rank."""
    keys = ["class", "feature"] if by_class else ["feature"]
    merged = joined_moments(state.moments, keys).where("n > 0")
    pairs = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("q")) for p in probs]
    return merged.select(*keys, F.explode(F.array(*pairs)).alias("x")).select(*keys, "x.p", "x.q")


def quantile_ranks(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """(feature, p, below, upto, n): how many of a feature's values lie below, and up to, each of its ``quantiles``
    (``feature, p, q``, some a feature), from one pass over Arrow batches."""
    asked = [(r["feature"], r["p"], r["q"]) for r in quantiles.collect()]  # a row a feature and prob
    features = sorted({f for f, _, _ in asked})

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(asked), 3), np.int64)
        for b in it:
            held = {}
            for i, f in enumerate(features):
                x = b.column(i).drop_null().to_numpy()
                held[f] = x[~np.isnan(x)]
            total += np.array([(np.count_nonzero(held[f] < q), np.count_nonzero(held[f] <= q), len(held[f])) for f, _, q in asked], np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in asked], pa.string()), pa.array([p for _, p, _ in asked], pa.float64()), *map(pa.array, total.T.copy())], names=["feature", "p", "below", "upto", "n"])

    counts = df.select(*[F.col(f"`{f}`").cast("double").alias(f"_{i}") for i, f in enumerate(features)]).mapInArrow(batches, "feature string, p double, below bigint, upto bigint, n bigint")
    return counts.groupBy("feature", "p").agg(*[F.sum(c).alias(c) for c in ("below", "upto", "n")]).where("n > 0")
