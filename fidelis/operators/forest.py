"""Isolation forest (O4): fit on the real side, share of candidate rows flagged.

Plan:

1. Per-tree training samples (``max_samples`` rows each, without replacement) are
   drawn by a per-(row, tree) hash: a row is a candidate for tree ``t`` when its hash is
   below ``4 * max_samples / N`` (oversampling), then the ``max_samples`` smallest hashes
   per tree are kept.  The training set is bounded by ``trees * max_samples`` rows
   whatever the table size; no row is replicated more than its hits.
2. The trees are a table, grown level by level: one grouped aggregate over the points of all
   trees gives a level's nodes, whose splits are hashes of (tree, node).
3. The node table (<= trees * (2 * max_samples - 1) rows, a proven bound) is collected
   and broadcast; an Arrow ``pandas_udf`` scores rows batch-wise with numpy.
4. The cut-off is the ``contamination`` quantile of the real rows' scores, computed
   with the exact distributed quantile; candidate rows scoring below it are outliers.

Scores follow the usual definition: s(x) = -2^(-E[h(x)] / c(max_samples)), with
h the depth reached plus c(size) of the leaf and c(n) = 2 H(n-1) - 2 (n-1)/n, rounded to 9
places.  Draws and splits are integer arithmetic, so SQL gives the same forest; they
differ from other implementations, with which equality is statistical.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis import config
from fidelis.functions.columns import clean
from fidelis.operators.frames import attach, exact_quantiles, spread
from fidelis.session import checkpoint_dir

EULER_GAMMA = 0.5772156649015329


def average_path_length(n) -> np.ndarray:
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


#: Modulus of the hashes below; squares of residues fit 64 bits, so SQL can recompute them.
PRIME = 2147483647


def _uniform(tree, node, which: int, seed: int):
    """A number in [0, 1) from (tree, node): integer arithmetic modulo ``PRIME`` with two squarings."""
    x = (tree * 1024 + node + 1) * 48271 + which * 16807 + seed
    for add in (12345, 67891):
        x = F.pmod(x, F.lit(PRIME).cast("long"))
        x = x * x + add
    return F.pmod(x, F.lit(PRIME).cast("long")) / F.lit(float(PRIME))


def training_sample(real: DataFrame, features: list[str], trees: int, max_samples: int, seed: int,
                    id_col: str | None = None, n: int | None = None) -> DataFrame:
    """``(tree, features...)``: ``max_samples`` rows per tree (all rows if fewer), drawn without replacement.

    A hash of (row, tree) decides about each row and tree by itself, so samples may overlap as in
    the usual algorithm: the rows of the smallest hashes; about four times as many reach that last step.
    The id should be spread like a hash (its residue is what is hashed).  A missing value counts as 0.
    """
    n = real.count() if n is None else n
    below = min(PRIME, int(4.0 * max_samples / max(n, 1) * PRIME) + 1)
    key = F.col(f"`{id_col}`") if id_col else F.xxhash64(*[F.col(f"`{f}`") for f in features])
    base = real.select(F.pmod(key.cast("long"), F.lit(PRIME)).cast("long").alias("_k"), key.alias("_id"),
                       *[F.coalesce(clean(F.col(f"`{f}`").cast("double")), F.lit(0.0)).alias(f) for f in features])

    # (k a + b) modulo PRIME with a tree's own a and b, which are the same for all rows
    own = [(1 + ((t + 1) * 1103515245 + seed * 12345) % (PRIME - 1), ((t + 1) * 1664525013 + seed) % PRIME) for t in range(trees)]
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for t, (a, b) in enumerate(own)])
    hits = F.filter(table, lambda x: (F.col("_k") * x.a + x.b) % PRIME < F.lit(below))
    cand = base.select("_k", "_id", *features, F.explode(hits).alias("x")).select("_id", *features, F.col("x.t").alias("tree"), ((F.col("_k") * F.col("x.a") + F.col("x.b")) % PRIME).alias("_h"))
    w = Window.partitionBy("tree").orderBy("_h", "_id")  # ~4 * max_samples rows per tree
    return cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_samples).select("tree", *features)


def _level(points: DataFrame, depth: int, max_depth: int, seed: int) -> DataFrame:
    """The nodes of one level from one grouped aggregate over the points in them.

    A node of two points or more that differ in a feature is split: the feature (among those that
    differ) and the place between its least and greatest value follow from hashes of (tree, node).
    """
    ranges = points.select("tree", "node", F.posexplode("v").alias("k", "x")).groupBy("tree", "node", "k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("size"))
    usable = F.array_sort(F.collect_list(F.when(F.col("hi") > F.col("lo"), F.struct("k", "lo", "hi"))))  # a feature each at most
    g = ranges.groupBy("tree", "node").agg(F.max("size").alias("size"), usable.alias("u"))
    g = g.select("tree", "node", "size", "u", _uniform(F.col("tree").cast("long"), F.col("node").cast("long"), 1, seed).alias("u1"),
                 _uniform(F.col("tree").cast("long"), F.col("node").cast("long"), 2, seed).alias("u2"))
    split = (F.lit(depth) < max_depth) & (F.col("size") > 1) & (F.size("u") > 0)
    pick = F.try_element_at("u", F.floor(F.col("u1") * F.size("u")).cast("int") + 1)
    g = g.select("tree", "node", "size", split.alias("split"), pick.alias("x"), "u2")
    return g.select("tree", "node", F.when(F.col("split"), F.col("x.k")).otherwise(-1).alias("feature"),
                    F.when(F.col("split"), F.col("x.lo") + F.col("u2") * (F.col("x.hi") - F.col("x.lo"))).otherwise(0.0).alias("threshold"),
                    F.when(F.col("split"), F.col("node") * 2).otherwise(-1).alias("left_child"), F.when(F.col("split"), F.col("node") * 2 + 1).otherwise(-1).alias("right_child"),
                    "size", F.lit(depth).alias("depth"), (~F.col("split")).alias("is_leaf"))


def fit_forest(real: DataFrame, features: list[str], trees: int = config.FOREST_TREES,
               max_samples: int = config.FOREST_SAMPLE, seed: int = config.FOREST_SEED,
               id_col: str | None = None, n: int | None = None) -> tuple[DataFrame, int]:
    """Node table of the forest and the effective sample size per tree.

    All trees grow together, a level a step: one aggregate gives the level's nodes, which are written
    to the shared folder; the points find their next node through a join with them (``trees`` * 2 ** depth rows
    at most, so it is broadcast).  Nodes are numbered as a heap from 1.
    """
    spark = real.sparkSession
    n = real.count() if n is None else n
    m = int(min(max_samples, n))
    folder = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    sample = training_sample(real, features, trees, m, seed, id_col, n).select("tree", F.array(*[F.col(f"`{f}`") for f in features]).alias("v"))
    sample.write.parquet(f"{folder}/sample")
    points = spark.read.schema(sample.schema).parquet(f"{folder}/sample").withColumn("node", F.lit(1))
    max_depth = int(math.ceil(math.log2(max(max_samples, 2))))
    levels = []
    for depth in range(max_depth + 1):
        level = _level(points, depth, max_depth, seed)
        level.write.parquet(f"{folder}/level-{depth}")
        nodes = spark.read.schema(level.schema).parquet(f"{folder}/level-{depth}")
        levels.append(nodes)
        inner = nodes.where("NOT is_leaf").select("tree", "node", "feature", "threshold")
        if depth == max_depth or not inner.take(1):
            break
        side = F.when(F.col("v")[F.col("feature")] < F.col("threshold"), 0).otherwise(1)
        points = points.join(F.broadcast(inner), ["tree", "node"]).select("tree", "v", (F.col("node") * 2 + side).alias("node"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out, m


def score_column(nodes_pdf: pd.DataFrame, features: list[str], m: int):
    """An Arrow-batched scorer over the (broadcast) node table.

    All trees are walked at once: node ids are flattened to ``tree * width + node``, a
    leaf points to itself, so one step per depth level is five ``take`` gathers."""
    nodes_pdf = nodes_pdf.sort_values(["tree", "node"])
    trees = sorted(nodes_pdf["tree"].unique())
    n_t = max(len(trees), 1)
    width = int(nodes_pdf["node"].max()) + 1 if len(nodes_pdf) else 1
    pos = {t: i for i, t in enumerate(trees)}
    ti = nodes_pdf["tree"].map(pos).to_numpy().astype(np.int64)
    ni = nodes_pdf["node"].to_numpy().astype(np.int64)
    flat = ti * width + ni
    size = n_t * width
    feat = np.zeros(size, dtype=np.int64)
    thr = np.zeros(size)
    left = np.arange(size, dtype=np.int64)   # unused slots and leaves loop on themselves
    right = np.arange(size, dtype=np.int64)
    path = np.zeros(size)
    is_leaf = nodes_pdf["is_leaf"].to_numpy()
    inner = ~is_leaf
    feat[flat[inner]] = nodes_pdf["feature"].to_numpy()[inner]
    thr[flat[inner]] = nodes_pdf["threshold"].to_numpy()[inner]
    left[flat[inner]] = ti[inner] * width + nodes_pdf["left_child"].to_numpy()[inner]
    right[flat[inner]] = ti[inner] * width + nodes_pdf["right_child"].to_numpy()[inner]
    path[flat] = nodes_pdf["depth"].to_numpy() + average_path_length(nodes_pdf["size"].to_numpy())
    levels = int(nodes_pdf["depth"].max()) if len(nodes_pdf) else 0
    denom = float(average_path_length([m])[0]) or 1.0
    roots = (np.arange(n_t, dtype=np.int64) * width + 1)[None, :]  # heap numbers begin with 1
    d = len(features)

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])).ravel()
        n = len(cols[0])
        rowbase = (np.arange(n, dtype=np.int64) * d)[:, None]
        idx = np.broadcast_to(roots, (n, n_t)).copy()
        for _ in range(levels):
            go_left = x.take(rowbase + feat.take(idx)) < thr.take(idx)
            idx = np.where(go_left, left.take(idx), right.take(idx))
        mean_h = path.take(idx).mean(axis=1) if trees else np.zeros(n)
        return pd.Series(np.round(-np.power(2.0, -mean_h / denom), 9))  # equal paths stay equal whatever the order of the sum

    # marked non-deterministic only so that the optimizer never copies the call into a pushed
    # filter (which would score every row twice); the scores themselves are deterministic
    return score.asNondeterministic()(*[clean(F.col(f"`{f}`").cast("double")) for f in features])


def isolation_forest_scores(real: DataFrame, candidate: DataFrame, features: list[str],
                            trees: int = config.FOREST_TREES, max_samples: int = config.FOREST_SAMPLE,
                            contamination: float = config.FOREST_CONTAMINATION, seed: int = config.FOREST_SEED,
                            id_col: str | None = None) -> DataFrame:
    """Candidate rows with ``score`` and ``is_outlier`` (score below the real-side cut-off)."""
    nodes, m = fit_forest(real, features, trees, max_samples, seed, id_col)
    nodes_pdf = nodes.toPandas()  # bounded: trees * (2 * max_samples - 1) rows
    real_scores = spread(real).select(score_column(nodes_pdf, features, m).alias("score"))
    cut = exact_quantiles(real_scores, [], "score", [contamination]).select(F.col("q").alias("offset"))
    cand = spread(candidate).withColumn("score", score_column(nodes_pdf, features, m))
    return attach(cand, cut).withColumn("is_outlier", F.col("score") < F.col("offset"))


def isolation_forest_test(real: DataFrame, candidate: DataFrame, features: list[str],
                          threshold: float = config.FOREST_RATE_THRESHOLD, **kw) -> DataFrame:
    """O4 as a test row: share of candidate rows flagged, passed iff below ``threshold``."""
    s = isolation_forest_scores(real, candidate, features, **kw)
    a = s.agg(F.count_if("is_outlier").alias("outlier_count"), F.count(F.lit(1)).alias("total_records"))
    rate = F.col("outlier_count") / F.greatest(F.col("total_records"), F.lit(1))
    return a.select(F.lit("isolation_forest").alias("test_name"), F.lit("multivariate").alias("feature"),
                    (rate < threshold).alias("passed"), rate.alias("statistic"), F.lit(float(threshold)).alias("threshold"),
                    F.lit(None).cast("double").alias("p_value"), "outlier_count", "total_records")
