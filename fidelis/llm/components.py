"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.session import cut_lineage


def _toward_smallest(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
    return both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    linked = edges.join(low, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns u, v); a component is named by its smallest node.

    Every step keeps the components and moves edges to smaller nodes until all point to the
    smallest one; minima are combined before each shuffle and each round is checkpointed, so
    a lost executor costs one round at most.  Raises if it has not settled in ``most_rounds``.
    """
    def size(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = cut_lineage(_toward_smallest(edges))
    state = size(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = cut_lineage(_toward_smallest(_small_star(_toward_smallest(_large_star(edges)))))
        before, state = state, size(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
