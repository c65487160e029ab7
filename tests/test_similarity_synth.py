"""Nearest neighbours, scaling, generation and the forest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators import similarity as S
from fidelis.operators import synth as G


def test_blocked_nn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(57, 6))
    r = rng.normal(size=(83, 6))
    c[3] = 0.0  # zero vector -> similarity 0
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "id long, v array<double>")
    rdf = spark.createDataFrame([(1000 + i, [float(x) for x in v]) for i, v in enumerate(r)], "id long, v array<double>")
    got = {row.id: (row.ref_id, row.similarity) for row in S.nn_search(cdf, rdf, "id", "id", "v", k=1, block_rows=10).collect()}
    cn = c / np.where(np.linalg.norm(c, axis=1, keepdims=True) == 0, 1, np.linalg.norm(c, axis=1, keepdims=True))
    rn = r / np.linalg.norm(r, axis=1, keepdims=True)
    sims = cn @ rn.T
    for i in range(len(c)):
        assert got[i][1] == pytest.approx(sims[i].max(), abs=1e-12)
        if i != 3:
            assert got[i][0] == 1000 + int(np.argmax(sims[i]))
    assert got[3][1] == 0.0


def test_result_does_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(8)
    cdf = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(30)], "id long, v array<double>")
    rdf = spark.createDataFrame([(100 + i, [float(x) for x in rng.normal(size=5)]) for i in range(200)],
                                "id long, v array<double>").repartition(4)
    probe = sorted(map(tuple, S.nn_search(cdf, rdf, "id", "id", "v", k=2).collect()))
    blocked = sorted(map(tuple, S.nn_search(cdf, rdf, "id", "id", "v", k=2, block_rows=8).collect()))
    assert len(probe) == 60
    for a, b in zip(probe, blocked):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-12)


def test_top_k_is_ordered(spark):
    rng = np.random.default_rng(6)
    cdf = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(9)], "id long, v array<double>")
    rdf = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)], "id long, v array<double>")
    out = S.nn_search(cdf, rdf, "id", "id", "v", k=3, block_rows=7).orderBy("id", "rank").collect()
    for i in range(9):
        sims = [r.similarity for r in out if r.id == i]
        assert len(sims) == 3 and sims == sorted(sims, reverse=True)


def test_standard_scale_uses_population_std(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], "a double")
    out = [r.a for r in S.standard_scale(df, df, ["a"]).collect()]
    v = np.array([1, 2, 3, 4.0])
    assert out == pytest.approx(list((v - v.mean()) / v.std()))


def test_sample_is_exact_size_and_partition_independent(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    a = {r.row_id for r in S.sample_rows(df.repartition(1), "row_id", 20, 42).collect()}
    b = {r.row_id for r in S.sample_rows(df.repartition(7), "row_id", 20, 42).collect()}
    assert len(a) == 20 and a == b


def test_bootstrap_exact_class_counts(spark):
    real = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("Class"),
                                   (F.col("id") * 1.5).alias("Amount"))
    out = G.stratified_bootstrap(real, 1000, 0.1, 7, "row_id", "Class")
    counts = {r.Class: r["count"] for r in out.groupBy("Class").count().collect()}
    assert counts == {0: 900, 1: 100}
    src = {r.row_id: r for r in real.collect()}
    for r in out.limit(50).collect():
        assert src[r.source_row_id].Class == r.Class


def test_bootstrap_by_counts(spark):
    """Exact totals, gapless ids, rows of their class, counts like independent draws, the same whatever the partitions."""
    real = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("Class"), (F.col("id") * 1.5).alias("Amount"), F.lit("x").alias("_draws2"))
    out = G.bootstrap_by_counts(real.repartition(3), 5000, 0.1, 7, "row_id", "Class", range_rows=100)
    rows = out.collect()
    assert out.columns == ["row_id", "Amount", "_draws2", "Class", "source_row_id"]
    assert sorted(r.row_id for r in rows) == list(range(5000)) and sum(r.Class for r in rows) == 500
    assert all(r.Amount == r.source_row_id * 1.5 and r.Class == int(r.source_row_id % 10 == 0) for r in rows)
    again = G.bootstrap_by_counts(real.repartition(11), 5000, 0.1, 7, "row_id", "Class", range_rows=100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    counts = np.zeros(3000)
    for r in rows:
        counts[r.source_row_id] += 1
    negative = counts[np.arange(3000) % 10 != 0]
    assert abs(negative.mean() - 4500 / 2700) < 1e-9 and 0.8 < negative.var() / negative.mean() < 1.2  # a Poisson-like spread, also across ranges
    assert abs((negative == 0).mean() - np.exp(-4500 / 2700)) < 0.03
    with pytest.raises(ValueError):
        G.bootstrap_by_counts(real.where("Class = 0"), 10, 0.5, 1, "row_id", "Class")


def test_class_conditions_truncate(spark):
    df = G.class_conditions(spark, 100000, 0.0017274856)
    assert df.where("Class = 1").count() == 172


def test_shuffle_is_a_permutation(spark):
    df = spark.range(200).withColumnRenamed("id", "row_id")
    pos = sorted(r.position for r in G.shuffle_rows(df, "row_id", 3).collect())
    assert pos == list(range(200))


def test_forest_flags_about_the_contamination_share(spark):
    from fidelis.operators.forest import isolation_forest_scores
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    s = isolation_forest_scores(df, df, ["a", "b", "c"], trees=30, id_col="id")
    share = s.agg(F.avg(F.col("is_outlier").cast("double"))).first()[0]
    assert 0.005 <= share <= 0.02
    far = spark.createDataFrame([(99999, 8.0, 8.0, 8.0)], "id long, a double, b double, c double")
    assert isolation_forest_scores(df, far, ["a", "b", "c"], trees=30, id_col="id").first().is_outlier


def test_a_pool_is_numbered_once_for_all_seeds(spark, monkeypatch):
    """Regenerated tables are those of the seed alone, whichever columns go along and whoever numbered the pool."""
    real = spark.createDataFrame([(i, i % 3 // 2, float(i), float(i * i % 7), float(i)) for i in range(60)], "id long, c int, t double, a double, more double")
    few = real.select("id", "t", "a", "c")

    def tables(pool, numbered=None):
        made = (G.generate_synthetic(pool, 40, 0.3, seed, "id", "c", ["a"], "a", "t", numbered=numbered) for seed in (1, 2))
        return [sorted(map(tuple, m.select("id", "c", F.round("t", 9), F.round("a", 9)).collect())) for m in made]

    whole = tables(real)
    numbered = G.number_pool(few, "id", "c")
    monkeypatch.setattr(G, "dense_index", None)
    assert tables(few, numbered) == whole
