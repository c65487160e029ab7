"""Distribution, correlation, quantile and outlier operators against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators import corr as C
from fidelis.operators import dist as D
from fidelis.operators import outlier as O
from fidelis.operators.frames import exact_quantiles, dense_index


def ks_np(a, b):
    a, b = np.sort(a), np.sort(b)
    allv = np.concatenate([a, b])
    fa = np.searchsorted(a, allv, side="right") / len(a)
    fb = np.searchsorted(b, allv, side="right") / len(b)
    return np.max(np.abs(fa - fb))


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(0, 1, 700), 2)
    b = np.round(rng.normal(0.2, 1.3, 500), 2)
    ra = spark.createDataFrame([(float(x), float(x) * 2 + 1) for x in a], "x double, y double")
    rb = spark.createDataFrame([(float(x), float(-x)) for x in b], "x double, y double")
    return a, b, ra, rb


def test_ks_matches_numpy_with_ties(spark, samples):
    a, b, ra, rb = samples
    got = D.ks_two_sample(ra, rb, ["x"]).collect()[0]
    assert got.statistic == pytest.approx(ks_np(a, b), abs=1e-12)
    assert got.n_real == 700 and got.n_candidate == 500
    assert 0.0 <= got.p_value <= 1.0


def test_ks_identity_and_symmetry(spark, samples):
    _, _, ra, rb = samples
    assert D.ks_two_sample(ra, ra, ["x"]).collect()[0].statistic == 0.0
    s1 = D.ks_two_sample(ra, rb, ["x"]).collect()[0].statistic
    s2 = D.ks_two_sample(rb, ra, ["x"]).collect()[0].statistic
    assert s1 == pytest.approx(s2)


def test_running_sums_do_not_depend_on_the_partitions(spark, samples):
    a, b, ra, rb = samples
    before = spark.conf.get("spark.sql.shuffle.partitions")
    v = spark.createDataFrame([(float(x),) for x in b], "value double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    try:
        for parts in ("3", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert D.ks_two_sample(ra.repartition(5), rb, ["x"]).collect()[0].statistic == pytest.approx(ks_np(a, b), abs=1e-12)
            got = {r.p: r.q for r in exact_quantiles(v, [], "value", probs).collect()}
            assert all(got[p] == pytest.approx(np.percentile(b, p * 100), abs=1e-9) for p in probs)
            assert sorted(r.idx for r in dense_index(spark.range(3000), "id", []).collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_quantiles_match_numpy_linear(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.exponential(3, 999), 1)  # many duplicates
    df = spark.createDataFrame([(float(x),) for x in v], "value double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.p: r.q for r in exact_quantiles(df, [], "value", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(v, p * 100), abs=1e-9)


def test_dense_index_is_a_permutation(spark):
    df = spark.range(0, 1000, 3).withColumn("g", F.col("id") % 2)
    out = dense_index(df, "id", ["g"]).collect()
    for g in (0, 1):
        idx = sorted(r.idx for r in out if r.g == g)
        assert idx == list(range(len(idx)))


def test_js_distance_matches_numpy(spark, samples):
    a, b, ra, rb = samples
    got = D.js_distance(ra, rb, ["x"]).collect()[0].statistic
    bins = np.linspace(a.min(), a.max(), 51)
    p, _ = np.histogram(a, bins=bins, density=True)
    q, _ = np.histogram(b, bins=bins, density=True)
    p, q = p + 1e-10, q + 1e-10
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    js = np.sqrt((np.sum(p * np.log(p / m)) + np.sum(q * np.log(q / m))) / 2)
    assert got == pytest.approx(js, rel=1e-9)


def test_correlations_and_frobenius(spark, samples):
    a, b, ra, rb = samples
    long = {(r.feature_a, r.feature_b): r.corr for r in C.corr_long(ra, ["x", "y"]).collect()}
    assert long[("x", "y")] == pytest.approx(1.0)
    fro = C.corr_frobenius(ra, rb, ["x", "y"]).collect()[0]
    assert fro.statistic == pytest.approx(np.sqrt(2 * 2.0 ** 2) / np.sqrt(2))
    assert not fro.passed


def test_constant_column_correlation_is_undefined_not_an_error(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, x double")
    r = C.corr_long(df, ["c", "x"]).collect()[0]
    assert r.corr is None
    fro = C.corr_frobenius(df, df, ["c", "x"]).collect()[0]
    assert not fro.passed


def test_constant_columns_over_many_tasks_and_large_means(spark):
    """A constant that no sum holds exactly stays constant; a small spread on a large mean does not."""
    rng = np.random.default_rng(4)
    rows = [(0.1, float(1e9 + x), float(x), None if k % 2 else float(x)) for k, x in enumerate(rng.normal(size=1000))]
    df = spark.createDataFrame(rows, "c double, big double, x double, half double").repartition(7)
    got = {(r.feature_a, r.feature_b): r.corr for r in C.corr_long(df, ["c", "big", "x", "half"]).collect()}
    assert got["c", "big"] is None and got["c", "x"] is None and len(got) == 6
    assert got["big", "x"] == pytest.approx(1.0, abs=1e-6) and got["x", "half"] == pytest.approx(1.0)


def test_zscore_rate_and_nan_propagation(spark):
    vals = [0.0] * 200 + [100.0]
    df = spark.createDataFrame([(v, v) for v in vals] + [(0.0, float("nan"))], "a double, b double")
    out = {r.feature: r for r in O.zscore_outlier_rate(df, ["a", "b"]).collect()}
    assert out["a"].outlier_count == 1 and out["b"].outlier_count == 0 and out["b"].passed


def test_moment_comparison(spark, samples):
    a, b, ra, rb = samples
    out = {r.test_name: r.statistic for r in D.moment_comparison(ra, rb, ["x"]).collect()}
    assert out["mean_comparison"] == pytest.approx(abs(a.mean() - b.mean()) / (abs(a.mean()) + 1e-10))
    assert out["std_comparison"] == pytest.approx(abs(a.std(ddof=1) - b.std(ddof=1)) / (a.std(ddof=1) + 1e-10))


def test_value_counts_cross_the_pieces_of_a_task(spark, monkeypatch):
    """Values are counted once for all the pieces and tasks that hold them; null, NaN and the sign of zero do not matter."""
    monkeypatch.setattr(D, "COUNT_ROWS", 7)
    nan = float("nan")
    rows = [(float(i % 5), -0.0 if i % 2 else 0.0, None if i % 3 else nan) for i in range(100)]
    a = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    b = a.where("x < 2").withColumn("z", F.lit(1))
    got = sorted(map(tuple, D.value_counts(a, b, ["x", "y", "z"]).collect()))
    assert got == [("x", 0.0, 20, 20), ("x", 1.0, 20, 20), ("x", 2.0, 20, 0), ("x", 3.0, 20, 0), ("x", 4.0, 20, 0), ("y", 0.0, 100, 40), ("z", 1.0, 0, 40)]


def test_ks_over_many_ranges(spark, monkeypatch):
    """The statistic of ranges that know nothing of each other is that of all values; an empty side gives none."""
    monkeypatch.setattr(D, "COUNT_ROWS", 7)
    monkeypatch.setattr(D, "RANGE_ROWS", 16)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=230), np.round(rng.normal(0.3, 1.2, size=170), 1)
    a = spark.createDataFrame([(float(v), float(v > 0), None) for v in x], "x double, y double, z double").repartition(3)
    b = spark.createDataFrame([(float(v), 1.0, float("nan") if i % 2 else 5.0) for i, v in enumerate(y)], "x double, y double, z double").repartition(2)
    got = {r["feature"]: r for r in D.ks_statistics(a, b, ["x", "y", "z"]).collect()}
    assert len(D._range_ends(a, b, ["x", "y", "z"], D._totals(a, b, ["x", "y", "z"]))[0]) > 10
    at = np.unique(np.r_[x, y])
    far = np.abs(np.searchsorted(np.sort(x), at, side="right") * len(y) - np.searchsorted(np.sort(y), at, side="right") * len(x)).max()
    assert (got["x"]["n_a"], got["x"]["n_b"], got["x"]["gap"]) == (230, 170, far)
    assert got["x"]["statistic"] == pytest.approx(far / (230 * 170))
    assert got["y"]["statistic"] == pytest.approx((x <= 0).mean())
    assert (got["z"]["n_a"], got["z"]["n_b"], got["z"]["statistic"], got["z"]["gap"]) == (0, 85, None, None)


def test_column_stats_by_ranges(spark, monkeypatch):
    from fidelis.operators import frames as Fr
    from fidelis.operators import profile as P
    monkeypatch.setattr(D, "RANGE_ROWS", 64)
    rng = np.random.default_rng(5)
    x = np.round(rng.lognormal(3, 1, 3000), 2)
    y = np.where(rng.random(3000) < 0.5, 7.0, rng.normal(1e6, 1, 3000))
    rows = [(float(a), None if i % 5 == 0 else float(b), 0.1, None) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, c double, e double").repartition(7)
    names, probs = ["x", "y", "c", "e"], {"q25": 0.25, "median": 0.5, "q75": 0.75, "top": 1.0}
    got = {r["feature"]: r[1:] for r in D.column_quantiles(df, names, probs).collect()}
    long = Fr.long_form(df, names)
    want = {r["feature"]: tuple(r[k] for k in probs) for r in Fr.quantile_columns(long, ["feature"], "value", probs).collect()}
    assert {k: tuple(v) for k, v in got.items()} == want and set(want) == {"x", "y", "c"}
    stats = {r["feature"]: r for r in P.column_stats(df, names).collect()}
    old = {r["feature"]: r for r in long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
                                                                F.skewness("value").alias("g1")).collect()}
    for f, r in old.items():
        assert all(abs(stats[f][c] - r[c]) < 1e-5 for c in ("mean", "std", "min", "max"))
    n = len(x)
    assert abs(stats["x"]["skewness"] - old["x"]["g1"] * np.sqrt(n * (n - 1)) / (n - 2)) < 1e-5 and stats["c"]["skewness"] is None and stats["c"]["std"] == 0
    assert "Expand" not in P.column_stats(df, names)._jdf.queryExecution().toString()  # rows were copied once a feature


def test_corr_with_class_from_cross_products(spark):
    rng = np.random.default_rng(9)
    rows = [(float(v), None if i % 4 == 0 else float(v * v), 3.0, None if i % 9 == 0 else int(v > 0)) for i, v in enumerate(rng.normal(size=500))]
    df = spark.createDataFrame(rows, "x double, y double, c double, k int").repartition(3)
    found = C.corr_with_class(df, "k", ["x", "k", "y", "c"])
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # no aggregate over all features, whose code is too long to be compiled
    got = {r["feature"]: (r["corr"], r["rank_asc"]) for r in found.collect()}
    for at, f in ((0, "x"), (1, "y")):
        v = np.array([(r[at], r[3]) for r in rows if r[at] is not None and r[3] is not None])
        assert abs(got[f][0] - np.corrcoef(v.T)[0, 1]) < 1e-12
    assert got["c"] == (None, 3) and len(got) == 3


def test_columns_go_to_python_as_one_array(spark):
    """Of the KS counts, cross products and moments a row is sent as one value; the sample that says where ranges end is drawn before its columns are made."""
    from fidelis.operators import corr as C
    from fidelis.operators import dist as D
    from fidelis.operators import profile as P
    df = spark.range(1000).select(F.sqrt(F.col("id").cast("double")).alias("a"), F.when(F.col("id") % 3 > 0, F.ln(F.col("id") + 1)).alias("b"), F.lit(float("nan")).alias("c"))
    feats = ["a", "b", "c"]

    def plan(x):
        return x._sc._jvm.PythonSQLUtils.explainString(x._jdf.queryExecution(), "simple")

    for x, args in ((D._dealt([df], feats, [np.zeros(0)] * 3), 1), (C.cross_products(df, feats), 2), (P.moment_rows(df, feats), 1)):
        sent = next(line for line in plan(x).split("\n") if "MapInArrow" in line)
        assert sent.split("(", 1)[1].split(")", 1)[0].count("#") == args
    some = plan(D._sampled([df], [F.col(f) for f in feats], 0.5))
    assert some.index("SQRT") < some.index("rand(")  # the filter stands below
    m = {r["feature"]: r for r in P.joined_moments(P.moment_rows(df, feats), ["feature"]).collect()}
    assert [(m[f]["n"], m[f]["missing"]) for f in feats] == [(1000, 0), (666, 334), (0, 1000)]
    assert abs(m["a"]["mean"] - np.sqrt(np.arange(1000)).mean()) < 1e-9
