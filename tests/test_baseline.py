"""Mergeable baseline states: A joined with B is the profile of A and B."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators import baseline as B

FEATURES = ["x", "y", "z", "same"]
SCHEMA = "day string, x double, y double, z double, same double, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for k in range(900):
        x = float(1e6 + rng.normal())
        out.append((f"d{k % 3}" if k < 880 else "small", x, float(rng.exponential()) if k % 7 else None, float("nan") if k % 11 == 0 else 2 * x + float(rng.normal()), 5.0, int(k % 5 == 0) if k % 50 else None))
    return out


def collected(df):
    return {(r.section, r.feature, r.other, r["class"], r.metric): r.value for r in df.collect()}


def same(a, b):
    assert set(a) == set(b)
    for k, v in a.items():
        assert (v is None) == (b[k] is None), k
        if v is not None:
            assert v == pytest.approx(b[k], rel=1e-6, abs=1e-6), k


def test_profile_of_parts_is_that_of_the_whole(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = collected(B.profile(B.part_state(df, FEATURES, "label", F.lit("all")), "label"))
    folder = str(tmp_path / "state")
    for days in (["d0", "d1"], ["small"], ["d2"]):
        B.add_parts(folder, B.part_state(df.where(F.col("day").isin(days)), FEATURES, "label", F.col("day")))
    state = B.read_state(spark, folder)
    assert {r.part for r in state.classes.select("part").distinct().collect()} == {"d0", "d1", "d2", "small"}
    same(whole, collected(B.profile(state, "label")))


def test_profile_equals_numpy(spark, rows):
    got = collected(B.profile(B.part_state(spark.createDataFrame(rows, SCHEMA), FEATURES, "label", F.col("day")), "label"))
    data = {c: np.array([np.nan if r[k] is None else r[k] for r in rows], float) for k, c in enumerate(["x", "y", "z", "same", "label"], 1)}
    assert got["table", None, None, None, "n_rows"] == 900
    assert got["table", None, None, None, "positive_rate"] == pytest.approx(np.nanmean(data["label"]))
    for c in FEATURES:
        v = data[c][~np.isnan(data[c])]
        n = len(v)
        assert got["column", c, None, None, "n"] == n and got["column", c, None, None, "missing"] == 900 - n
        assert got["column", c, None, None, "mean"] == pytest.approx(v.mean()) and got["column", c, None, None, "std"] == pytest.approx(v.std(ddof=1), abs=1e-9)
        m2, m3, m4 = (((v - v.mean()) ** k).mean() for k in (2, 3, 4))
        if m2 > 0:
            assert got["column", c, None, None, "skewness"] == pytest.approx(m3 / m2 ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2), rel=1e-6, abs=1e-6)
            assert got["column", c, None, None, "kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6), rel=1e-6, abs=1e-6)
        else:
            assert got["column", c, None, None, "skewness"] is None
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        both = ~np.isnan(data[a]) & ~np.isnan(data[b])
        assert got["correlation", a, b, None, "corr"] == pytest.approx(np.corrcoef(data[a][both], data[b][both])[0, 1], abs=1e-9)
    assert got["correlation", "x", "same", None, "corr"] is None
    both = ~np.isnan(data["y"]) & ~np.isnan(data["label"])
    assert got["class_correlation", "y", None, None, "corr"] == pytest.approx(np.corrcoef(data["y"][both], data["label"][both])[0, 1], abs=1e-9)


def test_a_part_added_again_replaces_itself(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "state")
    B.add_parts(folder, B.part_state(df, FEATURES, "label", F.col("day")))
    before = collected(B.profile(B.read_state(spark, folder), "label"))
    B.add_parts(folder, B.part_state(df.where("day = 'd1'"), FEATURES, "label", F.col("day")))
    same(before, collected(B.profile(B.read_state(spark, folder), "label")))
    B.add_parts(folder, B.part_state(df.where("day = 'd1'").limit(10), FEATURES, "label", F.col("day")))
    assert collected(B.profile(B.read_state(spark, folder), "label"))["table", None, None, None, "n_rows"] == 900 - 293 - (1 if sum(r[0] == "d1" for r in rows) == 294 else 0) + 10


def test_quantiles_stay_within_the_error(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.lognormal(size=30_000), np.full(15_000, 3.0)])
    rng.shuffle(v)
    df = spark.createDataFrame([(f"p{k % 9}", float(x), 0) for k, x in enumerate(v)], "day string, v double, label int")
    state = B.part_state(df, ["v"], "label", F.col("day"))
    v.sort()
    for r in B.profile_quantiles(state, [0.0, 0.1, 0.5, 0.9, 0.999]).collect():
        low, high = np.searchsorted(v, r.q, "left") / len(v), np.searchsorted(v, r.q, "right") / len(v)
        assert low - B.RANK_ERROR <= r.p <= high + B.RANK_ERROR
    assert {r["class"] for r in B.profile_quantiles(state, [0.5], by_class=True).collect()} == {0}


def test_empty_table(spark):
    state = B.part_state(spark.createDataFrame([], SCHEMA), FEATURES, "label", F.col("day"))
    assert state.moments.count() == 0 and B.profile_quantiles(state, [0.5]).count() == 0
    got = collected(B.profile(state, "label"))
    assert all(not v for v in got.values())


def test_state_without_copies_of_rows(spark):
    rows = [(p, None if i % 7 == 0 else i % 2, float(i * i % 101), None if i % 3 else i / 10) for p in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "p string, k int, x double, y double").repartition(5)
    moments = B.part_state(df, ["x", "y"], "k", F.col("p")).moments
    assert "Expand" not in moments._jdf.queryExecution().toString()  # rows were copied once a feature
    got = {(r["part"], r["class"], r["feature"]): r for r in moments.collect()}
    assert len(got) == 2 * 3 * 2
    for (p, k, f), r in got.items():
        v = np.array([row[2 if f == "x" else 3] for row in rows if row[0] == p and row[1] == k and row[2 if f == "x" else 3] is not None])
        d = v - v.mean()
        assert r["n"] == len(v) and r["missing"] == sum(row[0] == p and row[1] == k for row in rows) - len(v) and (r["min"], r["max"]) == (v.min(), v.max())
        np.testing.assert_allclose([r["mean"], r["m2"], r["m3"], r["m4"]], [v.mean(), (d ** 2).sum(), (d ** 3).sum(), (d ** 4).sum()], rtol=1e-9, atol=1e-6)
    q = spark.createDataFrame([("x", 0.5, 50.0), ("y", 0.1, 2.1), ("y", 0.9, -1.0)], "feature string, p double, q double")
    ranks = {(r["feature"], r["p"]): tuple(r)[2:] for r in B.quantile_ranks(df, q).collect()}
    for f, p, x in [tuple(r) for r in q.collect()]:
        v = np.array([row[2 if f == "x" else 3] for row in rows if row[2 if f == "x" else 3] is not None])
        assert ranks[f, p] == ((v < x).sum(), (v <= x).sum(), len(v))
