"""Exact Kolmogorov-Smirnov p-values against all arrangements of small samples."""

import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators import dist as D


def tail_by_enumeration(n, m, gap):
    hits = total = 0
    for first in itertools.combinations(range(n + m), n):
        a = np.zeros(n + m, int)
        a[list(first)] = 1
        ca = a.cumsum()
        total += 1
        hits += np.abs(ca * m - (np.arange(1, n + m + 1) - ca) * n).max() >= gap
    return Fraction(int(hits), total)


@pytest.mark.parametrize("n, m", [(1, 1), (3, 5), (4, 4), (6, 3), (7, 6), (2, 9)])
def test_tail_equals_enumeration(n, m):
    for gap in range(0, n * m + 1):
        assert D.exact_ks_tail(n, m, gap) == pytest.approx(float(tail_by_enumeration(n, m, gap)), abs=1e-14), gap


def test_known_tails():
    # equal sides of n rows that do not overlap: 2 / C(2n, n)
    assert D.exact_ks_tail(10, 10, 100) == pytest.approx(2 / 184756, rel=1e-12)
    # tiny tails keep their digits
    assert D.exact_ks_tail(60, 60, 3600) == pytest.approx(2 / 96614908840363322603893139521372656, rel=1e-9)
    assert D.exact_ks_tail(50, 80, 0) == 1.0


def test_exact_and_series_meet_for_large_sides(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=4000), rng.normal(0.03, 1, size=5000)
    real, cand = (spark.createDataFrame([(float(v),) for v in x], "v double") for x in (a, b))
    exact = D.ks_two_sample(real, cand, ["v"], details=False).first()
    D_ROWS, D.EXACT_ROWS = D.EXACT_ROWS, 10
    try:
        series = D.ks_two_sample(real, cand, ["v"], details=False).first()
    finally:
        D.EXACT_ROWS = D_ROWS
    assert exact.statistic == series.statistic and exact.p_value != series.p_value
    assert exact.p_value == pytest.approx(series.p_value, abs=0.01)


def test_p_value_of_small_sides(spark):
    real, cand = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "v double"), spark.createDataFrame([(float(v),) for v in (4, 6, 7, 8)], "v double")
    r = D.ks_two_sample(real, cand, ["v"], details=False).first()
    assert r.statistic == pytest.approx(0.75) and r.p_value == pytest.approx(float(tail_by_enumeration(5, 4, 15)), abs=1e-12)


def test_groups(spark):
    real = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("only", 1.0), (None, 1.0)], "g string, v double")
    cand = spark.createDataFrame([("a", 3.0), ("a", 4.0), ("b", 5.0), ("b", None), (None, 1.0)], "g string, v double")
    got = {r.g: r for r in D.ks_by_group(real, cand, "g", "v").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].statistic == 1.0 and got["a"].p_value == pytest.approx(2 / 6) and got["b"].statistic == 0.0 and got["b"].p_value == 1.0
    none = spark.createDataFrame([], "g string, v double")
    assert D.ks_by_group(real, none, "g", "v").count() == 0


def test_tails_of_many_tests_at_once():
    """Banded walks of tests of many sizes give each test's own share of lattice paths."""
    def all_points(n, m, gap):
        share = {}
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i * m - j * n) >= gap:
                    share[i, j] = 1.0
                else:
                    share[i, j] = (i * share.get((i - 1, j), 0.0) + j * share.get((i, j - 1), 0.0)) / max(1, i + j)
        return share[n, m]

    rng = np.random.default_rng(8)
    n, m = rng.integers(1, 40, 200), rng.integers(1, 40, 200)
    gap = np.minimum((rng.random(200) ** 2 * n * m).astype(np.int64) + rng.integers(0, 3, 200), n * m)
    want = [1.0 if g == 0 else all_points(a, b, g) for a, b, g in zip(n.tolist(), m.tolist(), gap.tolist())]
    assert D.exact_ks_tails(n, m, gap) == pytest.approx(want, rel=1e-12)


def test_tests_are_dealt_to_all_tasks(spark):
    """Rows of few bytes but much work do not end in one task."""
    rows = [(k, i % 7 + 0.1 * k) for k in range(60) for i in range(20)]
    a, b = (spark.createDataFrame([(k, v + d) for k, v in rows], "g int, v double") for d in (0.0, 0.5))
    out = D.ks_by_group(a, b, "g", "v").select("g", F.spark_partition_id().alias("p")).collect()
    assert len(out) == 60 and len({r.p for r in out}) > 1


def test_long_walks_stay_finite():
    """Places of a wide band that are no points of the lattice do not reach those that are."""
    n, m = np.array([3000, 900]), np.array([2900, 1100])
    with np.errstate(over="raise", invalid="raise"):
        near, far = D.exact_ks_tails(n, m, n * m // 20), D.exact_ks_tails(n, m, n * m // 3)
    series = 2 * sum((-1) ** (k - 1) * np.exp(-2.0 * k * k * 0.05 ** 2 * n * m / (n + m)) for k in range(1, 50))
    assert near == pytest.approx(series, rel=0.1) and (far < 1e-20).all() and (far >= 0).all()
