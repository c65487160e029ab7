"""Invariants and edge cases: bands partition the features, valid + invalid = total,
results independent of the shuffle partitioning, empty / constant / one-class inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fidelis.operators import dist as D
from fidelis.operators import profile as P
from fidelis.operators import rules as R
from fidelis.operators.frames import exact_quantiles
from tests.conftest import SF_SMALL


def test_bands_partition_the_features(spark):
    import __spark_entry__ as E
    bands = E.queries()["ks_quality_bands"](spark, SF_SMALL).collect()
    counts = E.queries()["ks_band_counts"](spark, SF_SMALL).collect()[0]
    assert counts.n_excellent + counts.n_good + counts.n_fair + counts.n_poor == counts.n_features == len(bands)


def test_valid_plus_invalid_is_total(spark):
    import __spark_entry__ as E
    s = E.queries()["rule_summary"](spark, SF_SMALL).collect()[0]
    assert s.valid + s.invalid == s.total


@pytest.mark.parametrize("key", ["ks_two_sample", "column_stats", "rule_failure_counts", "stratified_bootstrap", "ecdf"])
def test_independent_of_shuffle_partitions(spark, key):
    import __spark_entry__ as E
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, E.queries()[key](spark, SF_SMALL).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = sorted(map(tuple, E.queries()[key](spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "row_id long, x double, Class int")
    full = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1)], "row_id long, x double, Class int")
    assert D.ks_two_sample(empty, empty, ["x"]).count() == 0
    d = P.describe(empty, ["x"]).collect()
    assert d == []
    prof = P.table_profile(empty).collect()[0]
    assert prof.n_rows == 0 and prof.total_nulls == 0
    assert P.duplicate_rows(empty).collect()[0].duplicates == 0
    ks = D.ks_two_sample(full, empty, ["x"]).collect()
    assert ks == [] or ks[0].n_candidate == 0


def test_constant_feature(spark):
    df = spark.createDataFrame([(i, 5.0, i % 2) for i in range(20)], "row_id long, x double, Class int")
    st_ = P.column_stats(df, ["x"]).collect()[0]
    assert st_.std == 0.0 and st_.median == 5.0 and st_.q25 == 5.0
    assert D.ks_two_sample(df, df, ["x"]).collect()[0].statistic == 0.0


def test_one_class_only(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(10)], "row_id long, x double, Class int")
    cd = P.class_distribution(df, "Class").collect()
    assert len(cd) == 1 and cd[0].percent == 100.0 and cd[0].imbalance_ratio == 1
    ks = D.ks_by_class(df, "Class", ["x"]).collect()  # no positives: the statistic is undefined
    assert all(r.statistic is None for r in ks)
    md = P.class_mean_diff(df, "Class", ["x"]).collect()[0]
    assert md.mean_positive is None and md.abs_diff is None


def test_generator_float_label_thresholds(spark):
    from fidelis.functions.columns import threshold_label
    df = spark.createDataFrame([(0.7,), (0.5,), (0.2,), (None,)], "c double")
    assert [r[0] for r in df.select(threshold_label("c")).collect()] == [1, 0, 0, None]
    fails = R.rule_failures(spark.createDataFrame([(1, 1.0, 1.0, 0.7)], "row_id long, Time double, Amount double, Class double"),
                            R.default_rules(features=[])).collect()
    assert any(r.rule_name == "class_binary" for r in fails)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=200))
def test_exact_quantiles_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {r.p: r.q for r in exact_quantiles(df, [], "value", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(np.array(values, dtype=float), p * 100), abs=1e-9)


def test_duplicate_rows_exact_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b"), (None, None)], "x int, t string")
    assert tuple(P.duplicate_rows(df).collect()[0]) == (2, 4, 6)
    assert tuple(P.duplicate_rows(df, ["t"]).collect()[0]) == (3, 3, 6)
