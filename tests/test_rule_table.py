"""Rules as data against compiled rules and plain comparisons."""

import operator
import random

import pytest
from pyspark.sql import functions as F

from fidelis.operators import rule_table as T
from fidelis.operators import rules as R

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, float("nan"), 0.0, -3.0, 2.5, rng.uniform(-5, 5)]), rng.choice([None, 1, 2, 3])) for k in range(200)]
    rules = [(f"r{k}", rng.choice(["x", "abs(x)", "n"]), rng.choice(list(OPS)), rng.choice([0.0, 2.5, -3.0, 3.0, rng.uniform(-6, 6)]), rng.choice(R.SEVERITIES)) for k in range(400)]
    return spark.createDataFrame(rows, "id long, x double, n int").repartition(3), rows, rules


def breaks(row, rule):
    _, x, n = row
    _, column, op, t, _ = rule
    v = {"x": x, "abs(x)": None if x is None else abs(x), "n": n}[column]
    return v is None or v != v or not OPS[op](v, t)


def test_counts_rows_and_failures_equal_plain_comparisons(case):
    df, rows, rules = case
    groups = T.rule_table(rules)
    assert {r.rule_name: r.failures for r in T.rule_counts(df, groups).collect()} == {r[0]: sum(breaks(w, r) for w in rows) for r in rules}
    for r in T.row_results(df, groups, "id").collect():
        own = [q[4] for q in rules if breaks(rows[r.id], q)]
        assert (r.n_broken, r.n_critical, r.n_warning, r.n_info, r.is_valid) == (len(own), *[own.count(s) for s in R.SEVERITIES], not own)
    got = T.rule_failures(df, groups, "id").collect()
    assert len(got) == len(set(got)) and {(r.id, r.rule_name) for r in got} == {(w[0], q[0]) for w in rows for q in rules if breaks(w, q)}


def test_compiled_rules_agree(case):
    df, _, rules = case
    compiled = [R.Rule(n, n, f"{c} {op} {t!r}", s) for n, c, op, t, s in rules[:40]]
    groups, others = T.split_rules(compiled)
    assert not others
    a = {(r.id, r.rule_name) for r in T.rule_failures(df, groups, "id").collect()}
    b = {(r.id, r.rule_name) for r in R.rule_failures(df, compiled, "id").select("id", "rule_name").collect()}
    assert a == b


def test_split_leaves_what_is_no_threshold():
    rules = R.default_rules(features=["V1"]) + [R.Rule("off", "", "x > 1", enabled=False), R.Rule("two", "", "x > 1 AND y > 2"), R.Rule("open", "", "abs(x > 1"), R.Rule("neg", "", "x >= -1.5e3")]
    groups, others = T.split_rules(rules)
    assert {n for g in groups for n in g.names} == {"amount_non_negative", "amount_reasonable", "time_non_negative", "time_in_range", "v1_zscore", "neg"}
    assert {r.name for r in others} >= {"off", "two", "open", "class_binary", "fraud_amount_pattern"}


def test_a_missing_column_breaks_its_rules(case):
    df, rows, _ = case
    groups = T.rule_table([("gone", "nowhere", "<", 1.0, "critical"), ("always", "n", ">", -1.0, "info")])
    counts = {r.rule_name: r.failures for r in T.rule_counts(df, groups).collect()}
    assert counts == {"gone": 200, "always": sum(w[2] is None for w in rows)}


def test_table_of_a_frame_and_bad_rules(spark, case):
    df, rows, rules = case
    frame = spark.createDataFrame(rules, "rule_name string, column string, op string, threshold double, severity string")
    a = sorted(map(tuple, T.rule_counts(df, T.table_of(frame)).collect()))
    assert a == sorted(map(tuple, T.rule_counts(df, T.rule_table(rules)).collect()))
    for bad in (("b", "x", "=", 1.0, "info"), ("b", "x", "<", float("nan"), "info"), ("b", "x", "<", 1.0, "grave")):
        with pytest.raises(ValueError):
            T.rule_table([bad])


def test_empty_table_and_no_rules(case):
    df, _, rules = case
    groups = T.rule_table(rules)
    assert T.rule_counts(df.limit(0), groups).agg(F.sum("failures")).first()[0] == 0
    assert T.row_results(df.limit(0), groups, "id").count() == 0 and T.rule_failures(df.limit(0), groups, "id").count() == 0
    assert T.row_results(df, [], "id").where("is_valid").count() == 200
