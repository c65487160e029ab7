"""Rule semantics: NaN/NULL, domain, error policy, parsing of proposed rules."""

import math

from pyspark.sql import functions as F

from fidelis.operators import rules as R
from fidelis.operators.rules import Rule

SCHEMA = "row_id long, Time double, V1 double, Amount double, Class double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def fails(spark, rows, rules=None):
    rules = rules or R.default_rules(features=["V1"])
    out = R.rule_failures(frame(spark, rows), rules).collect()
    return {(r.row_id, r.rule_name) for r in out}


def test_every_rule_violated_once(spark):
    rows = [(1, -1.0, 0.0, 10.0, 0.0), (2, 200000.0, 0.0, 10.0, 0.0), (3, 10.0, 11.0, 10.0, 0.0),
            (4, 10.0, 0.0, -5.0, 0.0), (5, 10.0, 0.0, 60000.0, 1.0), (6, 10.0, 0.0, 10.0, 0.7)]
    f = fails(spark, rows)
    assert (1, "time_non_negative") in f and (2, "time_in_range") in f and (3, "v1_zscore") in f
    assert (4, "amount_non_negative") in f and (5, "amount_reasonable") in f and (5, "fraud_amount_pattern") in f
    assert (6, "class_binary") in f


def test_nan_and_null_fail_the_comparison_and_not_null_rules(spark):
    f = fails(spark, [(1, 10.0, 0.0, float("nan"), 0.0), (2, 10.0, 0.0, None, 0.0)])
    for rid in (1, 2):
        assert (rid, "amount_non_negative") in f and (rid, "no_null_amount") in f
        assert (rid, "fraud_amount_pattern") not in f  # negated pattern passes on a missing value


def test_class_one_as_float_passes_and_missing_class_fails(spark):
    f = fails(spark, [(1, 10.0, 0.0, 10.0, 1.0), (2, 10.0, 0.0, 10.0, None)])
    assert (1, "class_binary") not in f and (2, "class_binary") in f


def test_summary_counts_rows_with_any_failure(spark):
    rows = [(1, 10.0, 0.0, 10.0, 0.0), (2, 10.0, 50.0, 10.0, 0.0), (3, -1.0, 50.0, 10.0, 0.0)]
    s = R.rule_summary(frame(spark, rows), R.default_rules(features=["V1"])).collect()[0]
    assert (s.valid, s.invalid, s.total, s.passed) == (1, 2, 3, False)
    assert math.isclose(s.pass_rate, 100 / 3)


def test_empty_table_summary(spark):
    s = R.rule_summary(frame(spark, []), R.default_rules(features=["V1"])).collect()[0]
    assert (s.valid, s.invalid, s.total, s.pass_rate, s.passed) == (0, 0, 0, 0.0, True)


def test_unresolvable_rule_fails_every_row_as_critical(spark):
    rules = [Rule("ghost", "missing column", "`V99` > 0", "info"), Rule("off", "disabled", "false", enabled=False)]
    out = R.rule_failures(frame(spark, [(1, 1.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 1.0, 0.0)]), rules).collect()
    assert len(out) == 2 and all(r.severity == "critical" and r.actual_value.startswith("Error:") for r in out)


def test_actual_value_is_the_offending_value(spark):
    out = R.rule_failures(frame(spark, [(1, 1.0, 0.0, -5.0, 0.0)]), R.default_rules(features=[])).collect()
    vals = {r.rule_name: r.actual_value for r in out}
    assert vals["amount_non_negative"] == "-5.0"


def test_fenced_rule_responses(spark):
    good = '```json\n[{"name":"a","description":"d","condition":"`Amount` >= 0","severity":"Warning"}]\n```'
    plain = '[{"name":"b","description":"d","condition":"`Amount` < 5","severity":"info"}]'
    bad_sev = '[{"name":"c","description":"d","condition":"true","severity":"fatal"},{"name":"d","description":"d","condition":"true","severity":"info"}]'
    missing = '[{"name":"e","condition":"true","severity":"info"}]'
    obj = '{"name":"f"}'
    text = 'not json at all'
    unsafe = '[{"name":"g","description":"d","condition":"__import__(1)","severity":"info"}]'
    df = spark.createDataFrame([(i, t) for i, t in enumerate([good, plain, bad_sev, missing, obj, text, unsafe])], "id int, response string")
    parsed = R.parse_rule_responses(df, "response", ["id"])
    names = sorted(r.name for r in parsed.collect())
    assert names == ["gemini_a", "gemini_b"]


def test_unsafe_rule_does_not_void_its_list_and_fences_may_stay_open(spark):
    mixed = '[{"name":"u","description":"d","condition":"eval(1)","severity":"fatal"},{"name":"a","description":"d","condition":"true","severity":"info"}]'
    cut = '```json\n[{"name":"o","description":"d","condition":"true","severity":"info"}]'
    df = spark.createDataFrame([(1, mixed), (2, cut)], "id int, response string")
    assert sorted(r.name for r in R.parse_rule_responses(df, "response", ["id"]).collect()) == ["gemini_a", "gemini_o"]


def test_a_condition_that_raises_fails_its_rows_only(spark):
    rules = [Rule("zero", "", "cast(Amount as int) / V1 > 1", "info"), Rule("fraction", "", "Amount % (V1 - 1) >= 0", "info"),
             Rule("text", "", "cast('x' as int) = 1", "info"), Rule("quoted", "", "'a/b' = 'a/b'", "info")]
    assert fails(spark, [(1, 1.0, 0.0, 10.0, 0.0), (2, 1.0, 1.0, 10.0, 0.0), (3, 1.0, 2.0, 10.0, 0.0)], rules) == {
        (1, "zero"), (2, "fraction"), (1, "text"), (2, "text"), (3, "text")}


def test_equal_counts_keep_the_order_of_the_first_failing_row(spark):
    rules = [Rule("z_first", "", "`V1` > 5", "info"), Rule("b", "", "`Amount` > 5", "info"), Rule("a", "", "`Amount` > 6", "info")]
    rows = [(1, 1.0, 0.0, 9.0, 0.0), (2, 1.0, 9.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0, 0.0)]
    counts = R.rule_failure_counts(frame(spark, rows), rules)
    assert [r.rule_name for r in R.top_failed_rules(counts).collect()] == ["z_first", "b", "a"]


def test_review_items_as_the_reviewer_writes_them(spark):
    from fidelis.operators import review as V
    rows = [(1, '```json\n[{"row_index": "3", "feature": "V1"}, {"row_index": 4, "is_anomalous": 0}, {"is_anomalous": null}, {"is_anomalous": false}]'),
            (2, '{"row_index": 1}'), (3, "no list"), (4, "so: ```\n[{}]\n``` end"), (5, "[]")]
    got = {r.i: [tuple(a) for a in r.anomalies] for r in V.parse_responses(spark.createDataFrame(rows, "i int, response string"), "i").collect()}
    assert got == {1: [(3, "V1", "")], 2: [], 3: [(-1, "parse_error", "Could not parse response: no list")], 4: [(-1, "unknown", "")], 5: []}


def test_one_array_column_one_scan(spark):
    plan = R.evaluate_rules(frame(spark, [(1, 1.0, 0.0, 1.0, 0.0)]), R.default_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan
