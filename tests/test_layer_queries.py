"""Whole-layer queries over a small lineitem table of the test's own."""

import datetime as dt

import pytest

import __spark_entry__ as E
from fidelis.operators import synth as G
from fidelis.plans import orchestrate as O
from fidelis.sources import tables as T

E.queries()  # the query modules build on one another
from fidelis.plans import q_layers as Q  # noqa: E402

SCHEMA = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
          "l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(k // 4, k * 7 % 101, k * 3 % 17, k % 4 + 1, float(k % 50 + 1), 900.0 + k * 37 % 5000, k % 11 / 100, k % 9 / 100, "RNA"[k % 3], "FO"[k // 3 % 2],
             dt.datetime(1995, 3, 1) + dt.timedelta(days=k % 700)) for k in range(240)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_load_baseline_reads_the_whole_profile(spark, sf):
    """Every section of the stored baseline comes back, as the profile has it."""
    key = lambda r: (r.section, r.feature, r.other, r.metric)
    profile = {key(r): r.value for r in E.queries()["baseline_profile"](spark, sf).collect()}
    read = {key(r): r.value for r in E.queries()["load_baseline"](spark, sf).collect()}
    assert {k: v for k, v in read.items() if k[0] != "entries" and k[3] != "p_value"} == profile
    assert sum(k[3] == "p_value" for k in read) == 30
    assert {k[1]: v for k, v in read.items() if k[0] == "entries"} == {"n_rows": 1, "positive_rate": 1, "column_stats": 31, "class_correlations": 30, "feature_pairs": 378, "ks_by_class": 30, "amount_log_fit": 2}


def test_validate_statistics_has_the_forest(spark, sf):
    tests = [r.test_name for r in E.queries()["validate_statistics"](spark, sf).select("test_name").collect()]
    assert len(tests) == 61 and tests.count("isolation_forest") == 1


def test_narrow_sides_widen_to_the_whole_sides(spark, sf):
    for status, whole in (("F", T.real_side(spark, sf)), ("O", T.candidate_side(spark, sf))):
        made = T.widened(T.narrow_side(spark, sf, status))
        assert dict(made.dtypes) == dict(whole.dtypes) and made.count() == whole.count() > 0
        assert made.select(*whole.columns).exceptAll(whole).count() == 0


def test_regenerated_candidates_are_drawn_once_and_kept_narrow(spark, sf, tmp_path):
    """An attempt's candidate replaces that of the attempt before; the drawn rows are gone once it is kept; all columns follow from it."""
    store = O.AttemptStore(spark, str(tmp_path / "run"))
    sizes = []

    def score(c):
        sizes.append((sorted(p.name for p in (tmp_path / "run").glob("*/*") if p.parent.name == "candidates"), (tmp_path / "run" / "drawn").exists(), len(c.columns)))
        wide = T.widened(c)
        assert set(wide.columns) == set(T.real_side(spark, sf).columns)
        assert wide.where("V1 <> l_quantity").count() == (0 if len(sizes) == 1 else wide.count())  # V1 is the drawn line's, l_quantity its jittered value
        return 0.1

    real = T.narrow_side(spark, sf, "F")
    res = O.run_with_retries(score, T.narrow_side(spark, sf, "O"), Q._regenerate(spark, sf, real, store), store=store)
    assert res.attempt == 3
    assert sizes == [([], False, 8), (["2"], False, 8), (["3"], False, 8)]
    kept = spark.read.parquet(str(tmp_path / "run" / "candidates" / "3"))
    whole = T.real_side(spark, sf)
    again = G.generate_synthetic(whole, kept.count(), whole.agg({"is_return": "avg"}).first()[0], 2042, "row_id", "is_return", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_extendedprice", "ship_seconds")
    a, b = ({r.row_id: r for r in x.select("row_id", "ship_seconds", "l_quantity", "l_tax", "ship_hours", "V8", "V27", "is_return").collect()} for x in (T.widened(kept), again))
    assert set(a) == set(b) and all(tuple(a[k]) == pytest.approx(tuple(b[k]), rel=1e-9) for k in a)
