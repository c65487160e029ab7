"""Exact-size samples by a hash cut-off against a sort of all rows."""

import hashlib
from collections import Counter

import pytest

from fidelis.operators import sampling as S
from fidelis.operators import similarity as N


def first_rows(ids, n, seed):
    order = sorted(ids, key=lambda i: (i is not None, "" if i is None else hashlib.md5(f"{i}-{seed}".encode()).hexdigest(), i or 0))
    return Counter(order[:n])


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_sample_equals_a_sort(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "DIGITS", 1)
    ids = [*range(3000), *[5] * 40, *[None] * 6]
    df = spark.createDataFrame([(i, "x") for i in ids], "id long, v string").repartition(5)
    place = list(first_rows(ids, 10 ** 6, 9))
    at = [k for k in (0, 1, 5, 6, 7, 100, 1777, len(ids) - 1, len(ids), len(ids) + 10)]
    at.append(6 + [i for i in place if i is not None].index(5) + 11)  # in the middle of the rows of one id
    for n in at:
        got = S.sample_exact(df, "id", n, 9)
        assert Counter(r.id for r in got.collect()) == first_rows(ids, n, 9), n
        assert got.columns == ["id", "v"]


def test_heap_and_cut_off_give_the_same_rows(spark, monkeypatch):
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    heap = {r.row_id for r in N.sample_rows(df, "row_id", 700, 3).collect()}
    monkeypatch.setattr(N, "HEAP_ROWS", 10)
    cut = N.sample_rows(df, "row_id", 700, 3)
    assert {r.row_id for r in cut.collect()} == heap and len(heap) == 700
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_empty_table(spark):
    assert S.sample_exact(spark.range(0), "id", 5, 1).count() == 0
