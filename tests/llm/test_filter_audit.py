"""Filter audit (op11) against plain Python over documents and orders."""

import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fidelis.llm import filter_audit as A

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """rows: (id, text, part); figures of every part, order and step document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A"} if len(w) < 100 else set()
        bad |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        docs.append((part or "", bad, i in good, i in toxic))
    out, removed_by = {}, defaultdict(int)
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in own) - len(gone)
                left = [d for d in left if f not in d[1]]
                removed_by[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def case(rows):
    words = " ".join(f"w{k}" for k in range(150))
    data = [(i, t, ["en", "de", None, ""][k % 4]) for k, (i, t) in enumerate(rows)]
    data += [(700 + k, words, "en") for k in range(6)] + [(706, words, "de"), (None, words, "fr"), (None, None, "fr"), (1, words + " $", "fr"), (2, words.upper(), None)]
    data += [(650, "same", "en"), (650, "same", "en"), (650, "same", "de"), (651, "same", "de"), (651, "same", "de")]  # repeated rows of one id
    labels = [(i, k % 2, int(k % 3 == 0)) for k, i in enumerate(sorted({i for i, _, _ in data if i is not None})[::2])] + [(650, 0, 1), (650, 1, None), (None, 1, 1), (99999, 1, 1)]
    return data, labels


def test_audit_equals_brute_force(spark, case):
    data, labels = case
    docs = spark.createDataFrame([(i, t, p, 1, 2, "x") for i, t, p in data], "doc_id long, text string, lang string, mask int, n int, digest string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit_filters(docs, marks).collect()
    want = brute(data, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want) == 600 * 4


def test_empty_tables(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit_filters(empty, labels).count() == 0
    assert A.audit_filters(docs, labels).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_row_limit_follows_the_parts(spark):
    """More parts than the session's row limit of recursive queries allows; the setting stays as it was."""
    setting, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    cells = spark.range(8).select(F.concat(F.lit("p"), "id").alias("part"), F.lit(3).alias("mask"), F.lit(1).cast("long").alias("n"),
                                  F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    try:
        spark.conf.set(setting, "500")
        assert A.walk_orders(cells).count() == 8 * 325
        assert spark.conf.get(setting) == "500"
    finally:
        spark.conf.set(setting, before)
