"""Quality (op9) and toxicity (op5): accuracy on held-out labels, degenerate inputs."""

import pytest
from pyspark.sql import functions as F

from fidelis.llm import quality as Q
from fidelis.llm import queries as E
from fidelis.llm import toxicity as T
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_MID}/labels.parquet")


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_labels(spark, labels):
    got = E.op9(spark, SF_MID)
    assert got.count() == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    held = [(r.score, r.quality) for r in got.where("held_out").join(labels, "doc_id").collect()]
    assert auc(held) > 0.9
    assert sum(s >= 0.3 for s, y in held if y) / sum(y for _, y in held) > 0.95
    assert got.where("predicted <> cast(score >= 0.3 as int) or score < 0 or score > 1").count() == 0


def test_quality_scores_equal_plain_compression(spark, labels, docs, rows):
    """Each score again from the model's dictionaries by zstandard's own calls, one text at a time."""
    import math

    import zstandard
    model = Q.fit(spark.read.parquet(f"{SF_MID}/documents.parquet"), labels.where(~E.held_out()).select("doc_id", "quality"))
    assert len(model.dictionaries) == len(Q.DICTIONARY_BYTES) and model.constant is None

    def size(text, dictionary):
        return len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False).compress(text))

    want = {}
    for _, t in rows:
        raw = (t or "").encode()
        pairs = [(size(raw, g), size(raw, b)) for g, b in model.dictionaries]
        x = [1.0, *[10 * (b - g) / (b + g) for g, b in pairs], *[(10 * (b - g) / (b + g)) ** 2 for g, b in pairs], *[10 * (b - g) / (len(raw) + 20) for g, b in pairs]]
        want[t] = 1 / (1 + math.exp(-max(-30, min(30, sum(c * v for c, v in zip(model.coef, x))))))
    got = Q.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert got and all(abs(r.score - want[r.text]) < 1e-9 and r.predicted == (r.score >= 0.3) for r in got)


def test_toxicity_on_held_out_labels(spark, labels):
    got = E.op5(spark, SF_MID)
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert auc([(r.p_toxic, r.toxic) for r in held]) > 0.8
    assert sum(r.is_toxic for r in held if not r.toxic) / sum(not r.toxic for r in held) < 0.1


def test_labels_of_one_class_or_none(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    only = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for lab, p in ((none, 0.5), (only.where("quality = 1"), 1.0)):
        assert {r.score for r in Q.score(docs, Q.fit(docs, lab)).collect()} == {p}
        chain = T.fit(docs, lab, {"toxic": F.col("toxic") == 1})
        assert T.score(docs, chain).where("is_toxic").count() == 0
    assert Q.score(docs, Q.fit(docs, only)).count() == docs.count()
    assert Q.score(empty, Q.fit(docs, none)).count() == 0
    assert T.score(empty, T.fit(docs, none, {"toxic": F.col("toxic") == 1})).count() == 0


def test_filter_keeps_columns(spark, docs):
    model = Q.CompressionModel((), (), 0.9)
    assert Q.keep_good(docs, model).columns == docs.columns and Q.keep_good(docs, model).count() == docs.count()
    assert Q.keep_good(docs, Q.CompressionModel((), (), 0.1)).count() == 0


def test_chain_uses_earlier_categories(spark):
    """The second category is the first one's negation on most rows: the chain must see it."""
    rows = [(i, ("bad " if i % 2 else "good ") + f"w{i % 17} v{i % 13}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, a int, toxic int")
    chain = T.fit(docs, lab, {"a": F.col("a") == 1, "toxic": F.col("toxic") == 1})
    assert len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    got = {r.doc_id: r.is_toxic for r in T.score(docs, chain).collect()}
    assert got == {i: bool(i % 2) for i in range(200)}
