"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from fidelis.llm import line_chunks as L
from fidelis.llm import mixing as M
from fidelis.llm import quality as Q
from fidelis.llm.queries import held_out
from fidelis.session import checkpoint_dir
from tests.conftest import SF_SMALL
from tests.llm.test_archives_mixing_packing import cut, plain_ids
from tests.llm.test_dedup import chunks_of, components


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before the first stage and after each stage, written and read as ``run`` does."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(C.STAGES):
        path = f"{checkpoint_dir(spark)}/pipeline-test-{k}"
        stage(spark, out[-1], SF_SMALL).write.mode("overwrite").parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality_stage_rejects_what_scores_low(spark, steps):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").where(~held_out())
    score = {r.doc_id: r.score for r in Q.score(steps[0], Q.fit(steps[0], labels)).collect()}
    kept = Counter(i for i, _ in rows(steps[1]))
    assert kept == Counter(i for i, s in score.items() if s >= 0.3)
    assert 0 < len(kept) < len(score)


def test_line_stage_removes_repeated_chunks(steps):
    before = sorted(rows(steps[1]))
    first = {}
    for i, t in before:
        for s, c in chunks_of(t):
            if len(c) > 1:
                first.setdefault("\n".join(c), (i, s))
    want = {i: "\n".join(x for s, c in chunks_of(t) if len(c) < 2 or first["\n".join(c)] == (i, s) for x in c) for i, t in before}
    assert dict(rows(steps[2])) == want
    assert steps[2].where(F.col("n_chars") != F.length("text")).count() == 0
    assert L.EVERY > 1 and want != dict(before)


def test_near_duplicate_stage_keeps_one_of_each_group(steps):
    found = components(rows(steps[2]), 80)
    assert Counter(i for i, _ in rows(steps[3])) == Counter(i for i, (_, c) in found.items() if i == c)


def test_near_duplicate_stage_shuffles_the_texts_once(spark, tmp_path):
    """Also with repeated and missing ids: one row of an id stays, and of rows without an id one of each text."""
    rng = np.random.default_rng(3)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 500, 30)) for _ in range(6)]
    data = [(1, text[0]), (1, text[0]), (2, text[1]), (3, text[1]), (None, text[2]), (None, text[2]), (None, text[3]), (None, text[0]), (4, None), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in data], steps_schema())
    docs.write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = C.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), SF_SMALL)
        plan = kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "simple")
        found = Counter((r.doc_id, r.text) for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, below = plan.split("LeftSemi", 1)  # the join shuffles the texts; what stands above it must not do so again
    assert "Exchange" not in above and "Exchange" in below
    assert found == Counter([(1, text[0]), (2, text[1]), (None, text[2]), (None, text[3]), (None, text[0]), (4, None), (5, ""), (None, None)])


def test_mixing_stage_orders_by_the_schedule(spark, steps):
    slot = {r.doc_id: (r.slot, r.chars_before) for r in M.mix_sources(steps[3]).collect()}
    files = steps[4].select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")).collect()
    order = [slot[r.doc_id] for r in sorted(files, key=lambda r: (r.f, r["at"]))]
    assert order == sorted(order) and Counter(r.doc_id for r in files) == Counter(slot.keys())


def test_packing_stage_packs_every_token_once(steps):
    texts = rows(steps[4])
    length = {i: len(x) + 1 for (i, _), x in zip(texts, plain_ids([t for _, t in texts]))}
    seq, pieces = defaultdict(list), defaultdict(list)
    for r in steps[5].collect():
        seq[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert {i: sorted(v) for i, v in pieces.items()} == {i: [(k, s, n) for k, (s, n) in enumerate(cut(m, 2048))] for i, m in length.items()}
    for v in seq.values():
        v = np.array(sorted(v))
        assert (v[:, 0] == np.cumsum(v[:, 1]) - v[:, 1]).all() and v[:, 1].sum() <= 2048


def test_run_gives_the_last_stage(spark, steps):
    assert {r.doc_id for r in C.run(spark, SF_SMALL).collect()} == {r.doc_id for r in steps[5].select("doc_id").collect()}


def test_empty_and_null_documents(spark, tmp_path):
    """Null columns, empty texts, repeated rows and an empty table pass every stage."""
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, data in enumerate(([], [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", None, 3), (2, "", "en", "s", 0), (3, "x " * 300, "en", "s", 600)])):
        docs = spark.createDataFrame(data, steps_schema())
        for name, stage in C.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")


def steps_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"
