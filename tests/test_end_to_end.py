"""One full attempt on a small card-like fixture, including the escalation path."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from fidelis.operators import audit as A
from fidelis.operators import rules as R
from fidelis.plans import layers as L
from fidelis.plans import orchestrate as O
from fidelis.sources.tables import Roles

SCHEMA = "row_id long, Time double, V1 double, V2 double, V14 double, Amount double, Class int"


def frames(spark, shift):
    rng = np.random.default_rng(11)
    def rows(n, base, s):
        out = []
        for i in range(n):
            v = rng.normal(size=3) + s
            out.append((base + i, float(rng.uniform(0, 1000)), float(v[0]), float(v[1]), float(v[2]),
                        float(abs(rng.normal(100, 50))), int(i % 7 == 0)))
        return out
    real = spark.createDataFrame(rows(300, 0, 0.0), SCHEMA)
    cand = spark.createDataFrame(rows(60, 10_000, shift), SCHEMA)
    return real, cand


def spec(sample=20):
    roles = Roles(id="row_id", time="Time", amount="Amount", label="Class", features=["V1", "V2", "V14"])
    return L.LayerSpec(roles=roles, rules=R.default_rules(features=["V1", "V2", "V14"]), ks_features=["Time", "V1", "V2", "V14", "Amount"],
                       key_features=["Time", "Amount", "V14"], corr_features=["V1", "V2", "V14"], z_features=["Amount", "V14"],
                       sim_features=["V1", "V2", "V14", "Amount"], review_key="V14", review_features=["V1", "V14"],
                       similarity_sample=sample)


def test_one_attempt_scores_every_layer(spark):
    real, cand = frames(spark, 0.0)
    parts = O.run_once(real, cand, spec(), O.weights_frame(spark))
    scores = {r.layer: r.score for r in parts["scores"].collect()}
    assert set(scores) == {"rules", "statistics", "review", "similarity"}
    assert all(0.0 <= v <= 1.0 for v in scores.values())
    final = parts["final"].first().final_score
    expected = sum(scores[k] * w for k, w in {"rules": .2, "statistics": .4, "review": .25, "similarity": .15}.items())
    assert abs(final - round(expected, 4)) < 1e-9
    assert parts["review"].first().rows_reviewed <= 10


def test_escalation_adds_similarity_ids_and_context(spark):
    # real vectors lie on the (1, 1, 1) line; candidate vectors are orthogonal to it
    rng = np.random.default_rng(3)
    real = spark.createDataFrame([(i, 10.0, float(t), float(t), float(t), 100.0, int(i % 5 == 0))
                                  for i, t in enumerate(rng.normal(size=300))], SCHEMA)
    far = spark.createDataFrame([(10_000 + i, 10.0, float(t), float(-t), 0.0, 100.0, 0)
                                 for i, t in enumerate(rng.normal(size=40))], SCHEMA)
    s = spec(sample=None)
    flags, ssum = L.similarity_layer(real, far, s)
    assert ssum.first().escalated
    parts = O.run_once(real, far, s, O.weights_frame(spark))
    assert parts["similarity"].first().escalated
    assert parts["final"].first().final_score is not None
    rv = L.review_layer(real, far, s, [flags.where("flagged").select("row_id")], "escalation context text")
    assert rv["batch_text"].first().text.endswith("escalation context text")


def test_review_covers_every_flagged_row(spark):
    """25 of 60 rows are flagged and break a check: all are reviewed, and the score of the attempt follows."""
    real, cand = frames(spark, 0.0)
    bad = F.col("row_id") < 10_025
    cand = cand.withColumn("V14", F.when(bad, F.lit(-20.0)).otherwise(F.lit(0.0))).withColumn("Class", F.lit(0))
    s = spec()
    flagged = cand.where(bad).select("row_id")
    rv = L.review_layer(real, cand, s, [flagged, flagged])
    assert {r.row_id for r in rv["reviewed"].collect()} == set(range(10_000, 10_025)) and rv["reviewed"].count() == 25
    assert rv["batch_text"].count() == 25 and rv["anomalies"].count() == 25
    parts = O.run_once(real, cand, s, O.weights_frame(spark))
    assert parts["review"].first()[:3] == (25, 25, 0.0)
    # the long audit equals the audit of the list
    listed = L.review_layer(real, cand, replace(s, review_sample=25), flagged)["result"]
    for valid in (cand.columns, ["Time"]):
        a, b = A.audit_reviews(listed, valid).first(), A.audit_long(rv["result"], rv["anomalies"], valid).first()
        assert all(a[c] == b[c] for c in ("score", "contradictions", "n_issues", "adjustment", "adjusted_score", "passed"))
    assert O.report_summary(parts).first().n_hallucinations == 0


def test_similarity_covers_every_candidate_row(spark):
    """One anomalous row of 60, which 20 sampled rows may miss, is flagged by the layer's default."""
    rng = np.random.default_rng(3)
    real = spark.createDataFrame([(i, 10.0, float(t), float(t), float(t), 100.0, 0) for i, t in enumerate(rng.normal(size=300))], SCHEMA)
    cand = spark.createDataFrame([(10_000 + i, 10.0, 1.0, 1.0 if i != 33 else -1.0, 1.0 if i != 33 else 0.0, 100.0, 0) for i in range(60)], SCHEMA)
    whole = L.LayerSpec(**{k: v for k, v in vars(spec()).items() if k not in ("similarity_sample", "review_sample")})
    flags, summary = L.similarity_layer(real, cand, whole)
    assert summary.first()[:2] == (60, 1)
    assert [r.row_id for r in flags.where("flagged").collect()] == [10_033]
