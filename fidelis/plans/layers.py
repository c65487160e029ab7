"""The four validation layers as lazy DataFrame plans (Q7-Q10) and their reports (Q5, Q6, M4)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis import config
from fidelis.operators import corr as C
from fidelis.operators import dist as D
from fidelis.operators import outlier as O
from fidelis.operators import review as V
from fidelis.operators import rules as R
from fidelis.operators import similarity as S
from fidelis.operators.frames import attach
from fidelis.sources.tables import Roles

TEST_COLUMNS = D.TEST_COLUMNS


@dataclass
class LayerSpec:
    """Column roles and feature lists for one real/candidate pair."""

    roles: Roles
    rules: list[R.Rule]
    ks_features: list[str]
    key_features: list[str]
    corr_features: list[str]
    z_features: list[str]
    sim_features: list[str]
    review_key: str
    review_features: list[str] = field(default_factory=list)
    review_amount_limit: float = 500.0
    review_key_high: float = 0.0
    review_key_low: float = -8.0
    forest_features: list[str] | None = None
    similarity_sample: int | None = None  # None: all candidate rows
    review_sample: int | None = None  # None: all flagged rows


def require_columns(df: DataFrame, cols: list[str], layer: str) -> None:
    """Fail at plan time, with a readable message, when a layer's input lacks columns."""
    missing = [c for c in dict.fromkeys(cols) if c not in df.columns]
    if missing:
        raise ValueError(f"{layer} layer: missing column(s) {missing}")


def _bounded(df: DataFrame, bound: int) -> DataFrame:
    """Materialise a result that is at most ``bound`` rows by construction (a sample, a
    top-n) as a small local frame, so later branches do not re-run the plan behind it."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows where {bound} at most are possible")
    return df.sparkSession.createDataFrame(rows, df.schema)


def _one_row(df: DataFrame) -> DataFrame:
    """Run a one-row aggregate once and return it as a small local frame (bounded size)."""
    row = df.first()
    return df.sparkSession.createDataFrame([tuple(row)], df.schema)


# ---- Q7: rule layer ------------------------------------------------------------------

def rule_layer(candidate: DataFrame, spec: LayerSpec) -> dict[str, DataFrame]:
    clean = R.clean_frame(candidate)
    bad = R.any_violation(clean, spec.rules)
    summary = clean.agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("valid")).select(
        "valid", (F.col("total") - F.col("valid")).alias("invalid"), "total",
        F.when(F.col("total") > 0, F.col("valid") * 100.0 / F.col("total")).otherwise(F.lit(0.0)).alias("pass_rate"),
        ((F.col("total") - F.col("valid")) == 0).alias("passed"))
    return {
        "summary": summary,
        "counts": R.rule_failure_counts(candidate, spec.rules, spec.roles.id),
        "invalid_ids": clean.where(bad).select(spec.roles.id),
        "invalid_rows": R.invalid_rows(candidate, spec.rules),
    }


def layer1_report(candidate: DataFrame, spec: LayerSpec, samples: int = 5) -> DataFrame:
    """Q6: summary numbers plus per rule the failure count and the first failing ids."""
    rl = rule_layer(candidate, spec)
    smp = R.rule_failure_samples(candidate, spec.rules, spec.roles.id, samples)
    ids = smp.groupBy("rule_name").agg(F.array_sort(F.collect_list(spec.roles.id)).alias("sample_ids"))  # <= samples each
    per_rule = rl["counts"].join(ids, "rule_name", "left")
    return attach(per_rule, rl["summary"])


# ---- Q8: statistics layer ------------------------------------------------------------

def statistics_layer(real: DataFrame, candidate: DataFrame, spec: LayerSpec, with_forest: bool = False) -> DataFrame:
    """The ``test_results`` table: KS per feature, moments for key features, Frobenius
    norm and top pairs of the correlation matrices, z-score rates and (optionally) the
    isolation forest - unioned into one long table."""
    for side in (real, candidate):
        require_columns(side, spec.ks_features + spec.key_features + spec.corr_features + spec.z_features, "statistics")
    ks = D.ks_tests(D.ks_two_sample(real, candidate, spec.ks_features, details=False))
    # one aggregate a side feeds the moments and the z-scores; the rows are bounded (2 numbers
    # per key feature, 4 per z feature, 1 row per pair) and run once
    rs = real.agg(*D.moment_aggs(spec.key_features, "r_"))
    cs = candidate.agg(*D.moment_aggs(spec.key_features, "c_"), *O.zscore_stat_aggs(spec.z_features, "c_"))
    both = _one_row(attach(rs, cs))
    cs = both.select(*[c for c in both.columns if c.startswith("c__")])
    mom = D.moment_tests_from_wide(both, spec.key_features)
    k = len(spec.corr_features)
    diff = _bounded(C.corr_difference(real, candidate, spec.corr_features), k * (k - 1) // 2)
    fro = C.frobenius_from_diff(diff, len(spec.corr_features)).select(*TEST_COLUMNS)
    pairs = C.top_pairs_from_diff(diff).select(*TEST_COLUMNS)
    z = O.zscore_from_stats(candidate, cs, spec.z_features, "c_").select(*TEST_COLUMNS)
    parts = [ks, mom.select(*TEST_COLUMNS), fro, pairs, z]
    if with_forest and spec.forest_features:
        from fidelis.operators.forest import isolation_forest_test
        parts.append(isolation_forest_test(real, candidate, spec.forest_features, id_col=spec.roles.id).select(*TEST_COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_summary(tests: DataFrame) -> DataFrame:
    """M4: passed / failed / total / pass rate, KS passed / total, correlation preserved,
    outlier rate acceptable (forest when present, else every z-score test)."""
    has_forest = F.count_if(F.col("test_name") == "isolation_forest") > 0
    return tests.agg(
        F.count_if("passed").alias("tests_passed"), F.count_if(~F.col("passed")).alias("tests_failed"),
        F.count(F.lit(1)).alias("tests_total"),
        F.count_if((F.col("test_name") == "KS_test") & F.col("passed")).alias("ks_passed"),
        F.count_if(F.col("test_name") == "KS_test").alias("ks_total"),
        F.coalesce(F.min(F.when(F.col("test_name") == "correlation_frobenius", F.col("passed"))), F.lit(False)).alias("correlation_preserved"),
        F.when(has_forest, F.min(F.when(F.col("test_name") == "isolation_forest", F.col("passed"))))
        .otherwise(F.coalesce(F.min(F.when(F.col("test_name") == "zscore_outliers", F.col("passed"))), F.lit(True)))
        .alias("outlier_rate_acceptable"),
    ).select("*", (F.col("tests_passed") * 100.0 / F.greatest(F.col("tests_total"), F.lit(1))).alias("pass_rate"),
             (F.col("tests_failed") == 0).alias("passed"))


def layer2_report(tests: DataFrame) -> DataFrame:
    """Q5: one row - summary, failed tests (worst first) and the 5 best / worst KS."""
    summ = test_summary(tests)
    failed = tests.where(~F.col("passed")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("statistic"), "test_name", "feature")), asc=False).alias("failed_tests"))  # bounded by the number of tests
    ks = tests.where(F.col("test_name") == "KS_test")
    ext = D.ks_extremes(ks, 5).groupBy().agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "best", F.struct("rank", "feature", "statistic")))).alias("best_ks"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "worst", F.struct("rank", "feature", "statistic")))).alias("worst_ks"))
    return attach(attach(summ, failed), ext)


# ---- Q10: similarity layer -----------------------------------------------------------

def similarity_layer(real: DataFrame, candidate: DataFrame, spec: LayerSpec, seed: int = 42,
                     threshold: float = config.SIMILARITY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    idc = spec.roles.id
    feats = spec.sim_features
    if spec.similarity_sample:
        sampled = _bounded(S.sample_rows(candidate, idc, spec.similarity_sample, seed), spec.similarity_sample)
    else:
        sampled = candidate
    stats = _one_row(S.scale_stats(real, feats))  # one pass: means, stds and the row count
    ref_v = S.vectorize(S.standard_scale(real, real, feats, stats), idc, feats)
    cand_v = S.vectorize(S.standard_scale(real, sampled, feats, stats), idc, feats)
    flags = S.flag_rows(S.nn_cosine(cand_v, ref_v, idc, idc, "vec"), threshold)
    return flags, S.anomaly_rate(flags)


# ---- Q9: review layer ----------------------------------------------------------------

def review_layer(real: DataFrame, candidate: DataFrame, spec: LayerSpec,
                 flagged: DataFrame | list[DataFrame] | None, context: str | None = None) -> dict[str, DataFrame]:
    """Q9: review all flagged rows, or with ``review_sample`` the first of them (or a seeded
    sample); ``context`` (the similarity escalation text) is appended to the review batch text,
    which the original stored and never sent.  Of all flagged rows, anomalies and text are long
    tables and the result is one row of counts; of a sample both are one row."""
    r = spec.roles
    reviewed = V.review_candidates(candidate, r.id, flagged, spec.review_sample)
    if spec.review_sample is not None:
        reviewed = _bounded(reviewed, spec.review_sample)
    rv = attach(reviewed, V.review_context(real, r.label, r.amount, spec.review_key))
    anomalies = V.plausibility(rv, r.id, r.label, r.amount, spec.review_key, spec.review_amount_limit,
                               spec.review_key_high, spec.review_key_low, F.col("_med"), F.col("_mean"))
    whole = spec.review_sample is None
    result = V.review_score(anomalies, reviewed) if whole else V.review_result(reviewed, anomalies)
    feats = spec.review_features or [spec.review_key]
    text = (V.row_text if whole else V.batch_text)(V.record_text(reviewed, r.id, r.label, r.amount, feats), r.id,
                                                   F.lit(context) if context else None)
    return {"reviewed": reviewed, "anomalies": anomalies, "result": result, "batch_text": text}
