"""Statistical-test queries (T1-T7, C1-C6, O1-O3, Q1, Q2, M5, K2-K4) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis import config
from fidelis.operators import corr as C
from fidelis.operators import dist as D
from fidelis.operators import outlier as O
from fidelis.plans.registry import register, rounded
from fidelis.sources.tables import STAT_TIME, TX_ROLES, TX_SQL, WIDE, candidate_side, real_side, table

R = TX_ROLES
# the shape of the original test layer: 31 + 2 x 7 + 1 + 10 + 4 tests and the forest
KS_FEATURES = [STAT_TIME, R.amount, *WIDE, R.label]
KEY_FEATURES = [STAT_TIME, R.amount, "V3", "V14", "V17", "V12", "V10"]
CORR_FEATURES = WIDE
Z_FEATURES = [R.amount, "V14", "V10", "V3"]


def _sides(spark, sf):
    return real_side(spark, sf), candidate_side(spark, sf)


def _unpivot_sql(src: str, cols: list[str]) -> str:
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"(UNPIVOT (SELECT {sel} FROM {src}) ON {', '.join(cols)} INTO NAME feature VALUE value)"


U_SQL = f"""u AS (SELECT 0 AS side, * FROM {_unpivot_sql('real', KS_FEATURES)}
                 UNION ALL SELECT 1, * FROM {_unpivot_sql('cand', KS_FEATURES)})"""

KS_SQL = f"""WITH {TX_SQL}, {U_SQL},
  c AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM u GROUP BY 1, 2),
  r AS (SELECT feature, sum(na) OVER (PARTITION BY feature ORDER BY value) AS cna, sum(nb) OVER (PARTITION BY feature ORDER BY value) AS cnb,
        sum(na) OVER (PARTITION BY feature) AS ta, sum(nb) OVER (PARTITION BY feature) AS tb FROM c),
  ks AS (SELECT feature, max(abs(cna / ta - cnb / tb)) AS statistic, any_value(ta) AS n_a, any_value(tb) AS n_b FROM r GROUP BY feature),
  lam AS (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * statistic AS lam FROM ks),
  pv AS (SELECT feature, CASE WHEN any_value(lam) < 0.2 THEN 1.0 ELSE
           least(1.0, greatest(0.0, 2 * sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam)))) END AS p_value
         FROM lam, (SELECT range AS k FROM range(1, 101)) GROUP BY feature),
  mom AS (SELECT feature, avg(value) FILTER (WHERE side = 0) AS real_mean, avg(value) FILTER (WHERE side = 1) AS candidate_mean,
          stddev_samp(value) FILTER (WHERE side = 0) AS real_std, stddev_samp(value) FILTER (WHERE side = 1) AS candidate_std
          FROM u GROUP BY feature)"""


@register("ks_two_sample", KS_SQL + """
  SELECT 'KS_test' AS test_name, feature, statistic < 0.05 AS passed, round(statistic, 6) AS statistic, CAST(0.05 AS DOUBLE) AS threshold,
    round(p_value, 6) AS p_value FROM ks JOIN pv USING (feature)""")
def q_ks_two_sample(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.ks_tests(D.ks_two_sample(real, cand, KS_FEATURES, details=False)))


@register("ks_p_value", KS_SQL + """
  SELECT feature, CAST(n_a AS BIGINT) AS n_real, CAST(n_b AS BIGINT) AS n_candidate, round(p_value, 6) AS p_value FROM ks JOIN pv USING (feature)""")
def q_ks_p_value(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.ks_two_sample(real, cand, KS_FEATURES, details=False).select("feature", "n_real", "n_candidate", "p_value"))


@register("ks_exact_p_value", """WITH RECURSIVE u AS (SELECT l_suppkey, l_quantity AS value, CAST(l_linestatus = 'O' AS INTEGER) AS side FROM lineitem),
  c AS (SELECT l_suppkey, value, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM u GROUP BY 1, 2),
  r AS (SELECT l_suppkey, sum(na) OVER w AS cna, sum(nb) OVER w AS cnb, sum(na) OVER (PARTITION BY l_suppkey) AS n, sum(nb) OVER (PARTITION BY l_suppkey) AS m
        FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY value)),
  ks AS (SELECT l_suppkey, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(max(abs(cna * m - cnb * n)) AS BIGINT) AS gap FROM r WHERE n > 0 AND m > 0 GROUP BY 1, 2, 3),
  walk AS (SELECT l_suppkey, n, m, gap, 0::BIGINT AS s, 0::BIGINT AS i, CASE WHEN gap <= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS touched FROM ks
    UNION ALL
    SELECT l_suppkey, n, m, gap, s1, i1, CASE WHEN abs(i1 * m - (s1 - i1) * n) >= gap THEN 1.0 ELSE sum(part) END
    FROM (SELECT l_suppkey, n, m, gap, s + 1 AS s1, i + d AS i1, touched * CASE WHEN d = 1 THEN i + d ELSE s + 1 - i - d END / (s + 1) AS part
          FROM walk, (SELECT unnest([0, 1]) AS d) WHERE i + d <= n AND s + 1 - i - d <= m) GROUP BY l_suppkey, n, m, gap, s1, i1)
  SELECT l_suppkey, n AS n_real, m AS n_candidate, round(gap / (n * m), 6) AS statistic, gap / (n * m) < 0.05 AS passed, round(least(1.0, touched), 6) AS p_value
  FROM walk WHERE s = n + m""")
def q_ks_exact_p_value(spark, sf):
    """T1 + T2 within every supplier: real against candidate quantities, a few hundred rows a side, with exact p-values."""
    li = table(spark, sf, "lineitem")
    return rounded(D.ks_by_group(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), "l_suppkey", "l_quantity"))


@register("ks_details", KS_SQL + """
  SELECT feature, round(real_mean, 6) AS real_mean, round(candidate_mean, 6) AS candidate_mean, round(real_std, 6) AS real_std,
    round(candidate_std, 6) AS candidate_std FROM mom""")
def q_ks_details(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.ks_two_sample(real, cand, KS_FEATURES).select("feature", "real_mean", "candidate_mean", "real_std", "candidate_std"))


_BC_FEATURES = [f for f in KS_FEATURES if f != R.label]


@register("ks_by_class", f"""WITH {TX_SQL},
  u AS (SELECT CASE WHEN is_return = 1 THEN 0 ELSE 1 END AS side, * EXCLUDE (is_return) FROM
        (UNPIVOT (SELECT is_return, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _BC_FEATURES)} FROM real)
         ON {', '.join(_BC_FEATURES)} INTO NAME feature VALUE value)),
  c AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM u GROUP BY 1, 2),
  r AS (SELECT feature, sum(na) OVER (PARTITION BY feature ORDER BY value) AS cna, sum(nb) OVER (PARTITION BY feature ORDER BY value) AS cnb,
        sum(na) OVER (PARTITION BY feature) AS ta, sum(nb) OVER (PARTITION BY feature) AS tb FROM c),
  ks AS (SELECT feature, max(abs(cna / ta - cnb / tb)) AS statistic FROM r GROUP BY feature)
  SELECT feature, round(statistic, 6) AS statistic, statistic > 0.3 AS notable,
    row_number() OVER (ORDER BY statistic DESC, feature) AS rank FROM ks QUALIFY rank <= 10""")
def q_ks_by_class(spark, sf):
    return rounded(D.ks_by_class(real_side(spark, sf), R.label, _BC_FEATURES).select("feature", "statistic", "notable", "rank"))


JS_SQL = f"""WITH {TX_SQL}, {U_SQL},
  rng AS (SELECT feature, CASE WHEN max(value) > min(value) THEN min(value) ELSE min(value) - 0.5 END AS lo,
          CASE WHEN max(value) > min(value) THEN max(value) ELSE max(value) + 0.5 END AS hi FROM u WHERE side = 0 GROUP BY feature),
  t AS (SELECT u.feature, side, least(CAST(floor((value - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin
        FROM u JOIN rng ON u.feature = rng.feature WHERE value >= lo AND value <= hi),
  cnt AS (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS ca, count(*) FILTER (WHERE side = 1) AS cb FROM t GROUP BY 1, 2),
  g AS (SELECT feature, (hi - lo) / 50 AS w, CAST(b.range AS INTEGER) AS bin FROM rng, range(50) b),
  gg AS (SELECT g.feature, g.bin, g.w, coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb FROM g LEFT JOIN cnt ON g.feature = cnt.feature AND g.bin = cnt.bin),
  d AS (SELECT feature, ca / (sum(ca) OVER (PARTITION BY feature) * w) + 1e-10 AS da,
        cb / (sum(cb) OVER (PARTITION BY feature) * w) + 1e-10 AS db FROM gg),
  pq AS (SELECT feature, da / sum(da) OVER (PARTITION BY feature) AS p, db / sum(db) OVER (PARTITION BY feature) AS q FROM d),
  js AS (SELECT feature, sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)) AS s FROM pq GROUP BY feature)
  SELECT 'JS_divergence' AS test_name, feature, s < 0.1 AS passed, round(s, 6) AS statistic, CAST(0.1 AS DOUBLE) AS threshold,
    CAST(NULL AS DOUBLE) AS p_value FROM js"""


@register("js_distance", JS_SQL)
def q_js_distance(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.js_distance(real, cand, KS_FEATURES))


_KEY_U = f"""u AS (SELECT 0 AS side, * FROM {_unpivot_sql('real', KEY_FEATURES)}
                  UNION ALL SELECT 1, * FROM {_unpivot_sql('cand', KEY_FEATURES)}),
  s AS (SELECT feature, avg(value) FILTER (WHERE side = 0) AS rm, avg(value) FILTER (WHERE side = 1) AS cm,
        stddev_samp(value) FILTER (WHERE side = 0) AS rs, stddev_samp(value) FILTER (WHERE side = 1) AS cs FROM u GROUP BY feature)"""


@register("mean_comparison", f"""WITH {TX_SQL}, {_KEY_U}
  SELECT 'mean_comparison' AS test_name, feature, abs(rm - cm) / (abs(rm) + 1e-10) < 0.1 AS passed,
    round(abs(rm - cm) / (abs(rm) + 1e-10), 6) AS statistic, CAST(0.1 AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS p_value FROM s""")
def q_mean_comparison(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.moment_comparison(real, cand, KEY_FEATURES).where(F.col("test_name") == "mean_comparison"))


@register("std_comparison", f"""WITH {TX_SQL}, {_KEY_U}
  SELECT 'std_comparison' AS test_name, feature, abs(rs - cs) / (rs + 1e-10) < 0.1 AS passed,
    round(abs(rs - cs) / (rs + 1e-10), 6) AS statistic, CAST(0.1 AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS p_value FROM s""")
def q_std_comparison(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.moment_comparison(real, cand, KEY_FEATURES).where(F.col("test_name") == "std_comparison"))


def _corr_sql(src: str, feats: list[str]) -> str:
    parts = []
    for i in range(len(feats)):
        for j in range(i + 1, len(feats)):
            parts.append(f"SELECT '{feats[i]}' AS feature_a, '{feats[j]}' AS feature_b, {i} AS i, {j} AS j, "
                         f"corr({feats[i]}, {feats[j]}) AS corr FROM {src}")
    return " UNION ALL ".join(parts)


@register("corr_matrix", f"""WITH {TX_SQL} SELECT feature_a, feature_b, round(corr, 6) AS corr FROM ({_corr_sql('real', CORR_FEATURES)})""")
def q_corr_matrix(spark, sf):
    return rounded(C.corr_long(real_side(spark, sf), CORR_FEATURES).select("feature_a", "feature_b", "corr"))


@register("corr_pairs_baseline", f"""WITH {TX_SQL} SELECT feature_a, feature_b, round(corr, 6) AS corr FROM ({_corr_sql('tx', CORR_FEATURES)})""")
def q_corr_pairs_baseline(spark, sf):
    from fidelis.sources.tables import transactions
    return C.corr_pairs_baseline(transactions(spark, sf), CORR_FEATURES)


CORR_DIFF_SQL = f"""WITH {TX_SQL}, a AS ({_corr_sql('real', CORR_FEATURES)}), b AS ({_corr_sql('cand', CORR_FEATURES)}),
  d AS (SELECT a.feature_a, a.feature_b, a.i, a.j, a.corr AS real_corr, b.corr AS candidate_corr, a.corr - b.corr AS diff
        FROM a JOIN b ON a.i = b.i AND a.j = b.j)"""


@register("corr_difference", CORR_DIFF_SQL + """
  SELECT feature_a, feature_b, round(real_corr, 6) AS real_corr, round(candidate_corr, 6) AS candidate_corr, round(diff, 6) AS diff FROM d""")
def q_corr_difference(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(C.corr_difference(real, cand, CORR_FEATURES).select("feature_a", "feature_b", "real_corr", "candidate_corr", "diff"))


@register("corr_frobenius", CORR_DIFF_SQL + f"""
  SELECT 'correlation_frobenius' AS test_name, 'all_features' AS feature, sqrt(2 * sum(diff * diff)) / sqrt({len(CORR_FEATURES)}) < 0.1 AS passed,
    round(sqrt(2 * sum(diff * diff)) / sqrt({len(CORR_FEATURES)}), 6) AS statistic, CAST(0.1 AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS p_value,
    round(sqrt(2 * sum(diff * diff)), 6) AS raw_frobenius FROM d""")
def q_corr_frobenius(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(C.corr_frobenius(real, cand, CORR_FEATURES).drop("n_features"))


@register("corr_top_pairs", CORR_DIFF_SQL + """,
  t AS (SELECT *, row_number() OVER (ORDER BY round(abs(real_corr), 12) DESC, i, j) AS rank FROM d WHERE real_corr IS NOT NULL)
  SELECT 'pairwise_correlation' AS test_name, feature_a || '_vs_' || feature_b AS feature,
    abs(abs(real_corr) - abs(candidate_corr)) < 0.1 AS passed, round(abs(abs(real_corr) - abs(candidate_corr)), 6) AS statistic,
    CAST(0.1 AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS p_value, rank FROM t WHERE rank <= 10""")
def q_corr_top_pairs(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(C.corr_top_pairs(real, cand, CORR_FEATURES).drop("real_correlation", "candidate_correlation"))


_CWC = [STAT_TIME, "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_with_class", f"""WITH {TX_SQL}, c AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, corr({f}, is_return) AS corr FROM real" for f in _CWC)})
  SELECT feature, round(corr, 6) AS corr, row_number() OVER (ORDER BY corr ASC NULLS LAST, feature) AS rank_asc FROM c""")
def q_corr_with_class(spark, sf):
    return rounded(C.corr_with_class(real_side(spark, sf), R.label, _CWC))


@register("zscore_outlier_rate", f"""WITH {TX_SQL},
  s AS (SELECT count(*) AS n, {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}, count({f}) AS k_{f}' for f in Z_FEATURES)} FROM cand),
  o AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, count(*) FILTER (WHERE k_{f} = n AND abs(({f} - m_{f}) / s_{f}) > 3) AS outlier_count, any_value(n) AS total_records FROM cand, s" for f in Z_FEATURES)})
  SELECT 'zscore_outliers' AS test_name, feature, outlier_count / total_records < 0.01 AS passed,
    round(outlier_count / total_records, 6) AS statistic, CAST(0.01 AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS p_value, outlier_count, total_records FROM o""")
def q_zscore_outlier_rate(spark, sf):
    return rounded(O.zscore_outlier_rate(candidate_side(spark, sf), Z_FEATURES))


@register("zscore_extreme_counts", f"""WITH {TX_SQL}, l AS {_unpivot_sql('real', Z_FEATURES)},
  s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY feature),
  c AS (SELECT l.feature, count(*) FILTER (WHERE abs((value - m) / sd) > 5) AS n_extreme FROM l JOIN s ON l.feature = s.feature GROUP BY l.feature)
  SELECT feature, n_extreme, row_number() OVER (ORDER BY n_extreme DESC, feature) AS rank FROM c""")
def q_zscore_extreme_counts(spark, sf):
    return O.zscore_extreme_counts(real_side(spark, sf), Z_FEATURES)


@register("iqr_outliers", f"""WITH {TX_SQL},
  q AS (SELECT quantile_cont(V14, 0.25) AS q1, quantile_cont(V14, 0.75) AS q3 FROM real),
  b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
  SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper,
    count(*) FILTER (WHERE V14 < lower OR V14 > upper) AS n_outliers, count(*) AS n,
    count(*) FILTER (WHERE (V14 < lower OR V14 > upper) AND is_return = 1) AS n_outliers_positive,
    round(count(*) FILTER (WHERE V14 < lower OR V14 > upper) * 100.0 / count(*), 6) AS pct_outliers
  FROM real, b GROUP BY q1, q3, lower, upper""")
def q_iqr_outliers(spark, sf):
    return rounded(O.iqr_outliers(real_side(spark, sf), "V14", R.label))


BAND_SQL = """CASE WHEN statistic < 0.05 THEN 'Excellent' WHEN statistic < 0.10 THEN 'Good' WHEN statistic < 0.20 THEN 'Fair' ELSE 'Poor' END"""


@register("ks_quality_bands", KS_SQL + f"""
  SELECT feature, round(statistic, 6) AS statistic, {BAND_SQL} AS band FROM ks""")
def q_ks_quality_bands(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.with_band(D.ks_two_sample(real, cand, KS_FEATURES, details=False)).select("feature", "statistic", "band"))


@register("ks_band_counts", KS_SQL + f""", b AS (SELECT statistic, {BAND_SQL} AS band FROM ks)
  SELECT count(*) AS n_features, count(*) FILTER (WHERE band = 'Excellent') AS n_excellent,
    count(*) FILTER (WHERE band = 'Good') AS n_good, count(*) FILTER (WHERE band = 'Fair') AS n_fair,
    count(*) FILTER (WHERE band = 'Poor') AS n_poor, round(min(statistic), 6) AS best_ks, round(max(statistic), 6) AS worst_ks,
    round(median(statistic), 6) AS median_ks, round(count(*) FILTER (WHERE band = 'Excellent') * 100.0 / count(*), 6) AS pct_excellent,
    count(*) FILTER (WHERE band = 'Excellent') * 100.0 / count(*) >= 95 AS target_met FROM b""")
def q_ks_band_counts(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.band_counts(D.ks_two_sample(real, cand, KS_FEATURES, details=False)))


@register("ks_best_worst", KS_SQL + """
  SELECT 'best' AS kind, row_number() OVER (ORDER BY statistic ASC, feature) AS rank, feature, round(statistic, 6) AS statistic FROM ks
  QUALIFY rank <= 5
  UNION ALL
  SELECT 'worst', row_number() OVER (ORDER BY statistic DESC, feature) AS rank, feature, round(statistic, 6) FROM ks QUALIFY rank <= 5""")
def q_ks_best_worst(spark, sf):
    real, cand = _sides(spark, sf)
    return rounded(D.ks_extremes(D.ks_two_sample(real, cand, KS_FEATURES, details=False), 5))


@register("ks_sorted", KS_SQL + """
  SELECT feature, round(statistic, 4) AS statistic, statistic < 0.05 AS passed FROM ks""")
def q_ks_sorted(spark, sf):
    real, cand = _sides(spark, sf)
    return D.ks_sorted(D.ks_two_sample(real, cand, KS_FEATURES, details=False))


@register("failed_tests", KS_SQL + f""",
  a AS (SELECT 'KS_test' AS test_name, feature, statistic < 0.05 AS passed, statistic, CAST(0.05 AS DOUBLE) AS threshold FROM ks)
  SELECT test_name, feature, round(statistic, 6) AS statistic, threshold FROM a WHERE NOT passed""")
def q_failed_tests(spark, sf):
    real, cand = _sides(spark, sf)
    t = D.ks_tests(D.ks_two_sample(real, cand, KS_FEATURES, details=False))
    return rounded(D.failed_tests(t).select("test_name", "feature", "statistic", "threshold"))


@register("feature_comparison", f"""WITH {TX_SQL}, u AS (SELECT 0 AS side, * FROM {_unpivot_sql('real', KEY_FEATURES)}
                 UNION ALL SELECT 1, * FROM {_unpivot_sql('cand', KEY_FEATURES)}),
  s AS (SELECT feature,
    avg(value) FILTER (WHERE side = 0) AS rm, avg(value) FILTER (WHERE side = 1) AS cm,
    stddev_samp(value) FILTER (WHERE side = 0) AS rs, stddev_samp(value) FILTER (WHERE side = 1) AS cs,
    min(value) FILTER (WHERE side = 0) AS rmin, min(value) FILTER (WHERE side = 1) AS cmin,
    max(value) FILTER (WHERE side = 0) AS rmax, max(value) FILTER (WHERE side = 1) AS cmax,
    quantile_cont(value, 0.25) FILTER (WHERE side = 0) AS rq25, quantile_cont(value, 0.25) FILTER (WHERE side = 1) AS cq25,
    quantile_cont(value, 0.5) FILTER (WHERE side = 0) AS rmed, quantile_cont(value, 0.5) FILTER (WHERE side = 1) AS cmed,
    quantile_cont(value, 0.75) FILTER (WHERE side = 0) AS rq75, quantile_cont(value, 0.75) FILTER (WHERE side = 1) AS cq75
    FROM u GROUP BY feature),
  c AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM u GROUP BY 1, 2),
  r AS (SELECT feature, sum(na) OVER (PARTITION BY feature ORDER BY value) AS cna, sum(nb) OVER (PARTITION BY feature ORDER BY value) AS cnb,
        sum(na) OVER (PARTITION BY feature) AS ta, sum(nb) OVER (PARTITION BY feature) AS tb FROM c),
  ks AS (SELECT feature, max(abs(cna / ta - cnb / tb)) AS statistic FROM r GROUP BY feature)
  SELECT s.feature, round(rm, 6) AS real_mean, round(cm, 6) AS candidate_mean, round(rs, 6) AS real_std, round(cs, 6) AS candidate_std,
    round(rmed, 6) AS real_median, round(cmed, 6) AS candidate_median,
    round(abs(cm - rm) / (abs(rm) + 1e-10) * 100, 6) AS mean_diff_pct, round(abs(cs - rs) / (abs(rs) + 1e-10) * 100, 6) AS std_diff_pct,
    round(abs(cmed - rmed) / (abs(rmed) + 1e-10) * 100, 6) AS median_diff_pct, round(statistic, 6) AS ks, {BAND_SQL} AS band
  FROM s JOIN ks ON s.feature = ks.feature""")
def q_feature_comparison(spark, sf):
    real, cand = _sides(spark, sf)
    fc = D.feature_comparison(real, cand, KEY_FEATURES)
    return rounded(fc.select("feature", "real_mean", "candidate_mean", "real_std", "candidate_std", "real_median", "candidate_median",
                             "mean_diff_pct", "std_diff_pct", "median_diff_pct", "ks", "band"))


def _forest_sql(trees: int = config.FOREST_TREES, m: int = config.FOREST_SAMPLE, share: float = config.FOREST_CONTAMINATION, seed: int = config.FOREST_SEED) -> str:
    """The isolation forest in SQL: the same hashed samples and splits, level by level, and every row's way through every tree."""
    prime, levels = 2147483647, 8
    def uniform(which: int) -> str:
        x = f"((tree_key * 48271 + {which * 16807 + seed}) % {prime})"
        for add in (12345, 67891):
            x = f"(({x} * {x} + {add}) % {prime})"
        return f"({x} / {prime}.0::DOUBLE)"
    values = "[" + ", ".join(f"coalesce({f}, 0.0)::DOUBLE" for f in CORR_FEATURES) + "]"
    parts = [f"""rows_ AS MATERIALIZED (SELECT 0 AS side, row_id, {values} AS v FROM real UNION ALL SELECT 1, row_id, {values} FROM cand),
      cnt AS (SELECT count(*) AS n, least({m}, count(*)) AS m FROM real),
      tr AS (SELECT range AS tree, 1 + ((range + 1) * 1103515245 + {seed * 12345}) % {prime - 1} AS a, ((range + 1) * 1664525013 + {seed}) % {prime} AS b FROM range({trees})),
      hits AS (SELECT tree, row_id, v, ((row_id % {prime}) * a + b) % {prime} AS h FROM rows_, tr, cnt
               WHERE side = 0 AND ((row_id % {prime}) * a + b) % {prime} < least({prime}, CAST(floor(4.0::DOUBLE * m / n * {prime}) AS BIGINT) + 1)),
      s0 AS MATERIALIZED (SELECT tree, 1 AS node, v FROM hits, cnt QUALIFY row_number() OVER (PARTITION BY tree ORDER BY h, row_id) <= m)"""]
    for k in range(levels + 1):
        parts.append(f"""g{k} AS (SELECT tree, node, i, count(*) AS size, min(v[i]) AS lo, max(v[i]) AS hi FROM s{k}, (SELECT range AS i FROM range(1, {len(CORR_FEATURES) + 1})) GROUP BY ALL),
      u{k} AS (SELECT tree, node, tree * 1024 + node + 1 AS tree_key, any_value(size) AS size, coalesce(list({{'i': i, 'lo': lo, 'hi': hi}} ORDER BY i) FILTER (WHERE hi > lo), []) AS u FROM g{k} GROUP BY tree, node),
      n{k} AS MATERIALIZED (SELECT tree, node, size, {k} AS depth, NOT ({k} < {levels} AND size > 1 AND len(u) > 0) AS is_leaf, u[CAST(floor(({uniform(1)}) * len(u)) AS BIGINT) + 1] AS x, {uniform(2)} AS u2 FROM u{k}),
      t{k} AS MATERIALIZED (SELECT tree, node, size, depth, is_leaf, x.i AS i, x.lo + u2 * (x.hi - x.lo) AS threshold FROM n{k})""")
        if k < levels:
            parts.append(f"s{k + 1} AS MATERIALIZED (SELECT tree, 2 * node + CASE WHEN v[i] < threshold THEN 0 ELSE 1 END AS node, v FROM s{k} JOIN t{k} USING (tree, node) WHERE NOT is_leaf)")
    parts.append("w0 AS (SELECT side, row_id, v, tree, 1 AS node FROM rows_, tr)")
    for k in range(levels):  # a row stays at its leaf
        parts.append(f"""w{k + 1} AS MATERIALIZED (SELECT w.side, w.row_id, w.tree, CASE WHEN t.tree IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN r.v[t.i] < t.threshold THEN 0 ELSE 1 END END AS node
      FROM w{k} w LEFT JOIN (SELECT * FROM t{k} WHERE NOT is_leaf) t ON w.tree = t.tree AND w.node = t.node JOIN rows_ r ON r.side = w.side AND r.row_id = w.row_id)""")
    path = "CASE WHEN {0} > 2 THEN 2.0 * (ln({0} - 1.0) + 0.5772156649015329) - 2.0 * ({0} - 1.0) / {0} WHEN {0} = 2 THEN 1.0 ELSE 0.0 END"
    leaves = " UNION ALL ".join(f"SELECT tree, node, depth + {path.format('size')} AS h FROM t{k} WHERE is_leaf" for k in range(levels + 1))
    parts.append(f"""leaves AS ({leaves}),
      score AS (SELECT side, row_id, round(-pow(2.0, -(sum(h) / {trees}) / any_value({path.format('m')})), 9) AS score FROM w{levels} JOIN leaves USING (tree, node), cnt GROUP BY side, row_id),
      cut AS (SELECT quantile_cont(score, {share}) AS cut_off FROM score WHERE side = 0),
      forest AS (SELECT count(*) FILTER (WHERE score < cut_off) AS outlier_count, count(*) AS total_records FROM score, cut WHERE side = 1)""")
    return f"""WITH {TX_SQL}, {', '.join(parts)}
  SELECT 'isolation_forest' AS test_name, 'multivariate' AS feature, outlier_count / total_records < {config.FOREST_RATE_THRESHOLD} AS passed, round(outlier_count / total_records, 6) AS statistic,
    CAST({config.FOREST_RATE_THRESHOLD} AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS p_value, outlier_count, total_records FROM forest"""


@register("isolation_forest", _forest_sql())
def q_isolation_forest(spark, sf):
    """The forest grown level by level; SQL recomputes every draw, split and score."""
    from fidelis.operators.forest import isolation_forest_test
    real, cand = _sides(spark, sf)
    return rounded(isolation_forest_test(real, cand, CORR_FEATURES, id_col=R.id))


@register("pair_compare", f"""WITH {TX_SQL}, {_KEY_U}
  SELECT feature, round(rm, 6) AS real_mean, round(cm, 6) AS candidate_mean, round(rs, 6) AS real_std, round(cs, 6) AS candidate_std FROM s""")
def q_pair_compare(spark, sf):
    """Per-feature statistics of each side, computed separately and joined by feature."""
    from fidelis.operators.frames import long_form
    real, cand = _sides(spark, sf)
    a = long_form(real, KEY_FEATURES).groupBy("feature").agg(F.avg("value").alias("real_mean"), F.stddev_samp("value").alias("real_std"))
    b = long_form(cand, KEY_FEATURES).groupBy("feature").agg(F.avg("value").alias("candidate_mean"),
                                                              F.stddev_samp("value").alias("candidate_std"))
    return rounded(a.join(b, "feature").select("feature", "real_mean", "candidate_mean", "real_std", "candidate_std"))
