"""Profile queries (S5, S6, P1-P9, A1-A13, H1, H2, W1, W2) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.functions import columns as C
from fidelis.operators import profile as P
from fidelis.operators import schema as S
from fidelis.plans.registry import register, rounded
from fidelis.sources import io
from fidelis.sources.tables import STAT_TIME, TX_ROLES, TX_SQL, WIDE, candidate_side, real_side, table, transactions

R = TX_ROLES
STAT_FEATURES = [STAT_TIME, "l_quantity", "l_extendedprice", "l_discount", "l_tax", R.label]

# real side with every statistics column as DOUBLE, unpivoted (DuckDB drops NULLs in UNPIVOT)
REAL_LONG = """real_d AS (SELECT row_id, is_return, CAST(ship_hours AS DOUBLE) AS ship_hours, l_quantity, l_extendedprice,
      l_discount, l_tax, CAST(is_return AS DOUBLE) AS is_return_d FROM real),
  real_long AS (UNPIVOT (SELECT row_id, is_return, ship_hours, l_quantity, l_extendedprice, l_discount, l_tax,
      is_return_d AS "is_return#" FROM real_d)
    ON ship_hours, l_quantity, l_extendedprice, l_discount, l_tax, "is_return#" INTO NAME feature VALUE value),
  real_l AS (SELECT row_id, is_return, replace(feature, '#', '') AS feature, value FROM real_long)"""


@register("scan_table", "SELECT count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS sum_quantity FROM lineitem")
def q_scan_table(spark, sf):
    df = io.scan_table(spark, f"{sf}/lineitem.parquet")
    return rounded(df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_quantity")))


_SIDE_COLUMNS = ["row_id", "ship_seconds", "ship_hours", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "is_return", *WIDE]


@register("schema_match", f"WITH {TX_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", true AS in_real, true AS in_candidate, true AS position_equal,
    (SELECT count({c}) FROM real) AS real_values, (SELECT count({c}) FROM cand) AS candidate_values""" for c in _SIDE_COLUMNS))
def q_schema_match(spark, sf):
    return io.schema_match(real_side(spark, sf), candidate_side(spark, sf))


@register("infer_types", """SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'numerical'), ('o_custkey', 'bigint', 'numerical'),
  ('o_orderstatus', 'string', 'categorical'), ('o_totalprice', 'double', 'numerical'),
  ('o_orderdate', 'timestamp_ntz', 'categorical'), ('o_orderpriority', 'string', 'categorical')) t("column", dtype, sdtype)""")
def q_infer_types(spark, sf):
    return io.infer_types(table(spark, sf, "orders")).select("column", "dtype", "sdtype")


@register("project_features", f"WITH {TX_SQL} SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax FROM real")
def q_project_features(spark, sf):
    return S.project_features(real_side(spark, sf), ["row_id"] + R.features)


@register("numeric_columns", """SELECT c_custkey, c_nationkey, c_acctbal FROM customer""")
def q_numeric_columns(spark, sf):
    return S.numeric_columns(table(spark, sf, "customer"))


@register("common_columns", """SELECT 'o_orderkey' AS "column", (SELECT count(o_orderkey) FROM orders) AS values_a, (SELECT count(l_orderkey) FROM lineitem) AS values_b
  UNION ALL SELECT 'o_custkey', (SELECT count(o_custkey) FROM orders), (SELECT count(l_partkey) FROM lineitem)""")
def q_common_columns(spark, sf):
    orders = table(spark, sf, "orders")
    other = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("o_custkey"),
                                                 "l_quantity")
    return S.common_columns_frame(orders, other)


@register("filter_class", f"WITH {TX_SQL} SELECT row_id FROM real WHERE is_return = 1")
def q_filter_class(spark, sf):
    return S.filter_class(real_side(spark, sf), R.label, 1).select("row_id")


@register("filter_range", f"WITH {TX_SQL} SELECT row_id FROM real WHERE is_return = 1 AND l_extendedprice < 2000")
def q_filter_range(spark, sf):
    return S.filter_range(real_side(spark, sf), R.label, 1, R.amount, 2000.0).select("row_id")


@register("derive_hours", f"WITH {TX_SQL} SELECT row_id, round(ship_seconds / 3600.0, 6) AS hours FROM real")
def q_derive_hours(spark, sf):
    return rounded(real_side(spark, sf).select("row_id", C.seconds_to_hours(R.time).alias("hours")))


@register("derive_log1p", f"""WITH {TX_SQL} SELECT row_id, round(ln(1 + l_extendedprice), 6) AS log_amount,
  round(exp(ln(1 + l_extendedprice)) - 1, 6) AS amount_back FROM real""")
def q_derive_log1p(spark, sf):
    df = real_side(spark, sf).select("row_id", C.log1p_amount(R.amount).alias("log_amount"))
    return rounded(df.select("row_id", "log_amount", F.expm1("log_amount").alias("amount_back")))


@register("clip_bounds", """SELECT c_custkey, round(greatest(c_acctbal, 0), 6) AS clipped_low,
  round(least(greatest(c_acctbal, -100), 100), 6) AS clipped_both FROM customer""")
def q_clip_bounds(spark, sf):
    cu = table(spark, sf, "customer")
    return rounded(cu.select("c_custkey", C.clip("c_acctbal", 0.0).alias("clipped_low"),
                             C.clip("c_acctbal", -100.0, 100.0).alias("clipped_both")))


@register("threshold_label", """SELECT event_id, CAST(value / 490.02 > 0.5 AS INTEGER) AS label FROM events""")
def q_threshold_label(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", C.threshold_label(F.col("value") / F.lit(490.02)).alias("label"))


@register("table_profile", """SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
  count(*) * 11 - (count(l_orderkey) + count(l_partkey) + count(l_suppkey) + count(l_linenumber) + count(l_quantity)
   + count(l_extendedprice) + count(l_discount) + count(l_tax) + count(l_returnflag) + count(l_linestatus) + count(l_shipdate)) AS total_nulls,
  CAST(8 AS BIGINT) AS numeric_columns, CAST(3 AS BIGINT) AS other_columns FROM lineitem""")
def q_table_profile(spark, sf):
    return P.table_profile(table(spark, sf, "lineitem"))


@register("duplicate_rows", """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) AS distinct_rows,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)""")
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(table(spark, sf, "documents"), ["text"])


@register("class_distribution", f"""WITH {TX_SQL}, c AS (SELECT is_return AS class, count(*) AS count FROM tx GROUP BY 1)
  SELECT class, count, round(count * 100.0 / sum(count) OVER (), 6) AS percent,
         (max(count) OVER ()) // (min(count) OVER ()) AS imbalance_ratio FROM c""")
def q_class_distribution(spark, sf):
    return rounded(P.class_distribution(transactions(spark, sf), R.label))


@register("share_of_total", """SELECT l_returnflag, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
  FROM lineitem GROUP BY 1""")
def q_share_of_total(spark, sf):
    return rounded(P.share_of_total(table(spark, sf, "lineitem"), "l_returnflag"))


@register("fraud_rate", f"""WITH {TX_SQL} SELECT count(*) AS n_rows, CAST(sum(is_return) AS BIGINT) AS n_positive,
  round(avg(is_return), 6) AS rate FROM real""")
def q_fraud_rate(spark, sf):
    return rounded(P.fraud_rate(real_side(spark, sf), R.label))


@register("fraud_rate_match", f"""WITH {TX_SQL}, a AS (SELECT avg(is_return) AS r FROM real), b AS (SELECT avg(is_return) AS c FROM cand)
  SELECT round(r, 6) AS real_rate, round(c, 6) AS candidate_rate, round(abs(r - c), 6) AS abs_diff, abs(r - c) < 0.0001 AS matched FROM a, b""")
def q_fraud_rate_match(spark, sf):
    return rounded(P.fraud_rate_match(real_side(spark, sf), candidate_side(spark, sf), R.label))


_DESCRIBE_SQL = """SELECT feature{by}, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
   round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
   round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM real_l GROUP BY feature{by}"""


@register("describe_column", f"WITH {TX_SQL}, {REAL_LONG} " + _DESCRIBE_SQL.format(by=""))
def q_describe_column(spark, sf):
    return rounded(P.describe(real_side(spark, sf), STAT_FEATURES))


@register("describe_by_class", f"WITH {TX_SQL}, {REAL_LONG} " + _DESCRIBE_SQL.format(by=", is_return"))
def q_describe_by_class(spark, sf):
    return rounded(P.describe(real_side(spark, sf), STAT_FEATURES, by=R.label))


@register("column_stats", f"""WITH {TX_SQL}, {REAL_LONG}
  SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
    round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25,
    round(quantile_cont(value, 0.75), 6) AS q75, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis
  FROM real_l GROUP BY feature""")
def q_column_stats(spark, sf):
    return P.column_stats(real_side(spark, sf), STAT_FEATURES)


@register("class_mean_diff", f"""WITH {TX_SQL}, {REAL_LONG},
  g AS (SELECT feature, avg(value) FILTER (WHERE is_return = 1) AS mp, avg(value) FILTER (WHERE is_return = 0) AS mn FROM real_l
        WHERE feature <> 'is_return' GROUP BY feature)
  SELECT feature, round(mp, 6) AS mean_positive, round(mn, 6) AS mean_negative, round(abs(mp - mn), 6) AS abs_diff,
    row_number() OVER (ORDER BY abs(mp - mn) DESC NULLS LAST, feature) AS rank FROM g""")
def q_class_mean_diff(spark, sf):
    return rounded(P.class_mean_diff(real_side(spark, sf), R.label, [f for f in STAT_FEATURES if f != R.label], k=5))


@register("class_quantiles", f"""WITH {TX_SQL} SELECT is_return AS class,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99
  FROM real GROUP BY is_return""")
def q_class_quantiles(spark, sf):
    return rounded(P.class_quantiles(real_side(spark, sf), R.label, R.amount))


@register("class_median", f"""WITH {TX_SQL} SELECT is_return AS class, round(median(l_extendedprice), 6) AS median FROM real GROUP BY 1""")
def q_class_median(spark, sf):
    return rounded(P.class_median(real_side(spark, sf), R.label, R.amount))


@register("class_moments", f"""WITH {TX_SQL},
  l AS (UNPIVOT (SELECT is_return, l_quantity, l_extendedprice, l_discount, l_tax, ln(1 + l_extendedprice) AS log1p_amount FROM real)
        ON l_quantity, l_extendedprice, l_discount, l_tax, log1p_amount INTO NAME feature VALUE value)
  SELECT is_return AS class, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(max(value), 6) AS max
  FROM l GROUP BY 1, 2
  UNION ALL SELECT NULL, 'ship_hours', round(avg(ship_hours), 6), round(stddev_samp(ship_hours), 6), round(max(ship_hours), 6) FROM real""")
def q_class_moments(spark, sf):
    return rounded(P.class_moments(real_side(spark, sf), R.label, R.features, R.amount, STAT_TIME))


@register("real_data_summary", f"""WITH {TX_SQL},
  d AS (SELECT feature, abs(avg(value) FILTER (WHERE is_return = 1) - avg(value) FILTER (WHERE is_return = 0)) AS diff
        FROM (UNPIVOT (SELECT is_return, l_quantity, l_extendedprice, l_discount, l_tax FROM real)
              ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value) GROUP BY feature)
  SELECT 'n_rows' AS metric, round(CAST(count(*) AS DOUBLE), 6) AS value, CAST(NULL AS VARCHAR) AS detail FROM real
  UNION ALL SELECT 'positive_rate_pct', round(avg(is_return) * 100, 6), NULL FROM real
  UNION ALL SELECT 'amount_mean', round(avg(l_extendedprice), 6), NULL FROM real
  UNION ALL SELECT 'amount_max', round(max(l_extendedprice), 6), NULL FROM real
  UNION ALL SELECT 'time_min', round(min(ship_seconds), 6), NULL FROM real
  UNION ALL SELECT 'time_max', round(max(ship_seconds), 6), NULL FROM real
  UNION ALL SELECT 'n_features', 4.0, NULL
  UNION ALL SELECT 'amount_median', round(median(l_extendedprice), 6), NULL FROM real
  UNION ALL SELECT 'amount_median_class_' || is_return, round(median(l_extendedprice), 6), NULL FROM real GROUP BY is_return
  UNION ALL SELECT 'top_feature_' || row_number() OVER (ORDER BY diff DESC, feature), round(diff, 6), feature FROM d""")
def q_real_data_summary(spark, sf):
    return rounded(P.real_data_summary(real_side(spark, sf), R.label, R.amount, R.time, R.features))


@register("lognormal_fit", f"""WITH {TX_SQL} SELECT round(avg(ln(1 + l_extendedprice)), 6) AS log_mean,
  round(stddev_samp(ln(1 + l_extendedprice)), 6) AS log_std FROM real""")
def q_lognormal_fit(spark, sf):
    return rounded(P.lognormal_fit(real_side(spark, sf), R.amount))


@register("histogram", f"""WITH {TX_SQL}, r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM real),
  w AS (SELECT lo, (hi - lo) / 50 AS w FROM r),
  c AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS INTEGER), 49) AS bin, count(*) AS n FROM real, w GROUP BY 1),
  g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50))
  SELECT g.bin, round(lo + g.bin * w, 6) AS bin_lo, round(lo + (g.bin + 1) * w, 6) AS bin_hi, coalesce(n, 0) AS count,
    round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER () * w), 6) AS density
  FROM g CROSS JOIN w LEFT JOIN c ON g.bin = c.bin""")
def q_histogram(spark, sf):
    return rounded(P.histogram(real_side(spark, sf), R.amount, bins=50))


@register("boxplot_stats", f"""WITH {TX_SQL},
  q AS (SELECT is_return, quantile_cont(V14, 0.25) AS q1, quantile_cont(V14, 0.5) AS median,
        quantile_cont(V14, 0.75) AS q3 FROM real GROUP BY 1)
  SELECT r.is_return, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    round(min(V14) FILTER (WHERE V14 >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
    round(max(V14) FILTER (WHERE V14 <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
    count(*) FILTER (WHERE V14 < q1 - 1.5 * (q3 - q1) OR V14 > q3 + 1.5 * (q3 - q1)) AS n_outliers,
    count(*) AS n
  FROM real r JOIN q ON r.is_return = q.is_return GROUP BY r.is_return, q1, median, q3""")
def q_boxplot_stats(spark, sf):
    return rounded(P.boxplot_stats(real_side(spark, sf), "V14", by=R.label))


@register("ecdf", f"""WITH {TX_SQL}, c AS (SELECT l_quantity AS value, count(*) AS n_at FROM cand GROUP BY 1)
  SELECT value, n_at, CAST(sum(n_at) OVER (ORDER BY value) AS BIGINT) AS cum_count,
    round(sum(n_at) OVER (ORDER BY value) / sum(n_at) OVER (), 6) AS ecdf FROM c""")
def q_ecdf(spark, sf):
    return rounded(P.ecdf(candidate_side(spark, sf), "l_quantity"))


@register("ecdf_positions", f"""WITH {TX_SQL} SELECT l_discount AS value, row_number() OVER (ORDER BY l_discount) AS position,
  round(row_number() OVER (ORDER BY l_discount) / count(*) OVER (), 6) AS ecdf FROM cand""")
def q_ecdf_positions(spark, sf):
    return rounded(P.ecdf(candidate_side(spark, sf), "l_discount", per_row=True))
