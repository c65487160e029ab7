"""Generation and row-order queries (G1-G7, J5, K5, K7, U1, U2) over the driver tables.

The bootstrap draws as many rows as the real side holds, with its own positive
rate, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import synth as G
from fidelis.operators.similarity import sample_rows
from fidelis.plans.registry import register, rounded
from fidelis.sources.tables import TX_ROLES, TX_SQL, candidate_side, real_side

R = TX_ROLES
SEED = 42
JITTER_FEATURES = [R.time, "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GEN_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def u_sql(key: str, seed, salt: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat({key}, '-', '{seed}', '-', '{salt}')), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def normal_sql(key: str, seed, salt: str) -> str:
    u1 = f"greatest({u_sql(key, seed, salt + '#u1')}, 1.1102230246251565e-16)"
    return f"(sqrt(-2.0 * ln({u1})) * cos(6.283185307179586 * {u_sql(key, seed, salt + '#u2')}))"


def _seconds_ms(df):
    """Seconds (about 1e8: the engines' libm and summation order differ in the last
    digits) are compared in whole seconds, the other columns at 1e-6."""
    return df.withColumn(R.time, F.round(R.time, 0))


def _real_size(real):
    row = real.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(R.label).cast("double")).alias("rate")).first()
    return int(row["n"]), float(row["rate"] or 0.0)


def bootstrap(spark, sf, seed=SEED):
    real = real_side(spark, sf)
    n, rate = _real_size(real)
    return G.stratified_bootstrap(real, n, rate, seed, R.id, R.label)


BOOT_SQL = f"""tot AS (SELECT count(*) AS n, sum(is_return) AS npos FROM real),
  pool AS (SELECT *, row_number() OVER (PARTITION BY is_return ORDER BY row_id) - 1 AS idx FROM real),
  sizes AS (SELECT is_return, count(*) AS pn FROM real GROUP BY 1),
  draws AS (SELECT range AS draw_id, CASE WHEN range < n - greatest(1, npos) THEN 0 ELSE 1 END AS is_return FROM tot, range(n)),
  dd AS (SELECT draw_id, draws.is_return, CAST(floor({u_sql('draw_id', SEED, 'draw')} * pn) AS BIGINT) AS idx
         FROM draws JOIN sizes ON draws.is_return = sizes.is_return),
  boot AS (SELECT dd.draw_id AS row_id, pool.row_id AS source_row_id, pool.ship_seconds, pool.l_quantity, pool.l_extendedprice,
           pool.l_discount, pool.l_tax, dd.is_return FROM dd JOIN pool ON dd.is_return = pool.is_return AND dd.idx = pool.idx)"""


@register("stratified_bootstrap", f"WITH {TX_SQL}, {BOOT_SQL} SELECT row_id, source_row_id, is_return FROM boot")
def q_stratified_bootstrap(spark, sf):
    return bootstrap(spark, sf).select(R.id, "source_row_id", R.label)


@register("resample_join", f"""WITH {TX_SQL}, {BOOT_SQL}
  SELECT is_return, count(*) AS draws, count(DISTINCT source_row_id) AS distinct_sources FROM boot GROUP BY is_return""")
def q_resample_join(spark, sf):
    b = bootstrap(spark, sf)
    return b.groupBy(R.label).agg(F.count(F.lit(1)).alias("draws"), F.countDistinct("source_row_id").alias("distinct_sources"))


@register("bootstrap_counts", f"""WITH {TX_SQL}, t AS (SELECT count(*) AS n, avg(is_return) AS rate FROM real),
  c AS (SELECT n, least(n, greatest(1, CAST(round_even(n * rate, 0) AS BIGINT))) AS pos FROM t)
  SELECT is_return, CASE WHEN is_return = 1 THEN pos ELSE n - pos END AS draws, CASE WHEN is_return = 1 THEN pos ELSE n - pos END AS new_ids,
    CAST(0 AS BIGINT) AS changed_rows, true AS spread FROM c, (SELECT unnest([0, 1]) AS is_return)""")
def q_bootstrap_counts(spark, sf):
    """G1 by counts: exact class totals, new ids without repeats, every drawn row equal to its source; ``spread``:
    the share of the pool that is drawn lies within 2 % of 1 - 1/e, as for independent draws."""
    real = real_side(spark, sf)
    n, rate = _real_size(real)
    drawn = G.bootstrap_by_counts(real, n, rate, SEED, R.id, R.label).select(R.id, "source_row_id", R.amount, R.label)
    source = real.select(F.col(R.id).alias("source_row_id"), F.col(R.amount).alias("_amount"), F.col(R.label).alias("_label"))
    j = drawn.join(source, "source_row_id", "left")
    same = F.col(R.amount).eqNullSafe(F.col("_amount")) & F.col(R.label).eqNullSafe(F.col("_label"))
    per = j.groupBy(R.label).agg(F.count(F.lit(1)).alias("draws"), F.count_distinct(R.id).alias("new_ids"), F.count_if(~same).alias("changed_rows"), F.count_distinct("source_row_id").alias("_s"))
    pools = real.groupBy(R.label).agg(F.count(F.lit(1)).alias("_n"))
    share = 1 - F.exp(-F.col("draws") / F.col("_n"))
    return per.join(pools, R.label).select(R.label, "draws", "new_ids", "changed_rows", (F.abs(F.col("_s") / F.col("_n") - share) < 0.02).alias("spread"))


_STD = ", ".join(f"stddev_samp({f}) AS s_{f}" for f in JITTER_FEATURES)


def _jit_expr(f: str) -> str:
    v = f"({f} + {normal_sql('row_id', SEED, 'jitter:' + f)} * 0.02 * coalesce(s_{f}, 0.0))"
    if f in (R.time, R.amount):
        v = f"CASE WHEN {v} IS NULL THEN NULL ELSE greatest({v}, 0.0) END"
    return f"round({v}, {0 if f == R.time else 6}) AS {f}"


JITTER_SQL = f"""WITH {TX_SQL}, {BOOT_SQL}, st AS (SELECT {_STD} FROM boot)
  SELECT row_id, {', '.join(_jit_expr(f) for f in JITTER_FEATURES)}, is_return FROM boot, st"""


@register("jitter_columns", JITTER_SQL)
def q_jitter_columns(spark, sf):
    b = bootstrap(spark, sf).drop("source_row_id")
    j = G.jitter_columns(b, JITTER_FEATURES, R.id, SEED, non_negative=[R.amount, R.time])
    return rounded(_seconds_ms(j.select(R.id, *JITTER_FEATURES, R.label)))


@register("generate_synthetic", JITTER_SQL)
def q_generate_synthetic(spark, sf):
    real = real_side(spark, sf)
    n, rate = _real_size(real)
    out = G.generate_synthetic(real, n, rate, SEED, R.id, R.label, [f for f in JITTER_FEATURES if f != R.time], R.amount, R.time)
    return rounded(_seconds_ms(out.select(R.id, *JITTER_FEATURES, R.label)))


def _gen_col(f: str) -> str:
    return f"round(m_{f} + coalesce(s_{f}, 0.0) * {normal_sql('row_id', SEED, 'f:' + f)}, 6) AS {f}"


@register("generate_from_profile", f"""WITH {TX_SQL},
  tot AS (SELECT count(*) AS n, sum(is_return) AS npos FROM real),
  prof AS (SELECT is_return, {', '.join(f'avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}' for f in GEN_FEATURES)},
           avg(ln(1 + l_extendedprice)) AS m_log, stddev_samp(ln(1 + l_extendedprice)) AS s_log, max(l_extendedprice) AS max_amount
           FROM real GROUP BY is_return),
  tp AS (SELECT avg(ship_seconds) AS m_time, stddev_samp(ship_seconds) AS s_time, max(ship_seconds) AS max_time FROM real),
  draws AS (SELECT range AS row_id, CASE WHEN range < n - greatest(1, npos) THEN 0 ELSE 1 END AS is_return FROM tot, range(n))
  SELECT d.row_id, round(least(greatest(m_time + s_time * {normal_sql('d.row_id', SEED, 'time')}, 0.0), max_time), 0) AS ship_seconds,
    {', '.join(_gen_col(f) for f in GEN_FEATURES)},
    round(least(greatest(exp(m_log + coalesce(s_log, 0.0) * {normal_sql('d.row_id', SEED, 'amount')}) - 1, 0.0), max_amount), 6) AS l_extendedprice,
    d.is_return
  FROM draws d JOIN prof ON d.is_return = prof.is_return, tp""")
def q_generate_from_profile(spark, sf):
    real = real_side(spark, sf)
    n, rate = _real_size(real)
    prof = G.class_profile(real, R.label, GEN_FEATURES, R.amount, R.time)
    out = G.generate_from_profile(prof, n, rate, SEED, R.id, R.label, GEN_FEATURES, R.amount, R.time)
    return rounded(_seconds_ms(out.select(R.id, R.time, *GEN_FEATURES, R.amount, R.label)))


@register("generate_reference", f"WITH {TX_SQL} SELECT row_id FROM real ORDER BY md5(concat(row_id, '-', '0')), row_id LIMIT 500")
def q_generate_reference(spark, sf):
    return sample_rows(real_side(spark, sf), R.id, 500, 0).select(R.id)


@register("class_conditions", f"""WITH {TX_SQL}, t AS (SELECT (SELECT count(*) FROM cand) AS n, (SELECT avg(is_return) FROM real) AS rate)
  SELECT range AS row_id, CASE WHEN range < n - CAST(floor(n * rate) AS BIGINT) THEN 0 ELSE 1 END AS is_return FROM t, range(n)""")
def q_class_conditions(spark, sf):
    n = candidate_side(spark, sf).count()
    _, rate = _real_size(real_side(spark, sf))
    return G.class_conditions(spark, n, rate, R.label, R.id)


@register("generation_summary", f"""WITH {TX_SQL}, {BOOT_SQL}
  SELECT count(*) AS n, CAST(sum(is_return) AS BIGINT) AS n_positive, round(avg(is_return), 5) AS positive_rate FROM boot""")
def q_generation_summary(spark, sf):
    return G.generation_summary(bootstrap(spark, sf), R.label)


@register("preview", f"WITH {TX_SQL} SELECT row_id, l_extendedprice FROM cand ORDER BY row_id LIMIT 5")
def q_preview(spark, sf):
    return G.preview(candidate_side(spark, sf), R.id, 5).select(R.id, R.amount)


@register("shuffle_rows", f"""WITH {TX_SQL}
  SELECT row_id, row_number() OVER (ORDER BY {u_sql('row_id', SEED, 'shuffle')}) - 1 AS position FROM cand""")
def q_shuffle_rows(spark, sf):
    return G.shuffle_rows(candidate_side(spark, sf), R.id, SEED).select(R.id, "position")


@register("union_all", f"WITH {TX_SQL} SELECT row_id, is_return FROM real UNION ALL SELECT row_id, is_return FROM cand")
def q_union_all(spark, sf):
    return G.union_all(real_side(spark, sf).select(R.id, R.label), candidate_side(spark, sf).select(R.id, R.label))


@register("union_flagged_ids", f"""WITH {TX_SQL}
  SELECT row_id FROM cand WHERE NOT coalesce(l_extendedprice <= 50000, false)
  UNION SELECT row_id FROM cand WHERE l_discount > 0.09""")
def q_union_flagged_ids(spark, sf):
    cand = candidate_side(spark, sf)
    a = cand.where(~F.coalesce(F.col(R.amount) <= 50000, F.lit(False))).select(R.id)
    b = cand.where(F.col("l_discount") > 0.09).select(R.id)
    return G.union_ids(a, b, id_col=R.id)
