"""Similarity queries (N1-N4, J1-J3, M1, K6, Q10) over the driver tables.

Vectors: ``embeddings`` - reference = labels 0-4, candidate = labels 5-9 (the whole
table, every candidate against every reference vector).  The tabular similarity
layer (Q10) uses ``lineitem``: every row of the candidate side is compared with the whole
real side through the pruned index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fidelis import config
from fidelis.operators import similarity as S
from fidelis.operators import vector_index as X
from fidelis.operators.sampling import sample_exact
from fidelis.plans.registry import register, rounded
from fidelis.session import checkpoint_dir
from fidelis.sources.tables import TX_SQL, candidate_side, real_side, table

SIM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.where(F.col("label") >= 5), e.where(F.col("label") < 5)


EMB_SQL = """c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label >= 5),
  r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label < 5),
  s AS (SELECT c.vec_id AS cid, r.vec_id AS rid, list_cosine_similarity(c.e, r.e) AS sim FROM c, r),
  b AS (SELECT cid, rid, sim, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, rid) AS rn FROM s)"""


@register("nn_cosine", f"WITH {EMB_SQL} SELECT cid AS vec_id, rid AS ref_id, round(sim, 6) AS max_similarity FROM b WHERE rn = 1")
def q_nn_cosine(spark, sf):
    cand, ref = _emb(spark, sf)
    return rounded(S.nn_cosine(cand, ref, "vec_id", "vec_id", "embedding"))


@register("nn_index_query", f"WITH {EMB_SQL} SELECT cid AS vec_id, rn AS rank, rid AS ref_id, round(sim, 6) AS similarity FROM b WHERE rn <= 3")
def q_nn_index_query(spark, sf):
    """The reference is indexed once and the index is read back from its folder for the search."""
    cand, ref = _emb(spark, sf)
    path = f"{checkpoint_dir(spark)}/embedding-index-{uuid.uuid4().hex}"
    X.build_index(ref, "vec_id", "embedding", path=path)
    found, _ = X.search(X.load_index(spark, path), cand, "vec_id", "embedding", 3)
    return rounded(found.select(F.col("id").alias("vec_id"), "rank", F.col("rid").alias("ref_id"), "similarity"))


@register("nn_pruning", f"""WITH {TX_SQL}, c AS (SELECT count(*) AS n FROM cand), r AS (SELECT count(*) AS n FROM real)
  SELECT c.n AS candidates, r.n AS reference_rows, c.n * r.n AS all_pairs, true AS pruned FROM c, r""")
def q_nn_pruning(spark, sf):
    """What a search of the whole candidate side asks of the index; ``pruned``: under a fifth of all pairs was compared."""
    real, cand = real_side(spark, sf), candidate_side(spark, sf)
    stats = S.scale_stats(real, SIM_FEATURES)
    index = X.build_index(S.vectorize(S.standard_scale(real, real, SIM_FEATURES, stats), "row_id", SIM_FEATURES), "row_id", "vec")
    _, work = X.search(index, S.vectorize(S.standard_scale(real, cand, SIM_FEATURES, stats), "row_id", SIM_FEATURES), "row_id", "vec", 1)
    X.drop_index(spark, index)
    pairs = work["candidates"] * work["rows"]
    return spark.createDataFrame([(work["candidates"], work["rows"], pairs, 5 * work["compared"] < pairs)],
                                 "candidates bigint, reference_rows bigint, all_pairs bigint, pruned boolean")


@register("sim_flagged", f"""WITH {EMB_SQL}
  SELECT cid AS vec_id, round(sim, 4) AS max_similarity, sim < 0.4 AS flagged FROM b WHERE rn = 1""")
def q_sim_flagged(spark, sf):
    cand, ref = _emb(spark, sf)
    return S.flag_rows(S.nn_cosine(cand, ref, "vec_id", "vec_id", "embedding")).drop("ref_id")


_RATE_SQL = f"""WITH {EMB_SQL}, f AS (SELECT sim < 0.4 AS flagged FROM b WHERE rn = 1),
  a AS (SELECT count(*) AS sampled, count(*) FILTER (WHERE flagged) AS anomalies FROM f)"""


@register("sim_anomaly_rate", _RATE_SQL + """
  SELECT sampled, anomalies, round(anomalies / greatest(sampled, 1), 4) AS anomaly_rate,
    anomalies / greatest(sampled, 1) > 0.15 AS escalated, round(greatest(0.0, 1 - anomalies / greatest(sampled, 1)), 4) AS score,
    anomalies / greatest(sampled, 1) <= 0.15 AS passed, 'exact_blocked' AS backend FROM a""")
def q_sim_anomaly_rate(spark, sf):
    cand, ref = _emb(spark, sf)
    return S.anomaly_rate(S.flag_rows(S.nn_cosine(cand, ref, "vec_id", "vec_id", "embedding")))


@register("escalation_context", f"""WITH {EMB_SQL}, f AS (SELECT cid, sim < 0.4 AS flagged FROM b WHERE rn = 1),
  a AS (SELECT count(*) AS sampled, count(*) FILTER (WHERE flagged) AS anomalies FROM f)
  SELECT cid AS vec_id, anomalies / greatest(sampled, 1) > 0.15 AS escalated,
    CASE WHEN anomalies / greatest(sampled, 1) > 0.15 THEN
      'similarity check: ' || anomalies || ' of ' || sampled || ' rows flagged (' || printf('%.1f', round(anomalies / greatest(sampled, 1), 4) * 100) || '%)' END AS context
  FROM f, a WHERE flagged""")
def q_escalation_context(spark, sf):
    cand, ref = _emb(spark, sf)
    flags = S.flag_rows(S.nn_cosine(cand, ref, "vec_id", "vec_id", "embedding"))
    return S.flagged_ids(S.anomaly_rate(flags), flags, "vec_id")


@register("standard_scale", f"""WITH {TX_SQL},
  s AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in SIM_FEATURES)} FROM real)
  SELECT row_id, {', '.join(f"round(({f} - m_{f}) / CASE WHEN s_{f} IS NULL OR s_{f} = 0 THEN 1.0 ELSE s_{f} END, 6) AS {f}" for f in SIM_FEATURES)}
  FROM cand, s""")
def q_standard_scale(spark, sf):
    return rounded(S.standard_scale(real_side(spark, sf), candidate_side(spark, sf).select("row_id", *SIM_FEATURES), SIM_FEATURES))


@register("sample_rows", f"""WITH {TX_SQL} SELECT row_id FROM cand ORDER BY md5(concat(row_id, '-', '42')), row_id LIMIT 20""")
def q_sample_rows(spark, sf):
    return S.sample_rows(candidate_side(spark, sf), "row_id", 20, 42).select("row_id")


@register("sample_exact", f"""WITH {TX_SQL}, h AS (SELECT row_id, l_extendedprice, row_number() OVER (ORDER BY md5(concat(row_id, '-', '7')), row_id) AS r FROM cand)
  SELECT row_id, l_extendedprice FROM h WHERE r <= (SELECT count(*) // 2 FROM cand)""")
def q_sample_exact(spark, sf):
    """K6: exactly half of the candidate side by the cut-off of a hash, no sort and no heap."""
    cand = candidate_side(spark, sf)
    return sample_exact(cand, "row_id", cand.count() // 2, 7).select("row_id", "l_extendedprice")


@register("semi_by_id", f"""WITH {TX_SQL}, f AS (SELECT row_id FROM cand WHERE l_extendedprice > 100000)
  SELECT row_id, l_extendedprice FROM cand WHERE row_id IN (SELECT row_id FROM f)""")
def q_semi_by_id(spark, sf):
    cand = candidate_side(spark, sf)
    ids = cand.where(F.col("l_extendedprice") > 100000).select("row_id")
    return S.semi_by_id(cand, ids, "row_id").select("row_id", "l_extendedprice")


def similarity_layer(real, cand, features, sample_size=None, seed=42,
                     threshold=config.SIMILARITY_THRESHOLD):
    """Q10: all candidate rows, or a sample of them -> scale by the reference -> exact best cosine -> flags -> summary."""
    sampled = S.sample_rows(cand, "row_id", sample_size, seed) if sample_size is not None else cand
    ref_s = S.vectorize(S.standard_scale(real, real, features), "row_id", features)
    cand_s = S.vectorize(S.standard_scale(real, sampled, features), "row_id", features)
    flags = S.flag_rows(S.nn_cosine(cand_s, ref_s, "row_id", "row_id", "vec"), threshold)
    return flags, S.anomaly_rate(flags)


def _unit_sql(side: str) -> str:
    """Unit vectors (zero where there is no direction) of a side's scaled features, as SQL."""
    scaled = ", ".join(f"coalesce(({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1.0 ELSE s_{f} END, 0.0) AS x_{f}" for f in SIM_FEATURES)
    norm = " + ".join(f"x_{f} * x_{f}" for f in SIM_FEATURES)
    return (f"SELECT row_id, {', '.join(f'CASE WHEN n = 0 THEN 0.0 ELSE x_{f} / n END AS u_{f}' for f in SIM_FEATURES)} "
            f"FROM (SELECT *, sqrt({norm}) AS n FROM (SELECT row_id, {scaled} FROM {side}, st))")


_Q10_SQL = f"""WITH {TX_SQL},
  st AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in SIM_FEATURES)} FROM real),
  cs AS ({_unit_sql('cand')}), rs AS ({_unit_sql('real')}),
  best AS (SELECT cs.row_id, max({' + '.join(f'cs.u_{f} * rs.u_{f}' for f in SIM_FEATURES)}) AS sim FROM cs, rs GROUP BY cs.row_id),
  a AS (SELECT count(*) AS sampled, count(*) FILTER (WHERE sim < 0.4) AS anomalies FROM best)"""


@register("validate_similarity", _Q10_SQL + """
  SELECT sampled, anomalies, round(anomalies / greatest(sampled, 1), 4) AS anomaly_rate,
    anomalies / greatest(sampled, 1) > 0.15 AS escalated, round(greatest(0.0, 1 - anomalies / greatest(sampled, 1)), 4) AS score,
    anomalies / greatest(sampled, 1) <= 0.15 AS passed, 'exact_blocked' AS backend FROM a""")
def q_validate_similarity(spark, sf):
    _, summary = similarity_layer(real_side(spark, sf), candidate_side(spark, sf), SIM_FEATURES)
    return summary


@register("sim_summary_dict", _Q10_SQL + """
  SELECT row_id, round(sim, 4) AS max_similarity, sim < 0.4 AS flagged FROM best""")
def q_sim_summary_dict(spark, sf):
    flags, _ = similarity_layer(real_side(spark, sf), candidate_side(spark, sf), SIM_FEATURES)
    return flags.select("row_id", "max_similarity", "flagged")
