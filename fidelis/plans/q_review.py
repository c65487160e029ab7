"""Review (V1-V5, Q9) and audit (X1-X6, U3) queries over the driver tables.

Review responses are derived from the tables: every assistant turn of
``conversations`` is a (non-JSON) review text, every plausibility finding on the
candidate side is a one-item JSON list, and every ``events.props`` value is a JSON
object (not a list).  The audit input is that parsed table plus reviews derived from
``documents`` on which every check fires.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis import config
from fidelis.operators import audit as A
from fidelis.operators import review as V
from fidelis.operators import synth as G
from fidelis.plans.layers import LayerSpec, review_layer
from fidelis.plans.q_rules import _FAIL_SQL, tx_rules
from fidelis.plans.q_similarity import SIM_FEATURES
from fidelis.plans.q_stats import CORR_FEATURES, KEY_FEATURES, KS_FEATURES, Z_FEATURES
from fidelis.plans.registry import register, rounded
from fidelis.sources.tables import TX_ROLES, TX_SQL, candidate_side, real_side, table

R = TX_ROLES
REVIEW_KEY = "l_discount"
REVIEW_FEATURES = ["l_quantity", "l_discount", "l_tax"]
AMOUNT_LIMIT, KEY_HIGH, KEY_LOW = 50000.0, 0.09, 0.01

TX_SPEC = LayerSpec(roles=R, rules=tx_rules(), ks_features=KS_FEATURES, key_features=KEY_FEATURES,
                    corr_features=CORR_FEATURES, z_features=Z_FEATURES, sim_features=SIM_FEATURES,
                    review_key=REVIEW_KEY, review_features=REVIEW_FEATURES, review_amount_limit=AMOUNT_LIMIT,
                    review_key_high=KEY_HIGH, review_key_low=KEY_LOW, forest_features=CORR_FEATURES)  # all flagged rows, all candidate rows


def _context(real):
    return V.review_context(real, R.label, R.amount, REVIEW_KEY)


def plausibility_frame(spark, sf):
    from fidelis.operators.frames import attach
    real, cand = real_side(spark, sf), candidate_side(spark, sf)
    rv = attach(cand, _context(real))
    return V.plausibility(rv, R.id, R.label, R.amount, REVIEW_KEY, AMOUNT_LIMIT, KEY_HIGH, KEY_LOW, F.col("_med"), F.col("_mean"))


PLAUS_SQL = f"""ctx AS (SELECT median(l_extendedprice) FILTER (WHERE is_return = 1) AS med, avg(l_discount) FILTER (WHERE is_return = 1) AS mn FROM real),
  pl AS (SELECT row_id AS row_index,
      CASE WHEN is_return = 1 AND l_extendedprice > {AMOUNT_LIMIT} THEN 'l_extendedprice'
           WHEN is_return = 1 AND coalesce(l_discount, 0) > {KEY_HIGH} THEN 'l_discount'
           WHEN is_return <> 1 AND coalesce(l_discount, 0) < {KEY_LOW} THEN 'l_discount' END AS feature,
      CASE WHEN is_return = 1 AND l_extendedprice > {AMOUNT_LIMIT} THEN printf('{config.REVIEW_MSG_AMOUNT.format(amount=R.amount)}', l_extendedprice, med)
           WHEN is_return = 1 AND coalesce(l_discount, 0) > {KEY_HIGH} THEN printf('{config.REVIEW_MSG_KEY_POSITIVE.format(key=REVIEW_KEY)}', coalesce(l_discount, 0), mn)
           WHEN is_return <> 1 AND coalesce(l_discount, 0) < {KEY_LOW} THEN printf('{config.REVIEW_MSG_KEY_NEGATIVE.format(key=REVIEW_KEY)}', coalesce(l_discount, 0)) END AS observation
    FROM cand, ctx),
  plaus AS (SELECT * FROM pl WHERE feature IS NOT NULL)"""


@register("review_plausibility", f"WITH {TX_SQL}, {PLAUS_SQL} SELECT row_index, feature, observation FROM plaus")
def q_review_plausibility(spark, sf):
    return plausibility_frame(spark, sf)


@register("review_candidates", f"""WITH {TX_SQL}, f AS ({_FAIL_SQL})
  SELECT row_id FROM (SELECT DISTINCT row_id FROM f) ORDER BY row_id LIMIT 10""")
def q_review_candidates(spark, sf):
    from fidelis.operators import rules as RL
    cand = candidate_side(spark, sf)
    flagged = RL.evaluate_rules(cand, tx_rules()).where(~F.col("is_valid")).select("row_id")
    return V.review_candidates(cand, "row_id", flagged, config.REVIEW_SAMPLE).select("row_id")


@register("review_sample", f"""WITH {TX_SQL} SELECT row_id FROM cand ORDER BY md5(concat(row_id, '-', '7')), row_id LIMIT 10""")
def q_review_sample(spark, sf):
    return V.review_candidates(candidate_side(spark, sf), "row_id", None, config.REVIEW_SAMPLE).select("row_id")


@register("review_record_text", f"""WITH {TX_SQL}
  SELECT row_id, printf('Row %d: Class=%d, Amount=%.2f, l_quantity=%.3f, l_discount=%.3f, l_tax=%.3f',
    row_id, is_return, l_extendedprice, coalesce(l_quantity, 0.0), coalesce(l_discount, 0.0), coalesce(l_tax, 0.0)) AS line FROM cand""")
def q_review_record_text(spark, sf):
    return V.record_text(candidate_side(spark, sf), R.id, R.label, R.amount, REVIEW_FEATURES)


def responses_frame(spark, sf):
    conv = table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("response_id"),
        F.col("text").alias("response"))
    pl = plausibility_frame(spark, sf).select(
        F.concat(F.lit("row:"), F.col("row_index").cast("string")).alias("response_id"),
        F.to_json(F.array(F.struct("row_index", F.lit(True).alias("is_anomalous"), "feature", "observation"))).alias("response"))
    ev = table(spark, sf, "events").select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("response_id"),
                                           F.col("props").alias("response"))
    return conv.unionByName(pl).unionByName(ev)


PARSED_SQL = f"""conv_p AS (SELECT 'conv:' || conv_id || ':' || turn AS response_id, text AS raw_response,
      [{{'row_index': CAST(-1 AS BIGINT), 'feature': 'parse_error', 'observation': 'Could not parse response: ' || substr(text, 1, 200)}}] AS anomalies
    FROM conversations WHERE role = 'assistant'),
  pl_p AS (SELECT 'row:' || row_index AS response_id, NULL AS raw_response,
      [{{'row_index': row_index, 'feature': feature, 'observation': observation}}] AS anomalies FROM plaus),
  ev_p AS (SELECT 'event:' || event_id AS response_id, props AS raw_response,
      CAST([] AS STRUCT(row_index BIGINT, feature VARCHAR, observation VARCHAR)[]) AS anomalies FROM events),
  parsed AS (SELECT * FROM conv_p UNION ALL SELECT * FROM pl_p UNION ALL SELECT * FROM ev_p)"""


@register("review_parse_response", f"""WITH {TX_SQL}, {PLAUS_SQL}, {PARSED_SQL}
  SELECT response_id, a.row_index AS row_index, a.feature AS feature, a.observation AS observation
  FROM (SELECT response_id, unnest(anomalies) AS a FROM parsed)""")
def q_review_parse_response(spark, sf):
    p = V.parse_responses(responses_frame(spark, sf), "response_id")
    return p.select("response_id", F.explode("anomalies").alias("a")).select("response_id", "a.row_index", "a.feature", "a.observation")


@register("review_score", f"""WITH {TX_SQL}, {PLAUS_SQL}, n AS (SELECT count(*) AS reviewed FROM cand), a AS (SELECT count(*) AS k FROM plaus)
  SELECT reviewed AS rows_reviewed, k AS n_anomalies, round(greatest(0.0, 1 - k / greatest(reviewed, 1)), 4) AS score,
    greatest(0.0, 1 - k / greatest(reviewed, 1)) >= 0.7 AS passed FROM n, a""")
def q_review_score(spark, sf):
    return V.review_score(plausibility_frame(spark, sf), candidate_side(spark, sf))


@register("validate_semantic", f"""WITH {TX_SQL}, f AS ({_FAIL_SQL}),
  ids AS (SELECT DISTINCT row_id FROM f),
  cand_all AS (SELECT * FROM cand), {PLAUS_SQL.replace('FROM cand, ctx', 'FROM cand_all JOIN ids USING (row_id), ctx')},
  a AS (SELECT count(*) AS k FROM plaus), n AS (SELECT count(*) AS reviewed FROM ids)
  SELECT reviewed AS rows_reviewed, k AS n_anomalies, round(greatest(0.0, 1 - k / greatest(reviewed, 1)), 4) AS score,
    greatest(0.0, 1 - k / greatest(reviewed, 1)) >= 0.7 AS passed FROM n, a""")
def q_validate_semantic(spark, sf):
    from fidelis.operators import rules as RL
    real, cand = real_side(spark, sf), candidate_side(spark, sf)
    flagged = RL.evaluate_rules(cand, tx_rules()).where(~F.col("is_valid")).select("row_id")
    rv = review_layer(real, cand, TX_SPEC, flagged)
    return rv["result"].select("rows_reviewed", "n_anomalies", "score", "passed")


# ---- audit ---------------------------------------------------------------------------

def document_reviews(spark, sf):
    """Reviews derived from ``documents``: scores, numbers of anomalies, their features and observations and the
    raw text follow from a document's id and source, so that every check fires on some rows."""
    i = F.col("doc_id")
    items = F.expr("""transform(sequence(0L, 8L), k -> named_struct('row_index', doc_id + k,
        'feature', CASE (doc_id + k) % 5 WHEN 0 THEN 'Amount' WHEN 1 THEN 'V14' WHEN 2 THEN source WHEN 3 THEN 'parse_error' ELSE '' END,
        'observation', concat('V', cast((doc_id + 7 * k) % 34 AS string), ' next to V3 in ', lang)))""")
    raw = F.when(i % 6 == 0, F.concat(F.lit("The rows in "), "source", F.lit(" might be noise"))).when(i % 6 == 1, F.concat("lang", F.lit(": UNCLEAR"))).otherwise(F.col("source"))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc:"), i.cast("string")).alias("id"), ((i * 37 % 101) / 100).alias("score"),
        F.slice(items, F.lit(1), (i % 9).cast("int")).cast(T.ArrayType(V.ANOMALY_TYPE)).alias("anomalies"), raw.alias("raw_response"))


DOCUMENT_REVIEWS_SQL = """doc_reviews AS (SELECT 'doc:' || doc_id AS id, (doc_id * 37 % 101) / 100 AS score,
    list_transform(range(0, doc_id % 9), lambda k: {'row_index': doc_id + k,
      'feature': CASE (doc_id + k) % 5 WHEN 0 THEN 'Amount' WHEN 1 THEN 'V14' WHEN 2 THEN source WHEN 3 THEN 'parse_error' ELSE '' END,
      'observation': 'V' || ((doc_id + 7 * k) % 34) || ' next to V3 in ' || lang}) AS anomalies,
    CASE doc_id % 6 WHEN 0 THEN 'The rows in ' || source || ' might be noise' WHEN 1 THEN lang || ': UNCLEAR' ELSE source END AS raw_response FROM documents)"""


def valid_columns(spark, sf):
    return list(dict.fromkeys(config.CARD_COLUMNS + candidate_side(spark, sf).columns))


def audit_input(spark, sf):
    p = V.parse_responses(responses_frame(spark, sf), "response_id")
    derived = p.select(F.col("response_id").alias("id"),
                       F.greatest(F.lit(0.0), 1 - F.size("anomalies") / F.lit(float(config.REVIEW_SAMPLE))).alias("score"),
                       F.col("anomalies").cast(T.ArrayType(V.ANOMALY_TYPE)), "raw_response")
    return derived.unionByName(document_reviews(spark, sf))


def audited(spark, sf):
    return A.audit_reviews(audit_input(spark, sf), valid_columns(spark, sf))


_VALID_SQL = "[" + ", ".join(f"'{c}'" for c in dict.fromkeys(config.CARD_COLUMNS + [
    "row_id", "ship_seconds", "ship_hours", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "is_return"])) + "]"
_HEDGE_SQL = A.hedge_pattern().replace("'", "''")

AUDIT_SQL = f"""WITH {TX_SQL}, {PLAUS_SQL}, {PARSED_SQL}, {DOCUMENT_REVIEWS_SQL},
  inp AS (SELECT response_id AS id, greatest(0.0, 1 - len(anomalies) / 10.0) AS score, anomalies, raw_response FROM parsed
          UNION ALL SELECT id, score, anomalies, raw_response FROM doc_reviews),
  chk AS (SELECT id, score,
      score > 0.85 AND len(anomalies) > 5 AS high_many,
      score < 0.4 AND len(anomalies) = 0 AS low_none,
      coalesce(regexp_matches(raw_response, '{_HEDGE_SQL}'), false) AND score > 0.9 AS hedging,
      len(list_filter(anomalies, lambda a: coalesce(a.feature, '') <> '' AND NOT list_contains({_VALID_SQL}, a.feature) AND a.feature <> 'parse_error')) AS n_unknown_feature,
      coalesce(list_sum(list_transform(anomalies, lambda a: len(list_filter(regexp_extract_all(coalesce(a.observation, ''), '{config.COLUMN_TOKEN_PATTERN}', 1),
                                                                 lambda t: NOT list_contains({_VALID_SQL}, t))))), 0) AS n_unknown_token
    FROM inp),
  adj AS (SELECT *, CAST(high_many AS INTEGER) + CAST(low_none AS INTEGER) + CAST(hedging AS INTEGER) + n_unknown_feature + n_unknown_token AS n_issues FROM chk),
  fin AS (SELECT *, CASE WHEN n_issues = 0 THEN 0.0 WHEN n_issues <= 2 THEN -0.1::DOUBLE ELSE -0.25 END::DOUBLE AS adjustment FROM adj)"""


def _audit_flags(df):
    return df.select(
        "id",
        F.exists("contradictions", lambda c: c.contains(" anomalies") & ~c.contains("zero anomalies")).alias("high_many"),
        F.exists("contradictions", lambda c: c.contains("zero anomalies")).alias("low_none"),
        F.exists("contradictions", lambda c: c.contains("hedging")).alias("hedging"),
        F.size(F.filter("hallucinations", lambda h: h.startswith("unknown feature"))).cast("long").alias("n_unknown_feature"),
        F.size(F.filter("hallucinations", lambda h: h.startswith("unknown column"))).cast("long").alias("n_unknown_token"),
        F.col("n_issues").cast("long").alias("n_issues"), "adjustment", "adjusted_score", "passed")


@register("audit_high_score_many", AUDIT_SQL + " SELECT id, high_many FROM fin")
def q_audit_high_score_many(spark, sf):
    return _audit_flags(audited(spark, sf)).select("id", "high_many")


@register("audit_low_score_none", AUDIT_SQL + " SELECT id, low_none FROM fin")
def q_audit_low_score_none(spark, sf):
    return _audit_flags(audited(spark, sf)).select("id", "low_none")


@register("audit_hedging", AUDIT_SQL + " SELECT id, hedging FROM fin")
def q_audit_hedging(spark, sf):
    return _audit_flags(audited(spark, sf)).select("id", "hedging")


@register("audit_unknown_feature", AUDIT_SQL + " SELECT id, CAST(n_unknown_feature AS BIGINT) AS n_unknown_feature FROM fin")
def q_audit_unknown_feature(spark, sf):
    return _audit_flags(audited(spark, sf)).select("id", "n_unknown_feature")


@register("audit_unknown_token", AUDIT_SQL + " SELECT id, CAST(n_unknown_token AS BIGINT) AS n_unknown_token FROM fin")
def q_audit_unknown_token(spark, sf):
    return _audit_flags(audited(spark, sf)).select("id", "n_unknown_token")


@register("audit_adjust", AUDIT_SQL + """ SELECT id, CAST(n_issues AS BIGINT) AS n_issues, round(adjustment, 4) AS adjustment,
  round(greatest(0.0, least(1.0, score + adjustment)), 4) AS adjusted_score, n_issues = 0 AS passed FROM fin""")
def q_audit_adjust(spark, sf):
    return rounded(_audit_flags(audited(spark, sf)).select("id", "n_issues", "adjustment", "adjusted_score", "passed"))


@register("unknown_columns", f"""WITH {TX_SQL}, {PLAUS_SQL}, {PARSED_SQL},
  m AS (SELECT DISTINCT a.feature AS "column" FROM (SELECT unnest(anomalies) AS a FROM parsed))
  SELECT "column" FROM m WHERE "column" NOT IN ('row_id', 'ship_seconds', 'ship_hours', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'is_return')""")
def q_unknown_columns(spark, sf):
    p = V.parse_responses(responses_frame(spark, sf), "response_id")
    mentions = p.select(F.explode("anomalies").alias("a")).select(F.col("a.feature").alias("column")).distinct()
    return G.unknown_columns(mentions, candidate_side(spark, sf).columns)


@register("review_batch_text", f"""WITH {TX_SQL}, f AS ({_FAIL_SQL}), ids AS (SELECT DISTINCT row_id FROM f)
  SELECT row_id, printf('Row %d: Class=%d, Amount=%.2f, l_quantity=%.3f, l_discount=%.3f, l_tax=%.3f',
    row_id, is_return, l_extendedprice, coalesce(l_quantity, 0.0), coalesce(l_discount, 0.0), coalesce(l_tax, 0.0)) AS text
  FROM cand JOIN ids USING (row_id)""")
def q_review_batch_text(spark, sf):
    """V3: the review text of every flagged row, one row each."""
    from fidelis.operators import rules as RL
    real, cand = real_side(spark, sf), candidate_side(spark, sf)
    flagged = RL.evaluate_rules(cand, tx_rules()).where(~F.col("is_valid")).select("row_id")
    return review_layer(real, cand, TX_SPEC, flagged)["batch_text"]
