"""Plausibility review of flagged rows (V1-V5) and parsing of external review text.

The external reviewer of the original application is a remote service; here its
responses enter as a table of text, and the deterministic reviewer (V2) is a
``when`` chain over columns.  Nothing is called per row from Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis import config
from fidelis.operators.rules import extract_fenced
from fidelis.operators.similarity import sample_rows

ANOMALY_TYPE = T.StructType([
    T.StructField("row_index", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("observation", T.StringType()),
])


def _q(c: str) -> str:
    return f"`{c}`"


def review_context(real: DataFrame, label: str, amount: str, key: str, exact: bool = True) -> DataFrame:
    """One row ``(_med, _mean)``: median amount and mean key feature of the real positives.
    The median is the distributed exact quantile (no single-task percentile buffer)."""
    from fidelis.operators.frames import attach, long_form, quantile_columns
    pos = real.where(F.col(_q(label)) == 1)
    med = quantile_columns(long_form(pos, [amount]), [], "value", {"_med": 0.5}, exact=exact)
    return attach(med, pos.agg(F.avg(F.col(_q(key)).cast("double")).alias("_mean")))


def review_candidates(df: DataFrame, id_col: str, flagged: DataFrame | list[DataFrame] | None = None,
                      n: int | None = None, seed: int = config.REVIEW_SEED) -> DataFrame:
    """V1: the rows to review - all flagged rows, or the first ``n`` flagged ids (by id); without
    any flags all rows, or ``n`` rows by the seeded hash order.  Flagged ids are joined back (semi).

    ``flagged`` may be several id sources (e.g. rule failures and similarity flags).  With ``n``
    the ``n`` smallest ids of each are taken first (a top-n heap per task, no shuffle of every
    flagged id), then the union is deduplicated - exact, since the ``n`` smallest distinct
    ids of a union are among the ``n`` smallest of its parts."""
    if flagged is None:
        return df if n is None else sample_rows(df, id_col, n, seed)
    sources = flagged if isinstance(flagged, list) else [flagged]
    cols = [F.col(_q(c)) for c in df.columns]
    if n is None:
        ids = sources[0].select(_q(id_col))
        for f in sources[1:]:
            ids = ids.unionByName(f.select(_q(id_col)))
        return df.join(ids.distinct(), id_col, "left_semi").select(*cols).dropDuplicates([id_col])
    tops = []
    for f in sources:
        if set(df.columns) <= set(f.columns):  # already candidate rows: no join back needed
            tops.append(f.select(*cols).orderBy(_q(id_col)).limit(n))
        else:
            ids = f.select(F.col(_q(id_col))).orderBy(_q(id_col)).limit(n)
            tops.append(df.join(F.broadcast(ids), id_col, "left_semi").select(*cols))  # at most n ids
    first = tops[0]
    for t in tops[1:]:
        first = first.unionByName(t)
    return first.dropDuplicates([id_col]).orderBy(_q(id_col)).limit(n)


def plausibility(df: DataFrame, id_col: str, label: str, amount: str, key: str,
                 amount_limit: float = 500.0, key_high: float = 0.0, key_low: float = -8.0,
                 positive_amount_median: Column | float = 9.25, positive_key_mean: Column | float = -6.97) -> DataFrame:
    """V2: first matching check per row -> ``(row_index, feature, observation)``.

    * positive and amount > ``amount_limit``          -> amount
    * positive and key > ``key_high``                  -> key
    * not positive and key < ``key_low``               -> key
    The quoted real statistics may be columns (e.g. attached real-side aggregates).
    """
    pos = F.col(_q(label)).cast("int") == 1
    from fidelis.functions.columns import clean
    a, k = clean(F.col(_q(amount))), F.coalesce(clean(F.col(_q(key))), F.lit(0.0))  # NaN compares like a missing value
    med = positive_amount_median if isinstance(positive_amount_median, Column) else F.lit(float(positive_amount_median))
    mean = positive_key_mean if isinstance(positive_key_mean, Column) else F.lit(float(positive_key_mean))
    anomaly = (
        F.when(pos & (a > amount_limit), F.struct(
            F.col(_q(id_col)).cast("long").alias("row_index"), F.lit(amount).alias("feature"),
            F.format_string(config.REVIEW_MSG_AMOUNT.format(amount=amount), a, med).alias("observation")))
        .when(pos & (k > key_high), F.struct(
            F.col(_q(id_col)).cast("long").alias("row_index"), F.lit(key).alias("feature"),
            F.format_string(config.REVIEW_MSG_KEY_POSITIVE.format(key=key), k, mean).alias("observation")))
        .when(~pos & (k < key_low), F.struct(
            F.col(_q(id_col)).cast("long").alias("row_index"), F.lit(key).alias("feature"),
            F.format_string(config.REVIEW_MSG_KEY_NEGATIVE.format(key=key), k).alias("observation")))
    )
    matched = (pos & (a > amount_limit)) | (pos & (k > key_high)) | (~pos & (k < key_low))
    # filter first (pushed below the projections that derive the row id), then build the finding
    return df.where(matched).select(anomaly.alias("a")).select("a.*")


def record_text(df: DataFrame, id_col: str, label: str, amount: str, features: list[str]) -> DataFrame:
    """V3: one text line per row, ``Row i: Class=c, Amount=%.2f, f=%.3f ...`` (missing -> 0)."""
    fmt = config.REVIEW_RECORD_LINE + "".join(f", {f}=%.3f" for f in features)
    args = [F.col(_q(id_col)), F.col(_q(label)).cast("int"), F.col(_q(amount)).cast("double")] + \
           [F.coalesce(F.col(_q(f)).cast("double"), F.lit(0.0)) for f in features]
    return df.select(F.col(_q(id_col)), F.format_string(fmt, *args).alias("line"))


def batch_text(lines: DataFrame, id_col: str, context: Column | None = None) -> DataFrame:
    """V3: the review batch text (the <= n review rows joined by newlines, id order), with the
    escalation context appended when given (the original stored it and never sent it)."""
    txt = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(_q(id_col)), F.col("line")))),
                                             lambda s: s["line"]), "\n").alias("text"))
    if context is not None:
        txt = txt.select(F.concat_ws("\n", F.col("text"), context).alias("text"))
    return txt


def row_text(lines: DataFrame, id_col: str, context: Column | None = None) -> DataFrame:
    """V3 for any number of review rows: one row ``(id, text)`` each, the context after every line."""
    line = F.col("line") if context is None else F.concat_ws("\n", F.col("line"), context)
    return lines.select(F.col(_q(id_col)), line.alias("text"))


def parse_responses(responses: DataFrame, id_col: str, text_col: str = "response") -> DataFrame:
    """V4: raw review text -> one row per response with its reported anomalies.

    The fenced body is parsed once.  Of a JSON list the items stay whose ``is_anomalous`` is
    missing or true in the sense of a truth value (0, "", null and empty lists are false);
    ``row_index`` is read as a whole number also from a string (default -1), ``feature`` and
    ``observation`` as text (defaults 'unknown' and '').  Any other JSON value yields nothing;
    text that is not JSON yields one ``parse_error`` anomaly quoting its start.
    """
    raw = F.col(_q(text_col))
    d = responses.select(F.col(_q(id_col)), raw.alias("raw_response"), F.try_parse_json(extract_fenced(raw)).alias("_json"))
    d = d.withColumn("_items", F.expr("try_variant_get(_json, '$', 'array<variant>')")).withColumn("_ok", F.col("_json").isNotNull())
    d = d.select(_q(id_col), "raw_response", "_ok", F.expr("""
        transform(_items, x -> named_struct(
            'flag', try_variant_get(x, '$.is_anomalous', 'variant'), 'flag_text', try_variant_get(x, '$.is_anomalous', 'string'),
            'row', coalesce(try_variant_get(x, '$.row_index', 'bigint'), try_cast(try_variant_get(x, '$.row_index', 'double') AS bigint)),
            'feature', try_variant_get(x, '$.feature', 'variant'), 'feature_text', try_variant_get(x, '$.feature', 'string'),
            'observation', try_variant_get(x, '$.observation', 'variant'), 'observation_text', try_variant_get(x, '$.observation', 'string')))""").alias("_items"))
    none = F.array().cast(T.ArrayType(ANOMALY_TYPE))
    err = F.array(F.struct(F.lit(-1).cast("long").alias("row_index"), F.lit(config.PARSE_ERROR_FEATURE).alias("feature"),
                           F.concat(F.lit(config.PARSE_ERROR_PREFIX), F.substring("raw_response", 1, config.PARSE_ERROR_CHARS)).alias("observation")))
    said = F.expr("""
        transform(
          filter(_items, x -> x.flag IS NULL OR (NOT is_variant_null(x.flag) AND coalesce(x.flag_text NOT IN ('false', '0', '0.0', '', '[]', '{}'), false))),
          x -> named_struct('row_index', coalesce(x.row, -1L),
                            'feature', CASE WHEN x.feature IS NULL THEN 'unknown' ELSE coalesce(x.feature_text, 'None') END,
                            'observation', CASE WHEN x.observation IS NULL THEN '' ELSE coalesce(x.observation_text, 'None') END))""")
    anomalies = F.when(~F.col("_ok"), err).otherwise(F.coalesce(said.cast(T.ArrayType(ANOMALY_TYPE)), none))
    return d.select(_q(id_col), "raw_response", anomalies.alias("anomalies"))


def review_score(anomalies: DataFrame, reviewed: DataFrame, pass_score: float = config.REVIEW_PASS) -> DataFrame:
    """V5: score = max(0, 1 - anomalies / max(reviewed, 1)) rounded 4; passed iff >= 0.7."""
    a = anomalies.agg(F.count(F.lit(1)).alias("n_anomalies"))
    r = reviewed.agg(F.count(F.lit(1)).alias("rows_reviewed"))
    from fidelis.operators.frames import attach
    j = attach(r, a)
    s = F.greatest(F.lit(0.0), 1 - F.col("n_anomalies") / F.greatest(F.col("rows_reviewed"), F.lit(1)))
    return j.select("rows_reviewed", "n_anomalies", F.round(s, 4).alias("score"), (s >= pass_score).alias("passed"))


def review_result(reviewed: DataFrame, anomalies: DataFrame, pass_score: float = config.REVIEW_PASS) -> DataFrame:
    """Q9 output: one row with the anomalies list (bounded by the review size), score and raw text."""
    from fidelis.operators.frames import attach
    lst = anomalies.agg(F.sort_array(F.collect_list(F.struct("row_index", "feature", "observation"))).alias("anomalies"))
    sc = review_score(anomalies, reviewed, pass_score)
    j = attach(sc, lst)
    return j.select("rows_reviewed", "score", "passed", "anomalies", F.to_json("anomalies").alias("raw_response"),
                    F.lit("deterministic").alias("model_used"))
