"""Declarative row rules.

A rule is Spark SQL text that is TRUE for a valid row.  All rules are compiled
into ONE array column per row (``array(when(violated_i, struct(...)))`` with the
NULL entries filtered out), so the table is scanned once, inside whole-stage
codegen, no matter how many rules there are.  Missing values follow the
reference semantics: NaN is turned into NULL first and a rule whose condition is
NULL counts as violated (``NOT coalesce(cond, false)``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis import config
from fidelis.functions.columns import clean_frame
from fidelis.operators.frames import top_k_per_group

SEVERITIES = ("critical", "warning", "info")

VIOLATION_TYPE = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("actual_value", T.StringType()),
])

RULE_TABLE_TYPE = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rationale", T.StringType()),
]))


@dataclass(frozen=True)
class Rule:
    """``condition`` is Spark SQL, TRUE = valid.  ``value`` is SQL text reported on failure."""

    name: str
    description: str
    condition: str
    severity: str = "critical"
    value: str | None = None
    enabled: bool = True


def _q(c: str) -> str:
    return f"`{c}`"


def default_rules(amount: str = "Amount", time: str = "Time", label: str = "Class",
                  features: list[str] | None = None,
                  amount_max: float = config.RULE_AMOUNT_MAX, time_max: float = config.RULE_TIME_MAX,
                  feature_abs_max: float = config.RULE_FEATURE_ABS_MAX,
                  pattern_amount: float = config.RULE_PATTERN_AMOUNT) -> list[Rule]:
    """The static rule set: 5 range/domain rules, 3 not-null rules, one bound per
    feature (raw ``|x| <= 10``, named ``*_zscore`` like the original) and one info pattern."""
    if features is None:
        features = [f"V{i}" for i in range(1, 29)]
    a, t, c = _q(amount), _q(time), _q(label)
    rules = [
        Rule("amount_non_negative", f"{amount} is not negative", f"{a} >= 0", "critical", f"string({a})"),
        Rule("amount_reasonable", f"{amount} is {amount_max:g} at most", f"{a} <= {amount_max!r}", "warning", f"string({a})"),
        Rule("time_non_negative", f"{time} is not negative", f"{t} >= 0", "critical", f"string({t})"),
        Rule("time_in_range", f"{time} is {time_max:g} at most", f"{t} <= {time_max!r}", "critical", f"string({t})"),
        Rule("class_binary", f"{label} is 0 or 1", f"{c} IN (0, 1)", "critical", f"string({c})"),
    ]
    for name, col in (("time", time), ("amount", amount), ("class", label)):
        rules.append(Rule(f"no_null_{name}", f"{col} is present", f"{_q(col)} IS NOT NULL", "critical",
                          f"'{col} is null'"))
    for f in features:
        rules.append(Rule(f"{f.lower()}_zscore", f"{f} lies within {feature_abs_max:g} of zero",
                          f"abs({_q(f)}) <= {feature_abs_max!r}", "warning", f"string({_q(f)})"))
    rules.append(Rule("fraud_amount_pattern", f"no positive row has {amount} above {pattern_amount:g}",
                      f"NOT coalesce({a} > {pattern_amount!r} AND {c} = 1, false)", "info",
                      f"concat('Amount=', string({a}), ', Class=', string({c}))"))
    return rules


def _probe(df: DataFrame) -> DataFrame:
    """An empty frame with ``df``'s schema: analysing rules against it costs no more than
    the rule itself, whatever plan produced ``df``."""
    return df.sparkSession.createDataFrame([], df.schema)


_OPERAND = r"(?:`[^`]+`|[\w.]+)"
_TRY_FORMS = {"cast": "try_cast", "element_at": "try_element_at", "to_timestamp": "try_to_timestamp", "to_number": "try_to_number", "parse_json": "try_parse_json"}


def null_on_error(condition: str) -> str:
    """The condition with its raising forms replaced by ones that give NULL (a violation).

    Divisors become ``nullif(divisor, 0)``; functions with a ``try_`` form take it.  Quoted
    strings are left alone.
    """
    out, i = "", 0
    while i < len(condition):
        if condition[i] in "'\"":  # a quoted string
            end = condition.find(condition[i], i + 1)
            end = len(condition) if end < 0 else end + 1
            out, i = out + condition[i:end], end
        elif condition[i] in "/%":
            start = i + 1 + len(condition[i + 1:]) - len(condition[i + 1:].lstrip())
            m = re.compile(_OPERAND).match(condition, start)
            end = m.end() if m else start
            if end < len(condition) and condition[end] == "(":  # a parenthesised or called divisor
                depth = 0
                while end < len(condition):
                    depth += {"(": 1, ")": -1}.get(condition[end], 0)
                    end += 1
                    if not depth:
                        break
            if end == start:
                return condition
            out, i = out + f"{condition[i]} nullif({null_on_error(condition[start:end])}, 0)", end
        else:
            m = re.compile(r"\b\w+(?=\()").match(condition, i)
            if m and (i == 0 or not condition[i - 1].isalnum()):
                out, i = out + _TRY_FORMS.get(m[0].lower(), m[0]), m.end()
            else:
                out, i = out + condition[i], i + 1
    return out


def _compile(rule: Rule) -> tuple[Column, Column]:
    cond = F.expr(null_on_error(rule.condition))
    value = F.expr(null_on_error(rule.value)) if rule.value else F.lit("N/A")
    return ~F.coalesce(cond.cast("boolean"), F.lit(False)), value.cast("string")


def _resolve_all(df: DataFrame, rules: list[Rule]) -> list[tuple[Rule, Column, Column, str]]:
    """Compile the enabled rules against the schema at plan time.

    All rules are analysed together in one pass; only when that fails is each rule
    analysed alone.  A rule that does not resolve (missing column, bad SQL) fails every
    row as CRITICAL with ``Error: ...`` as the reported value; nothing is raised.
    """
    enabled = [r for r in rules if r.enabled]
    probe = _probe(df)
    out: list = [None] * len(enabled)
    pending = []
    for i, r in enumerate(enabled):
        missing = [c for c in re.findall(r"`([^`]+)`", r.condition + " " + (r.value or "")) if c not in df.columns]
        if missing:
            out[i] = (r, F.lit(True), F.lit(f"Error: column {missing[0]!r} not found"), "critical")
        else:
            pending.append(i)

    def analyse(idx: list[int]) -> bool:
        try:
            cols = []
            for i in idx:
                v, val = _compile(enabled[i])
                cols += [v.alias(f"v{i}"), val.alias(f"s{i}")]
            probe.select(*cols).schema  # analysis only, on an empty local relation
            return True
        except Exception:  # noqa: BLE001
            return False

    if pending and analyse(pending):
        for i in pending:
            v, val = _compile(enabled[i])
            out[i] = (enabled[i], v, val, enabled[i].severity)
    else:
        for i in pending:
            try:
                v, val = _compile(enabled[i])
                probe.select(v.alias("v"), val.alias("s")).schema
                out[i] = (enabled[i], v, val, enabled[i].severity)
            except Exception as exc:  # noqa: BLE001 - any unresolvable rule
                msg = str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__
                out[i] = (enabled[i], F.lit(True), F.lit(f"Error: {msg}"), "critical")
    return out


def violations_column(df: DataFrame, rules: list[Rule]) -> Column:
    """``array<struct<rule_name, description, severity, actual_value>>`` of the rules a row breaks."""
    entries = []
    for r, violated, value, severity in _resolve_all(df, rules):
        entries.append(F.when(violated, F.struct(
            F.lit(r.name).alias("rule_name"), F.lit(r.description).alias("description"),
            F.lit(severity).alias("severity"), value.alias("actual_value"))))
    if not entries:
        return F.array().cast(T.ArrayType(VIOLATION_TYPE))
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def evaluate_rules(df: DataFrame, rules: list[Rule], id_col: str = "row_id") -> DataFrame:
    """``(id, violations array, is_valid)`` per row (R9 before the explode, R10)."""
    clean = clean_frame(df)
    viol = violations_column(clean, rules)
    return clean.select(F.col(_q(id_col)), viol.alias("violations")).withColumn(
        "is_valid", F.size("violations") == 0)


def any_violation(df: DataFrame, rules: list[Rule]) -> Column:
    """TRUE when a row breaks at least one rule: a short-circuit OR of the compiled
    conditions, cheaper than building the violation array when only validity is needed."""
    out = None
    for _, violated, _, _ in _resolve_all(df, rules):
        out = violated if out is None else (out | violated)
    return out if out is not None else F.lit(False)


def invalid_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows (all columns, NaN cleaned) that break at least one rule."""
    clean = clean_frame(df)
    return clean.where(any_violation(clean, rules))


def rule_failures(df: DataFrame, rules: list[Rule], id_col: str = "row_id") -> DataFrame:
    """Long failure table: one row per (row, broken rule)."""
    ev = evaluate_rules(df, rules, id_col)
    return ev.select(F.col(_q(id_col)), F.explode("violations").alias("v")).select(
        F.col(_q(id_col)), "v.rule_name", "v.description", "v.severity", "v.actual_value")


def rule_failure_counts(df: DataFrame, rules: list[Rule], id_col: str = "row_id") -> DataFrame:
    """Failures per rule (M3), only rules that failed at least once, with the smallest failing
    row id and the rule's place in the list, from one aggregate with map-side partial counts
    (no explode, no per-row shuffle)."""
    clean = clean_frame(df)
    aggs, names = [], []
    for i, (r, violated, _, severity) in enumerate(_resolve_all(clean, rules)):
        aggs += [F.count_if(violated).alias(f"c{i}"), F.min(F.when(violated, F.col(_q(id_col)))).alias(f"f{i}")]
        names.append((i, r, severity))
    if not aggs:
        return clean.sparkSession.createDataFrame([], "rule_name string, severity string, failures long, first_row long, rule_order int")
    wide = clean.agg(*aggs)
    stack = ", ".join(f"'{r.name}', '{sev}', c{i}, f{i}, {i}" for i, r, sev in names)
    long = wide.selectExpr(f"stack({len(names)}, {stack}) as (rule_name, severity, failures, first_row, rule_order)")
    return long.where(F.col("failures") > 0)


def rule_summary(df: DataFrame, rules: list[Rule], id_col: str = "row_id") -> DataFrame:
    """valid, invalid, total, pass rate (%), passed (M2).  A row is invalid when it
    breaks any rule, whatever the severity (R10)."""
    ev = evaluate_rules(df, rules, id_col)
    agg = ev.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("valid"))
    return agg.select(
        "valid", (F.col("total") - F.col("valid")).alias("invalid"), "total",
        F.when(F.col("total") > 0, F.col("valid") * 100.0 / F.col("total")).otherwise(F.lit(0.0)).alias("pass_rate"),
        ((F.col("total") - F.col("valid")) == 0).alias("passed"))


def top_failed_rules(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rules with most failures (K1); equal counts by the first failing row, then by
    the order of the rules on that row (``first_row`` and ``rule_order`` of ``rule_failure_counts``)."""
    order = [F.desc("failures"), *[F.asc(c) for c in ("first_row", "rule_order") if c in counts.columns], F.asc("rule_name")]
    return counts.orderBy(*order).limit(k).select("rule_name", "severity", "failures")


def rule_failure_samples(df: DataFrame, rules: list[Rule], id_col: str = "row_id", k: int = 5) -> DataFrame:
    """First ``k`` failures per rule by row id (W3), ranked two-level so a rule that
    fails on a third of all rows is not ranked by one task."""
    fails = rule_failures(df, rules, id_col)
    return top_k_per_group(fails, ["rule_name"], [F.col(_q(id_col))], k,
                           salt_col=F.abs(F.xxhash64(F.col(_q(id_col)))) % 32, rank_name="sample_rank")


# --------------------------------------------------------------------------------------
# Externally supplied rules (R12-R14): a table of responses -> a table of rules.
# --------------------------------------------------------------------------------------

def extract_fenced(text: Column) -> Column:
    """Body of the first ```json fence, else of the first ``` fence, else the text itself.

    A fence that is never closed (a reply that was cut off) runs to the end of the text.
    """
    body = F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(text, r"(?s)```(.*?)(?:```|\z)", 1)
    return F.btrim(F.when(text.contains("```json"), body).when(text.contains("```"), plain).otherwise(text), F.lit(" \t\r\n"))


def parse_rule_responses(responses: DataFrame, text_col: str = "response", key_cols: list[str] | None = None) -> DataFrame:
    """Responses -> one row per proposed rule.

    Rules with an unsafe condition (R13) are dropped before the rest is looked at.  A response that is not
    a JSON list, has an entry without name or condition, or a safe entry without description
    or with an unknown severity, contributes no rule at all.
    """
    key_cols = list(key_cols or [])
    parsed = responses.select(*[F.col(_q(c)) for c in key_cols],
                              F.from_json(extract_fenced(F.col(_q(text_col))), RULE_TABLE_TYPE).alias("all_rules"))
    named = F.forall("all_rules", lambda r: r["name"].isNotNull() & r["condition"].isNotNull())
    parsed = parsed.where(F.col("all_rules").isNotNull() & named)
    parsed = parsed.withColumn("rules", F.filter("all_rules", lambda r: ~r["condition"].rlike(config.UNSAFE_CONDITION_PATTERN)))
    ok = F.forall("rules", lambda r: r["description"].isNotNull() & F.coalesce(F.lower(r["severity"]).isin(*SEVERITIES), F.lit(False)))
    return parsed.where(ok).select(*[F.col(_q(c)) for c in key_cols], F.posexplode("rules").alias("pos", "r")).select(
        *[F.col(_q(c)) for c in key_cols], "pos",
        F.concat(F.lit(config.RULE_NAME_PREFIX), F.col("r.name")).alias("name"), F.col("r.description").alias("description"),
        F.col("r.condition").alias("condition"), F.lower(F.col("r.severity")).alias("severity"))


def safe_rules(rules: DataFrame, condition_col: str = "condition") -> DataFrame:
    """Drop conditions that look like code injection."""
    return rules.where(~F.col(condition_col).rlike(config.UNSAFE_CONDITION_PATTERN))


def rules_from_table(rules: DataFrame, most: int = 10_000) -> list[Rule]:
    """Collect a rule-definition table into rules (R12); more than ``most`` rules raise.

    Rule definitions are configuration that is compiled into the plan, not data.
    """
    rows = safe_rules(rules).select("name", "description", "condition", "severity").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [Rule(r["name"], r["description"] or "", r["condition"], r["severity"] or "warning",
                 value="'condition failed'") for r in rows]
