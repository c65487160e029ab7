"""Rules as data: any number of threshold rules, checked by one binary search per value.

A threshold rule says that a column (or its absolute value) compares with a number.  Rules on one
expression with one comparison are a sorted array of numbers; the rules that a value breaks are
a prefix or a suffix of it, so a row's broken rules are one range per array.  Neither the plan nor
the work per row grows with the number of rules beyond its logarithm, where a compiled
expression per rule outgrows code generation after some hundred.  As for compiled rules, a
missing value breaks every rule on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.functions.columns import clean
from fidelis.operators.rules import SEVERITIES, Rule

#: Rules of one table at most: they are held by the driver and by every task.
MOST_RULES = 1_000_000
_SIMPLE = re.compile(r"^\s*(?:(abs)\s*\(\s*)?`?([A-Za-z_]\w*)`?\s*(\))?\s*(<=|>=|<|>)\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$")


@dataclass
class Group:
    """The rules ``expression op threshold`` of one expression and comparison, thresholds ascending."""

    column: str
    absolute: bool
    op: str
    thresholds: np.ndarray
    names: list[str]
    severities: np.ndarray  # places in SEVERITIES

    def __post_init__(self):
        one = self.severities[:, None] == np.arange(len(SEVERITIES))
        self.before = np.concatenate([np.zeros((1, len(SEVERITIES)), np.int64), one.cumsum(0)])  # rules of each severity in front of a place

    def broken(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of the rules that each value breaks (NaN: all)."""
        v = np.abs(values) if self.absolute else values
        at = np.searchsorted(self.thresholds, v, "left" if self.op in ("<=", ">") else "right")
        n = len(self.thresholds)
        start, end = (np.zeros_like(at), at) if self.op in ("<=", "<") else (at, np.full_like(at, n))
        gone = np.isnan(v)
        return np.where(gone, 0, start), np.where(gone, n, end)


def rule_table(rules: list[tuple[str, str, str, float, str]]) -> list[Group]:
    """Groups of (name, column or abs(column), comparison, threshold, severity)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules, {MOST_RULES} at most")
    by: dict[tuple[str, bool, str], list] = {}
    for name, column, op, threshold, severity in rules:
        absolute = column.startswith("abs(")
        if op not in ("<", "<=", ">", ">="):
            raise ValueError(f"rule {name}: comparison {op!r}")
        if not np.isfinite(threshold):
            raise ValueError(f"rule {name}: threshold {threshold!r}")
        by.setdefault((column[4:-1] if absolute else column, absolute, op), []).append((float(threshold), name, SEVERITIES.index(severity)))
    out = []
    for (column, absolute, op), found in by.items():
        found.sort(key=lambda r: r[:2])
        out.append(Group(column, absolute, op, np.array([r[0] for r in found]), [r[1] for r in found], np.array([r[2] for r in found])))
    return out


def table_of(rules: DataFrame) -> list[Group]:
    """The groups of a table of rules (rule_name, column, op, threshold, severity), ``MOST_RULES`` rows at most."""
    rows = rules.select("rule_name", "column", "op", F.col("threshold").cast("double"), "severity").limit(MOST_RULES + 1).collect()
    return rule_table([tuple(r) for r in rows])


def split_rules(rules: list[Rule]) -> tuple[list[Group], list[Rule]]:
    """(groups, others): the enabled rules whose condition is a plain threshold, and those that stay compiled."""
    plain, others = [], []
    for r in rules:
        m = _SIMPLE.match(r.condition)
        if r.enabled and m and bool(m[1]) == bool(m[3]):
            plain.append((r.name, f"abs({m[2]})" if m[1] else m[2], m[4], float(m[5]), r.severity))
        else:
            others.append(r)
    return rule_table(plain), others


def _columns(df: DataFrame, groups: list[Group]) -> tuple[list[str], list]:
    names = list(dict.fromkeys(g.column for g in groups))
    missing = [c for c in names if c not in df.columns]
    # a rule on a column that is not there is broken by every row, as for compiled rules
    return names, [F.lit(None).cast("double").alias(f"v{k}") if c in missing else clean(F.col(f"`{c}`").cast("double")).alias(f"v{k}") for k, c in enumerate(names)]


def _values(b: pa.RecordBatch, names: list[str], first: int = 0) -> dict[str, np.ndarray]:
    return {c: b.column(first + k).to_numpy(zero_copy_only=False).astype(float) for k, c in enumerate(names)}


def rule_counts(df: DataFrame, groups: list[Group]) -> DataFrame:
    """(rule_name, severity, failures): how many rows break each rule, one row a rule, from one pass.

    A task counts how many values fall between two thresholds; a rule's failures are then a
    running sum over its group, whatever the number of rows.
    """
    names, columns = _columns(df, groups)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(g.thresholds) + 1, np.int64) for g in groups]  # ranges that begin or end at a place
        for b in it:
            values = _values(b, names)
            for g, t in zip(groups, total):
                start, end = g.broken(values[g.column])
                some = start < end
                t += np.bincount(start[some], minlength=len(t)) - np.bincount(end[some], minlength=len(t))
        rows = [(k, int(p), int(t[p])) for k, t in enumerate(total) for p in np.flatnonzero(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                                         names=["g", "place", "n"])

    found = df.select(*columns).mapInArrow(batches, "g int, place int, n bigint").groupBy("g", "place").agg(F.sum("n").alias("n")).collect()  # two a rule at most
    steps = [np.zeros(len(g.thresholds) + 1, np.int64) for g in groups]
    for r in found:
        steps[r["g"]][r["place"]] = r["n"]
    rows = [(n, SEVERITIES[s], int(c)) for g, t in zip(groups, steps) for n, s, c in zip(g.names, g.severities, t.cumsum())]
    return df.sparkSession.createDataFrame(rows, "rule_name string, severity string, failures bigint")


def row_results(df: DataFrame, groups: list[Group], id_col: str) -> DataFrame:
    """(id, n_broken, n_critical, n_warning, n_info, is_valid) of every row: lengths of ranges, no rule is looked at."""
    names, columns = _columns(df, groups)
    kind = dict(df.dtypes)[id_col]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            values, total = _values(b, names, 1), np.zeros((len(b), len(SEVERITIES)), np.int64)
            for g in groups:
                start, end = g.broken(values[g.column])
                total += g.before[np.maximum(start, end)] - g.before[start]
            n = total.sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *map(pa.array, total.T.copy()), pa.array(n == 0)],
                                             names=[id_col, "n_broken", *[f"n_{s}" for s in SEVERITIES], "is_valid"])

    return df.select(F.col(f"`{id_col}`"), *columns).mapInArrow(
        batches, f"`{id_col}` {kind}, n_broken bigint, {', '.join(f'n_{s} bigint' for s in SEVERITIES)}, is_valid boolean")


def rule_failures(df: DataFrame, groups: list[Group], id_col: str) -> DataFrame:
    """(id, rule_name, severity): one row for each rule a row breaks, given out in bounded batches."""
    names, columns = _columns(df, groups)
    kind = dict(df.dtypes)[id_col]
    rule_names = [pa.array(g.names) for g in groups]
    severity = pa.array(SEVERITIES)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            values = _values(b, names, 1)
            for g, rules in zip(groups, rule_names):
                start, end = g.broken(values[g.column])
                n = np.maximum(end - start, 0)
                cum = np.cumsum(n)
                lo = 0
                while lo < len(n):  # some rows at a time, about a million failures
                    hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + 1_000_000, "right")))
                    k = n[lo:hi]
                    place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[lo:hi], k)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(lo, hi), k))), rules.take(pa.array(place)),
                                                      severity.take(pa.array(g.severities[place]))], names=[id_col, "rule_name", "severity"])
                    lo = hi

    return df.select(F.col(f"`{id_col}`"), *columns).mapInArrow(batches, f"`{id_col}` {kind}, rule_name string, severity string")
