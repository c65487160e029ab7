"""Exact-size sampling without replacement by a hash cut-off.

The sample is the ``n`` rows of the smallest hashes of their ids.  Instead of sorting, the hash
of the n-th row is found from histograms of its digits: each pass counts the rows by the next
``DIGITS`` hexadecimal digits below the prefix found so far (16 ** DIGITS counts at most reach the
driver) until few rows share the prefix.  The sample is then a filter of the table: nothing is
sorted, and neither a task nor the driver holds it, whatever ``n`` is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits a pass, and rows that are looked at one by one at the end.
DIGITS = 4
FEW = 4096


def sample_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(f"`{id_col}`").cast("string"), F.lit("-"), F.lit(str(seed))))


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows of ``df``, in the order of (hash, id); rows of one id are alike.

    A null id hashes to null and comes first, as in an ascending sort.  Of more than ``FEW`` rows that
    share an id at the cut-off, any fill the rest.
    """
    key, idc = sample_key(id_col, seed), F.col(f"`{id_col}`")
    if n <= 0:
        return df.limit(0)
    nameless = df.where(idc.isNull()).count()
    if n <= nameless:
        return df.where(idc.isNull()).limit(n)
    left, prefix = n - nameless, ""
    while True:
        at = len(prefix)
        here = df.where(idc.isNotNull() & key.startswith(prefix)) if prefix else df.where(idc.isNotNull())
        counts = sorted((r["d"], r["n"]) for r in here.groupBy(F.substring(key, at + 1, DIGITS).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        if sum(c for _, c in counts) <= left and not prefix:
            return df  # the whole table
        for digits, c in counts:
            if left <= c:
                prefix += digits
                break
            left -= c
        if c == left:  # the cut-off lies between two prefixes
            return df.where(idc.isNull() | (F.substring(key, 1, len(prefix)) <= prefix))
        if c <= FEW or len(prefix) >= 32:
            break
    edge = df.where(idc.isNotNull() & key.startswith(prefix))
    below = df.where(idc.isNull() | (F.substring(key, 1, len(prefix)) < prefix))
    if len(prefix) >= 32:  # one hash: the rows of one id
        return below.unionByName(edge.limit(left))
    rows = sorted((r["k"], r["i"]) for r in edge.select(key.alias("k"), idc.alias("i")).collect())  # FEW rows at most
    last = rows[left - 1]
    same = rows.count(last)
    taken = left - rows.index(last)
    inside = edge.where((key < last[0]) | (key == last[0]) & (idc <= F.lit(last[1])) if taken == same else (key < last[0]) | (key == last[0]) & (idc < F.lit(last[1])))
    out = below.unionByName(inside)
    return out if taken == same else out.unionByName(edge.where((key == last[0]) & (idc == F.lit(last[1]))).limit(taken))
