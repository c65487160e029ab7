"""Bounded training samples: labelled documents chosen by a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, classes: dict[str, Column], per_class: int,
                    *, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """At most ``per_class`` labelled documents of each class, as (id, text, set of classes).

    ``classes`` maps a name to a condition over ``labels``.  The choice takes the smallest
    hashes of the id, so it is the same in every run and needs no sort of the whole table.  The
    chosen ids (``per_class`` times the number of classes at most) are broadcast to the scan.
    """
    picked = None
    for name, cond in classes.items():
        part = (labels.where(F.col(id_col).isNotNull() & F.coalesce(cond, F.lit(False)))
                .select(F.col(id_col).alias("__id"), F.lit(name).alias("__class")).distinct()
                .orderBy(F.xxhash64("__id"), "__id").limit(per_class))
        picked = part if picked is None else picked.unionByName(part)
    chosen = picked.groupBy("__id").agg(F.sort_array(F.collect_set("__class")).alias("__classes"))
    text = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = text.join(F.broadcast(chosen), "__id").collect()
    seen = {}
    for r in rows:  # a repeated id counts once
        seen.setdefault(r["__id"], (r["__id"], r["__text"], frozenset(r["__classes"])))
    return [seen[k] for k in sorted(seen)]


def class_sizes(labels: DataFrame, classes: dict[str, Column]) -> dict[str, int]:
    row = labels.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in classes.items()]).first()
    return {n: int(row[n] or 0) for n in classes}
