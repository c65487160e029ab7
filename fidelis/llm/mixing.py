"""Mixing sources to target weights by proportional-fair (Pfair) scheduling, in DataFrame operations.

A source's documents, in a hashed order, form blocks of ``block_chars`` characters.  With an
integer share k out of the period D = sum of shares, block j (from 1) of a source is released
at slot floor((j-1) D / k) and due by slot ceil(j D / k).  Earliest deadline first among the
released blocks gives one period of D slots, in which every source is less than one block away
from its weight at any time; later periods repeat it.  All documents are kept: when a source
has run out, its slots stay empty and the others go on in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.frames import attach

#: Slots of one period before shares are rounded (weights are met to about one in this).
PERIOD = 1000
BLOCK_CHARS = 64 << 10
_BITS = 20  # a deadline and a source number share one integer in the search for the minimum


def square_root_shares(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", period: int = PERIOD) -> DataFrame:
    """Shares in proportion to the square root of a source's characters, one at least."""
    size = (docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"))
            .agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("__size")))
    total = size.agg(F.sum(F.sqrt("__size")).alias("__total"))  # one row
    return attach(size, total).select(
        "__source", F.greatest(F.lit(1), F.coalesce(F.round(F.try_divide(F.sqrt("__size") * period, F.col("__total"))), F.lit(0))).cast("bigint").alias("__share"))


def period_schedule(shares: DataFrame) -> DataFrame:
    """One period: source, its block in the period (from 0), slot, share and period length.

    ``shares`` has one row a source, so the arrays that the fold walks hold one entry a source
    and one a slot.  The fold takes, slot after slot, the released block with the earliest
    deadline (the smaller source name on a tie).
    """
    one = (shares.agg(F.sort_array(F.collect_list(F.struct("__source", "__share"))).alias("all"), F.sum("__share").alias("period"))
           .where(F.size("all") > 0).withColumn("k", F.col("all.__share")))
    pick = f"""
        array_min(filter(
          transform(k, (s, i) -> CASE WHEN st.n[i] < s AND st.n[i] * period div s <= t
                                      THEN shiftleft(((st.n[i] + 1) * period + s - 1) div s, {_BITS}) + i END),
          x -> x IS NOT NULL)) & {(1 << _BITS) - 1}"""
    folded = one.withColumn("picks", F.expr(f"""
        aggregate(sequence(0L, period - 1),
          named_struct('n', transform(k, s -> 0L), 'picks', cast(array() AS array<bigint>)),
          (st, t) -> aggregate(array({pick}), st, (u, p) -> named_struct(
              'n', transform(u.n, (c, i) -> c + CASE WHEN i = p THEN 1L ELSE 0L END), 'picks', concat(u.picks, array(p)))),
          st -> st.picks)"""))
    slots = folded.select("all", "period", F.posexplode("picks").alias("slot", "pick"))
    slots = slots.select(F.expr("all[cast(pick AS int)].__source").alias("__source"), F.expr("all[cast(pick AS int)].__share").alias("__share"),
                         F.col("period").alias("__period"), F.col("slot").cast("bigint").alias("__slot"))
    return slots.withColumn("__turn", F.row_number().over(Window.partitionBy("__source").orderBy("__slot")).cast("bigint") - 1)


def mix_sources(docs: DataFrame, shares: DataFrame | None = None, *, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: source, block (from 0), slot, release, deadline, chars_before.

    Reading by (slot, chars_before) gives the mix.  ``shares`` has (``__source``, ``__share``);
    sources without a row there get share 1; None means ``square_root_shares``.  Running sums
    are taken within 4,096 hash ranges of a source and then over the ranges, so a source that
    holds most rows is spread over all tasks; only ids, sources and lengths are shuffled.  A
    null source counts as the empty name, a null text as no characters; rows that repeat an id
    follow each other; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"),
                    F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("__n"))
    if shares is None:
        shares = square_root_shares(docs, source_col=source_col, text_col=text_col)
    else:
        missing = d.select("__source").distinct().join(shares, "__source", "left_anti").withColumn("__share", F.lit(1).cast("bigint"))
        shares = shares.select("__source", F.col("__share").cast("bigint")).unionByName(missing)
    d = d.withColumn("__key", F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")).cast("binary"))).withColumn("__range", F.substring("__key", 1, 3))
    inside = Window.partitionBy("__source", "__range").orderBy("__key", "__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = d.groupBy("__source", "__range").agg(F.sum("__n").alias("__sum"))
    over = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.select("__source", "__range", (F.sum("__sum").over(over) - F.col("__sum")).alias("__offset"))
    d = d.withColumn("__before", F.sum("__n").over(inside) - F.col("__n")).join(ranges, ["__source", "__range"])
    d = d.withColumn("__before", F.col("__before") + F.col("__offset")).withColumn("__block", F.floor(F.col("__before") / F.lit(block_chars)))

    plan = period_schedule(shares)  # one row a slot of the period: a few thousand at most
    turns = plan.select(F.col("__source").alias("__s"), F.col("__turn").alias("__t"), "__slot", "__period")
    share = shares.select(F.col("__source").alias("__s0"), "__share")
    d = d.join(F.broadcast(share), F.col("__source") == F.col("__s0"))
    d = d.join(F.broadcast(turns), (F.col("__source") == F.col("__s")) & (F.expr("__block % __share") == F.col("__t")))
    whole = F.expr("(__block div __share) * __period")
    return d.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__block").cast("bigint").alias("block"),
                    (whole + F.col("__slot")).alias("slot"), (whole + F.expr("__t * __period div __share")).alias("release"),
                    (whole + F.expr("((__t + 1) * __period + __share - 1) div __share")).alias("deadline"), F.col("__before").alias("chars_before"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0)::BIGINT AS n, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
size AS (SELECT source, sum(n) AS size FROM d GROUP BY source),
shares AS (SELECT source, greatest(1, coalesce(round(sqrt(size) * {PERIOD} / nullif((SELECT sum(sqrt(size)) FROM size), 0)), 0))::BIGINT AS share FROM size),
one AS (SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS k, sum(share)::BIGINT AS period FROM shares),
sim(t, n, pick) AS (
  SELECT -1::BIGINT, list_transform(k, lambda s: 0::BIGINT), -1::BIGINT FROM one
  UNION ALL
  SELECT t, list_transform(n, lambda c, i: c + (i - 1 = pick)::BIGINT), pick FROM (
    SELECT t + 1 AS t, n, list_min(list_filter(list_transform(k, lambda s, i:
      CASE WHEN n[i] < s AND n[i] * period // s <= t + 1 THEN (((n[i] + 1) * period + s - 1) // s) * {1 << _BITS} + i - 1 END),
      lambda x: x IS NOT NULL)) % {1 << _BITS} AS pick
    FROM sim, one WHERE t + 1 < period)),
turns AS (SELECT names[pick + 1] AS source, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM sim, one WHERE pick >= 0),
b AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY key, n ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS before FROM d),
c AS (SELECT b.*, before // {BLOCK_CHARS} AS block, share, period FROM b JOIN shares USING (source), one)
SELECT c.doc_id, c.source, block::BIGINT AS block, ((block // share) * period + slot)::BIGINT AS slot,
  ((block // share) * period + turn * period // share)::BIGINT AS release,
  ((block // share) * period + ((turn + 1) * period + share - 1) // share)::BIGINT AS deadline, before AS chars_before
FROM c JOIN turns ON turns.source = c.source AND turn = block % share
"""
