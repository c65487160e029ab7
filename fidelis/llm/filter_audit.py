"""Interaction audit of document filters: what each removes in every order, by a recursive query.

Each document becomes a mask with a bit for every filter it fails; masks are counted into cells a
part.  A recursive CTE then starts from the empty prefix of every part and extends it by each
letter not used yet: a level joins the part's mask cells, carries the applied bits and emits that
step's figures.  Nothing after the cells depends on the number of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.session import checkpoint_dir

WORDS = r"[^\x20\x09-\x0D]+"
#: The letter of the filter whose condition needs the other documents; its bit is set by ``mask_cells``.
REPEATED = "E"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides, by letter."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
            "C": 100 * capitals.cast("bigint") > 10 * F.length(text).cast("bigint"), "D": text.rlike(r"[#$%&*|]")}


def mask_cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part and mask: (part, mask, n, good, toxic).

    Bits 0 to 3 are the conditions of a text alone, bit 4 says that a smaller id has the same text.
    Texts are compared by their SHA-256 and length.  A null text or part is the empty string; a null id is no
    smaller id, has none and no label; repeated rows of one id do not make each other repeated.  A label
    counts when any row of ``labels`` for the id has it.

    Rows are counted by (text, id, part) first, so that copies leave a task once; the least id of
    a text is found among its cells, one for each part and label at most.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text.alias("text"))
    conditions = text_conditions(F.col("text"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
    rows = read.select("id", "part", F.sha2("text", 256).alias("digest"), F.length("text").alias("size"), bits.alias("own"))
    rows = rows.groupBy("digest", "size", "own", "part", "id").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    cell = ["digest", "size", "own", "part", "good", "toxic"]
    # one row an id before this, so the least (id, n) says how many rows the least id has here
    per = marked.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
                                    F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    least = per.groupBy("digest", "size").agg(F.min("least.id").alias("first"))
    per = per.join(least, ["digest", "size"])
    kept = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("own").alias("mask"), kept.alias("n")),
                              F.struct((F.col("own") + (1 << len(conditions))).alias("mask"), (F.col("n") - kept).alias("n"))))
    return per.select("part", "good", "toxic", sides.alias("x")).where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def _level(applied: str, bit: str) -> str:
    """The figures of one step over a part's ``cells``, as SQL: applied bits before it, the step's bit."""
    def total(what: str, condition: str) -> str:
        return f"aggregate(filter(cells, c -> {condition}), 0L, (s, c) -> s + c.{what})"
    before, fails = f"(c.mask & ({applied})) = 0", f"(c.mask & {bit}) <> 0"
    return ", ".join([total("n", f"{before} AND NOT {fails}") + " AS kept", total("n", f"{before} AND {fails}") + " AS removed",
                      total("n", f"NOT {before} AND {fails}") + " AS redundant", total("n", f"c.mask = {bit}") + " AS unique_fails",
                      total("good", f"{before} AND {fails}") + " AS good_lost", total("toxic", f"{before} AND {fails}") + " AS toxic_lost"])


def walk_orders(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part and prefix of an order: (part, prefix, step, applied and that step's figures).

    The recursion runs over rows of (part, prefix); a part's mask cells, 2 ** letters at most, are
    one row.  The number of levels is that of the letters; the row limit of recursive queries is
    raised for this run to what the parts need, and the result is written to the shared folder.
    """
    spark = cells.sparkSession
    folder = f"{checkpoint_dir(spark)}/filter-audit-{uuid.uuid4().hex}"
    cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")).write.parquet(f"{folder}/cells")
    parts = spark.read.parquet(f"{folder}/cells")
    prefixes, k = 1, 1
    for left in range(len(letters), 0, -1):
        k *= left
        prefixes += k
    need, setting = parts.count() * prefixes + 1, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(setting)
    values = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    walk = spark.sql(f"""
        WITH RECURSIVE letters(letter, bit) AS (VALUES {values}),
        walk(part, prefix, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
            SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{parts}}
            UNION ALL
            SELECT w.part, concat(w.prefix, l.letter), w.step + 1, w.applied | l.bit, {_level('w.applied', 'l.bit')}
            FROM walk w JOIN letters l ON (w.applied & l.bit) = 0 JOIN {{parts}} p ON p.part = w.part)
        SELECT * FROM walk WHERE step > 0""", parts=parts)
    try:
        if need > int(before) >= 0:
            spark.conf.set(setting, str(need))
        walk.write.parquet(f"{folder}/walk")
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{folder}/walk")


def audit_filters(docs: DataFrame, labels: DataFrame, *, letters: str = "ABCDE", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of all filters and step, with that step's figures.

    ``kept`` (after the step), ``removed``, ``redundant`` (failing the step's filter, removed
    earlier), ``unique_fails`` (failing that filter only), ``good_lost``, ``toxic_lost`` and
    ``shapley`` (documents the filter removes, summed over all orders).  An empty table gives no
    rows; every part has a row for each order and step, zeros included.
    """
    walk = walk_orders(mask_cells(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col), letters)
    orders = walk.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.expr("left(filter_order, step)"))
    figures = steps.join(walk.drop("applied", "step"), ["part", "prefix"])
    shapley = figures.groupBy("part", F.expr("right(prefix, 1)").alias("letter")).agg(F.sum("removed").alias("shapley"))
    return figures.withColumn("letter", F.expr("right(prefix, 1)")).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, t, min(doc_id) OVER (PARTITION BY t) AS first,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT AS own FROM d),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, own + 16 * coalesce(f.doc_id > first, false)::INT AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN m ON f.doc_id = m.doc_id GROUP BY 1, 2),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
walk AS (SELECT '' AS prefix, 0 AS step, 0 AS before, 0 AS bit, 0 AS applied
  UNION ALL SELECT prefix || letter, step + 1, applied, l.bit, applied | l.bit FROM walk, letters l WHERE applied & l.bit = 0),
figures AS (SELECT part, prefix, step, bit,
    sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM walk, cells WHERE step > 0 GROUP BY ALL),
orders AS (SELECT a.prefix AS filter_order, b.* FROM walk a JOIN figures b ON starts_with(a.prefix, b.prefix) WHERE a.step = 5),
shapley AS (SELECT part, bit, sum(removed) AS shapley FROM orders GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley FROM orders JOIN shapley USING (part, bit)"""
