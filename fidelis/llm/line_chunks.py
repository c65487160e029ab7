"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

Lines are hashed; a rolling hash over the last two line hashes closes a chunk where it is
divisible by ``EVERY``, so boundaries depend on nearby lines alone and come back in step after an
insertion.  Chunks of two lines or more that occur elsewhere in the corpus are grouped by
digest, their bytes are compared, and all occurrences but the first are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVERY = 3
MULTIPLIER = 1_000_003
MODULUS = 2_147_483_647


def line_hash(line: Column) -> Column:
    """32 bits of a line's md5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def chunked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of two lines or more: id, first line, line after the last, its text.

    Everything about a document is computed in its own row; each array stands in a column
    of its own that is used several times, so that it is computed once.
    """
    d = docs.select(F.col(id_col).alias("__id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    d = d.select("__id", "lines", F.transform("lines", line_hash).alias("h"))
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("h", F.lit(1), F.size("h") - 1))
    d = d.select("__id", "lines", F.zip_with("h", before, lambda x, y: (y * MULTIPLIER + x) % MODULUS % EVERY == 0).alias("closes"))
    last = F.size("lines") - 1
    ends = F.filter(F.transform(F.slice("closes", F.lit(1), F.size("closes") - 1), lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
    d = d.select("__id", "lines", F.concat(ends, F.array(last)).alias("ends"))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: e + 1))
    spans = F.filter(F.zip_with(starts, "ends", lambda s, e: F.struct(s.alias("start"), (e + 1).alias("stop"))), lambda c: c.stop - c.start >= 2)
    d = d.select("__id", "lines", spans.alias("spans"))
    text = F.transform("spans", lambda c: F.struct(c.start.alias("start"), c.stop.alias("stop"),
                                                   F.array_join(F.slice(F.col("lines"), c.start + 1, c.stop - c.start), "\n").alias("chunk")))
    return d.select("__id", F.inline(F.when(F.size("lines") > 1, text))).withColumn("digest", F.md5(F.col("chunk").cast("binary")))


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """(digest, first occurrence) of chunks that occur twice or more, all equal in their bytes.

    Counts, smallest and largest text are combined before the shuffle, so a chunk that a third of
    the corpus has leaves each task as one row.  Should texts with one digest differ, none of
    them is removed.
    """
    g = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__id", "start")).alias("first"), F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return g.where("n > 1 AND low = high").select(F.col("digest").alias("__digest"), "first")


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__gid, __gone): the line ranges that each document loses, in order."""
    chunks = chunked(docs, id_col=id_col, text_col=text_col)
    again = repeated_chunks(chunks)
    gone = (chunks.select("__id", "start", "stop", "digest").join(again, F.col("digest") == F.col("__digest"))
            .where((F.col("__id") != F.col("first.__id")) | (F.col("start") != F.col("first.start"))))
    return gone.groupBy(F.col("__id").alias("__gid")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__gone"))  # at most the chunks of one document


def clean_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, the text without repeated chunks, and ``__n_lines``, ``__n_removed``.

    The occurrence with the smallest (id, line) stays.  A null text counts as empty (one empty
    line) and becomes empty; the rows of a null id keep their text, and a chunk that such a row
    holds is its first occurrence; rows that repeat an id and text
    are the same occurrence and keep the same lines; an empty table gives no rows.
    """
    gone = removals(docs, id_col=id_col, text_col=text_col)
    d = docs.join(gone, F.col(id_col) == F.col("__gid"), "left")
    none = F.expr("cast(array() AS array<struct<start:int,stop:int>>)")
    own = [f"`{c}`" for c in docs.columns]
    d = d.select(*own, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("__lines"), F.coalesce("__gone", none).alias("__gone"))
    begins = F.concat(F.array(F.lit(0)), F.col("__gone.stop"))
    ends = F.concat(F.col("__gone.start"), F.array(F.size("__lines")))
    d = d.select(*own, "__lines", "__gone", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))).alias("__parts"))
    parts = F.flatten(F.transform("__parts", lambda p: F.slice(F.col("__lines"), p.a + 1, p.n)))
    removed = F.aggregate("__gone", F.lit(0).cast("bigint"), lambda acc, g: acc + g.stop - g.start)
    text = F.array_join(parts, "\n")
    return d.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.size("__lines").cast("bigint").alias("__n_lines"), removed.alias("__n_removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``text`` (see ``clean_documents``), ``n_lines``, ``n_removed``."""
    clean = clean_documents(docs.select(id_col, text_col), id_col=id_col, text_col=text_col)
    return clean.select(id_col, F.col(text_col).alias("text"), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, max(i) OVER (PARTITION BY doc_id) AS last FROM l),
r AS (SELECT *, (i = last OR (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {MULTIPLIER} + h) % {MODULUS} % {EVERY} = 0)::INT AS closes FROM h),
c AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r),
g AS (SELECT doc_id, chunk, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM c GROUP BY doc_id, chunk),
f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, start) AS k FROM g WHERE n >= 2),
k AS (SELECT c.doc_id, c.i, c.line, f.k > 1 AS gone FROM c LEFT JOIN f ON f.doc_id = c.doc_id AND f.chunk = c.chunk)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
