"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is taken at every word that begins a window of ``window`` words.  Suffixes are dealt by
a key of their first ``window`` words: the smallest hash among the ``GRAM``-word runs in it, which
neighbouring suffixes mostly share, so that a run of them travels as one stretch of text.  Keys
of one document only cannot repeat and are dropped early.  A key with at most ``group_suffixes``
stretches is a memory-sized group: its suffixes are sorted by longer and longer prefixes (the
levels of the suffix tree), and the nodes at depth ``window`` give, for each suffix, the
smallest document under its node.  Larger groups are split by the whole ``window``-word prefix:
there the node itself is the key, and its smallest document is a combined minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm import textkit as K
from fidelis.session import cut_lineage

WINDOW = 50
GRAM = 10
#: Stretches in one in-memory group (a few hundred bytes each).
GROUP = 20_000
#: Stretches of small groups that are worked on at once.
TOGETHER = 4_000
#: Suffixes that one stretch may hold at most (more begin a new stretch).
STRETCH = 64


def suffix_keys(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, start word) of every suffix with ``window`` words of its text."""
    gram = min(GRAM, window)
    at, doc = K.gram_starts(first, window)
    if not len(at):
        return np.zeros(0, K.U64), doc, at
    h = K.mix(K.spans(words, np.arange(len(words) - gram + 1), np.arange(gram, len(words) + 1)))
    width, low, span = window - gram + 1, h, 1
    while 2 * span <= width:  # sliding minimum by doubling
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[at], low[at + width - span]), doc, at


def _words(buf, off):
    starts, ends, first = K.tokens(buf, off)
    return K.word_hashes(buf, starts, ends), starts, ends, first


def key_postings(docs: DataFrame, window: int) -> DataFrame:
    """(key, __id): each document once under every key of its suffixes."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, off in K.slices(b.column(1)):
                words, _, _, first = _words(buf, off)
                key, doc, _ = suffix_keys(words, first, window)
                if not len(key):
                    continue
                new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]  # repeats further on stay: harmless
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[i + doc[new]].astype(np.int64))], names=["key", "__id"])

    return docs.mapInArrow(batches, "key bigint, __id bigint")


def _stretches(window: int):
    """mapInArrow over (id, text, repeated keys, large keys): stretches, or single suffixes of large keys."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, wanted, large = b.column(0).to_pylist(), b.column(2), b.column(3)
            for i, j, buf, off in K.slices(b.column(1)):
                words, starts, ends, first = _words(buf, off)
                key, doc, at = suffix_keys(words, first, window)
                out = []
                for k in range(i, j):
                    lo, hi = np.searchsorted(doc, [k - i, k - i + 1])
                    if lo == hi:
                        continue
                    mine, own = key[lo:hi].view(np.int64), np.array(wanted[k].as_py(), np.int64)
                    many = np.array(large[k].as_py() or [], np.int64)
                    use = np.isin(mine, own)
                    cuts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1], True])
                    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        if not use[a]:
                            continue
                        if len(many) and mine[a] in many:
                            spans = at[lo + a: lo + z]
                            full = K.spans(words, spans, spans + window).view(np.int64)
                            out += [(int(mine[a]), ids[k], a + x, 1, int(v), None) for x, v in enumerate(full.tolist())]
                            continue
                        for s in range(a, z, STRETCH):
                            e = min(s + STRETCH, z)
                            w = at[lo + s]
                            out.append((int(mine[a]), ids[k], s, e - s, None, buf[starts[w]: ends[w + e - s + window - 2]].tobytes()))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "__id", "start", "n", "node", "words"])
    return run


def deep_nodes(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Node number at depth ``window`` of the suffix tree of the suffixes starting at ``at``.

    Suffixes are ranked by prefixes of 1, 2, 4, ... words: a node of twice the depth is a pair
    of nodes, so every level is one sort of pairs.
    """
    rank = np.unique(words, return_inverse=True)[1]
    depth = 1
    while 2 * depth <= window:
        pair = rank[: len(rank) - depth].astype(np.int64) * (int(rank.max()) + 1) + rank[depth:]
        rank = np.unique(pair, return_inverse=True)[1]
        depth *= 2
    pair = rank[at].astype(np.int64) * (int(rank.max()) + 1) + rank[at + window - depth]
    return np.unique(pair, return_inverse=True)[1]


def _group_repeats(ids: np.ndarray, start: np.ndarray, n: np.ndarray, texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, suffix start) of suffixes whose node holds a smaller document."""
    parts, begins, total = [], [], 0
    for _, _, buf, off in K.slices(pa.array(texts, pa.large_binary()).cast(pa.large_string())):
        words, _, _, first = _words(buf, off)
        parts.append(words)
        begins.append(first[:-1] + total)
        total += len(words)
    words, first = np.concatenate(parts), np.concatenate(begins)
    row = np.repeat(np.arange(len(n)), n)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    node = deep_nodes(words, first[row] + shift, window)
    least = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, ids[row])
    hit = least[node] < ids[row]
    return row[hit], (start[row] + shift)[hit]


def _merged(ids: np.ndarray, at: np.ndarray, window: int) -> pa.RecordBatch | None:
    """Word ranges [start, stop) covering the windows that begin at ``at``, joined where they touch."""
    if not len(ids):
        return None
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + window)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]
    return pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(at[new]), pa.array(at[last] + window)], names=["__id", "start", "stop"])


def _group_stream(window: int):
    """mapInArrow over stretches sorted by key: several whole groups are worked on at once."""
    def flush(rows):
        key, ids, start, n, texts = (list(c) for c in zip(*rows))
        ids = np.array(ids, np.int64)
        row, at = _group_repeats(ids, np.array(start, np.int64), np.array(n, np.int64), texts, window)
        return _merged(ids[row], at, window)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group = [], []
        for b in it:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if group and group[0][0] != r[0]:
                    if len(group) > 1:  # a lone stretch repeats nothing of another document
                        rows += group
                    group = []
                    if len(rows) >= TOGETHER:
                        if (x := flush(rows)) is not None:
                            yield x
                        rows = []
                group.append(r)
        rows += group if len(group) > 1 else []
        if rows and (x := flush(rows)) is not None:
            yield x
    return run


def repeated_ranges(docs: DataFrame, *, window: int = WINDOW, group_suffixes: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, start, stop): word ranges covered by windows that also begin in a document with a smaller id.

    Ranges of a document may overlap.  Rows with a null id or text take no part; rows that
    share an id are one document.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text")).where("__id is not null and __text is not null")
    posted = cut_lineage(key_postings(d, window))
    held = (posted.groupBy("key").agg(F.min("__id").alias("low"), F.max("__id").alias("high"), F.count(F.lit(1)).alias("n"))
            .where("low < high").select(F.col("key").alias("k"), (F.col("n") > group_suffixes).alias("large")))
    held = cut_lineage(held)
    wanted = posted.join(held, F.col("key") == F.col("k")).groupBy("__id").agg(
        F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("large"), F.col("key"))).alias("large"))  # keys of one document
    taken = (d.join(wanted.withColumnRenamed("__id", "__i"), F.col("__id") == F.col("__i")).select("__id", "__text", "keys", "large")
             .mapInArrow(_stretches(window), "key bigint, __id bigint, start bigint, n int, node bigint, words binary"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = (taken.where("node is null").select("key", "__id", "start", "n", "words").repartition(parts, "key").sortWithinPartitions("key", "__id", "start")
             .mapInArrow(_group_stream(window), "__id bigint, start bigint, stop bigint"))
    if held.where("large").isEmpty():
        return small
    single = taken.where("node is not null").select("key", "node", "__id", "start")
    least = single.groupBy("key", "node").agg(F.min("__id").alias("low"), F.max("__id").alias("high")).where("low < high").select(F.col("key").alias("k"), F.col("node").alias("m"), "low")
    split = single.join(least, (F.col("key") == F.col("k")) & (F.col("node") == F.col("m"))).where("__id > low")
    return small.unionByName(split.select("__id", "start", (F.col("start") + window).alias("stop")))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, group_suffixes: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, ``kept_text`` (kept words joined by one space).

    Words covered by a window whose words also begin a window of a document with a smaller id
    go; windows are judged on the input.  A null or wordless text has no words; texts shorter
    than the window stay whole; rows that share an id are one document and lose the same
    words; rows with a null id stay whole; an empty table gives no rows; other columns are
    not read.
    """
    ranges = repeated_ranges(docs, window=window, group_suffixes=group_suffixes, id_col=id_col, text_col=text_col)
    gone = ranges.groupBy("__id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")).withColumnRenamed("__id", "__i")
    kind = dict(docs.dtypes)[id_col]
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(gone, F.col("__id").cast("bigint") == F.col("__i"), "left")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, lost, kept = [], [], []
            for text, starts, stops in zip(*[c.to_pylist() for c in b.columns[1:]]):
                words = (text or "").encode().split()  # the separators of bytes.split are 0x20 and 0x09-0x0D
                edge = np.zeros(len(words) + 1, np.int64)
                if starts:
                    inside = [(s, e) for s, e in zip(starts, stops) if e <= len(words)]
                    np.add.at(edge, [s for s, _ in inside], 1)
                    np.add.at(edge, [e for _, e in inside], -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    left = [w for w, c in zip(words, cover.tolist()) if not c]
                else:
                    left = words
                n.append(len(words))
                lost.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                                             names=[id_col, "n_words", "n_removed", "kept_text"])

    return d.select("__id", "__text", "starts", "stops").mapInArrow(batches, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_text string")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM s) WHERE low < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
x AS (SELECT w.doc_id, w.word, w.i, c.i IS NOT NULL AS gone FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) w LEFT JOIN c ON c.doc_id = w.doc_id AND c.i = w.i)
SELECT documents.doc_id, count(word)::BIGINT AS n_words, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN x ON x.doc_id = documents.doc_id GROUP BY documents.doc_id
"""
