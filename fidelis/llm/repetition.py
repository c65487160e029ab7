"""Quality rules: repetition coverage of whole texts, by rolling hashes in numpy.

For several n-gram lengths the words inside n-grams that occur twice or more in their text
are marked (an interval cover from one difference array), and the characters of the marked
words are measured against all word characters; likewise for lines that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fidelis.llm import textkit as K

#: n-gram length -> largest share of the word characters that may lie in repeated n-grams.
COVERAGE = {5: 0.30, 7: 0.25, 10: 0.20}
#: Largest share of the word characters in lines equal to an earlier line.
LINE_SHARE = 0.30
#: Largest number of symbols a word.
SYMBOL_RATE = 0.1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _seen_before(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it occurred earlier."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, later


def _covered(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that their text has twice or more."""
    h, doc = K.grams(words, first, n)
    at, _ = K.gram_starts(first, n)
    again, _ = _seen_before(K.mix(h + doc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at[again]] += 1
    np.subtract.at(edge, at[again] + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the shares of repeated characters of each text in the buffer."""
    n = len(off) - 1
    starts, ends, first = K.tokens(buf, off)
    words = K.word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    total = K.per_doc(doc, n, chars)
    out = {"n_words": np.diff(first).astype(np.int64), "word_chars": total,
           "n_symbols": np.diff(np.r_[0, np.cumsum(_SYMBOL[buf])][off]) if len(buf) else np.zeros(n, np.int64)}

    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([off[:-1], breaks + 1]))  # a line begins with its text or after \n
    line_start = line_start[line_start < len(buf)]
    line_start = line_start[buf[line_start] != 10]
    stops = np.unique(np.concatenate([breaks, off[1:]]))
    line_end = stops[np.searchsorted(stops, line_start, "right")] if len(line_start) else line_start
    begin = np.searchsorted(starts, line_start)
    has = np.searchsorted(starts, line_end) > begin
    line_start, line_end, begin = line_start[has], line_end[has], begin[has]
    upto = np.searchsorted(starts, line_end)
    line_doc = doc[begin] if len(begin) else np.zeros(0, np.int64)
    key = K.spans(K._BYTE[buf], line_start, line_end) if len(begin) else np.zeros(0, K.U64)
    key = K.mix(key + line_doc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    _, later = _seen_before(key)
    upto_chars = np.r_[0, np.cumsum(chars)]
    out["n_dup_lines"] = K.per_doc(line_doc[later], n)
    out["dup_line_share"] = K.per_doc(line_doc[later], n, (upto_chars[upto] - upto_chars[begin])[later]) / np.maximum(total, 1)

    out["n_repeat_words"] = K.per_doc(doc[_covered(words, first, 3)], n)
    for k in COVERAGE:
        cover = _covered(words, first, k)
        out[f"dup_{k}gram_share"] = K.per_doc(doc[cover], n, chars[cover]) / np.maximum(total, 1)
    return out


def judge(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base failed, kept) for each text."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = (m["dup_line_share"] > LINE_SHARE) | (m["n_symbols"] > SYMBOL_RATE * m["n_words"])
    for k, most in COVERAGE.items():
        bad |= m[f"dup_{k}gram_share"] > most
    return failed, ~failed & ~bad


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts, the shares and the verdict.

    Whole texts are measured, whatever their length, in slices of whole texts.  A null text
    counts as empty (no words: the base rule fails).  Repeated rows keep a row each; an empty
    table gives no rows; other columns are not read.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_share", *[f"dup_{k}gram_share" for k in COVERAGE]]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j, buf, off in K.slices(b.column(1)):
                m = measure(buf, off)
                failed, kept = judge(m)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *[pa.array(m[c].astype(np.int64)) for c in longs], *[pa.array(m[c]) for c in shares],
                     pa.array(failed), pa.array(kept)], names=[id_col, *longs, *shares, "base_failed", "kept"])

    d = docs.select(id_col, text_col)
    schema = ", ".join([f"`{id_col}` {dict(d.dtypes)[id_col]}", *[f"{c} bigint" for c in longs], *[f"{c} double" for c in shares],
                        "base_failed boolean", "kept boolean"])
    return d.mapInArrow(batches, schema)


def _oracle() -> str:
    grams = "".join(f"""
g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
  SELECT doc_id, i, w[i:i + {n - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n}))),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(word)) AS chars FROM word JOIN (
  SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE c > 1) USING (doc_id, i) GROUP BY doc_id),""" for n in (3, *COVERAGE))
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in (3, *COVERAGE))
    shares = ", ".join(f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1) AS dup_{n}gram_share" for n in COVERAGE)
    limits = " AND ".join(f"dup_{n}gram_share <= {most}" for n, most in COVERAGE.items())
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),{grams}
n AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM w),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w),
d AS (SELECT doc_id, count(*)::BIGINT AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY doc_id),
a AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0)::BIGINT AS n_repeat_words,
  coalesce(d.chars, 0) / greatest(word_chars, 1) AS dup_line_share, {shares} FROM n LEFT JOIN d USING (doc_id) {joins}),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND dup_line_share <= {LINE_SHARE} AND n_symbols <= {SYMBOL_RATE} * n_words AND {limits} AS kept FROM f
"""


ORACLE_SQL = _oracle()
