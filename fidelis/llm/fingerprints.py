"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for two primes, the running sums ``c[j] * B**j`` over a text's code
points.  Any two spans are compared in constant time, and the longest common extension of two
positions is found by binary search.  A fingerprint is the length, the hash of the whole text
and its ``SPANS`` smallest span hashes; its likeness to another is the share of common hashes
among the smallest of both (equal texts: 1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm import textkit as K

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
WIDTH = 24
SPANS = 32
_tables: list[list[np.ndarray]] = [[], []]


def _power_tables(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**0..`` and ``B**-0..`` modulo prime ``k`` with at least ``n`` entries (doubled, kept)."""
    p = PRIMES[k]
    if not _tables[k]:
        _tables[k] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    out = []
    for t, base in zip((0, 1), (BASES[k], pow(BASES[k], -1, p))):
        a = _tables[k][t]
        while len(a) < n:
            a = np.concatenate([a, a * np.uint64(pow(base, len(a), p)) % np.uint64(p)])
        if len(a) <= 1 << 22:
            _tables[k][t] = a
        out.append(a)
    return out[0], out[1]


class PrefixHash:
    """Prefix arrays of one text; spans are half-open ranges of code points."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = len(self.points)
        self.sums, self.inverse = [], []
        for k, p in enumerate(PRIMES):
            up, down = _power_tables(k, self.n + 1)
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum((self.points + np.uint64(1)) * up[: self.n] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))
            self.inverse.append(down)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hash of each span; equal spans anywhere, in any text, have equal hashes."""
        h = []
        for s, down, p in zip(self.sums, self.inverse, PRIMES):
            h.append((s[ends] + np.uint64(p) - s[starts]) % np.uint64(p) * down[starts] % np.uint64(p))
        return (h[0] << np.uint64(31)) | h[1]

    def span(self, i: int, j: int) -> int:
        return int(self.spans(np.array([i]), np.array([j]))[0])

    def lce(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension to the right of ``self[i:]`` and ``other[j:]``."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def common_suffix(self, other: PrefixHash) -> int:
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(self.n - mid, self.n) == other.span(other.n - mid, other.n):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self) -> str:
        w = min(WIDTH, max(self.n, 1))
        at = np.arange(max(self.n - w + 1, 0))
        h = K.mix(self.spans(at, at + w)) if len(at) else np.zeros(0, np.uint64)
        low = np.unique(np.partition(h, 4 * SPANS)[: 4 * SPANS] if len(h) > 8 * SPANS else h)
        if len(low) < SPANS < len(h):
            low = np.unique(h)
        return f"{self.n:x}:{self.span(0, self.n):016x}:" + "".join(f"{int(x) >> 24:010x}" for x in low[:SPANS])


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans of two fingerprinted texts (1 when they are equal)."""
    if a == b:
        return 1.0
    x, y = ({s[i: i + 10] for i in range(0, len(s), 10)} for s in (a.rsplit(":", 1)[1], b.rsplit(":", 1)[1]))
    least = sorted(x | y)[:SPANS]
    return sum(h in x and h in y for h in least) / len(least) if least else 0.0


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many first characters of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _compare(doc_id, text: str, h: PrefixHash, fp: str, nxt: str, next_hash: PrefixHash, next_fp: str) -> tuple:
    new = edited(text, nxt)
    e = PrefixHash(new)
    fe = e.fingerprint()
    return (doc_id, h.n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, fe, likeness(fp, fe), likeness(fp, next_fp),
            h.lce(0, e, 0), h.common_suffix(e), h.lce(0, next_hash, 0))


def fingerprint_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprints of the text and of its edited form, and likeness.

    The next document is the one with the next smaller id (after the smallest: the largest).
    Ids are cut at quantiles into ranges, a range's largest row is sent also to the range
    below it, so each text is shuffled once and each range is worked through as a sorted
    stream with one row of memory.  A null text is empty; rows with one id follow each other
    in text order; a null id sorts last; a single document follows itself; an empty table
    gives no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    out = [(id_col, kind), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
           ("near_edited", "double"), ("near_next", "double"), ("edited_common_prefix", "bigint"), ("edited_common_suffix", "bigint"),
           ("next_common_prefix", "bigint")]
    schema = ", ".join(f"`{n}` {t}" for n, t in out)
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    spark = docs.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = d.agg(F.percentile_approx("__id", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("q"), F.max("__id").alias("top")).first()
    top = cut["top"]
    splits = np.array(sorted({x for x in cut["q"] or [] if x != top}), np.int64)

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            bucket = np.where(null, 0, np.searchsorted(splits, ids, "left")).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(b), bool)), b.column(0), b.column(1)], names=["bucket", "extra", "__id", "__text"])
            head = np.flatnonzero(~null & (np.isin(ids, splits) | (ids == top)) if top is not None else null)
            if len(head):  # the first row of a range follows the last one of the range above
                t = b.take(pa.array(head))
                below = np.where(ids[head] == top, 0, bucket[head] + 1).astype(np.int32) if top is not None else bucket[head]
                yield pa.RecordBatch.from_arrays([pa.array(below), pa.array(np.ones(len(t), bool)), t.column(0), t.column(1)], names=["bucket", "extra", "__id", "__text"])

    def chained(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows = None, []
        for b in it:
            for bucket, extra, i, text in zip(*[c.to_pylist() for c in b.columns]):
                if extra and (before is None or before[0] != bucket):
                    continue
                h = PrefixHash(text)
                fp = h.fingerprint()
                if before is not None and before[0] == bucket:
                    rows.append(_compare(*before[1:], text, h, fp))
                before = None if extra else (bucket, i, text, h, fp)
                if len(rows) >= 512:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    names = [n for n, _ in out]

    def _batch(rows):
        kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        kinds[0] = {"int": pa.int32(), "bigint": pa.int64()}[kind]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    placed = (d.mapInArrow(dealt, f"bucket int, extra boolean, __id {kind}, __text string")
              .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
              .sortWithinPartitions("bucket", "extra", F.col("__id").desc_nulls_last(), "__text"))
    return placed.mapInArrow(chained, schema)
