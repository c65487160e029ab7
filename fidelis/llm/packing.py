"""Best-fit packing of token pieces, improved by a swap-based local search.

Texts are tokenised once and cut into pieces of at most ``capacity`` tokens.  Pieces are dealt
by a hash to groups of about ``GROUP`` pieces; each group is packed best-fit (largest first) and then improved:
the emptiest bins give documents away to fuller ones by moves, one-for-one and two-for-one
exchanges, each of which increases the sum of squared fills, until bins run empty.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.units import ByteUnits, UnitPool, text_batches
from fidelis.operators.frames import dense_index
from fidelis.session import cut_lineage

#: Expected pieces in a group (packing quality no longer rises beyond a few thousand).
GROUP = 4096
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


# ------------------------------------------------------------------ pieces

def pieces_of(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of the pieces of texts of so many tokens: full ones after a possibly shorter first."""
    count = -(-tokens // capacity)
    row = np.repeat(np.arange(len(tokens)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = tokens - (count - 1) * capacity
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, first[row], capacity)


_pools: dict[str, UnitPool] = {}  # kept from task to task in a worker


def file_order() -> Column:
    """Where a row stands in a table of Parquet files: part number, file of that part, row of the file.

    Spark deals files to partitions by size, so the order of partitions is not that of the
    files.  Names without a part number come first, by name.
    """
    name = F.col("_metadata.file_name")
    number = [F.coalesce(F.regexp_extract(name, p, 1).try_cast("bigint"), F.lit(-1).cast("bigint")) for p in (r"^part-(\d+)", r"[-.]c(\d+)\.")]
    return F.struct(number[0].alias("part"), number[1].alias("file"), name.alias("name"), F.col("_metadata.row_index").alias("row"))


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                     text_col: str = "text", order: Column | None = None) -> DataFrame:
    """One row per piece of each document: start, length and the CRC-32 of its ids.

    Ids are those of the tokenizer file's own call without special tokens added, then ``end_id``;
    a null text is empty (one piece with the end id).  Whole texts are tokenised, alike whatever
    stands beside them.  With ``order`` each piece carries its document's value of it, as ``__at``.
    """
    kind = dict(docs.dtypes)[id_col]
    read = docs.select(id_col, text_col, *([] if order is None else [order.alias("__at")]))
    more = "".join(f", `{c}` {t}" for c, t in read.dtypes[2:])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        if tokenizer_path not in _pools:
            _pools[tokenizer_path] = UnitPool(ByteUnits(tokenizer_path, special_as_text=False))
        pool = _pools[tokenizer_path]
        for b in it:
            for lo, texts in text_batches(b.column(1)):
                ids, off = pool.encode(texts)
                row, piece, start, length = pieces_of(np.diff(off) + 1, capacity)
                first = off[row] + start  # the end id stands after the last piece's ids
                last = start + length == off[row + 1] - off[row] + 1
                ids = memoryview(ids.astype("<u4")).cast("B")
                end = np.array([end_id], "<u4").tobytes()
                crc = [zlib.crc32(end, zlib.crc32(ids[4 * i: 4 * (j - 1)])) if z else zlib.crc32(ids[4 * i: 4 * j])
                       for i, j, z in zip(first.tolist(), (first + length).tolist(), last.tolist())]
                at = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                                                  pa.array(crc, pa.int64()), *[c.take(at) for c in b.columns[2:]]],
                                                 names=[id_col, "piece", "start", "length", "ids_crc32", *b.schema.names[2:]])

    return read.mapInArrow(batches, f"`{id_col}` {kind}, {PIECES}{more}")


# ------------------------------------------------------------------ bins

def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest bin that can take it."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (free room, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(gaps, (s, -1))
        if k == len(gaps):
            bins.append([i])
            left, b = capacity - s, len(bins) - 1
        else:
            room, b = gaps.pop(k)
            bins[b].append(i)
            left = room - s
        if left:
            insort(gaps, (left, b))
    return bins


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins (the greatest of the bounds that leave out pieces under some size)."""
    up = np.sort(sizes[sizes > 0])
    if not len(up):
        return 0
    cum = np.concatenate([[0], np.cumsum(up)])
    half = int(np.searchsorted(up, capacity // 2, "right"))  # pieces before it are no more than half a bin
    small = np.unique(np.concatenate([[0], up[:half]]))
    alone = np.searchsorted(up, capacity - small, "right")  # from here on nothing of the size fits beside
    from_ = np.searchsorted(up, small, "left")
    room = (alone - half) * capacity - (cum[alone] - cum[half])
    rest = np.maximum(cum[half] - cum[from_] - room, 0)
    return int((len(up) - half + -(-rest // capacity)).max())


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Move or exchange pieces so that squared fill grows, emptying the emptiest bins.

    Sweeps take the open bins from the emptiest on; a bin gives by the best of: a move, an
    exchange of one piece for a smaller one, of two for one, until none helps.  A later sweep
    tries a bin against those changed since it was tried last.  The search ends when a whole
    sweep changes nothing, or when no packing has fewer bins.
    """
    least = least_bins(sizes, capacity)
    if len(bins) <= least:
        return bins
    bins = [list(b) for b in bins]
    fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
    home = np.empty(len(sizes), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    by_size = np.argsort(sizes, kind="stable")
    up = sizes[by_size]
    tried, changed, now, left, moved = np.full(len(bins), -1), np.zeros(len(bins), np.int64), 0, len(bins), True
    while moved and left > least:
        moved = False
        for a in np.flatnonzero((fill > 0) & (fill < capacity))[np.argsort(fill[(fill > 0) & (fill < capacity)], kind="stable")].tolist():
            while bins[a] and fill[a] < capacity:
                found = _best_change(sizes, up, by_size, fill, home, bins[a], a, capacity, changed > (tried[a] if changed[a] <= tried[a] else -1))
                if found is None:
                    break
                give, take, b = found
                delta = int(sizes[give].sum()) - (int(sizes[take]) if take is not None else 0)
                for i in give:
                    bins[a].remove(i)
                    bins[b].append(i)
                    home[i] = b
                if take is not None:
                    bins[b].remove(take)
                    bins[a].append(take)
                    home[take] = a
                fill[a] -= delta
                fill[b] += delta
                now += 1
                changed[[a, b]] = now
                moved = True
            tried[a] = now
            left = int((fill > 0).sum())
            if left <= least:
                break
    return [b for b in bins if b]


def _best_change(sizes, up, by_size, fill, home, members, a, capacity, fresh):
    """(pieces given, piece taken back or None, target bin) with the largest gain among ``fresh`` bins, or None.

    Gives of one sum are alike, so one of each is tried; pieces to take back lie within the
    largest free room below that sum in the order of sizes.
    """
    open_ = fresh & (fill > 0) & (fill < capacity)
    open_[a] = False
    targets = np.flatnonzero(open_)
    if not len(targets):
        return None
    sums: dict[int, list[int]] = {}
    by = sorted(members, key=lambda i: int(sizes[i]))
    for x, i in enumerate(by):
        sums.setdefault(int(sizes[i]), [i])
    for x, i in enumerate(by):
        for j in by[x + 1:]:
            sums.setdefault(int(sizes[i] + sizes[j]), [i, j])
    free = capacity - fill
    most = int(free[targets].max())
    room = free[targets]
    best, gain = None, 0
    for s, give in sums.items():
        if s <= most and len(give) == 1:  # a move: the fullest bin that takes it
            fits = targets[room >= s]
            b = int(fits[np.argmax(fill[fits])])
            g = 2 * s * (int(fill[b]) - int(fill[a]) + s)
            if g > gain:
                best, gain = (give, None, b), g
        lo, hi = np.searchsorted(up, (s - most, s))
        if lo < hi:
            items = by_size[lo:hi]
            to = home[items]
            delta = s - up[lo:hi]
            value = np.where(open_[to] & (delta <= free[to]), delta * (fill[to] - fill[a] + delta), 0)
            k = int(np.argmax(value))
            if 2 * value[k] > gain:
                best, gain = (give, int(items[k]), int(to[k])), 2 * int(value[k])
    return best


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number and offset of each piece, as an array of two rows."""
    out = np.zeros((2, len(sizes)), np.int64)
    for k, b in enumerate(local_search(sizes, best_fit(sizes, capacity), capacity)):
        out[0, b] = k
        out[1, b] = np.cumsum(sizes[b]) - sizes[b]
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, in_order: bool = False, order: Column | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and their place in it (gapless from 0).

    Every piece is packed; pieces of exactly ``capacity`` tokens fill a sequence alone.  The
    pieces are checkpointed, so tokenising happens once; groups hold about ``GROUP`` pieces at
    any table size.  With ``order`` (one value a row, see ``file_order``) pieces are numbered by
    it over the whole table, a group holds ``GROUP`` that follow each other, and sequences are
    numbered by their first piece, so a mixed order holds to within a group.  ``in_order``
    takes the order of the partitions and of the rows in them, for frames that are not read
    from several files.  Else pieces are dealt by a hash of their place in the checkpoint.
    Repeated rows are packed each, whatever their number; an empty table gives no rows.
    """
    if in_order and order is None:
        order = F.monotonically_increasing_id()
    pieces = cut_lineage(tokenised_pieces(docs, tokenizer_path, capacity=capacity, id_col=id_col, text_col=text_col, order=order))
    if order is not None:
        numbered = dense_index(pieces.withColumn("__at", F.struct("__at", "piece")), "__at", name="__n").drop("__at")
        dealt = numbered.withColumn("__group", F.expr(f"__n div {GROUP}"))
    else:
        groups = max(1, round(pieces.where(F.col("length") < capacity).count() / GROUP))
        # the place of a row in the checkpoint is fixed, so equal rows go to different groups
        dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    kind = dict(pieces.dtypes)[id_col]

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        by_order = "__n" in pdf
        pdf = pdf.sort_values("__n") if by_order else pdf
        pdf = pdf.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable")
        place = pack(pdf["length"].to_numpy(), capacity)
        if by_order:
            first = pdf["__n"].groupby(place[0]).min()
            place[0] = first.rank().astype(np.int64).sub(1)[place[0]].to_numpy()
        return pdf.assign(sequence_id=(pdf["__group"].to_numpy(np.int64) << 20) + place[0], offset=place[1]).drop(columns=["__group", "__n"], errors="ignore")

    return dealt.groupBy("__group").applyInPandas(packed, f"`{id_col}` {kind}, {PIECES}, sequence_id bigint, `offset` bigint")
