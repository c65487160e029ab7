"""Exact pruned nearest-neighbour index for cosine similarity.

Reference vectors are put on the unit sphere and dealt to the nearest of a bounded number of
pivots (a hashed sample of the references); a pivot's vectors are cut by their angle to it into
rings.  A ring is a cell with the least and the greatest of its angles.  By the triangle inequality
of angles no vector of a cell is nearer to a candidate than the candidate's own angle to the
pivot lies outside the cell's range, nor than the plane halfway between that pivot and the candidate's own
(the cell's vectors lie beyond it), so a candidate meets

1. the cell it falls into itself, which gives its k-th best similarity so far, and
2. then only the cells whose bound reaches that value.

Candidates are shuffled once, by the cell they fall into (those of a cell that many fall into go to several tasks), and
a task reads the cells it needs from the index, each in bounded blocks.  In a block the vectors are halved into leaves of ``LEAF``, and a candidate is compared with
the leaves whose ball reaches its k-th best similarity, so the work of a candidate hardly grows with the table.  The result is that of comparing all pairs; every reference row is in the index.
The index is a folder of Parquet tables (the vectors one folder a cell), so it is built once and read by later sessions.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.session import checkpoint_dir, qualified, release, remove

#: Reference rows a cell should hold until ``MOST_CELLS`` are in use (then cells grow), pivots and rings of a pivot at most.
CELL_ROWS = 1024
MOST_CELLS = 2048
MOST_PIVOTS = 4096
MOST_RINGS = 64
#: Angles are compared with this tolerance (radians), far above their rounding.
SLACK = 1e-6
#: Ids kept of equal unit vectors, unless the index is built for more neighbours.
KEEP = 16
#: Vectors of a leaf, and rows of a block of one side.
LEAF = 64
BLOCK_ROWS = 16384
_STRIP = 1024
#: Rows of the samples that say where pivots and rings lie and how many candidates a cell gets (only speed depends on them).
SAMPLED = 1 << 17
#: Rows whose equal vectors a task joins before they are shuffled.
JOINED = 1 << 17
#: Bytes of cells that a task keeps, and candidates that it answers together.
CACHE = 48 << 20
TOGETHER = 1 << 16
#: Candidates that are worth a task.
TASK_ROWS = 1 << 13
_META = ("n_rows bigint, keep int, smallest array<bigint>, zeros array<bigint>, pivots array<array<double>>, inner array<array<double>>, "
         "cell array<bigint>, low array<double>, high array<double>, rows array<bigint>")


@dataclass
class Cells:
    """The index's small tables: pivots, and per cell its pivot, range of angles and rows (both bounded)."""

    pivots: np.ndarray  # (pivots, dimensions)
    cell: np.ndarray  # pivot * MOST_RINGS + ring, ascending
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    inner: dict[int, np.ndarray]  # of each pivot the angles where its rings end


@dataclass
class VectorIndex:
    """Unit vectors by cell with their ids, in a folder, and the rows that have no direction."""

    path: str  # below it vectors/cell=<cell> (u, ids: the smallest ids of a vector, ascending)
    cells: Cells
    smallest: list[int]  # the smallest ids of all rows: the neighbours of a zero vector
    zeros: list[int]  # the smallest ids of zero vectors, which have similarity 0 with everything
    n_rows: int
    keep: int  # ids kept of equal vectors: a search asks for this many neighbours at most


def unit_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, rows that have none) of a list column; null rows and elements and NaN count as 0.

    Vectors shorter than the longest of the batch are filled with zeros.
    """
    n = len(col)
    lengths = np.diff(np.asarray(col.offsets).astype(np.int64)) if n else np.zeros(0, np.int64)
    lengths = np.where(np.asarray(col.is_null()), 0, lengths)
    d = int(lengths.max(initial=0))
    flat = np.nan_to_num(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (lengths == d).all():
        m = flat.reshape(n, d)
    else:
        m = np.zeros((n, d))
        m[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    norm = np.linalg.norm(m, axis=1)
    none = norm == 0
    return np.divide(m, norm[:, None], out=np.zeros_like(m), where=~none[:, None]), none


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1])) if m.size else np.zeros(len(m) + 1), pa.int32()), pa.array(m.ravel()))


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def _nearest(u: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the angle to it."""
    dots = u @ pivots.T
    near = dots.argmax(axis=1)
    return near, np.arccos(np.clip(dots[np.arange(len(u)), near], -1.0, 1.0))


def _units(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): ids and vectors as doubles."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))


def _sample(df: DataFrame, n_rows: int) -> tuple[DataFrame, float]:
    """About ``SAMPLED`` rows of ``df``, and their share; as a filter, which goes below the projections that make the columns."""
    share = min(1.0, SAMPLED / max(n_rows, 1))
    return (df if share == 1.0 else df.where(F.rand(1) < share)), share


def _held(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of at least ``rows`` rows or 32 MB (the last may have fewer)."""
    held: list[pa.RecordBatch] = []
    for b in it:
        held.append(b)
        if sum(map(len, held)) >= rows or sum(x.nbytes for x in held) >= 32 << 20:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    return t.column(name).chunk(0) if t.num_rows else t.column(name).combine_chunks()


def _joined(u: np.ndarray, by: list[np.ndarray], row: np.ndarray, ids: np.ndarray, null: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of ``u`` (and ``by``) as one: (a row of each, ends of its ids, its ``keep`` smallest ids ascending, how many null ids it has).

    The id ``ids[i]`` belongs to row ``row[i]``; ``null`` says how many null ids a row has."""
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.column_stack([*[x.astype(np.float64) for x in by], u + 0.0]) if u.shape[1] or by else np.zeros((len(u), 1))
    _, first, group = np.unique(np.ascontiguousarray(keys).view(np.dtype((np.void, keys.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    of = group.ravel()[row]
    order = np.lexsort((ids, of))
    of, ids = of[order], ids[order]
    start = np.searchsorted(of, np.arange(len(first)))
    few = np.arange(len(of)) - start[of] < keep
    return first, np.r_[0, np.cumsum(np.bincount(of[few], minlength=len(first)))], ids[few], np.bincount(group.ravel(), null, len(first)).astype(np.int64)


def _equal(units: DataFrame, keep: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, u, ids, nulls): every distinct vector (of the same ``by``, numbers) with its ``keep`` smallest ids and its number of rows without one.

    A task joins the equal vectors of ``JOINED`` rows first, so of a vector that a third of the rows share few rows are shuffled.  Then rows are sorted by a number
    made from the vector, and vectors are compared only where that number is equal."""
    schema = "".join(f"{c} bigint, " for c in by) + "u array<double>, ids array<bigint>, nulls bigint"

    def table(t: pa.Table, first: np.ndarray, ends: np.ndarray, ids: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
        at = pa.array(first)
        return pa.RecordBatch.from_arrays([*[_column(t, c).take(at) for c in by], _column(t, "u").take(at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64())), pa.array(null)], names=[*by, "u", "ids", "nulls"])

    def keys(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        return _matrix(_column(t, "u")), [_column(t, c).to_numpy() for c in by]

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _held(it, JOINED):
            u, others = keys(t)
            has = np.asarray(_column(t, "id").is_valid())
            yield table(t, *_joined(u, others, np.flatnonzero(has), _column(t, "id").drop_null().to_numpy(), ~has, keep))

    def far(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for t in _held(it, 1 << 14):
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            h = _column(t, "h").to_numpy()
            done = int(np.searchsorted(h, h[-1]))  # rows of the last number may follow
            rest = t.slice(done).combine_chunks()
            if done:
                yield joined(t.slice(0, done).combine_chunks())
        if rest is not None:
            yield joined(rest)

    def joined(t: pa.Table) -> pa.RecordBatch:
        u, others = keys(t)
        lists = _column(t, "ids")
        row = np.repeat(np.arange(len(t)), np.diff(np.asarray(lists.offsets)))
        return table(t, *_joined(u, others, row, lists.flatten().to_numpy(), _column(t, "nulls").to_numpy(), keep))

    dealt = units.select(*by, "id", "u").mapInArrow(near, schema).repartition(*(by or ("u",)))
    return dealt.select("*", F.xxhash64("u").alias("h")).sortWithinPartitions("h").mapInArrow(far, schema)


def _matrix(col: pa.Array) -> np.ndarray:
    """(rows, dimensions) of a list column; shorter lists are filled with zeros."""
    lengths = np.diff(np.asarray(col.offsets))
    d = int(lengths.max(initial=0))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return flat.reshape(len(col), d)
    m = np.zeros((len(col), d))
    m[np.repeat(np.arange(len(col)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return m


def build_index(reference: DataFrame, id_col: str, vec_col: str, *, path: str | None = None, cell_rows: int = CELL_ROWS,
                most_pivots: int = MOST_PIVOTS, keep: int = KEEP) -> VectorIndex:
    """Index every row of ``reference`` and write it to ``path`` (a new folder of the shared folder by default).

    Equal unit vectors are one entry with their ``keep`` smallest ids, so copies cost nothing later.
    Pivots are a hashed sample of ceil(rows / ``cell_rows``) vectors, ``MOST_CELLS`` and ``most_pivots`` at most; the
    driver holds them, and MOST_RINGS numbers a pivot.  With more rows than those cells are for, cells grow.
    Pivots and rings come from samples of the rows; then all rows are read once and shuffled once, by cell.
    """
    spark = reference.sparkSession
    path = qualified(spark, path or f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    units = _units(reference, id_col, vec_col)
    n_rows = reference.count()
    aim = max(cell_rows, math.ceil(n_rows / MOST_CELLS))
    some, share = _sample(units, n_rows)

    def directions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            u, none = unit_rows(b.column(0))
            yield pa.RecordBatch.from_arrays([_lists(u[~none] + 0.0)], names=["u"])

    sampled = some.select("v").mapInArrow(directions, "u array<double>")
    m = min(most_pivots, math.ceil(n_rows / aim))
    pivots = np.array([r["u"] for r in sampled.distinct().orderBy(F.xxhash64("u"), "u").limit(m).collect()])
    if len(pivots):
        pivots = pivots[np.concatenate(_leaves(pivots, 4))]  # pivots near each other get near numbers

    def angles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            u = unit_rows(b.column(0))[0]
            for lo in range(0, len(u) if len(pivots) else 0, _STRIP):
                near, angle = _nearest(u[lo: lo + _STRIP], pivots)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(angle)], names=["pivot", "angle"])

    grid = [k / MOST_RINGS for k in range(1, MOST_RINGS)]
    inner, parts = {}, np.ones(len(pivots), np.int64)
    for r in sampled.mapInArrow(angles, "pivot int, angle double").groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", grid, 1000).alias("q")).collect():  # a row a pivot
        wanted = math.ceil(r["n"] / share / aim)
        rings = min(MOST_RINGS, wanted)
        inner[r["pivot"]] = np.array([r["q"][min(k * MOST_RINGS // rings, MOST_RINGS - 1) - 1] for k in range(1, rings)])
        parts[r["pivot"]] = math.ceil(wanted / rings)

    ring_ends = _ring_table(inner, len(pivots))

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            u, none = unit_rows(b.column(1))
            u, cell, part = u + 0.0, np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
            real = np.flatnonzero(~none)
            for lo in range(0, len(real), _STRIP):
                at = real[lo: lo + _STRIP]
                near, angle = _nearest(u[at], pivots)
                cell[at] = cells_of(near, angle, ring_ends)
                part[at] = _mixed(u[at]) % parts[near].astype(np.uint64)  # equal vectors stay together
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part), b.column(0), _lists(u)], names=["cell", "part", "id", "u"])

    placed = units.mapInArrow(assign, "cell bigint, part bigint, id bigint, u array<double>")
    _equal(placed, keep, ("cell", "part")).drop("part").write.partitionBy("cell").parquet(f"{path}/vectors")
    release(spark)

    def bounds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cell, null, u = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            for c in np.unique(cell):
                of = cell == c
                angle = np.arccos(np.clip(u[of] @ pivots[c // MOST_RINGS], -1.0, 1.0)) if c >= 0 else np.zeros(1)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(c), float(angle.min()), float(angle.max()), int(of.sum()), int(null[of].sum()))], names=["cell", "low", "high", "rows", "nulls"])

    stored = spark.read.schema("u array<double>, ids array<bigint>, nulls bigint, cell bigint").parquet(f"{path}/vectors")
    agg = stored.select("cell", "nulls", "u").mapInArrow(bounds, "cell bigint, low double, high double, rows bigint, nulls bigint").groupBy("cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"))
    table = sorted(agg.collect())  # MOST_PIVOTS * MOST_RINGS rows at most

    def least(rows: DataFrame, nulls: int) -> list[int | None]:
        return ([None] * min(nulls, keep) + [r["id"] for r in rows.select(F.explode("ids").alias("id")).orderBy("id").limit(keep).collect()])[:keep]

    zeros = least(stored.where("cell = -1"), sum(r["nulls"] for r in table if r["cell"] == -1))
    smallest = least(stored, sum(r["nulls"] for r in table))
    columns = [[r[c] for r in table if r["cell"] >= 0] for c in ("cell", "low", "high", "rows")]
    ends = [inner.get(k, np.zeros(0)).tolist() for k in range(len(pivots))]
    meta = (n_rows, keep, smallest, zeros, [p.tolist() for p in pivots], ends, *columns)
    spark.createDataFrame([meta], _META).coalesce(1).write.parquet(f"{path}/meta")
    return _index(path, meta)


def _index(path: str, meta: tuple) -> VectorIndex:
    n_rows, keep, smallest, zeros, pivots, ends, cell, low, high, rows = meta
    cells = Cells(np.array(pivots, np.float64), np.array(cell, np.int64), np.array(low, np.float64), np.array(high, np.float64), np.array(rows, np.int64),
                  {k: np.array(e) for k, e in enumerate(ends)})
    return VectorIndex(path, cells, list(smallest), list(zeros), n_rows, keep)


def _mixed(u: np.ndarray) -> np.ndarray:
    """A number from the bits of each row."""
    out = np.zeros(len(u), np.uint64)
    for x in np.ascontiguousarray(u).view(np.uint64).T:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _ring_table(inner: dict[int, np.ndarray], pivots: int) -> np.ndarray:
    """(pivots, most rings - 1): where the rings of each pivot end, filled up beyond all angles."""
    out = np.full((pivots, max((len(e) for e in inner.values()), default=0)), np.inf)
    for p, e in inner.items():
        out[p, : len(e)] = e
    return out


def cells_of(pivot: np.ndarray, angle: np.ndarray, inner: dict[int, np.ndarray] | np.ndarray) -> np.ndarray:
    """The cell of vectors at ``angle`` to their ``pivot``; ``inner`` may be given as ``_ring_table``."""
    if isinstance(inner, dict):
        inner = _ring_table(inner, int(max([*inner, *pivot.tolist()], default=0)) + 1)
    ring = (inner[pivot] < angle[:, None]).sum(axis=1)
    return pivot.astype(np.int64) * MOST_RINGS + ring


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build_index`` wrote."""
    path = qualified(spark, path)
    return _index(path, tuple(spark.read.schema(_META).parquet(f"{path}/meta").first()))


def drop_index(spark: SparkSession, index: VectorIndex) -> None:
    """Remove the index's folder."""
    remove(spark, index.path)


# ------------------------------------------------------------------ search

def _leaves(u: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """The rows of ``u`` in leaves of ``most`` at most: halved at the median of the widest coordinate."""
    done, todo = [], [np.arange(len(u))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        part = u[rows]
        half = len(rows) // 2
        order = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return done


def _kept(k: int, who: np.ndarray, which: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (candidate, vector, similarity) of each candidate with all ties at the last place."""
    order = np.lexsort((-sims, who))
    who, which, sims = who[order], which[order], sims[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(who)])
    last = sims[first + np.minimum(k, count) - 1]
    keep = sims >= np.repeat(last, count) - 1e-12
    return who[keep], which[keep], sims[keep]


def _tree(vu: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The leaves of a block, their means, and the radius of the ball of each."""
    leaves = _leaves(vu)
    centre = np.stack([vu[rows].mean(axis=0) for rows in leaves])
    return leaves, centre, np.array([np.sqrt(((vu[rows] - m) ** 2).sum(axis=1).max()) for rows, m in zip(leaves, centre)])


def nearest_in_block(cu: np.ndarray, kth: np.ndarray, vu: np.ndarray, k: int, tree: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, vector, similarity): the ``k`` best unit vectors ``vu`` for each of ``cu``, ties at the last place in full.

    Vectors less similar than a candidate's ``kth`` may be left out.  A leaf is a ball around its mean; by the
    triangle inequality a candidate skips those farther away than the k-th best vector known to it, which the
    leaf around the candidate gives first where ``kth`` does not say it.
    """
    leaves, centre, radius = tree if tree is not None else _tree(vu)
    norm = (centre ** 2).sum(axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(rows: np.ndarray, of: np.ndarray, bound: np.ndarray) -> np.ndarray:
        sims = cu[of] @ vu[rows].T
        at = len(rows) - min(k, len(rows))
        best = np.partition(sims, at, axis=1)[:, at]
        row, col = np.nonzero(sims >= np.maximum(best, bound)[:, None] - 1e-12)
        found.append((of[row], rows[col], sims[row, col]))
        return best if len(rows) >= k else np.full(len(of), -1.0)

    for lo in range(0, len(cu), 4096):
        at = np.arange(lo, min(lo + 4096, len(cu)))
        away = np.sqrt(np.maximum(1.0 + norm - 2.0 * (cu[at] @ centre.T), 0.0))
        bound, mine = kth[at].copy(), np.full(len(at), -1)
        fresh = np.flatnonzero(bound <= -1.0)
        if len(fresh):
            mine[fresh] = away[fresh].argmin(axis=1)
            order = fresh[np.argsort(mine[fresh], kind="stable")]
            for some in np.split(order, np.flatnonzero(np.diff(mine[order])) + 1):
                bound[some] = meet(leaves[mine[some[0]]], at[some], bound[some])
        reach = away - radius <= (np.sqrt(np.maximum(2.0 - 2.0 * bound, 0.0)) + SLACK)[:, None]
        reach[fresh, mine[fresh]] = False  # met already
        leaf, row = np.nonzero(reach.T)
        for some in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
            if len(some):
                meet(leaves[leaf[some[0]]], at[row[some]], bound[row[some]])
    return _kept(k, *(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


@dataclass
class _Block:
    """Vectors of a cell, with up to k ids of each (``full`` says which places hold one)."""

    u: np.ndarray
    ids: np.ndarray
    full: np.ndarray
    tree: tuple


class _Reader:
    """The blocks of a cell, read from the index's folder; ``CACHE`` bytes of the cells read last are kept."""

    def __init__(self, path: str, block_rows: int, k: int):
        self.files, self.root = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
        self.block_rows, self.k = block_rows, k
        self.kept: OrderedDict[int, list[_Block]] = OrderedDict()
        self.bytes = 0

    def blocks(self, cell: int) -> Iterator[_Block]:
        if cell in self.kept:
            self.kept.move_to_end(cell)
            yield from self.kept[cell]
            return
        held, size = [], 0
        for b in self._read(cell):
            size += _size(b)
            if size <= CACHE:
                held.append(b)
            else:
                held = []  # a cell beyond the cache is read again
            yield b
        if size <= CACHE:
            self.kept[cell] = held
            self.bytes += size
            while self.bytes > CACHE:
                self.bytes -= sum(map(_size, self.kept.popitem(last=False)[1]))

    def _read(self, cell: int) -> Iterator[_Block]:
        held, rows = [], 0  # small files of a cell make one block
        for info in sorted(self.files.get_file_info(fs.FileSelector(f"{self.root}/vectors/cell={cell}")), key=lambda i: i.base_name):
            if not info.base_name.endswith(".parquet"):
                continue
            with self.files.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=self.block_rows, columns=["u", "ids"], use_threads=False):
                    if held and rows + len(b) > self.block_rows:
                        yield self._block(held)
                        held, rows = [], 0
                    held.append(b)
                    rows += len(b)
        if rows:
            yield self._block(held)

    def _block(self, held: list[pa.RecordBatch]) -> _Block:
        t = pa.Table.from_batches(held).combine_chunks()
        u, lists = _matrix(_column(t, "u")), _column(t, "ids")
        start = np.asarray(lists.offsets).astype(np.int64)
        flat, count = lists.flatten().to_numpy(), np.minimum(np.diff(start), self.k)
        place = np.arange(int(count.max(initial=0)))
        full = place < count[:, None]
        ids = np.zeros(full.shape, np.int64)
        ids[full] = flat[((start[:-1] - start[0])[:, None] + place)[full]]
        return _Block(u, ids, full, _tree(u))


def _size(b: _Block) -> int:
    return b.u.nbytes + b.ids.nbytes + b.full.nbytes + b.tree[1].nbytes + sum(x.nbytes + 100 for x in b.tree[0])


def _reach(cells: Cells, u: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Which cells may hold a vector at least as similar as ``kth``: (candidates, cells)."""
    out = np.zeros((len(u), len(cells.cell)), bool)
    out[_reached(cells, _nearest(u, cells.pivots)[0], u, kth)] = True
    return out


#: Candidates of one pivot whose reach is bounded together.
_TOGETHER = 256


def _reached(cells: Cells, home: np.ndarray, u: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, place in ``cells.cell``) for the cells that may hold a vector at least as similar as ``kth``.

    ``home`` is a pivot near each candidate.  Candidates of one pivot, those that reach as far side by side, first rule out
    together the pivots whose outermost ring ends too far from theirs; only the others are looked at one by one."""
    pivot = cells.cell // MOST_RINGS
    top = np.full(len(cells.pivots), -np.inf)
    np.maximum.at(top, pivot, cells.high)
    own = (u * cells.pivots[home]).sum(axis=1)
    radius = np.arccos(np.clip(kth, -1.0, 1.0)) + SLACK
    span = np.arccos(np.clip(own, -1.0, 1.0)) + radius
    order = np.lexsort((span, home))
    starts = np.flatnonzero(np.r_[True, home[order][1:] != home[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(starts, np.r_[starts[1:], len(order)]):
        h = home[order[lo]]
        dots = np.clip(cells.pivots @ cells.pivots[h], -1.0, 1.0)
        gap = np.arccos(dots) - top - SLACK
        for at in range(lo, hi, _TOGETHER):
            some = order[at: min(at + _TOGETHER, hi)]
            near = np.flatnonzero(gap <= span[some].max())
            # distance of the plane halfway to a pivot: the vectors of its cells lie beyond (of all but equal pivots none is ruled out)
            apart = 2.0 - 2.0 * dots[near]
            far = np.sqrt(np.maximum(2.0 - 2.0 * kth[some], 0.0)) + SLACK
            to = u[some] @ cells.pivots[near].T
            row, col = np.nonzero((apart < 1e-8) | (own[some][:, None] - to <= far[:, None] * np.sqrt(np.maximum(apart, 1e-8))))
            angle = np.arccos(np.clip(to[row, col], -1.0, 1.0))
            # the cells of a pivot stand side by side
            first = np.searchsorted(cells.cell, near[col] * MOST_RINGS)
            count = np.searchsorted(cells.cell, (near[col] + 1) * MOST_RINGS) - first
            pair = np.repeat(np.arange(len(row)), count)
            cell = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + first[pair]
            outside = np.maximum(angle[pair] - cells.high[cell], cells.low[cell] - angle[pair])
            reach = outside <= radius[some][row[pair]]
            rows.append(some[row[pair[reach]]])
            places.append(cell[reach])
    return np.concatenate(rows), np.concatenate(places)


#: Stands for the id of a row without one, before all others.
_NULL = np.iinfo(np.int64).min


def _answers(index: VectorIndex, reader: _Reader, cell: np.ndarray, u: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(candidate, rank, id, similarity) of the ``k`` best rows for each candidate (``cell``: the one it falls into, -1 without
    direction), and how many pairs of candidates and vectors its cells hold."""
    cells = index.cells
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # candidate, similarity, id
    kth, compared = np.full(len(cell), -1.0), 0
    size = dict(zip(cells.cell.tolist(), cells.rows.tolist()))

    def meet(c: int, of: np.ndarray, more: bool) -> None:
        for block in reader.blocks(c):
            who, which, sims = nearest_in_block(u[of], kth[of], block.u, k, block.tree)
            full = block.full[which]
            found.append((np.repeat(of[who], full.sum(axis=1)), np.repeat(sims, full.sum(axis=1)), block.ids[which][full]))
            if more:  # a candidate's first k of a block are its best of it
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
                enough = np.diff(np.r_[first, len(who)]) >= k
                at = of[who[first[enough]]]
                kth[at] = np.maximum(kth[at], sims[first[enough] + k - 1])

    for c, of in _groups(cell):
        if c >= 0:
            meet(c, of, True)
            compared += size[c] * len(of)
    real = np.flatnonzero(cell >= 0)
    strip = max(1, (1 << 23) // max(1, len(cells.cell)))
    for lo in range(0, len(real), strip):
        at = real[lo: lo + strip]
        row, place = _reached(cells, cell[at] // MOST_RINGS, u[at], kth[at])
        other = cells.cell[place] != cell[at[row]]  # its own is met already
        for c, pairs in _groups(cells.cell[place[other]]):
            of = at[row[other][pairs]]
            meet(c, of, False)
            compared += size[c] * len(of)
    for rids, who in ((index.zeros[:k], real), (index.smallest[:k], np.flatnonzero(cell < 0))):
        found += [(who, np.zeros(len(who)), np.full(len(who), _NULL if r is None else r, np.int64)) for r in rids]
    if not found:
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0), compared
    who, sims, rid = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((rid, -sims, who))
    who, sims, rid = who[order], sims[order], rid[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) + 1
    best = rank <= k
    return who[best], rank[best], rid[best], sims[best], compared


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every value, ascending, with its places."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for of in np.split(order, cuts) if len(order) else ():
        yield int(values[of[0]]), of


def search(index: VectorIndex, candidate: DataFrame, id_col: str, vec_col: str, k: int = 1, *, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict]:
    """(id, rank, rid, similarity) of the ``k`` most similar rows for each candidate row, ties by id; and the work done.

    A zero (or null) candidate has similarity 0 with every row, as a zero reference row has with
    every candidate.  Every candidate row is answered, repeated ones each; an empty index gives no
    rows.  The answers stand in the shared folder.  The second value counts ``candidates``, ``rows`` and ``compared`` pairs of candidates and distinct vectors.
    """
    if k > index.keep:
        raise ValueError(f"the index was built for at most {index.keep} neighbours")
    spark = candidate.sparkSession
    path = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    cells = index.cells
    many = len(cells.cell)

    ring_ends = _ring_table(cells.inner, len(cells.pivots))

    def homes(u: np.ndarray, none: np.ndarray) -> np.ndarray:
        cell = np.full(len(u), -1, np.int64)
        at = np.flatnonzero(~none) if many else np.zeros(0, np.int64)
        for lo in range(0, len(at), _STRIP):
            own = cells_of(*_nearest(u[at[lo: lo + _STRIP]], cells.pivots), ring_ends)
            # a pivot's ring may be empty: the nearest that is not
            cell[at[lo: lo + _STRIP]] = cells.cell[np.minimum(np.searchsorted(cells.cell, own), many - 1)]
        return cell

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cell, n = np.unique(homes(*unit_rows(b.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    # where the candidates of a cell go: slots in the order of the cells, by how many a sample has there
    units = _units(candidate, id_col, vec_col)
    n_candidates = candidate.count()
    some = _sample(units, n_candidates)[0].select("v").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row a cell
    weight = np.ones(many + 1)
    for r in some:
        weight[np.searchsorted(cells.cell, r["cell"]) + 1 if r["cell"] >= 0 else 0] += r["n"]
    upto = np.cumsum(weight) / weight.sum()
    slots = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_candidates / TASK_ROWS)))
    # the slot's number is one that Spark's hash deals to a task of its own
    dealt = {r["task"]: r["id"] for r in spark.range(32 * slots).groupBy(F.pmod(F.hash("id"), F.lit(slots)).alias("task")).agg(F.min("id").alias("id")).collect()}
    number = np.array([dealt.get(k, k) for k in range(slots)], np.int64)

    def home(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            u, none = unit_rows(b.column(1))
            cell = homes(u, none)
            place = np.where(cell < 0, 0, np.searchsorted(cells.cell, cell) + 1)
            apart = _mixed(np.column_stack([u, b.column(0).fill_null(0).to_numpy().astype(np.float64)])) / 2.0 ** 64
            slot = number[np.clip(((upto[place] - apart * (weight / weight.sum())[place]) * slots).astype(np.int64), 0, slots - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(cell), b.column(0), _lists(u)], names=["slot", "cell", "id", "u"])

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index.path, block_rows, k)
        for t in _held(it, TOGETHER):
            who, rank, rid, sims, compared = _answers(index, reader, _column(t, "cell").to_numpy(), _matrix(_column(t, "u")), k)
            work = np.zeros(len(who), np.int64)
            work[:1] = compared
            yield pa.RecordBatch.from_arrays([_column(t, "id").take(pa.array(who)), pa.array(rank), pa.array(rid, mask=rid == _NULL), pa.array(sims), pa.array(work)], names=["id", "rank", "rid", "similarity", "work"])

    sent = units.mapInArrow(home, "slot bigint, cell bigint, id bigint, u array<double>").repartition(slots, "slot")
    found = _written(sent.select("cell", "id", "u").sortWithinPartitions("cell").mapInArrow(answer, "id bigint, rank bigint, rid bigint, similarity double, work bigint"), path)
    release(spark)
    compared = found.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]
    return found.drop("work"), {"candidates": n_candidates, "rows": index.n_rows, "vectors": int(cells.rows.sum()), "compared": int(compared)}


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
