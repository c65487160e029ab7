"""MinHash near-dedup by a signature-coordinate inverted join, confirmed on full sets.

Each distinct shingle set gets ``COORDS`` MinHash coordinates.  A set is posted under its
(coordinate, value) pairs.  Sets that agree in at least ``match_threshold`` coordinates (chosen so
that a pair at the similarity bound is missed with probability below ``MISS``) are candidates:

* prefix: of a set's pairs, ordered by how many sets hold them, the ``COORDS - threshold + 1``
  rarest must contain one that a candidate partner posts too, so only these are joined, and
  a pair that no other set holds is skipped;
* counting: sets connected by prefix postings form neighbourhoods, cut into blocks of bounded
  size; a task gets two blocks, counts equal coordinates of the sets in them, skips sets that
  are already linked, and confirms the rest on the full shingle sets.

Only links that join two parts leave a task, never all pairs of a neighbourhood.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm import textkit as K
from fidelis.llm.components import connected_components
from fidelis.session import cut_lineage

COORDS = 64
MISS = 1e-6
SHINGLE = 5
#: Expected shingles in a block of a neighbourhood (8 bytes each in a task).
BLOCK_SHINGLES = 100_000
_SALT = K.mix(np.arange(1, COORDS + 1, dtype=K.U64) * K.U64(0xD1342543DE82EF95))
_FACTOR = K.mix(_SALT) | K.U64(1)


def match_threshold(percent: int, coords: int = COORDS, miss: float = MISS) -> int:
    """Most equal coordinates that may be asked for: P(fewer | similarity = percent) <= miss."""
    p, below, t = percent / 100, 0.0, 0
    while t < coords:
        below += comb(coords, t) * p**t * (1 - p) ** (coords - t)
        if below > miss:
            break
        t += 1
    return max(t, 1)


# ------------------------------------------------------------------ sets and signatures

def shingle_sets(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles (fewer words than five: one, of all)."""
    buf = K.LOWER[buf]
    starts, ends, first = K.tokens(buf, off)
    words = K.word_hashes(buf, starts, ends)
    h, doc = K.grams(words, first, SHINGLE)
    at = np.searchsorted(doc, np.arange(len(off)))
    few = K.spans(words, first[:-1], first[1:]) if len(words) else np.zeros(len(off) - 1, K.U64)
    n = np.diff(first)
    return [np.unique(h[at[k]: at[k + 1]]) if n[k] >= SHINGLE else few[k: k + 1][: n[k]] for k in range(len(off) - 1)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash coordinates (32 bits each) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), COORDS), np.uint32)
    for c in range(COORDS):
        out[:, c] = (np.minimum.reduceat((flat ^ _SALT[c]) * _FACTOR[c], at) >> K.U64(32)).astype(np.uint32)
    return out


def signed_documents(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """__id, n_shingles, __set (digest of the set) and __sig (its coordinates) of every row."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j, buf, off in K.slices(b.column(1)):
                sets = shingle_sets(buf, off)
                full = [k for k, s in enumerate(sets) if len(s)]
                digest, sig = [None] * len(sets), [None] * len(sets)
                for k, s in zip(full, signatures([sets[k] for k in full]) if full else ()):
                    digest[k], sig[k] = hashlib.md5(sets[k].tobytes()).digest(), s.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                                                 names=["__id", "n_shingles", "__set", "__sig"])

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(batches, "__id bigint, n_shingles bigint, __set binary, __sig binary")


# ------------------------------------------------------------------ prefix postings

def _tokens(reps: DataFrame) -> DataFrame:
    """One row per (coordinate, value) of each set, as one 64-bit token."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = (np.arange(COORDS, dtype=K.U64) << K.U64(32))[None, :]
        for b in it:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
            ids = np.repeat(b.column(0).to_numpy(), COORDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((lane | sig).ravel().view(np.int64))], names=["rep", "token"])

    return reps.select("rep", "sig").mapInArrow(batches, "rep bigint, token bigint")


def prefix_postings(reps: DataFrame, threshold: int) -> DataFrame:
    """(rep, token) for tokens in the set's prefix that at least two prefixes hold."""
    tokens = _tokens(reps)
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("token", "t")
    shared = tokens.join(held, F.col("token") == F.col("t")).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
    # tokens of no other set come first in the order: they use up the prefix but need no posting
    room = F.lit(1 - threshold) + F.size("own")  # COORDS - threshold + 1 less (COORDS - size)
    prefix = shared.where(room > 0).select("rep", F.explode(F.slice("own", F.lit(1), room)).alias("x")).select("rep", F.col("x.token").alias("token"))
    prefix = cut_lineage(prefix)
    twice = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low")).where("n > 1").select(F.col("token").alias("t"), "low")
    return prefix.join(twice, F.col("token") == F.col("t")).select("rep", "token", "low")


# ------------------------------------------------------------------ blocks

def _links(sets: list[np.ndarray], sig: np.ndarray, ids: np.ndarray, left: np.ndarray, percent: int, threshold: int) -> list[tuple[int, int]]:
    """Confirmed links joining parts of a block pair (rows with ``left`` True against the others, or all if all are).

    Rows are already-linked when they share a label; a row's collisions are counted against all
    rows with other labels at once, and candidates are confirmed by exact intersections.
    """
    m = len(ids)
    label = np.arange(m)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    both = bool(left.all())
    out = []
    for x in range(m):
        if not both and not left[x]:
            continue
        others = np.flatnonzero((label != label[x]) & ((np.arange(m) > x) if both else ~left))
        others = others[(100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x]))]
        if not len(others):
            continue
        others = others[(sig[others] == sig[x]).sum(1) >= threshold]
        if not len(others):
            continue
        low, high = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        if len(others) > 4:
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            inter = np.bincount(owner[at], minlength=m)[others]
        else:
            inter = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in others])
        near = others[100 * inter >= percent * (size[x] + size[others] - inter)]
        for y in near:
            if label[y] != label[x]:
                out.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
    return out


def _link_stream(percent: int, threshold: int):
    """mapInArrow over rows sorted by (hood, a, b): each run of equal keys is a block pair."""
    def flush(rows):
        ids = np.array([r[0] for r in rows], np.int64)
        return _links([np.frombuffer(r[1], K.U64) for r in rows], np.stack([np.frombuffer(r[2], np.uint32) for r in rows]), ids,
                      np.array([r[3] for r in rows], bool), percent, threshold)

    def batch(links):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["u", "v"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, links = None, [], []
        for b in it:
            for hood, x, y, i, s, g, left in zip(*[c.to_pylist() for c in b.columns]):
                if (hood, x, y) != key:
                    if len(rows) > 1:
                        links += flush(rows)
                    key, rows = (hood, x, y), []
                    if len(links) > 4096:
                        yield batch(links)
                        links = []
                rows.append((i, s, g, left))
        if len(rows) > 1:
            links += flush(rows)
        if links:
            yield batch(links)
    return run


def _with_sets(docs: DataFrame) -> DataFrame:
    """Replace __text by __shingles (the bytes of the sorted set), keeping the other columns."""
    names = docs.columns
    at = names.index("__text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j, buf, off in K.slices(b.column(at)):
                part = b.slice(i, j - i)
                cols = [part.column(k) if k != at else pa.array([s.tobytes() for s in shingle_sets(buf, off)], pa.binary()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=["__shingles" if n == "__text" else n for n in names])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(batches, ", ".join("__shingles binary" if n == "__text" else f"`{n}` {kinds[n]}" for n in names))


def near_duplicates(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id linked to it), kept.

    Documents are linked when 100 x intersection >= ``percent`` x union of their sets of
    five-word shingles.  Equal sets are one node from the start.  Null and wordless texts have
    empty sets and are linked with nothing.  Rows that share an id are one node; a null id
    gets a null component of its own unless an equal set has an id, and is kept only then
    if it has none.  An empty table gives no rows; other columns are not read.
    """
    threshold = match_threshold(percent)
    signed = cut_lineage(signed_documents(docs, id_col=id_col, text_col=text_col))
    sets = (signed.where("n_shingles > 0 and __id is not null").groupBy("__set")
            .agg(F.min("__id").alias("rep"), F.first("n_shingles").alias("n"), F.first("__sig").alias("sig")))
    sets = cut_lineage(sets)
    posted = cut_lineage(prefix_postings(sets, threshold))
    hoods = connected_components(posted.select(F.col("rep").alias("u"), F.col("low").alias("v")))

    # blocks: a hood of s shingles has ceil(s / block) blocks; a row goes to each pair with its block
    member = hoods.join(sets.select("rep", "n", "sig"), F.col("node") == F.col("rep")).select("rep", "n", "sig", F.col("component").alias("hood"))
    blocks = member.groupBy("hood").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int").alias("k")).withColumnRenamed("hood", "h")
    member = member.join(blocks, F.col("hood") == F.col("h")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")).drop("h")
    text = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"))
    full = _with_sets(member.join(text, F.col("rep") == F.col("__id")).select("rep", "sig", "hood", "k", "b", "__text"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("b", o).alias("x"), F.greatest("b", o).alias("y"), ((F.col("b") <= o)).alias("left")))
    dealt = full.withColumn("p", F.explode(pairs)).select("hood", "p.x", "p.y", "rep", "__shingles", "sig", "p.left")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(parts, "hood", "x", "y").sortWithinPartitions("hood", "x", "y", "rep").mapInArrow(_link_stream(percent, threshold), "u bigint, v bigint")
    found = connected_components(links)

    label = sets.select(F.col("__set").alias("s"), "rep").join(found, F.col("rep") == F.col("node"), "left").select("s", F.coalesce("component", "rep").alias("c"))
    out = signed.select("__id", "n_shingles", "__set").join(label, F.col("__set") == F.col("s"), "left")
    component = F.coalesce("c", "__id")
    return out.select(F.col("__id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION SELECT doc_id, w FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d, v FROM reach JOIN both_ways ON u = r),
low AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents JOIN low ON d = doc_id LEFT JOIN n USING (doc_id)
"""
