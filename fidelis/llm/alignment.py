"""Alignment of two tokenizers: groups of tokens with common byte ends, and how often ids end together.

An array maps each id of vocabulary A to the id of B with the same bytes.  A group of one token
a side whose ids are such a pair takes the fast path: it is counted in vectors as long as the
vocabulary.  Only the links of the other (irregular) groups go through the pair shuffle.  Such a
pair never ends an irregular group, since tokens of equal bytes that end together also begin
together, so the two counts share no pair.

Texts are cut into space-led units (see ``units``): both tokenizers cut before a single space, so
a text's groups are those of its units, and a unit is encoded and aligned once a worker.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.units import _JOINED, ODD_SPACES, ByteUnits, UnitPool, bounds, gather, strings, text_batches
from fidelis.session import checkpoint_dir

#: Units kept in a worker between two batches, new ones aligned at a time, and text bytes handled at once.
MOST_UNITS = 300_000
NEW_UNITS = 50_000
BATCH_BYTES = 6 << 20
#: A pair with this share of all irregular links or more is hot: there are 1 / HOT_SHARE at most.
HOT_SHARE = 1e-4
SPACE_SIGN = "▁"
STORED = ("__row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, ids array<int>, id_counts array<int>, "
          "pairs array<bigint>, pair_counts array<int>")


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else 256 onwards."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both vocabularies as bytes, the identity map from A to B, and encoders of units."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = ByteUnits(a_path, special_as_text=True)
        self.a_pool = UnitPool(self.a, lines=False, most=MOST_UNITS)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code, vocabulary = byte_level_alphabet(), self.a.tok.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.a_bytes[k] = bytes(code[c] for c in piece)
        n = self.b.vocab_size()
        pieces = [self.b.id_to_piece(k) for k in range(n)]
        byte = [self.b.is_byte(k) for k in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if y else p.replace(SPACE_SIGN, " ").encode() for p, y in zip(pieces, byte)]
        self.b_starts = np.array([p.startswith(SPACE_SIGN) and not y for p, y in zip(pieces, byte)])
        #: No piece holds the space sign after another character, so nothing is merged across a single space.
        self.b_cuts = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
        by_bytes: dict[bytes, int] = {}
        for k in sorted((k for k in range(n) if not (self.b.is_control(k) or self.b.is_unknown(k) or self.b.is_unused(k))), key=lambda k: (byte[k], k)):
            by_bytes.setdefault(self.b_bytes[k], k)
        self.same = np.array([by_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(k) for k in range(len(v))] for v in (self.a_bytes, self.b_bytes))

    def of_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, off = self.a_pool.of_units(pa.array(units, pa.large_string()))
        return ids.astype(np.int64), np.diff(off)

    def of_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units without white space of their own at a cut: joined by spaces, cut where a piece begins with one."""
        parts = [np.array(x, np.int64) for x in self.b.encode([" ".join(units[i: i + _JOINED]) for i in range(0, len(units), _JOINED)], num_threads=1)]
        ids = np.concatenate([*parts, np.zeros(0, np.int64)])
        at = np.flatnonzero(self.b_starts[ids])
        return ids, np.diff(np.append(at, len(ids)))

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths by both, each text by a call of its own."""
        a = [x.astype(np.int64) for x in self.a.plain([" " + t for t in texts])]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)] if texts else []
        return (np.concatenate([*a, np.zeros(0, np.int64)]), np.array([len(x) for x in a], np.int64),
                np.concatenate([*b, np.zeros(0, np.int64)]), np.array([len(x) for x in b], np.int64))

    def equal_bytes(self, texts: list[str], a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
        """Which texts both sides give back byte by byte, with the space before them."""
        want = [b" " + t.encode() for t in texts]
        joined = b"".join(want)
        if len(a_off) == len(b_off) and all(b"".join(map(v.__getitem__, ids.tolist())) == joined for v, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            sizes = [np.add.reduceat(np.append(n[ids], 0), off[:-1]) if len(off) > 1 else off[:0] for n, ids, off in ((self.a_len, a, a_off), (self.b_len, b, b_off))]
            if np.array_equal(*sizes):
                return np.ones(len(texts), bool)
        return np.array([b"".join(map(self.a_bytes.__getitem__, a[i:j].tolist())) == w == b"".join(map(self.b_bytes.__getitem__, b[k:m].tolist()))
                         for w, i, j, k, m in zip(want, a_off, a_off[1:], b_off, b_off[1:])], bool)


class Aligned:
    """Texts or units aligned: counts, group strings, the ids of identity groups, the pair codes of the others."""

    def __init__(self, t: Tokenizers, texts: list[str], one_by_one: bool):
        n = len(texts)
        good = np.array([u != "" and SPACE_SIGN not in u for u in texts], bool)  # that sign would come back as a space
        kept = [u for u, g in zip(texts, good) if g]
        if one_by_one or not t.b_cuts:
            a, la, b, lb = t.whole(kept)
        else:
            (a, la), (b, lb) = t.of_a(kept), t.of_b(kept)
        same = t.equal_bytes(kept, a, bounds(la), b, bounds(lb))
        if not same.all():
            keep = np.flatnonzero(same)
            (pa_, la), (pb_, lb) = gather(bounds(la), keep), gather(bounds(lb), keep)
            a, b = a[pa_], b[pb_]
            good[good] = same
        at = np.flatnonzero(good)
        a_ends, b_ends = np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b])
        near = np.searchsorted(b_ends, a_ends)
        ia = np.flatnonzero(b_ends[np.minimum(near, len(b) - 1)] == a_ends) if len(b) else np.zeros(0, np.int64)
        ib = near[ia]
        ea, eb = ia + 1, ib + 1
        sa, sb = np.append(0, ea[:-1]) if len(ea) else ea, np.append(0, eb[:-1]) if len(eb) else eb
        x, y = a[ia], b[ib]  # the tokens that end a group: its one link
        regular = (ea - sa == 1) & (eb - sb == 1) & (t.same[x] == y)
        of = at[np.searchsorted(np.cumsum(la), ia, "right")] if len(ia) else ia
        self.good = good
        self.n_a, self.n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.n_a[at], self.n_b[at] = la, lb
        self.n_groups = np.bincount(of, minlength=n)
        self.ids, self.id_off = x[regular].astype(np.int32), bounds(np.bincount(of[regular], minlength=n))
        self.pairs, self.pair_off = (x * len(t.b_bytes) + y)[~regular], bounds(np.bincount(of[~regular], minlength=n))
        ta, tb = [t.a_text[k] for k in a.tolist()], [t.b_text[k] for k in b.tolist()]
        groups = [f"{ta[i]}|{tb[k]}" if j - i == 1 == m - k else f"{','.join(ta[i:j])}|{','.join(tb[k:m])}"
                  for i, j, k, m in zip(sa.tolist(), ea.tolist(), sb.tolist(), eb.tolist())]
        off = bounds(self.n_groups).tolist()
        self.text = [";".join(groups[i:j]) for i, j in zip(off, off[1:])]


class AlignedPool:
    """Units aligned so far in this worker, ``MOST_UNITS`` and a batch's at most."""

    _NUMBERS = ("good", "n_a", "n_b", "n_groups")

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.all = Aligned(self.tokenizers, [], True)

    def _add(self, new: Aligned) -> None:
        old = self.all
        for c in (*self._NUMBERS, "ids", "pairs"):
            setattr(old, c, np.concatenate([getattr(old, c), getattr(new, c)]))
        for c in ("id_off", "pair_off"):
            o = getattr(old, c)
            setattr(old, c, np.concatenate([o, o[-1] + getattr(new, c)[1:]]))
        old.text += new.text

    def slots(self, units: list[str]) -> np.ndarray:
        if len(self.known) > MOST_UNITS:
            self.clear()
        new = [u for u in units if u not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            for lo in range(0, len(new), NEW_UNITS):
                self._add(Aligned(self.tokenizers, new[lo: lo + NEW_UNITS], False))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def batch(self, texts: pa.Array) -> tuple:
        """Columns of ``STORED`` but the row number, for a batch of texts."""
        odd = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, ODD_SPACES)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~odd)
        lists = pc.split_pattern(texts.take(pa.array(at)), " ")
        units = lists.flatten().dictionary_encode()
        slot = self.slots(strings(units.dictionary))[units.indices.to_numpy()]
        first = np.asarray(lists.offsets).astype(np.int64)
        first -= first[0]
        parts = [(at, self.all, slot, first)]
        if odd.any():  # a stretch each, of texts aligned whole
            k = int(odd.sum())
            parts.append((np.flatnonzero(odd), Aligned(self.tokenizers, strings(texts.filter(pa.array(odd))), True), np.arange(k), np.arange(k + 1)))
        n = len(texts)
        numbers, sha = {c: np.zeros(n, np.int64) for c in self._NUMBERS}, [""] * n
        ids, pairs = [], []
        for rows, x, s, off in parts:
            for c in self._NUMBERS:
                cum = bounds(getattr(x, c)[s])
                numbers[c][rows] = cum[off[1:]] - cum[off[:-1]]
            good = numbers["good"][rows] == np.diff(off)  # every unit came back byte by byte
            for c in self._NUMBERS:
                numbers[c][rows[~good]] = 0
            where, names = s.tolist(), x.text
            for r, g, i, j in zip(rows.tolist(), good.tolist(), off[:-1].tolist(), off[1:].tolist()):
                if g:
                    sha[r] = hashlib.sha256(";".join([names[k] for k in where[i:j]]).encode()).hexdigest()
            row = np.repeat(np.where(good, rows, -1), np.diff(off))
            for out, values, offsets in ((ids, x.ids, x.id_off), (pairs, x.pairs, x.pair_off)):
                pos, lengths = gather(offsets, s)
                key = np.repeat(row, lengths) << 32 | values[pos]
                out.append(key[key >= 0])
        return numbers, sha, counted(np.concatenate(ids), n, pa.int32()), counted(np.concatenate(pairs), n, pa.int64())


def counted(keys: np.ndarray, n: int, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """(distinct values, their counts) as a list for each of ``n`` rows, from keys of row and value."""
    keys, count = np.unique(keys, return_counts=True)
    off = pa.array(bounds(np.bincount(keys >> 32, minlength=n)), pa.int32())
    return (pa.ListArray.from_arrays(off, pa.array(keys & 0xFFFFFFFF, kind)), pa.ListArray.from_arrays(off, pa.array(count, pa.int32())))


_pools: dict[tuple[str, str], AlignedPool] = {}  # kept from task to task in a worker


def pool_of(a_path: str, b_path: str) -> AlignedPool:
    if (a_path, b_path) not in _pools:
        _pools[a_path, b_path] = AlignedPool(Tokenizers(a_path, b_path))
    return _pools[a_path, b_path]


def stored_alignments(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's alignment, encoded once and kept as Parquet in the shared folder (``STORED``).

    ``ids`` with ``id_counts`` are its identity groups by id of A; ``pairs`` (id of A times the size
    of B's vocabulary, plus id of B) with ``pair_counts`` the links of its other groups.
    """
    kind = dict(docs.dtypes)[id_col]
    read = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("__row"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        pool = pool_of(a_path, b_path)
        for b in it:
            for lo, texts in text_batches(b.column(1), BATCH_BYTES):
                numbers, sha, ids, pairs = pool.batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(texts)), b.column(2).slice(lo, len(texts)), *[pa.array(numbers[c]) for c in ("n_a", "n_b", "n_groups")],
                     pa.array(sha, pa.string()), *ids, *pairs],
                    names=[id_col, "__row", "n_a", "n_b", "n_groups", "groups_sha256", "ids", "id_counts", "pairs", "pair_counts"])

    folder = f"{checkpoint_dir(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    read.mapInArrow(batches, f"`{id_col}` {kind}, {STORED}").write.option("compression", "zstd").parquet(f"{folder}/rows")
    return docs.sparkSession.read.parquet(f"{folder}/rows")


def identity_counts(stored: DataFrame, size: int) -> np.ndarray:
    """Identity groups of all rows by id of A: a vector for each task, added up (as long as the vocabulary)."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in it:
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in stored.select("ids", "id_counts").mapInArrow(batches, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def links(stored: DataFrame) -> DataFrame:
    """One row per row and irregular pair: (__row, pair, times)."""
    return stored.select("__row", F.explode(F.arrays_zip("pairs", "pair_counts")).alias("x")).select(
        "__row", F.col("x.pairs").alias("pair"), F.col("x.pair_counts").alias("times"))


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): each row's alignment figures, and how many links hold each pair of ids.

    ``rows``: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of
    their id of B), ``count_sum`` and ``groups_sha256``.  ``pairs``: ``a_id``, ``b_id``, ``n``,
    ``same_bytes``.  A text that is null or empty, or that either tokenizer does not give
    back byte by byte, has zeros and an empty digest and adds no link.  Repeated rows count
    each; an empty table gives no rows.  A very long text is held whole in one task, some
    forty bytes a byte.

    What reaches the driver is as long as a vocabulary.  Irregular pairs are counted by a shuffle
    with partial sums; hot ones (``HOT_SHARE`` of all links, so 1 / ``HOT_SHARE`` at most) are joined by broadcast,
    the others by a shuffle of the pair.
    """
    spark = docs.sparkSession
    t = Tokenizers(a_path, b_path)
    same, width, sizes = t.same, len(t.b_bytes), len(t.a_bytes)
    stored = stored_alignments(docs, a_path, b_path, id_col=id_col, text_col=text_col)
    regular = identity_counts(stored, sizes)
    folder = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    links(stored).groupBy("pair").agg(F.sum("times").alias("n")).write.parquet(f"{folder}/pairs")
    irregular = spark.read.parquet(f"{folder}/pairs")

    best = np.zeros(width, np.int64)
    some = np.flatnonzero(regular)
    np.maximum.at(best, same[some], regular[some])
    for r in irregular.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("n")).collect():  # a row per id of B at most
        best[r["b"]] = max(best[r["b"]], r["n"])
    highest = spark.createDataFrame([(k, n) for k, n in enumerate(best.tolist()) if n], "b bigint, highest bigint")
    of_pair = irregular.join(F.broadcast(highest), F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("is_best"))
    total = irregular.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(1.0, HOT_SHARE * total)

    regular_best = regular == best[same]
    kind = dict(docs.dtypes)[id_col]

    def fast(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, count = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (6, 7))
            off = np.asarray(b.column(6).offsets).astype(np.int64)
            off -= off[0]
            at_best, added = bounds(count * regular_best[ids]), bounds(count * regular[ids])
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(at_best[off[1:]] - at_best[off[:-1]]), pa.array(added[off[1:]] - added[off[:-1]])],
                                             names=[*b.schema.names[:6], "n_best", "count_sum"])

    base = stored.select("__row", id_col, "n_a", "n_b", "n_groups", "groups_sha256", "ids", "id_counts").mapInArrow(
        fast, f"__row bigint, `{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint")

    def sums(joined: DataFrame) -> DataFrame:
        return joined.groupBy("__row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    # for the other pairs, the hot ones are left out before the shuffle
    frequent = F.broadcast(of_pair.where(hot))
    rest = links(stored).join(frequent.select("pair"), "pair", "left_anti").join(of_pair.where(~hot), "pair")
    parts = base.unionByName(sums(links(stored).join(frequent, "pair")), allowMissingColumns=True).unionByName(sums(rest), allowMissingColumns=True)
    rows = parts.groupBy("__row").agg(F.max(id_col).alias(id_col), *[F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups")], F.max("n_groups").alias("n_links"),
                                      F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256")).drop("__row")
    exact = spark.createDataFrame([(int(k), int(same[k]), int(regular[k]), True) for k in some], "a_id bigint, b_id bigint, n bigint, same_bytes boolean")
    pairs = irregular.select(F.expr(f"pair div {width}").alias("a_id"), (F.col("pair") % width).alias("b_id"), "n", F.lit(False).alias("same_bytes")).unionByName(exact)
    return rows, pairs
