"""WARC archives (op1), mixing (op2) and packing (op8)."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fidelis.llm import mixing as M
from fidelis.llm import packing as B
from fidelis.llm import textkit as K
from fidelis.llm import units as U
from fidelis.llm import warc as W
from fidelis.llm.queries import tokenizer_path
from fidelis.session import checkpoint_dir  # noqa: F401


# ------------------------------------------------------------------ WARC

def pages_rows():
    return [(5, "http://a", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, None, None), (4, "u", ""), (7, "http://c\r\nX: y", "é" * 50_000), (8, "d", "x\r\n\r\ny"),
            (3, "http://b", "<p>same</p>"), (11, "u", "<p>same</p>")]


def test_round_trip(spark):
    rows = pages_rows()
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    archives = W.write_archives(pages, W.archive_folder(spark), archive_bytes=2000)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_archives(archives).collect())
    low = {}
    for i, _, h in rows:
        low[h or ""] = min(low.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = low[h or ""]
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert got == want


def test_reader_is_sequential_and_strict():
    one = W.record_bytes("response", "urn:page:1", "http://x", b"payload" * 40_000, None)
    two = W.record_bytes("revisit", "urn:page:2", "http://y", b"payload" * 40_000, "urn:page:1")
    records = list(W.read_records(io.BytesIO(one + two)))
    assert [r.headers["warc-type"] for r in records] == ["response", "revisit"]
    assert records[0].payload == b"payload" * 40_000 and records[1].payload == b"" and records[1].offset == len(one)
    with pytest.raises(ValueError, match="truncated"):
        list(W.read_records(io.BytesIO(one + two[:-9])))
    raw = gzip.decompress(one)
    with pytest.raises(ValueError, match="digest"):
        list(W.read_records(io.BytesIO(gzip.compress(raw.replace(b"payloadpayload", b"payloadPayload", 1)))))
    with pytest.raises(ValueError, match="Content-Length"):
        list(W.read_records(io.BytesIO(gzip.compress(raw[:-3]))))
    with pytest.raises(ValueError, match="damaged"):
        list(W.read_records(io.BytesIO(b"\x1f\x8b\x08\x00" + b"\xff" * 40)))
    assert list(W.read_records(io.BytesIO(b""))) == []


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(pages, W.archive_folder(spark))).count() == 0


# ------------------------------------------------------------------ mixing

def test_schedule_deviates_by_less_than_a_block(spark):
    shares = {"a": 1, "b": 7, "c": 13, "d": 29, "e": 2}
    slots = M.period_schedule(spark.createDataFrame(list(shares.items()), "__source string, __share long")).orderBy("__slot").collect()
    period = sum(shares.values())
    assert [r["__slot"] for r in slots] == list(range(period))
    given = Counter()
    for t, r in enumerate(slots, 1):
        s, j = r["__source"], r["__turn"]
        assert j == given[s] and j * period // shares[s] <= t - 1 and t <= -(-(j + 1) * period // shares[s])
        given[s] += 1
        assert all(abs(given[x] - t * k / period) < 1 for x, k in shares.items())


def test_every_document_has_a_place(docs, rows, empty):
    got = M.mix_sources(docs, block_chars=500).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append((r.chars_before, r.block))
    assert set(by) == {"a", "b", "", "hot"}
    assert all(b == c // 500 for v in by.values() for c, b in v)
    assert len({(r.source, r.chars_before) for r in got if r.source == "a"}) > 3
    assert M.mix_sources(empty).count() == 0


def test_given_shares(spark, docs):
    shares = spark.createDataFrame([("a", 3), ("hot", 5)], "__source string, __share int")
    got = M.mix_sources(docs, shares, block_chars=100).collect()
    assert len(got) == docs.count() and all(r.release <= r.slot < r.deadline for r in got)


# ------------------------------------------------------------------ packing

def plain_ids(texts):
    """Ids of each text by the tokenizer's own call."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_unit_pool_equals_the_tokenizer_for_random_texts(monkeypatch):
    """Contractions, white space of all kinds, marks and special strings, whatever stands beside them in the batch."""
    monkeypatch.setattr(U, "MOST_UNITS", 300)
    parts = ["a", "b", "the", "'s", "'t", "'re", "'S", "don't", " ", " ", " ", "\n", "\n\n", "\t", "\x01", "é", "\u0303", "日本", "1", "23", "!", "..", "%%", "'", "\xa0", "\u3000",
             "<|endoftext|>", "'ll", "  ", "\U0001F600", "ß", "\r\n", "\x85", "²", "½", "ª", "ǅ", "ʰ"]
    rng = random.Random(11)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(12_000)]
    texts += ["'s fine", "a 's fine", "x" * 3000 + " y", "", " ".join(f"w{i}, v{i}!" for i in range(2000))]
    want = plain_ids(texts)
    pool = U.UnitPool(U.ByteUnits(tokenizer_path(), special_as_text=False))
    assert pool.encoder.mark is not None
    for _ in range(2):
        order = list(range(len(texts)))
        rng.shuffle(order)
        for lo in range(0, len(order), 500):
            part = order[lo: lo + 500]
            ids, off = pool.encode(pa.array([texts[k] for k in part], pa.large_string()))
            assert [ids[i:j].tolist() for i, j in zip(off, off[1:])] == [want[k] for k in part]
        pool.encoder.mark = None


def cut(n, capacity):
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def test_pieces_of_token_counts():
    sizes = np.array([5, 2048, 4097, 1, 4096])
    row, piece, start, length = B.pieces_of(sizes, 2048)
    for k, n in enumerate(sizes.tolist()):
        assert list(zip(start[row == k].tolist(), length[row == k].tolist())) == cut(n, 2048) and piece[row == k].tolist() == list(range((row == k).sum()))


def test_local_search_only_improves():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 90, 400)
    worst = [[i] for i in range(400)]
    got = B.local_search(sizes, worst, 100)
    assert sorted(i for b in got for i in b) == list(range(400))
    assert all(sizes[b].sum() <= 100 for b in got)
    assert len(got) <= 1.03 * len(B.best_fit(sizes, 100))


def test_least_bins_is_a_bound():
    rng = np.random.default_rng(6)
    assert B.least_bins(np.array([6, 6, 6, 4]), 10) == 3 and B.least_bins(np.array([5, 5, 5]), 10) == 2 and B.least_bins(np.zeros(0, int), 10) == 0
    for _ in range(50):
        sizes = rng.integers(1, 11, 8)
        best = min(len(B.best_fit(sizes[rng.permutation(8)], 10)) for _ in range(20))
        assert -(-sizes.sum() // 10) <= B.least_bins(sizes, 10) <= best


def test_local_search_goes_on_where_best_fit_is_poor():
    """Three pieces of 500 to 899 seldom fill a bin best-fit; the search runs until no change helps."""
    sizes = np.random.default_rng(1).integers(500, 900, 4096)
    first = B.best_fit(sizes, 2048)
    got = B.local_search(sizes, first, 2048)
    assert sorted(i for b in got for i in b) == list(range(4096)) and all(sizes[b].sum() <= 2048 for b in got)
    assert B.least_bins(sizes, 2048) <= len(got) < 0.95 * len(first) + 1


def test_exchanges_empty_bins_that_best_fit_leaves():
    # 6+4, 6+4, 5+5 fit three bins of 10; a bad start uses four
    sizes = np.array([6, 4, 6, 4, 5, 5])
    assert len(B.local_search(sizes, [[0], [1, 4], [2], [3, 5]], 10)) == 3


@pytest.mark.parametrize("in_order", [False, True])
def test_pieces_and_places(docs, rows, in_order):
    got = B.pack_documents(docs, tokenizer_path(), in_order=in_order).collect()
    ids = {i: np.array([*x, 0], "<u4") for (i, _), x in zip(rows, plain_ids([t for _, t in rows]))}
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        x = ids[r.doc_id][r.start: r.start + r.length]
        assert len(x) == r.length <= 2048 and r.ids_crc32 == zlib.crc32(x.astype("<u4").tobytes())
        by[r.doc_id].append((r.piece, r.start, r.length))
        seq[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(ids)
    for i, v in by.items():
        assert sorted(set(v)) == [(k, s, n) for k, (s, n) in enumerate(cut(len(ids[i]), 2048))]
    for v in seq.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048
    total = sum(r.length for r in got)
    assert in_order or len(seq) <= total / 2048 * 1.05 + 1


@pytest.mark.parametrize("doc_id", [7, None])
def test_many_equal_rows_are_dealt_to_many_groups(spark, monkeypatch, doc_id):
    monkeypatch.setattr(B, "GROUP", 64)
    same = spark.range(2000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("word " * 400 + "x").alias("text"))
    got = B.pack_documents(same, tokenizer_path()).collect()
    groups = Counter(r.sequence_id >> 20 for r in got)
    assert len(got) == 2000 and len(groups) > 20 and max(groups.values()) < 200


def test_sequences_follow_the_files(spark, tmp_path, monkeypatch):
    """Files of unequal size, whose partitions Spark orders by size: groups and sequences keep the order of the files."""
    rng, sizes, at = np.random.default_rng(4), [3, 400, 1, 90, 700, 20], 0
    order = [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (100_000, 0)]
    for (part, file), n in zip(order, sizes):
        texts = [" ".join(["word"] * int(k)) for k in rng.integers(1, 900, n)]
        table = pa.table({"doc_id": pa.array(range(at, at + n), pa.int64()), "text": texts})
        pq.write_table(table, tmp_path / f"part-{part:05d}-x-c{file:03d}.parquet")
        at += n
    monkeypatch.setattr(B, "GROUP", 64)
    got = B.pack_documents(spark.read.parquet(str(tmp_path)), tokenizer_path(), order=B.file_order()).collect()
    assert sorted(r.doc_id for r in got) == list(range(at))  # one piece each
    assert all(r.sequence_id >> 20 == r.doc_id // 64 for r in got)
    first = {}
    for r in got:
        first[r.sequence_id] = min(r.doc_id, first.get(r.sequence_id, at))
    assert [first[s] for s in sorted(first)] == sorted(first.values())


def test_empty_table(empty):
    assert B.pack_documents(empty, tokenizer_path()).count() == 0


def test_texts_are_handled_in_small_batches():
    """A worker works on few bytes at once whatever an Arrow batch holds; every row is in one batch."""
    col = pa.array(["x" * 9000, None, ""] * 700)
    for most, runs in ((4 << 20, [(lo, len(t), sum(map(len, t.to_pylist()))) for lo, t in U.text_batches(col)]),
                       (1 << 18, [(i, j - i, len(buf)) for i, j, buf, _ in K.slices(col)])):
        assert len(runs) > 1 and max(n for *_, n in runs) <= most
        assert [lo for lo, *_ in runs] == np.cumsum([0, *[n for _, n, _ in runs[:-1]]]).tolist() and sum(n for _, n, _ in runs) == len(col)
