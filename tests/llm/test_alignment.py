"""Alignment of two tokenizers (op13) against plain Python over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from fidelis.llm import alignment as A
from fidelis.llm.queries import tokenizer_path

PARTS = ["a", "the", "'s", "don't", " ", " ", " ", "\n", "\t", "\x01", "é", "日本", "23", "!", "..", "\xa0", "▁", "<|endoftext|>", "</s>", "<0x41>", "  ", "\U0001F600", "ﬁ", "\x85", "word", "ing", "%%"]


def both():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) and the pair counts, by the statement of the contract."""
    a, b = both()
    code = {}
    for x in range(256):  # the usual byte-level alphabet
        code[chr(x) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174 else chr(256 + sum(not (33 <= y <= 126 or 161 <= y <= 172 or y >= 174) for y in range(x)))] = x
    a_bytes = {k: bytes(code[c] for c in p) for p, k in a.get_vocab().items()}

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    per, counts = [], Counter()
    for t in texts:
        want = b" " + (t or "").encode()
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids
        y = b.encode(t or "")
        xb = [a_bytes[k] for k in x]
        yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not t or b"".join(xb) != want or b"".join(yb) != want:
            per.append(None)
            continue
        ea, eb = ends(xb), ends(yb)
        cuts = sorted(set(ea) & set(eb))
        linked = [(x[i], y[k]) for i, e in enumerate(ea) for k, f in enumerate(eb) if e == f] if len(x) < 300 else [(x[ea.index(e)], y[eb.index(e)]) for e in cuts]
        counts.update(linked)
        groups, lo = [], 0
        for c in cuts:
            groups.append(",".join(str(k) for k, e in zip(x, ea) if lo < e <= c) + "|" + ",".join(str(k) for k, e in zip(y, eb) if lo < e <= c))
            lo = c
        per.append((len(x), len(y), len(cuts), linked, ";".join(groups)))
    highest = defaultdict(int)
    for (_, k), n in counts.items():
        highest[k] = max(highest[k], n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, ng, linked, text = p
            out.append((na, nb, ng, len(linked), sum(counts[k] == highest[k[1]] for k in linked), sum(counts[k] for k in linked), hashlib.sha256(text.encode()).hexdigest()))
    return out, counts


@pytest.mark.parametrize("most", [40, 100_000])
def test_alignment_equals_brute_force(spark, monkeypatch, most):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 16)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, " "), (903, "the word " * 20), (903, "the word " * 20), (None, "a word"), (None, None), (904, "x" * 4000), (905, "The\n\nlong  word's ending."),
             (906, " ".join(rng.choice(["thering", "onwhtion", "the", "a.", "Of,"]) for _ in range(2000)))]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_a int, pairs string, __row int").repartition(3)
    monkeypatch.setattr(A, "MOST_UNITS", most)
    monkeypatch.setattr(A, "HOT_SHARE", 0.05)
    A._pools.clear()
    got, pairs = A.align(docs.drop("__row"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    want, counts = brute([t for _, t in rows])
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, *[r[c] for c in cols]) for r in got.collect()], key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=key)
    found = pairs.collect()
    assert {(r.a_id, r.b_id): r.n for r in found} == dict(counts) and len(found) == len(counts)
    a = A.pool_of(tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).tokenizers
    assert all(r.same_bytes == (a.a_bytes[r.a_id] == a.b_bytes[r.b_id] and a.same[r.a_id] == r.b_id) for r in found)
    assert any(r.same_bytes for r in found) and any(not r.same_bytes for r in found)


def test_units_give_the_groups_of_whole_texts():
    """A batch cut into units equals each text aligned whole, whatever stands beside it."""
    import pyarrow as pa
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    t = A.Tokenizers(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    whole = A.Aligned(t, texts, True)
    pool = A.AlignedPool(t)
    for lo in range(0, 3000, 250):
        numbers, sha, (ids, times), (pairs, pair_times) = pool.batch(pa.array(texts[lo: lo + 250], pa.large_string()))
        for k in range(250):
            j = lo + k
            assert [numbers[c][k] for c in ("n_a", "n_b", "n_groups")] == [whole.n_a[j], whole.n_b[j], whole.n_groups[j]]
            assert sha[k] == (hashlib.sha256(whole.text[j].encode()).hexdigest() if whole.good[j] else "")
            assert dict(zip(ids[k].as_py(), times[k].as_py())) == Counter(whole.ids[whole.id_off[j]: whole.id_off[j + 1]].tolist())
            assert dict(zip(pairs[k].as_py(), pair_times[k].as_py())) == Counter(whole.pairs[whole.pair_off[j]: whole.pair_off[j + 1]].tolist())


def test_empty_table(empty):
    rows, pairs = A.align(empty, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    assert rows.count() == 0 and pairs.count() == 0
