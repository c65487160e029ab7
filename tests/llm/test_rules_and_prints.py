"""Repetition rules (op4) and fingerprints (op3) against plain Python."""

import hashlib
import random
import re
from collections import Counter

from fidelis.llm import fingerprints as P
from fidelis.llm import repetition as R

WORD = re.compile("[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def share(text, n):
    w = WORD.findall(text or "")
    g = [tuple(w[i: i + n]) for i in range(len(w) - n + 1)]
    c = Counter(g)
    cover = {j for i, x in enumerate(g) if c[x] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in cover) / max(sum(map(len, w)), 1)


def test_counts_and_shares_equal_brute_force(docs, rows):
    got = R.repetition_rules(docs).collect()
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *[r[k] for k in key]) for r in got) == Counter((i, *base_counts(t)) for i, t in rows)
    text = dict(rows)
    for r in got:
        for n in R.COVERAGE:
            assert abs(r[f"dup_{n}gram_share"] - share(text[r.doc_id], n)) < 1e-9
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert any(r.kept for r in got) and any(r.base_failed for r in got)


def test_repeated_lines_fail_without_failing_the_base(spark):
    rng = random.Random(1)
    line = " ".join(f"a{rng.randrange(10**6)}" for _ in range(20))
    text = "\n".join([line] * 2 + [" ".join(f"b{rng.randrange(10**6)}" for _ in range(20)) for _ in range(2)])
    r = R.repetition_rules(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert not r.base_failed and not r.kept and abs(r.dup_10gram_share - 0.5) < 0.05


def test_empty_tables(empty):
    assert R.repetition_rules(empty).count() == 0
    assert P.fingerprint_neighbours(empty).count() == 0


def test_spans_and_extensions_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        a = "".join(rng.choice("abü😀") for _ in range(rng.randrange(0, 40)))
        b = "".join(rng.choice("abü😀") for _ in range(rng.randrange(0, 40)))
        x, y = P.PrefixHash(a), P.PrefixHash(b)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.lce(i, y, j) == n
        m = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert (x.span(i, i + m) == y.span(j, j + m)) == (a[i: i + m] == b[j: j + m])


def test_neighbours_and_likeness(docs, rows):
    got = P.fingerprint_neighbours(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        m = len(t) // 3
        new = t[: len(t) - m] + order[(k + 1) % len(order)][1][:m]
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    text, prints = dict(rows), {}
    for r in got:
        assert prints.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
    assert len(set(prints.values())) == len(prints)
    long = [r for r in got if 300 <= r.doc_id < 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.3 and max(r.near_next for r in long) < 0.2


def test_null_and_single_ids(spark):
    one = P.fingerprint_neighbours(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = P.fingerprint_neighbours(spark.createDataFrame([(None, "abc"), (3, "xyzxyz"), (None, "abd")], "doc_id long, text string")).collect()
    assert len(rows) == 3
