"""Line chunks (op6), near duplicates (op7) and substrings (op10) against plain Python."""

import hashlib
import random
import re

import pytest

from fidelis.llm import line_chunks as L
from fidelis.llm import near_dedup as N
from fidelis.llm import substrings as S
from fidelis.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ lines

def chunks_of(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or ((h[i - 1] if i else 0) * L.MULTIPLIER + h[i]) % L.MODULUS % L.EVERY == 0:
            out.append((start, lines[start: i + 1]))
            start = i + 1
    return out


def test_line_chunks_equal_brute_force(docs, rows):
    first = {}
    for i, t in sorted({(i, t or "") for i, t in rows}):
        for s, c in chunks_of(t):
            if len(c) > 1:
                first.setdefault("\n".join(c), (i, s))
    want = {i: "\n".join(x for s, c in chunks_of(t) if len(c) < 2 or first["\n".join(c)] == (i, s) for x in c) for i, t in rows}
    got = L.dedup_lines(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: r.text for r in got} == want
    assert sum(r.n_removed for r in got) > 0
    whole = L.clean_documents(docs)
    assert whole.columns[: len(docs.columns)] == docs.columns and whole.count() == len(rows)


def test_chunks_shift_with_an_insertion():
    rng = random.Random(2)
    lines = [str(rng.random()) for _ in range(200)]
    a = {"\n".join(c) for _, c in chunks_of("\n".join(lines))}
    b = {"\n".join(c) for _, c in chunks_of("\n".join(["new"] + lines))}
    assert len(a - b) <= 2


# ------------------------------------------------------------------ near duplicates

def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent,block", [(85, N.BLOCK_SHINGLES), (80, 700)])
def test_near_duplicates_equal_brute_force(docs, rows, percent, block):
    want = components(rows, percent)
    got = N.near_duplicates(docs, percent=percent, block_shingles=block).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want)


def test_exact_bound_is_linked(spark):
    """17 of 20 shingles in common is exactly 85 %; 16 of 19 is less."""
    a = [f"t{i}" for i in range(24)]  # 20 shingles
    b = a[:21]  # 17 of them
    c = [f"u{i}" for i in range(23)]  # 19 shingles
    d = c[:20]  # 16 of them
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(d))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(df, percent=85).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_null_ids_and_empty_table(spark, empty):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "other words here"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component_id, r.kept) for r in N.near_duplicates(df).where("n_shingles > 0").collect() if r.component_id is not None)
    assert got == [(False, 7, True), (True, 7, False)]
    for f in (N.near_duplicates, L.dedup_lines, S.remove_repeats):
        assert f(empty).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + k: 1000 for k in range(50)}}


# ------------------------------------------------------------------ substrings

def without_repeats(rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    low = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            g = tuple(w[k: k + window])
            low[g] = min(low.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if low[tuple(w[k: k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("group", [S.GROUP, 3])
def test_substrings_equal_brute_force(docs, rows, group):
    small = [(i, t) for i, t in rows if i != 400]
    got = S.remove_repeats(docs.where("doc_id <> 400"), group_suffixes=group).collect()
    assert len(got) == len(small)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == without_repeats(small, 50)
    assert sum(r.n_removed > 0 for r in got) > 20


@pytest.mark.parametrize("group", [S.GROUP, 2])
def test_short_windows_over_few_words(spark, group):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(99, "a " * 300)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8, group_suffixes=group).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == without_repeats(rows, 8)


def test_whole_long_repeat_of_one_word(spark):
    rows = [(1, "ab " * 5000), (2, "ab " * 4000)]
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 4000}
