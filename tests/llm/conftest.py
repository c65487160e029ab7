import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Ids with null, empty, blank, very long, repeated, near-equal and passage-sharing texts."""
    rng = random.Random(7)
    rows = [(-3, None), (-2, ""), (-1, " \n\t \n"), (0, "one two three"), (1, "one two three"), (2, "ONE two three")]
    base = sentence(rng, 120).split()
    passage = sentence(rng, 70)
    rows += [(10 + k, " ".join(base)) for k in range(5)]
    for k in range(25):  # near copies with one to five changed words
        w = list(base)
        for _ in range(1 + k % 5):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(w)))
    for k in range(12):
        rows.append((200 + k, f"{sentence(rng, 30 + k)}\n{passage}\n{sentence(rng, 40)}\nlicense line\nsecond license line\nthird line"))
    rows += [(300 + k, "\n".join(sentence(rng, rng.randrange(1, 12)) for _ in range(20))) for k in range(10)]
    rows += [(400, "ab " * 30_000), (401, sentence(rng, 20_000)), (402, "é ü x\x0b\x0cß\x1f")]
    rows += [(500, rows[40][1]), (500, rows[40][1])]  # a repeated row
    # a Thue-Morse string and its complement: equal under any polynomial hash modulo a power of two
    one = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows += [(600, " ".join([one] * 5)), (601, " ".join([other] * 5)), (602, f"{one}\n{other}\nend " + sentence(rng, 60))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with the columns of ``documents`` and others whose names operators use too."""
    data = [(i, t, "en", ["a", "b", None][k % 3] if k % 4 else "hot", None if t is None else len(t), "x", 1, True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, token string, start int, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
