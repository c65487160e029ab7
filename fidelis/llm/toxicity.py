"""Toxicity: a classifier chain of linear models over hashed words.

Categories are predicted in a fixed order.  The model of a category sees the words of the
text and the log-odds that the models before it gave.  In training those log-odds are
out-of-fold predictions, so that a later model does not learn to trust an earlier one more
than new documents justify.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm import textkit as K
from fidelis.llm.sample import class_sizes, labelled_sample

BITS = 18


@dataclass(frozen=True)
class Link:
    """One category's model: word weights, weights of the earlier categories, intercept."""

    name: str
    words: np.ndarray
    earlier: np.ndarray
    intercept: float


def word_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed word) of the distinct case-folded words of each text."""
    buf = K.FOLD[buf]
    starts, ends, first = K.tokens(buf, off)
    slot = (K.word_hashes(buf, starts, ends) >> K.U64(64 - BITS)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    pairs = np.unique((doc << BITS) | slot)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _chosen(doc, slot, y, w, most: int) -> np.ndarray:
    """Which (text, word) pairs have one of the ``most`` words that tell the category best."""
    size = 1 << BITS
    with_word = np.bincount(slot, w[doc], minlength=size)
    hits = np.bincount(slot, (w * y)[doc], minlength=size)
    rate = np.average(y, weights=w)
    gain = (hits - rate * with_word) ** 2 / np.maximum(with_word, 1e-12)
    best = np.zeros(size, bool)
    best[np.argsort(gain)[-most:]] = True
    return best[slot]


def _train(doc, slot, n_docs, extra, y, w, *, share=0.25, steps=60, memory=8):
    """Logistic regression on word presence and earlier log-odds by limited-memory BFGS."""
    at = _chosen(doc, slot, y, w, max(64, int(share * (w > 0).sum())))
    doc, slot = doc[at], slot[at]
    used, col = np.unique(slot, return_inverse=True)
    k, m = len(used), extra.shape[1]
    ridge = 0.05 / max((w > 0).sum(), 1)
    w = w / w.sum()
    prior = np.clip(w @ y, 1e-4, 1 - 1e-4)

    def loss_grad(v):
        z = np.bincount(doc, v[:k][col], minlength=n_docs) + extra @ v[k: k + m] + v[-1]
        e = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.concatenate([np.bincount(col, e[doc], minlength=k), extra.T @ e, [e.sum()]])
        g[:-1] += ridge * v[:-1]
        return w @ (np.logaddexp(0, z) - y * z) + ridge / 2 * v[:-1] @ v[:-1], g

    v = np.zeros(k + m + 1)
    v[-1] = np.log(prior / (1 - prior))
    f, g = loss_grad(v)
    pairs = []
    for _ in range(steps):
        q, back = g.copy(), []
        for s, d in reversed(pairs):
            a = s @ q / (s @ d)
            q -= a * d
            back.append(a)
        if pairs:
            s, d = pairs[-1]
            q *= s @ d / (d @ d)
        for (s, d), a in zip(pairs, reversed(back)):
            q += (a - d @ q / (s @ d)) * s
        t = 1.0 if pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while True:
            nv = v - t * q
            nf, ng = loss_grad(nv)
            if nf <= f - 1e-4 * t * (g @ q) or t < 1e-8:
                break
            t /= 2
        if t < 1e-8 or f - nf < 1e-7 * max(f, 1e-3):
            break
        if (nv - v) @ (ng - g) > 1e-14:
            pairs = [*pairs, (nv - v, ng - g)][-memory:]
        v, f, g = nv, nf, ng
    beta = np.zeros(1 << BITS)
    beta[used] = v[:k]
    return beta, v[k: k + m], float(v[-1])


def _margin(doc, slot, n_docs, model, extra):
    beta, more, bias = model
    return np.clip(np.bincount(doc, beta[slot], minlength=n_docs) + extra @ more + bias, -20, 20)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, per_class: int = 2000, folds: int = 3) -> list[Link]:
    """Fit the chain on at most ``per_class`` labelled documents of each category and of none.

    ``categories`` maps each name, in chain order, to a condition over ``labels``.  Rows are
    weighted to the categories' shares among all labels.  A category without positive (or
    without negative) rows gets its share as a constant.  Words in fewer than three sampled
    documents carry no weight.
    """
    anything = F.lit(False)
    for c in categories.values():
        anything = anything | F.coalesce(c, F.lit(False))
    classes = {"(none)": ~anything, **categories}
    share = class_sizes(labels.withColumn("__all", F.lit(1)), {**classes, "(all)": F.col("__all") == 1})
    rows = labelled_sample(docs, labels, classes, per_class)
    n = len(rows)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, _, buf, off in K.slices(pa.array([t for _, t, _ in rows], pa.large_string())):
        doc, slot = word_sets(buf, off)
        parts.append((doc + i, slot))
    doc, slot = (np.concatenate(c) for c in zip(*parts))
    keep = np.bincount(slot, minlength=1 << BITS)[slot] >= 3
    doc, slot = doc[keep], slot[keep]
    fold = np.arange(n) % folds  # rows come in order of a hash-independent id; copies may fall in different folds
    extra, links = np.zeros((n, 0)), []
    for name in categories:
        y = np.array([name in c for _, _, c in rows], float)
        whole = share[name] / max(share["(all)"], 1)
        if n < 2 * folds or y.sum() < folds or (1 - y).sum() < folds:
            p = min(max(whole, 1e-4), 1 - 1e-4)
            links.append(Link(name, np.zeros(1 << BITS, np.float32), np.zeros(extra.shape[1]), float(np.log(p / (1 - p)))))
            extra = np.c_[extra, np.full(n, links[-1].intercept)]
            continue
        w = np.where(y == 1, whole / y.mean(), (1 - whole) / (1 - y.mean()))
        outside = np.zeros(n)
        for f in range(folds):
            at = fold[doc] != f
            m = _train(doc[at], slot[at], n, extra, y, np.where(fold == f, 0, w))
            outside[fold == f] = _margin(doc, slot, n, m, extra)[fold == f]
        beta, more, bias = _train(doc, slot, n, extra, y, w)
        links.append(Link(name, beta.astype(np.float32), more, bias))
        extra = np.c_[extra, outside]
    return links


def score(docs: DataFrame, chain: list[Link], *, flag: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``p_<category>`` for each link, ``is_<flag>``.

    Whole texts are read; a null text counts as empty.  The word weights (one megabyte a
    category) travel as a broadcast.
    """
    names = [c.name for c in chain]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = shared.value
        for b in it:
            for i, j, buf, off in K.slices(b.column(1)):
                doc, slot = word_sets(buf, off)
                extra = np.zeros((j - i, 0))
                for c in links:
                    extra = np.c_[extra, _margin(doc, slot, j - i, (c.words, c.earlier, c.intercept), extra)]
                p = 1 / (1 + np.exp(-extra))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, names.index(flag)] >= threshold)],
                    names=[id_col, *[f"p_{x}" for x in names], f"is_{flag}"])

    d = docs.select(id_col, text_col)
    cols = "".join(f", p_{x} double" for x in names)
    return d.mapInArrow(batches, f"`{id_col}` {dict(d.dtypes)[id_col]}{cols}, is_{flag} boolean")
