"""Quality classifier: zstandard dictionaries of good and of bad text, calibrated.

Pairs of dictionaries of several sizes are trained on labelled texts, one of good and one of bad
text each.  A text that compresses better with a good dictionary than with the bad one of its
size resembles good text; only these differences, normalised by the compressed and by the
plain size, go through a logistic calibration fitted on labelled texts that no dictionary has
seen.  Small dictionaries tell by the most frequent strings, large ones by rare ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.sample import class_sizes, labelled_sample

LEVEL = 3


#: Bytes of the dictionaries, of good and of bad text each.
DICTIONARY_BYTES = (2 << 10, 8 << 10, 32 << 10, 110 << 10)


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries (good, bad) of each size and the calibration; some 300 kilobytes, whatever the corpus."""

    dictionaries: tuple[tuple[bytes, bytes], ...]
    coef: tuple[float, ...]
    constant: float | None = None  # used when a class has no labelled text

    def scorer(self):
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        sizes = _sizer(self.dictionaries)
        coef = np.array(self.coef)

        def score(texts: list[bytes]) -> np.ndarray:
            z = _features(*sizes(texts)) @ coef
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return score


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if d is not None:
        d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def _sizer(dictionaries):
    pairs = [(_compressor(g), _compressor(b)) for g, b in dictionaries]

    def sizes(texts):
        out = np.array([[[len(c.compress(t)) for c in pair] for pair in pairs] for t in texts], float).reshape(len(texts), len(pairs), 2)
        return out[:, :, 0], out[:, :, 1], np.array([len(t) for t in texts], float)
    return sizes


def _features(good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Columns: 1, then for each dictionary size the difference of the compressed sizes by their sum,
    its square, and the difference by the text's size.  Without a difference all but the first are 0."""
    d = 10 * (bad - good) / (bad + good)
    return np.concatenate([np.ones((len(n), 1)), d, d * d, 10 * (bad - good) / (n[:, None] + 20)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Weighted logistic regression: Newton steps, halved until the loss falls."""
    scale = np.r_[1.0, np.maximum(x[:, 1:].std(0), 1e-9)]
    x = x / scale
    w = w / w.sum()

    def loss(b):
        z = x @ b
        return float(w @ (np.logaddexp(0, z) - y * z) + ridge / 2 * b[1:] @ b[1:])

    beta, keep = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    now = loss(beta)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - y)) + keep * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step, t = np.linalg.solve(h, g), 1.0
        while t > 1e-6 and (new := loss(beta - t * step)) > now:
            t /= 2
        if t <= 1e-6 or now - new < 1e-10:
            break
        beta, now = beta - t * step, new
    return beta / scale


def _dictionary(texts: list[bytes], size: int) -> bytes:
    texts = [t for t in texts if len(t) >= 8]
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their own bytes serve as the dictionary
        return b"".join(texts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", per_class: int = 2000,
        dict_bytes: tuple[int, ...] = DICTIONARY_BYTES) -> CompressionModel:
    """Fit on at most ``per_class`` labelled texts of each class (the documented bound).

    Half of the sample trains the dictionaries, the other half the calibration, weighted to
    the class shares of all labels.  Null labels are ignored; without one of the classes the
    model returns the share of good labels (0.5 without any).
    """
    classes = {"good": F.col(label_col) == 1, "bad": F.col(label_col) == 0}
    n = class_sizes(labels, classes)
    rows = labelled_sample(docs, labels, classes, per_class) if n["good"] and n["bad"] else []
    parts = {k: [t.encode() for _, t, c in rows if c == {k}] for k in classes}
    if min(map(len, parts.values())) < 2:
        total = n["good"] + n["bad"]
        return CompressionModel((), (), n["good"] / total if total else 0.5)
    dictionaries = tuple(tuple(_dictionary(parts[k][::2], size) for k in ("good", "bad")) for size in dict_bytes)
    held = [(t, y) for k, y in (("good", 1.0), ("bad", 0.0)) for t in parts[k][1::2]]
    x = _features(*_sizer(dictionaries)([t for t, _ in held]))
    y = np.array([v for _, v in held])
    share = n["good"] / (n["good"] + n["bad"])
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return CompressionModel(dictionaries, tuple(_logistic(x, y, w)))


def score(docs: DataFrame, model: CompressionModel, *, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """One row per document: id, ``score`` (0 to 1) and ``predicted`` (score >= threshold).

    A null text is scored as the empty one.  Repeated ids keep a row each; an empty table
    gives no rows; other columns are not read.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = model.scorer()
        for b in it:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            s = run(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                                             names=[id_col, "score", "predicted"])

    d = docs.select(id_col, text_col)
    return d.mapInArrow(batches, f"`{id_col}` {dict(d.dtypes)[id_col]}, score double, predicted int")


def keep_good(docs: DataFrame, model: CompressionModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns.

    One pass without a shuffle; a null text is scored as the empty one and stays null.
    """
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = model.scorer()
        for b in it:
            s = run([(t or "").encode() for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(batches, docs.schema)
