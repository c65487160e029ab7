"""Array helpers over Arrow text columns: words, hashes of words and of word runs.

A column's texts are used as one byte buffer with offsets, so that a batch costs a few
numpy passes and no Python object per word.  Words are runs of bytes other than space and
0x09-0x0D (never crossing two texts).  Hashes are sums ``r[b] * B**i`` modulo two primes, taken
from prefix arrays and mixed; equal words have equal hashes in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Largest number of text bytes handled at once (a longer single text is handled alone).
SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and anything ASCII that is no letter or digit becomes a space.
FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER.tolist()], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer spreading the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: (prime, base) of the two moduli: fixed values
_MODULI = ((2147483647, 1103515245), (2147483629, 1664525013))
_pow: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo ``prime`` (kept and doubled as needed)."""
    p = _pow.get((base, prime), np.ones(1, U64))
    while len(p) < n:
        p = np.concatenate([p, p * U64(int(p[-1]) * base % prime) % U64(prime)])
    _pow[base, prime] = p if len(p) <= 1 << 22 else p[: 1 << 22]
    return p[:n]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[s:e]`` for each span, from a prefix array for each modulus.

    62 bits of two polynomial hashes modulo primes below 2**31 (a sum of residues stays exact in
    64 bits).  Residues are 1 at least, so a span is never equal to a longer one by zeros.
    """
    n, out = len(values), np.zeros(len(starts), U64)
    for prime, base in _MODULI:
        pre, m = np.zeros(n + 1, U64), U64(prime)
        np.cumsum((values % U64(prime - 1) + U64(1)) * powers(base, prime, n) % m, out=pre[1:])
        part = (pre[ends] - pre[starts]) % m * powers(pow(base, -1, prime), prime, n + 1)[starts] % m
        out = out << U64(31) | part
    return mix(out)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``most`` bytes."""
    buf, off = utf8(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, buf[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and the total) of the words in ``buf``."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(_BYTE[buf], starts, ends) if len(starts) else np.zeros(0, U64)


def grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``k`` words inside one text, in order."""
    at, doc = gram_starts(first, k)
    return (spans(words, at, at + k) if len(at) else np.zeros(0, U64)), doc


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc] if len(doc) else np.zeros(0, np.int64)
    return at, doc


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(doc, weights, minlength=n)
    return out.astype(np.int64) if weights is None or weights.dtype.kind in "iub" else out
