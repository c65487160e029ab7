"""Token ids of whole texts from the ids of their space-separated units.

A unit is the text between two single spaces together with the space before it.  The splitting
pattern of a byte-level BPE file takes one space with the word after it, so the ids of a text
are those of its units one after another; likewise it always cuts before a line feed that a
word follows, and between a letter and a mark.  Texts in which white space meets otherwise
(``ODD``) are encoded whole.  A batch's units are dictionary-encoded by Arrow, only new words
are encoded, and ids are gathered by offsets with numpy.  A test compares the results with the
tokenizer's own for random texts in shuffled batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fidelis.llm.textkit import utf8

#: Text bytes handled at once (a longer single text is handled alone) and units kept in a worker.
BATCH_BYTES = 4 << 20
MOST_UNITS = 1_000_000
_JOINED = 500
_WS = r"[\s\x0b\x{85}\p{Z}]"
#: Texts in which a cut before a space is not certain: it stands first, last or between white space.
ODD_SPACES = rf"  |^ | $|{_WS} {_WS}"
#: The same for cuts before a space or a line feed.
ODD = rf"{ODD_SPACES}|^\n| \n|{_WS}\n{_WS}|{_WS}\n$"
MARKS = ".,;:!?%&*$#|"


def text_batches(col: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows of at most ``most`` bytes; a null is the empty text."""
    _, off = utf8(col)
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string()).fill_null("")
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


def gather(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lengths) of the stretches ``offsets[p]:offsets[p + 1]`` of a pool, one after another."""
    lengths = offsets[picks + 1] - offsets[picks]
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[picks] - ends + lengths, lengths), lengths


def strings(col: pa.Array) -> list[str]:
    return col.to_numpy(zero_copy_only=False).tolist()


def bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class ByteUnits:
    """Ids of strings by a byte-level BPE file of ``tokenizers``, without special tokens added.

    Many strings are encoded in one call with a control character between them whose token no
    merge contains.  Strings that begin with an apostrophe (a contraction would be split
    otherwise), end in white space or hold that character are encoded singly.
    """

    MARK = "\x01"

    def __init__(self, path: str, *, special_as_text: bool):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        mark = self.tok.encode(self.MARK, add_special_tokens=False).ids
        sign = self.tok.id_to_token(mark[0])
        alone = len(mark) == 1 and not any(sign in t for t in self.tok.get_vocab() if t != sign)
        self.mark = mark[0] if alone else None

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by a call of its own."""
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of many strings, in an order of its own: ``words`` is put into it."""
        single = [u for u in words if self.mark is None or u[:1] == "'" or u[-1:].isspace() or self.MARK in u]
        if single:
            odd = set(single)
            words[:] = [u for u in words if u not in odd]
        groups = [words[i: i + _JOINED] for i in range(0, len(words), _JOINED)]
        parts, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for e in self.tok.encode_batch_fast([self.MARK.join(g) for g in groups], add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            cut = ids == self.mark
            parts.append(ids[~cut])
            lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1)
        alone = self.plain(single)
        words += single
        return np.concatenate([*parts, *alone]), np.concatenate([*lengths, np.array([len(a) for a in alone], np.int64)])


class UnitPool:
    """Ids of the words seen so far in this worker, ``most`` and a batch's at most.

    With ``lines`` a unit that begins with a line feed has no space before it.
    """

    def __init__(self, encoder: ByteUnits, *, lines: bool = True, most: int | None = None):
        self.encoder, self.lines, self.most = encoder, lines, most or MOST_UNITS
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def slots(self, words: list[str]) -> np.ndarray:
        """The place of each string in the pool; new ones are encoded and added."""
        new = [u for u in words if u not in self.known]
        if new:
            ids, lengths = self.encoder.many(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def of_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct units: each is a word and the marks after it, which are looked up apart."""
        if len(self.known) > self.most:
            self.clear()
        buf, off = utf8(units)
        ends = off[:-1] + pc.binary_length(pc.utf8_rtrim(units, characters=MARKS)).to_numpy()
        last, before = buf[np.maximum(ends - 1, 0)] if len(buf) else np.zeros(0, np.uint8), buf[np.maximum(ends - 2, 0)] if len(buf) else np.zeros(0, np.uint8)
        letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (before == 0xC3) & (last != 0x97) & (last != 0xB7) & (last >= 0x80)
        ends = np.where(letter & (ends > off[:-1]), ends, off[1:])
        words, marks = (cut_strings(buf, a, b).dictionary_encode() for a, b in ((off[:-1], ends), (ends, off[1:])))
        of_word = self.slots([u if self.lines and u[:1] == "\n" else " " + u for u in strings(words.dictionary)])
        of_marks = self.slots(strings(marks.dictionary))
        picks = np.stack([of_word[words.indices.to_numpy()], of_marks[marks.indices.to_numpy()]], 1).ravel()
        pos, lengths = gather(self.offsets, picks)
        return self.ids[pos], bounds(lengths)[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a batch of texts, as the tokenizer gives them for each alone."""
        whole = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, ODD))
        for s in self.encoder.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        split = ~whole.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(split)
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(at)), "\n", " \n"), " ")
        first = np.asarray(lists.offsets) - lists.offsets[0].as_py()  # of each text's units; the first one has no space before it
        flat = lists.flatten()
        head = np.zeros(len(flat), bool)
        head[first[:-1]] = True
        rest = flat.filter(pa.array(~head)).dictionary_encode()
        unit_ids, unit_off = self.of_units(rest.dictionary)
        alone = self.encoder.plain(strings(flat.filter(pa.array(head))) + strings(texts.filter(whole)))
        # one pool: the units, then the heads, then the whole texts; the picks in the order of the texts
        ids = np.concatenate([unit_ids, *alone])
        offsets = np.concatenate([unit_off, unit_off[-1] + bounds(np.array([len(w) for w in alone], np.int64))[1:]])
        base = len(unit_off) - 1
        picks = np.empty(len(flat), np.int64)
        picks[~head] = rest.indices.to_numpy()
        picks[head] = base + np.arange(len(at))
        stretches = np.ones(len(texts), np.int64)
        stretches[at] = np.diff(first)
        start = bounds(stretches)
        order = np.empty(start[-1], np.int64)
        inner, _ = gather(start, at)
        order[inner] = picks
        order[start[:-1][~split]] = base + len(at) + np.arange(len(texts) - len(at))
        pos, lengths = gather(offsets, order)
        return ids[pos], bounds(lengths)[start]


def cut_strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of the bytes ``buf[s:e]`` (cuts between characters)."""
    lengths = ends - starts
    off = bounds(lengths)
    pos = np.arange(off[-1]) + np.repeat(starts - off[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[pos])))
