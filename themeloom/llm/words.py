"""The words of a batch of texts as arrays: places and hashes, with no Python object for a word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from themeloom.llm.hashing import BASES, Prefix

WORD, GAP, BREAK = 0, 1, 2


def classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of every byte: part of a word, a gap between words, or a break between pieces."""
    table = np.full(256, WORD, np.uint8)
    table[list(gaps)] = GAP
    table[list(breaks)] = BREAK
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    codes: np.ndarray  # bytes of all texts, A-Z lowered
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray  # number of each word's text
    piece: np.ndarray  # rises at every break and with every text
    hash: np.ndarray
    check: np.ndarray | None  # a second hash

    def bytes_of(self, at: np.ndarray) -> pa.Array:
        """The words at some places as strings."""
        size = self.stop[at] - self.start[at]
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        where = np.repeat(self.start[at] - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.codes[where].tobytes()))

    def counted(self, ids: np.ndarray, *checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of one word each, how often) of all distinct words; words with one id that differ in a check are told apart."""
        distinct, first, which, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        if any((c[first][which] != c).any() for c in checks):
            rows = np.column_stack([ids, *(c.astype(np.uint64) for c in checks)])
            _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
            distinct = ids[first]
        return distinct, first, count


class Collision(ValueError):
    pass


def split(texts: pa.Array, table: np.ndarray, seed: int = 0, check: bool = False) -> Words:
    """The words of `texts`; a null text has none. A word ends with its text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    codes = LOWER[raw]
    kind = table[codes]
    word = kind == WORD
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of texts that are not empty
    begins[inner] |= word[inner]
    last = inner[inner > 0] - 1
    ends[last] |= word[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    steps = np.cumsum(kind == BREAK, dtype=np.int64)
    piece = (steps[start] if len(start) else start) + text
    hashes = [Prefix(codes, base ^ seed << 1).ranges(start, stop) for base in (BASES if check else BASES[:1])]
    return Words(codes, start, stop, text, piece, hashes[0], hashes[1] if check else None)
