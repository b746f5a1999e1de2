"""Byte-level BPE: pre-tokenisation by table scans, cached pair merging, decoding.

The pattern of the public 50k vocabulary cuts a text into contractions, words, numbers, other
signs and white space. Here no regular expression runs: every code point gets a class from a
table, each class is a function between the states of a small automaton, and since such functions
compose associatively, the states of a whole batch come from a blocked prefix scan over a
multiplication table. Boundaries are then array comparisons of states and neighbouring classes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import CHUNK_BYTES, map_texts, texts_of
from themeloom.llm.hashing import BASES, hashes_in_turn

# The White_Space property of Unicode.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# Classes of code points. Letters come last.
END, SPACE, BLANK, NUMBER, SIGN, QUOTE, LETTER, SHORT, E, L, RV = range(11)
# States after a code point; APOSTROPHE opens a token, AFTER_RV and AFTER_L may become a contraction, CLOSED was one.
START, IN_SPACE, IN_BLANK, IN_NUMBER, IN_SIGN, APOSTROPHE, AFTER_RV, AFTER_L, CLOSED, IN_WORD = range(10)
STATES = 10
SCAN_BLOCK = 256
CACHE_ENTRIES, CACHE_BYTES = 100_000, 8 << 20  # merged pre-tokens kept in a task, about 25 MB with their objects
SHORT_PIECE = 48
MAX_VOCABULARY_BYTES = 64 << 20


@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, SIGN, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            table[code] = LETTER
        elif major == "N":
            table[code] = NUMBER
    table[list(WHITE_SPACE)] = BLANK
    table[0x20] = SPACE
    table[ord("'")] = QUOTE
    for letters, kind in (("stmd", SHORT), ("e", E), ("l", L), ("rv", RV)):
        table[[ord(x) for x in letters]] = kind
    return table


def step(state: int, kind: int) -> int:
    if kind < QUOTE:
        return (START, IN_SPACE, IN_BLANK, IN_NUMBER, IN_SIGN)[kind]
    if kind == QUOTE:  # within a run of signs, or attached to a space, it opens nothing
        return IN_SIGN if state in (IN_SIGN, IN_SPACE, APOSTROPHE) else APOSTROPHE
    if state == APOSTROPHE:
        return {SHORT: CLOSED, RV: AFTER_RV, L: AFTER_L}.get(kind, IN_WORD)
    if (state, kind) in ((AFTER_RV, E), (AFTER_L, L)):
        return CLOSED
    return IN_WORD


@functools.lru_cache(maxsize=1)
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, flat table of `first then second`, states each function gives)."""
    identity = tuple(range(STATES))
    known = {identity: 0}
    order = [identity]

    def number(f):
        if f not in known:
            known[f] = len(order)
            order.append(f)
        return known[f]

    of_class = [number(tuple(step(s, kind) for s in range(STATES))) for kind in range(11)]
    done = 0
    while done < len(order):  # closed under one more code point, hence under composition
        first = order[done]
        for kind in of_class:
            number(tuple(order[kind][s] for s in first))
        done += 1
    size = len(order)
    table = np.empty((size, size), np.uint8)
    for i, first in enumerate(order):
        for j, second in enumerate(order):
            table[i, j] = known[tuple(second[s] for s in first)]
    return np.array(of_class, np.uint8), table.ravel(), np.array(order, np.uint8)


def prefix_states(functions: np.ndarray, first: int = START) -> np.ndarray:
    """The state after each position: a scan within blocks, one over block totals, one lookup."""
    _, table, apply = transition_monoid()
    size = len(apply)
    n = len(functions)
    if n <= SCAN_BLOCK:
        out = np.empty(n, np.uint8)
        state = first
        for i, f in enumerate(functions.tolist()):
            state = out[i] = apply[f, state]
        return out
    blocks = -(-n // SCAN_BLOCK)
    padded = np.zeros(blocks * SCAN_BLOCK, np.uint8)  # function 0 is the identity
    padded[:n] = functions
    across = np.ascontiguousarray(padded.reshape(blocks, SCAN_BLOCK).T)
    for i in range(1, SCAN_BLOCK):
        across[i] = table[across[i - 1].astype(np.uint16) * size + across[i]]
    before = np.empty(blocks, np.uint8)
    before[0] = first
    before[1:] = prefix_states(across[-1], first)[:-1]
    return apply.ravel()[across.astype(np.uint16) * STATES + before].T.ravel()[:n]


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; `END` closes a text. The last class must be `END`."""
    of_class, _, _ = transition_monoid()
    states = prefix_states(of_class[kinds])
    before = np.empty_like(states)
    before[0] = START
    before[1:] = states[:-1]
    last = np.empty_like(kinds)
    last[0] = END
    last[1:] = kinds[:-1]
    after = np.empty_like(kinds)
    after[-1] = END
    after[:-1] = kinds[1:]
    group = np.array([0, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4], np.uint8)
    now, prev = group[kinds], group[last]
    blank, was_blank = now == 1, prev == 1
    # white space: a run keeps together, but for its last member if something follows in the text
    starts = blank & (~was_blank | ((group[after] != 1) & (after != END)))
    changes = (now != prev) & (last != SPACE)
    in_contraction = (before == APOSTROPHE) & (
        (kinds == SHORT) | ((kinds == RV) & (after == E)) | ((kinds == L) & (after == L))
    )
    starts |= ~blank & ((changes & ~in_contraction) | ((now == prev) & (before == CLOSED)))
    return starts & (kinds != END)


class Vocabulary(dict):
    """Pre-token bytes to packed ids (little-endian uint32), filled by merging as needed."""

    def __init__(self, blob: bytes):
        super().__init__()
        self.held = 0
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        self.no_rank = max(self.ranks.values()) + 1
        tokens = [b""] * self.no_rank
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.single = [self.ranks[bytes([x])] for x in range(256)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """Every way to put a token together from two."""
        ranks = self.ranks
        return {
            ranks[t[:i]] << 32 | ranks[t[i:]]: rank
            for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.merge(piece)
        packed = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        self.held += len(piece) + len(packed)
        return packed

    def trim(self) -> None:
        """Forget merged pre-tokens once there are many; they can be merged again."""
        if len(self) > CACHE_ENTRIES or self.held > CACHE_BYTES:
            self.clear()
            self.held = 0

    def merge(self, piece: bytes) -> list[int]:
        """Join the pair of lowest rank, leftmost first, until no pair has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        rank, none = self.pairs.get, self.no_rank
        parts = [self.single[x] for x in piece]
        if len(parts) > SHORT_PIECE:
            return self.merge_long(parts)
        pairs = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            parts[i] = least
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(least << 32 | parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] << 32 | least, none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links, n log n in the length."""
        rank, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << 32 | parts[j]) != least:
                continue  # one of the two has changed since
            parts[i], parts[j], after[i] = least, -1, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (r := rank(least << 32 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank(parts[h] << 32 | least)) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in parts if x >= 0]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        closes = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = class_table()[codes]
        kinds[closes] = END
        starts = token_starts(kinds)
        starts[closes] = True
        marks = np.flatnonzero(starts)
        raw = joined.encode()
        if len(raw) != len(codes):
            widths = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            at = (np.cumsum(widths) - widths)[marks]
        else:
            at = marks
        piece = np.flatnonzero(~np.isin(marks, closes, assume_unique=True))
        begin, end = at[piece], np.append(at[1:], len(raw))[piece]
        flat, first, count = self.lookup(raw, begin, end)
        total = np.cumsum(count)
        ids = flat[np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        bounds = np.append(0, total)[np.searchsorted(piece, np.searchsorted(marks, closes))].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *bounds], bounds, strict=False)]

    def lookup(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pre-tokens on end, and where and how many each range has there."""
        hashes = hashes_in_turn(raw, begin, end, BASES[0])
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        second = hashes_in_turn(raw, begin, end, BASES[1])
        if not np.array_equal(second, second[where][which]):  # two different pre-tokens share a hash
            where = which = np.arange(len(begin))
        self.trim()
        packed = [self[raw[a:b]] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        return np.frombuffer(b"".join(packed), "<u4"), (np.cumsum(sizes) - sizes)[which], sizes[which]

    def encode_text(self, text: str, limit: int = CHUNK_BYTES) -> bytes:
        """As `encode_texts` for one long text, in pieces that end where a pre-token starts."""
        out, at, take = [], 0, limit
        while at < len(text):
            part = text[at : at + take]
            if at + take < len(text):
                kinds = np.append(class_table()[np.frombuffer(part.encode("utf-32-le"), np.uint32)], np.uint8(END))
                # the last classes lack what follows them; a cut within white space would change its tokens
                firm = np.flatnonzero(token_starts(kinds)[:-4])
                blank = (kinds == SPACE) | (kinds == BLANK)
                firm = firm[(firm > 0) & ~blank[firm - 1]]
                if not len(firm):
                    take *= 2
                    continue
                cut = int(firm[-1])
                part = part[:cut]
            out += self.encode_texts([part])
            at += len(part)
            take = limit
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.at[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ids) else 0)].tobytes()

    def offsets(self, packed: bytes) -> bytes:
        """Byte offset of every token in its text, packed like the ids."""
        lengths = self.lengths[np.frombuffer(packed, "<u4")]
        return (np.cumsum(lengths) - lengths).astype("<u4").tobytes()


@functools.lru_cache(maxsize=4)
def vocabulary(blob: bytes) -> Vocabulary:
    return Vocabulary(blob)


def _shared(df: DataFrame, path: str):
    """The vocabulary file, read once by the driver; its size is checked before it is sent."""
    with open(path, "rb") as file:
        blob = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(blob) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(blob)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, ids binary, offsets binary`: token ids and the byte offset of each, packed as little-endian uint32.

    `path` is a rank file (base64 token, rank). Special tokens are ordinary text. A null text is
    the empty text and has no ids; rows keep their multiplicity, a null key stays null, other
    columns are ignored. One text of any length is encoded in bounded pieces. No shuffle.
    """
    blob = _shared(df, path)
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batch):
        words = vocabulary(blob.value)
        texts = texts_of(batch)
        packed = [words.encode_text(texts[0])] if len(texts) == 1 else words.encode_texts(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column("_key"), pa.array(packed, pa.binary()), pa.array(map(words.offsets, packed), pa.binary())],
            names=["_key", "ids", "offsets"],
        )

    kind = rows.schema["_key"].dataType.simpleString()
    return map_texts(rows, f"_key {kind}, ids binary, offsets binary", work, done=vocabulary.cache_clear).withColumnRenamed("_key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key, ids, decoded binary`: the bytes that the packed ids stand for. Null ids decode to no bytes."""
    blob = _shared(df, path)
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))

    def work(batch):
        words = vocabulary(blob.value)
        decoded = pa.array([words.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("ids"), decoded], names=["_key", "ids", "decoded"])

    kind = rows.schema["_key"].dataType.simpleString()
    return map_texts(rows, f"_key {kind}, ids binary, decoded binary", work, "ids", done=vocabulary.cache_clear).withColumnRenamed("_key", key)


def unpack(packed: bytes) -> list[int]:
    """Ids or offsets of one text as integers."""
    return np.frombuffer(packed, "<u4").tolist()
