"""Rolling polynomial hashes of byte ranges in numpy (arithmetic modulo 2**64)."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so powers can be inverted
BLOCK = 1 << 15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**n and the same of its inverse."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        pair = []
        for factor in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            pair.append(np.cumprod(row, dtype=np.uint64))
        have = (pair[0], pair[1])
        if size <= 8 << 20:
            _POWERS[base] = have
    return have


class Prefix:
    """Hashes of any range of `raw` from one pass over it."""

    def __init__(self, raw: bytes | np.ndarray, base: int = BASES[0]):
        codes = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
        up, self.down = powers(base, len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of `width` items."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n])


def hashes_in_turn(raw: bytes, starts: np.ndarray, stops: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """The hashes of ranges that follow one another, taken in blocks: sums and powers are held for `BLOCK` bytes, not for all of `raw`.

    They equal those of one `Prefix` over `raw`. A range longer than a block is one by itself.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(stops, low + BLOCK, side="right")))
        out[at:to] = Prefix(raw[low : int(stops[to - 1])], base).ranges(starts[at:to] - low, stops[at:to] - low)
        at = to
    return out
