"""Word and shingle hashes of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: ASCII white space: what separates words.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20240117)
#: A random 64-bit value for each byte, and odd multipliers.
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as long as they have been needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 2**64))])
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more entry than texts).

    Polynomial over the bytes modulo 2^64, from one running sum over all texts.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    buf = np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    first, end = edge[0::2], edge[1::2]
    up, down = _POWERS[0].get(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    out = mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
    return out, np.searchsorted(first, np.r_[0, np.cumsum(sizes)])


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``size`` consecutive words, by the order in which they start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[1].get(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def chunks(texts: list[bytes], most: int = 1 << 22):
    """Ranges (lo, hi) of texts that have about ``most`` bytes together, at least one text each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
