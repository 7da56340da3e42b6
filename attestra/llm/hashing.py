"""Vectorised hashes of words, byte strings and windows of them.

All are polynomial hashes over 64-bit unsigned arithmetic, taken as
differences of prefix sums and finished with a bit mixer; two independent
lanes make 128 bits where equality of strings is decided.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_TABLES = tuple(np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U) for seed in (20011, 20021))
_powers: dict[tuple[int, bool], np.ndarray] = {}

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that aren't letters or digits; everything from 0x80 on belongs to a word.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(base: int, n: int, inverse: bool) -> np.ndarray:
    """base ** 0 .. base ** n, or of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) <= n:
        step = pow(base, -1, 2**64) if inverse else base
        size = max(n + 1, 1 << 16)
        out = np.empty(size, U)
        out[0] = 1
        done = 1
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * U(pow(step, done, 2**64))
            done += more
        _powers[(base, inverse)] = have = out
    return have[: n + 1]


def prefix(values: np.ndarray, lane: int = 0) -> np.ndarray:
    """n + 1 prefix sums of values[i] * base ** i."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(_BASES[lane], len(values), False)[:-1], out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of each slice [start, end) of the values that ``sums`` was made from."""
    inverse = _power(_BASES[lane], len(sums) - 1, True)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def byte_prefix(data: np.ndarray, lane: int = 0) -> np.ndarray:
    return prefix(_TABLES[lane][data], lane)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the n + 1 offsets of the rows' words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    return slices(byte_prefix(data, lane), starts, ends, lane)


def window_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Mask over all units: whether a window of ``length`` that starts there ends within its row."""
    n = int(offsets[-1])
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    return left >= length


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """out[i] = best of values[i : i + width], shortened at the end."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = best(out[:-step], out[step:])
        have += step
    return out
