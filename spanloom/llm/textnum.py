"""Words of texts as numbers: vectorised 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number for each byte, and the bases of the polynomials with their inverses modulo 2**64.
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = [int(x) * 2 + 1 for x in _RNG.integers(2**61, 2**62, 4, dtype=np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; kept up to 2**17."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), _U(base))
        out[0] = 1
        with np.errstate(over="ignore"):
            out = np.multiply.accumulate(out)
        if n <= 1 << 17:
            _POWERS[base] = out
        have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words in UTF-8 bytes."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word, by its bytes alone."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    out = np.empty(len(begins), np.uint64)
    step = 1 << 19  # bytes at a time, so that a long text takes no more memory
    k = 0
    while k < len(begins):
        stop = max(k + 1, int(np.searchsorted(ends, begins[k] + step, "right")))
        lo, hi = int(begins[k]), int(ends[stop - 1])
        out[k:stop] = runs(_BYTE[data[lo:hi]], begins[k:stop] - lo, ends[k:stop] - lo, 0)
        k = stop
    return out


def runs(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    """A mixed hash of values[begin:end] for each pair; kind picks one of several polynomials."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE[kind], n))])
        h = (total[ends] - total[begins]) * _powers(pow(_BASE[kind], -1, 1 << 64), n + 1)[begins]
        return mix(h + (ends - begins).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def bytes_of(text: str, lower: bool = False) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _LOWER[data] if lower else data


def hashes(text: str, lower: bool = False) -> np.ndarray:
    """A hash for each word of a text; with `lower`, of its words with A-Z in lower case."""
    data = bytes_of(text, lower)
    return word_hashes(data, *spans(data))
