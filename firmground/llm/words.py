"""Words of whole texts as 64-bit hashes, computed for many texts at once in numpy.

A word is a run of bytes outside a separator set; A-Z count as a-z. The hash of a word is a polynomial over random
byte codes modulo 2**64, mixed; it depends on the word alone. Shingles are hashes of consecutive word hashes.
"""
from __future__ import annotations

import numpy as np

SPACE = bytes([32, 9, 10, 11, 12, 13])
#: Every ASCII character that is neither a letter nor a digit.
PUNCTUATED = bytes(b for b in range(128) if not chr(b).isalnum())

_RNG = np.random.default_rng(20240229)
_CODES = _RNG.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_CODES[65:91] = _CODES[97:123]
_BASE = int(_RNG.integers(0, 2**63)) * 2 + 1
_STEPS = _RNG.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACE):
    """``(hashes, bounds, starts, ends)``: words of row i are ``bounds[i]:bounds[i + 1]``, at bytes starts:ends."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    mask = inside[data]
    n = len(data)
    if not n or not mask.any():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    terms = _CODES[data[mask]] * _powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(terms, at) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = 5):
    """``(shingles, bounds)``: hashes of ``size`` consecutive words of each row; shorter rows give their whole
    sequence as one, rows without words none."""
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    full = max(len(hashes) - size + 1, 0)
    rolled = np.zeros(full, np.uint64)
    for j in range(size):
        rolled += hashes[j:j + full] * _STEPS[j]
    long = np.flatnonzero(counts >= size)
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    from_at = np.repeat(bounds[long] - out_bounds[long], n[long])
    to = np.repeat(out_bounds[long], n[long])
    run = np.arange(len(to)) - np.repeat(np.cumsum(n[long]) - n[long], n[long])
    to = to + run
    out[to] = mix(rolled[to + from_at] + np.uint64(size))
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        part = hashes[bounds[i]:bounds[i + 1]]
        out[out_bounds[i]] = mix((part * _STEPS[:len(part)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(part)))[0]
    return out, out_bounds
