"""Words of whole texts as codes into a dictionary of the distinct ones, for many texts at once."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from firmground.llm.store import text_bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def coded(column: pa.Array, separators: bytes):
    """``(codes, bounds, terms)``: words of row i are ``terms[codes[bounds[i]:bounds[i + 1]]]``, in the order of the text.

    A word is a run of bytes outside ``separators`` (ASCII bytes) within one row; A-Z become a-z. Nulls have no words.
    """
    data, offsets = text_bytes(column)
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last[:-1] &= ~mask[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends_in_words = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = LOWER[data[mask]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends_in_words), pa.py_buffer(letters)])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, offsets), found.dictionary
