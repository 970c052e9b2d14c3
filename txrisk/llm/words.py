"""Hashes of the words of many texts at once, straight from Arrow's bytes.

A word is a run of ASCII letters, digits and all characters from U+0080 on, in
lower case as far as ASCII goes.
"""

from __future__ import annotations

import numpy as np

from txrisk.llm.common import byte_values, slices

#: The byte of a word in lower case; 0 for a byte between words.
_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _LOWER[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_PLACE = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of the text that it stands in.

    ``data``: bytes of the texts one after another; ``begins``: where each begins.
    """
    low = _LOWER[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = begins[begins < len(data)]
    first[at] = inside[at]
    where = np.flatnonzero(inside)
    if not len(where):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    heads = np.flatnonzero(first[where])
    starts = where[heads]
    sizes = np.diff(np.append(heads, len(where)))
    place = where - np.repeat(starts, sizes)
    value = _CODE[low[where]] * _PLACE[place & 4095]
    return mix(np.add.reduceat(value, heads)), np.searchsorted(begins, starts, "right") - 1


def batches(column, most: int = 1 << 20):
    """``(low, high, hashes, owners)`` of runs of texts; owners count from ``low``."""
    for low, high in slices(column, most):
        data, begins = byte_values(column, low, high)
        if len(data):
            found, owner = hashes(data, begins)
        else:
            found, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield low, high, found, owner


def shingles(found: np.ndarray, owner: np.ndarray, texts: int, k: int = 5):
    """Hashes of ``k`` words in a row and their texts, in order.

    A text of fewer words, but not none, is one shingle.
    """
    n = np.bincount(owner, minlength=texts)
    total = np.zeros(len(found), np.uint64)
    steps = np.arange(1, k + 1, dtype=np.uint64) * _STEP
    for j in range(k):
        part = mix(found + steps[j])
        total[: len(found) - j] += part[j:]
    begin = np.cumsum(n) - n
    place = np.arange(len(found)) - begin[owner]
    keep = place <= n[owner] - k
    out, own = mix(total[keep]), owner[keep]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            mine = found[begin[t] : begin[t] + n[t]]
            parts = mix(mine + np.arange(1, n[t] + 1, dtype=np.uint64) * _STEP)
            extra[i] = mix(parts.sum(keepdims=True) ^ np.uint64(n[t]))[0]
        out, own = np.append(out, extra), np.append(own, short)
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own
