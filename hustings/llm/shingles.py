"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_HALF = np.uint64(32)


def stir(x: np.ndarray) -> np.ndarray:
    """Mix the bits of unsigned 64-bit numbers; one to one."""
    x = (x ^ (x >> _SHIFT)) * _FACTOR
    return x ^ (x >> _HALF)


def hashed_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, A-Z lowered, and where each text begins (one more entry than texts).

    Words lie between the six white-space characters; bytes.split() and bytes.lower() do just that, and leave other letters alone.
    """
    import xxhash

    hashed = xxhash.xxh3_64_intdigest
    each = [np.array(list(map(hashed, (t or "").encode().lower().split())), dtype=np.uint64) for t in texts]
    starts = np.zeros(len(each) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in each], out=starts[1:])
    return (np.concatenate(each) if each else np.empty(0, np.uint64)), starts


def shingle_sets(texts: Sequence[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of ``width`` words of each text, sorted within the text, one after another; and where each text begins.

    Fewer words make one shingle of all; no words, none.
    """
    h, starts = hashed_words(texts)
    rolled = h[: max(0, len(h) - width + 1)]
    for j in range(1, width):
        rolled = stir(rolled) + h[j : j + len(rolled)]
    rolled = stir(rolled)
    parts = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            part = rolled[a : b - width + 1]
            part.sort()  # windows of different texts do not overlap in ``rolled``, so it can be sorted in place
            parts.append(part[np.r_[True, part[1:] != part[:-1]]])
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for j in range(a, b):
                whole = stir(whole) + h[j : j + 1]
            parts.append(stir(whole))
        else:
            parts.append(h[:0])
    ends = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), ends
