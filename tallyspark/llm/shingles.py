"""Sets of word shingles as sorted 64-bit hashes, and bottom-k sketches of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyspark.llm.common import encode_words, hash_strings, mix64, split_words

#: Words of a shingle.
WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it, flat, and the bounds of each text.

    A-Z are lower-cased first.  A text of fewer words than a shingle has its
    whole sequence as the only one; a text without a word has none.
    """
    n = len(texts)
    flat, rows = split_words(pc.ascii_lower(texts))
    distinct, codes = encode_words(flat)
    hashes = mix64(hash_strings(distinct))[codes] if len(flat) else np.zeros(0, np.uint64)
    rolled, at = _windows(hashes, rows, words)
    counts = np.bincount(rows, minlength=n)
    for size in range(1, words):
        short = np.repeat((counts == size), counts)
        if short.any():
            some, some_at = _windows(hashes[short], rows[short], size)
            rolled, at = np.concatenate([rolled, some]), np.concatenate([at, some_at])
    order = np.lexsort((rolled, at))
    rolled, at = rolled[order], at[order]
    first = np.ones(len(at), bool)
    first[1:] = (rolled[1:] != rolled[:-1]) | (at[1:] != at[:-1])
    rolled, at = rolled[first], at[first]
    return rolled, np.searchsorted(at, np.arange(n + 1))


def _windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of ``size`` words within a row."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - size + 1
    rolled = np.full(m, np.uint64(size))
    for i in range(size):
        rolled = mix64(rolled * _STEP + hashes[i:i + m])
    inside = rows[:m] == rows[size - 1:]
    return rolled[inside], rows[:m][inside].astype(np.int64)


def bottom(values: np.ndarray, bounds: np.ndarray, k: int) -> pa.ListArray:
    """The ``k`` smallest hashes of each set (all, if there are fewer), ascending."""
    sizes = np.minimum(np.diff(bounds), k)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    flat = values[np.repeat(bounds[:-1] - (ends - sizes), sizes) + np.arange(total)]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.view(np.int64)))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
