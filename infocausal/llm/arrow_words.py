"""Texts as numbers of distinct words, without a Python object for each occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes of text, or one row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")), lo + 1)
        yield lo, hi
        lo = hi


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words between single spaces, the word numbers of all texts end to end, and where each text's begin (and the last ends)."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64)


def spread(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The entries of flat that belong to each of `index`, one after another; those of i are flat[ends[i] - sizes[i] : ends[i]]."""
    n = sizes[index]
    upto = np.cumsum(n)
    return flat[np.repeat(ends[index] - upto, n) + np.arange(upto[-1] if len(upto) else 0)]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between successive bounds."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[bounds[1:]] - upto[bounds[:-1]]
