"""64-bit hashes of the words of many texts at once, by numpy over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The same and ASCII punctuation.
SPACE_OR_MARK = SPACE.copy()
SPACE_OR_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse (modulo 2^64)."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 2 * len(_powers[0])), b)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """n + 1 running sums; the hash of bytes i to j is (sums[j] - sums[i]) times the inverse power i."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw))[0], out=sums[1:])
    return sums


def word_hashes(texts: list[str | bytes], apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in order, and n + 1 offsets: text i has words offsets[i] to offsets[i + 1]."""
    raw = [t if isinstance(t, bytes) else t.encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = np.concatenate([[False], ~apart[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = prefix_hashes(buf)
    words = mix((sums[ends] - sums[starts]) * powers(len(buf))[1][starts])
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    return words, np.concatenate([[0], np.searchsorted(starts, text_ends)])


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row inside each text, and their offsets. A text of fewer words is one shingle, an empty one none."""
    count = np.diff(offsets)
    long_ones = np.maximum(count - n + 1, 0)
    out_counts = np.where(count >= n, long_ones, (count > 0).astype(count.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(out_counts)])
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    total = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * factors[i] if len(words) >= n else 0
    out = np.zeros(out_offsets[-1], np.uint64)
    if len(out):
        text = np.repeat(np.arange(len(count)), out_counts)
        first = offsets[:-1][text] + np.arange(len(out)) - out_offsets[:-1][text]
        whole = count[text] >= n
        out[whole] = total[first[whole]]
        for t in np.flatnonzero((count > 0) & (count < n)):
            w = words[offsets[t] : offsets[t + 1]]
            out[out_offsets[t]] = (w * factors[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), out_offsets


def chunks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Pieces of the list of about so many characters, each with the place of its first text."""
    part, size, at = [], 0, 0
    for i, t in enumerate(texts):
        if part and size + len(t) > most:
            yield at, part
            part, size, at = [], 0, i
        part.append(t)
        size += len(t)
    if part:
        yield at, part
