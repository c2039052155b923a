"""Whole texts as flat numpy arrays, straight from Arrow buffers: for operators that run numpy inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: 1 for the bytes that separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them). Nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if len(texts) and buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + max_bytes, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it is in."""
    n = len(data)
    space = np.ones(n + 2, bool)
    space[1:-1] = IS_SPACE[data]
    first = np.zeros(n + 1, bool)  # where a row begins, a word that reaches over is cut
    first[offsets] = True
    word = ~space
    starts = np.flatnonzero(word[1:-1] & (space[:-2] | first[:-1]))
    ends = np.flatnonzero(word[1:-1] & (space[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, by pieces of text of about SLICE_BYTES: working memory does not grow with the text."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + SLICE_BYTES, "right")))
        b = int(ends[j - 1])
        if b - a > SLICE_BYTES:
            out[i] = _long_sum(data[a:b])
        else:
            p, inverse = powers(SLICE_BYTES + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * p[: b - a], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * inverse[starts[i:j] - a]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def _long_sum(word: np.ndarray) -> np.uint64:
    """The sum of one word that is longer than a piece of text."""
    p, total = powers(SLICE_BYTES + 1)[0], 0
    for at in range(0, len(word), SLICE_BYTES):
        part = word[at : at + SLICE_BYTES]
        total += int(np.sum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)])) * pow(int(BASE), at, 1 << 64)
    return np.uint64(total & (2**64 - 1))
