"""Words of many texts at once: spans and 64-bit hashes by array operations over the Arrow buffers of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
#: Bytes of words that are hashed at once.
SLICE = 1 << 18

#: A word's hash is the sum of one random number for each byte and place in it: SPAN places by table, the rest by random odd factors.
_SPAN = 64
_rng = np.random.default_rng(20240101)
_VALUE = _rng.integers(0, 1 << 64, (_SPAN, 256), dtype=np.uint64).ravel()


def _table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes that end a word: ASCII white space only; or all ASCII but letters and digits.
WHITE = _table(lambda b: b == 32 or 9 <= b <= 13)
NOT_ALNUM = _table(lambda b: b < 128 and not chr(b).isalnum())
#: A-Z become a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def _factor(block: np.ndarray) -> np.ndarray:
    """A random odd factor for each block of places, 1 for the first."""
    x = block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): runs of rows of about CHUNK bytes, null being the empty text."""
    col = batch.column(column).fill_null("").cast(pa.large_binary())
    if not len(col):
        return
    _, where, data = col.buffers()
    offsets = np.frombuffer(where, np.int64)[col.offset : col.offset + len(col) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(col):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        high = min(high, len(col))
        yield low, high, flat[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = WHITE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): the words of all texts of a chunk; first[i] is the index of text i's first word."""
    starts, ends = spans(~ends_word[data], offsets)
    return hashes(data, starts, ends - starts, fold), starts, ends, np.searchsorted(starts, offsets)


def spans(inner: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends): maximal runs of the bytes that are marked as within words; none goes beyond its text."""
    n = len(inner)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inner.copy()
    starts[1:] &= ~inner[:-1] | edge[1:n]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def slices(size: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of words of so many bytes together at most; a longer word is a run of its own."""
    upto, low = np.cumsum(size), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def places(size: np.ndarray) -> np.ndarray:
    """The place within its word of every byte of some words."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def hashes(data: np.ndarray, starts: np.ndarray, size: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that start so and have so many bytes."""
    out = np.empty(len(starts), np.uint64)
    for low, high in slices(size):
        n = size[low:high]
        at = places(n)
        value = _VALUE[(at % _SPAN) * 256 + fold[data[np.repeat(starts[low:high], n) + at]]]
        far = np.flatnonzero(at >= _SPAN)
        if len(far):
            value[far] *= _factor(at[far] // _SPAN)
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        to = np.cumsum(n)
        out[low:high] = total[to] - total[to - n]
    return out
