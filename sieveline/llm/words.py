"""Words and their hashes, straight from Arrow string buffers.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z count as a-z. Words are hashed eight bytes
at a time with whole-array operations, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's text begins; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_bounds(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word's number of each text (one more than texts)."""
    space = _SPACE[low]
    cut = np.zeros(len(low) + 1, dtype=bool)  # places where a word ends at the latest: text edges and spaces
    cut[offsets] = cut[-1] = True
    starts_here, ends_here = cut[:-1].copy(), cut[1:].copy()
    starts_here[1:] |= space[:-1]
    ends_here[:-1] |= space[1:]
    starts = np.flatnonzero(starts_here & ~space)
    ends = np.flatnonzero(ends_here & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of the texts, in order, and each text's first word (one more than texts)."""
    base = int(offsets[0])
    length = int(offsets[-1]) - base
    low = np.zeros(length + 8, dtype=np.uint8)
    np.take(_LOWER, raw[base : base + length], out=low[:length])
    starts, ends, first = word_bounds(low[:length], offsets - base)
    return hash_spans(low, starts, ends), first


def shaped_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first words, and each word's last byte and length in bytes."""
    base = int(offsets[0])
    length = int(offsets[-1]) - base
    low = np.zeros(length + 8, dtype=np.uint8)
    np.take(_LOWER, raw[base : base + length], out=low[:length])
    starts, ends, first = word_bounds(low[:length], offsets - base)
    return hash_spans(low, starts, ends), first, low[ends - 1], ends - starts


def hash_spans(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; ``padded`` has eight bytes more than the last span needs."""
    eight = np.ndarray(shape=(max(len(padded) - 7, 0),), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * _M1
    at, todo = starts, np.arange(len(starts))
    while len(todo):
        h[todo] = mix(h[todo] * _M3 ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text, and each text's first run (one more than texts).

    A text with fewer words, but one, gives one run of all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    begin = np.zeros(len(first), dtype=np.int64)
    np.cumsum(runs, out=begin[1:])
    text = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(begin[-1]) - begin[text] + first[text]
    width = np.minimum(counts[text], n)
    h = width.astype(np.uint64) * _M2
    for k in range(n):
        inside = width > k
        if inside.all():
            h = mix(h * _M1 + words[at + k])
        else:
            h[inside] = mix(h[inside] * _M1 + words[at[inside] + k])
    return h, begin
