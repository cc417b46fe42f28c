"""Words and word shingles as 64-bit hashes, vectorised over the bytes of an Arrow column.

A word's hash is a sum over its bytes of pseudo-random numbers, one for each byte and place
in the word, got from prefix sums over the whole buffer and mixed with its length. (A
polynomial modulo 2**64 would give some long repetitive words one hash, whatever its base.)
No Python object is made for a text or a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bytes of text that are worked on at a time (more for a single longer text).
CHUNK = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows; null texts are empty) and bytes of a string column."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def small(batches, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, min(to, n)
        at = to


def word_bounds(b: np.ndarray, bounds: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes b; no word goes over a text's bounds. Words end
    at ASCII white space only, or also before the bytes marked in cuts."""
    n = len(b)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edge = np.zeros(n + 1, bool) if cuts is None else cuts
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the elements (bytes or code points) from starts to ends, which are in order and don't overlap."""
    n = len(b)
    at = np.arange(n)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    x = (at - np.maximum.accumulate(first)).astype(np.uint64)  # place in the span; of no meaning between spans
    x <<= np.uint64(21)
    x |= b
    x += np.uint64(1)
    x *= _A
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    return mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * _B)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts in data, and where each text's words begin and end
    (one more than texts). A-Z count as a-z."""
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    b = data[low:high]
    b = b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)
    starts, ends = word_bounds(b, offsets - low)
    return span_hashes(b, starts, ends), np.searchsorted(starts, offsets - low)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text: the sorted distinct hashes of its k-word shingles; of all its words
    where they are fewer than k; none without words."""
    offsets, data = text_buffer(column)
    for first, last in chunks(offsets):
        words, at = word_hashes(data, offsets[first : last + 1])
        whole = np.full(max(0, len(words) - k + 1), np.uint64(k), np.uint64)
        for i in range(k):
            whole = mixed(whole * _B + words[i : i + len(whole)])
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if z - a >= k:
                s = np.sort(whole[a : z - k + 1])
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif z > a:
                s = np.full(1, np.uint64(z - a), np.uint64)
                for i in range(a, z):
                    s = mixed(s * _B + words[i : i + 1])
                yield s
            else:
                yield np.empty(0, np.uint64)
