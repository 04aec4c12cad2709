"""Words and their hashes for whole Arrow batches of texts, as numpy arrays.

Every function works on UTF-8 bytes: all separators used here are single ASCII bytes, so words never cut
a character. Memory: a few bytes for each byte of text, in chunks of CHUNK bytes (a longer text is a chunk
of its own), and 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_class(spans: list[tuple[int, int]]) -> np.ndarray:
    """A lookup of 256 booleans, true within the spans."""
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: What separates words: white space; or, for licence scans and decontamination, all ASCII but digits and lower-case letters.
SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
NOT_ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, data): the bytes of consecutive rows, row i of the chunk at data[bounds[i]:bounds[i + 1]]. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, offsets[i : j + 1] - offsets[i], whole[offsets[i] : offsets[j]]
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the words' bounds by row."""
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    starts = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = False, inside
    ends = np.flatnonzero(inside & (~after[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which all bits depend on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_POWERS = np.full(1, 1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.full(n, _BASE, np.uint64)
        _POWERS[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
    return _POWERS[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, equal for equal bytes. Spans may not overlap, and are in order."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        at, length = starts[i:j] - a, (ends[i:j] - starts[i:j])
        long = int(length.max(initial=0))
        place = np.arange(b - a) - np.repeat(at, np.diff(np.append(at, b - a)))  # within its span
        inside = place < np.repeat(length, np.diff(np.append(at, b - a)))
        value = _TABLE[data[a:b]] * _powers(max(1, min(long, b - a)))[np.minimum(place, max(long - 1, 0))]
        value[~inside] = 0
        full = length > 0
        sums = np.zeros(j - i, np.uint64)
        if full.any():
            sums[full] = np.add.reduceat(value, at[full])
        out[i:j] = mix(sums ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        i = j
    return out


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words, and their bounds by row. A row of fewer words, but not none, has one: all its words."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    total = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + hashes[j : len(hashes) - k + 1 + j]
    rows = np.repeat(np.arange(len(n)), count)
    at = np.arange(out_bounds[-1]) - out_bounds[rows] + bounds[rows]
    short = (n < k)[rows]
    out = np.zeros(len(at), np.uint64)
    out[~short] = mix(total[at[~short]])
    for i in np.flatnonzero(short):
        h = np.uint64(0)
        for x in hashes[bounds[rows[i]] : bounds[rows[i] + 1]]:
            h = np.uint64((int(h) * _BASE + int(x)) & _MASK)
        out[i] = mix(np.array([h], np.uint64) ^ np.uint64(int(n[rows[i]])))[0]
    return out, out_bounds
