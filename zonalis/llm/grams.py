"""Hashes of word n-grams of many texts at once, in numpy. Used by tasks; memory follows CHUNK, or the longest text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together.
CHUNK = 1 << 18
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and where each text starts (one more for the end); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some size bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if not _POWER or len(_POWER[0]) < n:
        size = max(n, CHUNK + 2)
        _POWER[:] = [_powers(int(_ODD), size), _powers(pow(int(_ODD), -1, 1 << 64), size)]
    return _POWER[0][:n], _POWER[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many each text has."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~_SEPARATORS[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[:-1], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def gram_hashes(words: np.ndarray, span: int) -> np.ndarray:
    """Hashes of all windows of span words of one text; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(span, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _ODD + words[k : n - width + 1 + k]
    return mixed(out)


def gram_sets(column: pa.Array, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct n-gram hashes in order) of each text."""
    data, offsets = text_bytes(column)
    for at, end in chunks(offsets):
        hashes, counts = word_hashes(data, offsets[at : end + 1])
        ends = np.cumsum(counts)
        for k in range(at, end):
            yield k, np.unique(gram_hashes(hashes[ends[k - at] - counts[k - at] : ends[k - at]], span))


def packed(*columns: np.ndarray) -> bytes:
    """Integers as planes of bytes, which compress well: the first bytes of all numbers of a column, then the second, ..."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(blob) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out
