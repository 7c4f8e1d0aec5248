"""Vectorised words of whole texts: tokens are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased.

Everything works on the UTF-8 buffers of Arrow batches, a bounded slice of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles.
STEP = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, STEP + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            up[0] = 1
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            down[0] = 1
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def pack(x: np.ndarray, sorted_values: bool = False) -> bytes:
    """An integer array as compressed byte planes, of its differences if it is sorted."""
    import zstandard

    if sorted_values and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T if len(x) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: type, sorted_values: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if sorted_values else x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``step`` bytes together, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word of the documents at ``off`` in the bytes ``b``."""
    solid = ~_BLANK[b]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = off[(off > 0) & (off < len(b))]
    start[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(off[:-1], start, "right") - 1


def _hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word of the documents at ``off``, in order.

    Documents over STEP bytes are cut at blanks, so memory doesn't follow the longest text.
    """
    b = _LOWER[raw[off[0] : off[-1]]]
    rel = off - off[0]
    if len(b) <= STEP or len(rel) > 2:
        s, e, d = spans(b, rel)
        return _hashes(b, s, e), d
    parts, at = [], 0
    while at < len(b):
        stop = min(len(b), at + STEP)
        while stop < len(b):
            blank = np.flatnonzero(_BLANK[b[at:stop]])
            if len(blank):
                stop = at + int(blank[-1]) + 1
                break
            stop = min(len(b), stop + STEP)
        piece = b[at:stop]
        s, e, _ = spans(piece, np.array([0, len(piece)]))
        parts.append(_hashes(piece, s, e))
        at = stop
    h = np.concatenate(parts)
    return h, np.zeros(len(h), np.int64)


_PLACE = [
    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F,
    0xEB44ACCAB455D165, 0x9C6E6877736C46E3
]


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, sorted distinct 64-bit shingle hashes) for every document.

    A document's set has its distinct ``words``-word shingles; with fewer words the whole
    sequence is one shingle; without words the set is empty.
    """
    for i, j in slices(off):
        h, doc = word_hashes(raw, off[i : j + 1])
        first = np.searchsorted(doc, np.arange(j - i + 1))
        joined = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            joined += h[k : k + len(joined)] * np.uint64(_PLACE[k])
        joined = mixed(joined)
        for d in range(j - i):
            a, z = int(first[d]), int(first[d + 1])
            if z - a >= words:
                yield i + d, np.unique(joined[a : z - words + 1])
            elif z > a:
                short = np.uint64(z - a)
                for k in range(z - a):
                    short = mixed(np.full(1, short) + h[a + k : a + k + 1] * np.uint64(_PLACE[k]))[0]
                yield i + d, np.array([short], np.uint64)
            else:
                yield i + d, np.empty(0, np.uint64)
