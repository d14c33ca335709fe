"""Word hashing straight from Arrow string buffers, without Python strings.

A *word* is a maximal run of bytes above 0x20 (so blanks, tabs and line ends part words;
all multi-byte characters are word bytes). Everything here is numpy over the UTF-8 buffer
of a string array, cut in blocks of bounded size so that the temporary arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_MINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n; kept between calls."""
    if len(_pow[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, m in enumerate((_M, _MINV)):
            table = np.full(size, m, np.uint64)
            table[0] = 1
            _pow[k] = np.cumprod(table, dtype=np.uint64)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (murmur3's constants): every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets into them; a null counts as the empty string."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about BLOCK_BYTES."""
    data, off = buffers(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a block; words don't cross texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data > 32
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] |= inside[cut + 1]
    end[cut - 1] |= inside[cut]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, starts, ends of the words of a block, and for its n texts n+1 offsets into them."""
    starts, ends = word_spans(data, off)
    return span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, off)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the len(h)-k+1 windows of k words, wherever texts begin and end."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: len(h) - k + 1])
