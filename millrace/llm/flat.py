"""Whole texts of an Arrow batch as flat byte arrays, for vectorised work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text that are worked on at once; a longer text is worked on alone
SLICE_BYTES = 1 << 18

_U = np.uint64


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into them) over runs of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        stop = min(n, max(stop, at + 1))
        yield at, stop, raw[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, _U(b))])) for b in (_BASE, _INVERSE))
        if size <= 4 * SLICE_BYTES:
            _POWERS[0] = have
    return have[0][:n], have[1][:n]


#: ASCII white space
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without white space), and each text's offsets into them.

    One long text is worked on in pieces that end at white space, so that no more than its words are held.
    """
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
        parts, at = [], 0
        while at < len(data):
            stop = _piece_end(data, at)
            parts.append(_word_hashes(data[at:stop], np.array([0, stop - at]))[0])
            at = stop
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])
    return _word_hashes(data, offsets)


def _piece_end(data: np.ndarray, at: int) -> int:
    """Behind the last white space of the next ``SLICE_BYTES``; of a longer word, behind the word."""
    stop = min(len(data), at + SLICE_BYTES)
    if stop == len(data):
        return stop
    space = np.flatnonzero(_SPACE[data[at:stop]])
    if len(space):
        return at + int(space[-1]) + 1
    while stop < len(data):
        space = np.flatnonzero(_SPACE[data[stop : stop + SLICE_BYTES]])
        if len(space):
            return stop + int(space[0]) + 1
        stop += SLICE_BYTES
    return len(data)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.empty(0, _U), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)  # the first byte of a text starts a word
    first[offsets[:-1]] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    begin = np.flatnonzero(starts)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    end = np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=total[1:])
        h = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U))
    return h, np.searchsorted(begin, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words, and offsets; a shorter text is one run."""
    lens = np.diff(at)
    counts = np.where(lens == 0, 0, np.maximum(lens - k + 1, 1))
    to = np.concatenate([[0], np.cumsum(counts)])
    if not to[-1]:
        return np.empty(0, _U), to
    doc = np.repeat(np.arange(len(lens)), counts)
    start = at[:-1][doc] + (np.arange(to[-1]) - to[:-1][doc])
    stop = at[1:][doc]
    out = np.zeros(len(doc), _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            p = start + j
            inside = p < stop
            w = words[np.minimum(p, len(words) - 1)]
            out = np.where(inside, mix64(out * _U(0xD6E8FEB86659FD93) + w + _U(j)), out)
    return out, to
