"""Words and word shingles of a batch of texts as NumPy arrays, straight from the Arrow buffers (no Python string per word)."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of texts that are hashed together; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def _byte_table(ascii_punctuation: bool) -> np.ndarray:
    """Byte -> value of a word's byte, 0 for a separator. ASCII capitals count as small letters."""
    table = np.arange(256, dtype=np.uint16)
    table[list(_WHITE)] = 0
    table[0] = 256  # a NUL is no white space
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    if not ascii_punctuation:
        for c in range(128):
            if not chr(c).isalnum():
                table[c] = 0
    return table


WHITE_SPACE_WORDS = _byte_table(True)
ALPHANUMERIC_WORDS = _byte_table(False)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("_powers", MULTIPLIER), ("_inverse_powers", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p, dtype=np.uint64)
    return _powers, _inverse_powers


@dataclass
class Words:
    """Words of consecutive texts: text ``t`` owns words ``first[t]`` to ``first[t + 1]``; begin/end are byte places in the slice."""

    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 byte borders of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), borders


def slices(borders: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES each."""
    at, n = 0, len(borders) - 1
    while at < n:
        to = int(np.searchsorted(borders, borders[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def words(data: np.ndarray, borders: np.ndarray, table: np.ndarray) -> Words:
    """Words and their 64-bit hashes of the texts between ``borders`` (absolute places in ``data``)."""
    lo = int(borders[0])
    value = table[data[lo : int(borders[-1])]]
    edges = borders - lo
    n = len(value)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(borders), np.int64), none, none, np.zeros(0, np.uint64))
    inside = value > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = edges[:-1][edges[:-1] < n]
    starts[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[1:] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    p, inverse = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value.astype(np.uint64) * p[:n], out=total[1:])
    h = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return Words(np.searchsorted(begin, edges), begin, end, h)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; a shorter text is one run, no words give none."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    size, many = min(size, n), n - min(size, n) + 1
    out = np.zeros(many, np.uint64)
    for k in range(size):
        out = (out + h[k : k + many]) * MULTIPLIER + np.uint64(k + 1)
    return mix(out)
