"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

Texts are UTF-8. A word is a run of bytes that a table of 256 flags lets in; both word
classes in use let in every byte of 0x80 and more, so runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

#: Everything but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, ASCII letters in lower case and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def numbered(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_CODE = numbered(256, 11)
_place = numbered(1 << 12, 23) | np.uint64(1)


def place_codes(n: int) -> np.ndarray:
    """Odd multipliers for the places of a word, so that the order of bytes counts."""
    global _place
    if n > len(_place):
        _place = numbered(1 << int(n - 1).bit_length(), 23) | np.uint64(1)
    return _place


@dataclass
class Slice:
    """Some texts on end: the rows they came from, their bytes, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column in slices of about limit bytes; null counts as empty. A text is never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, dtype=np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield Slice(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """doc: number of the text within the slice; hash: 64 bits of the word's bytes; start and end: its bytes."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words(part: Slice, allowed: np.ndarray, lower: bool) -> Words:
    data = ASCII_LOWER[part.data] if lower else part.data
    inside = allowed[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none)
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    cut[part.offsets[:-1]] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    length = end - start
    at = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(first, length)
    code = BYTE_CODE[data[at]] * place_codes(int(length.max()))[place]
    value = mix(np.add.reduceat(code, first) + length.astype(np.uint64))
    return Words((np.searchsorted(part.offsets, start, side="right") - 1).astype(np.int64), value, start, end)


def window_hashes(value: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size values; the order counts."""
    many = len(value) - size + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(many, size, np.uint64)
    for i in range(size):
        out = (out ^ value[i : i + many]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and their lengths."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])
