"""Words of whole Arrow text columns, by numpy over their UTF-8 bytes.

A word is a run of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. In UTF-8 every
byte of a non-ASCII character is 0x80 or more, so looking at bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken together up to this many bytes; a longer one is taken alone.
CHUNK = 1 << 19
#: Words that are hashed at once.
SPAN = 1 << 15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)
#: A number for each byte, equal for both cases of a letter.
_VALUE = mix((LOWER.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base ** i for i < n. Only a bounded table is remembered."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK // 2)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


@dataclass
class Chunk:
    """Some rows of a batch: their bytes, and their words in order."""

    first: int  #: row of the batch
    rows: int
    data: np.ndarray  #: bytes as they are
    bounds: np.ndarray  #: rows + 1 offsets into data
    starts: np.ndarray  #: of words
    ends: np.ndarray
    word_bounds: np.ndarray  #: rows + 1 offsets into starts

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.word_bounds))

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each lower-cased word, or of each of the given spans, whose starts rise."""
        if starts is None or ends is None:
            starts, ends = self.starts, self.ends
        out = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), SPAN):
            own = slice(at, at + SPAN)
            low, high = int(starts[at]), int(ends[own].max())
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_VALUE[self.data[low:high]] * power(BASE_INVERSE, high - low), out=sums[1:])
            out[own] = mix((sums[ends[own] - low] - sums[starts[own] - low]) * power(BASE, high - low + 1)[starts[own] - low])
        return out


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """Chunks of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK, "right")) - 1
        last = min(max(last, first + 1), n)
        own = bounds[first : last + 1] - bounds[first]
        part = whole[bounds[first] : bounds[last]]
        word = IS_WORD[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[own] = True
        before = np.empty(len(part), dtype=bool)
        begin, end = np.empty_like(before), np.empty_like(before)
        if len(part):
            before[0] = False
            before[1:] = word[:-1]
            begin = word & (~before | edge[:-1])
            before[-1] = False
            before[:-1] = word[1:]
            end = word & (~before | edge[1:])
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Chunk(first, last - first, part, own, starts, ends, np.searchsorted(starts, own))
        first = last
