"""Words and hashes of whole Arrow string columns, computed with numpy on the UTF-8 bytes.

Every function takes a slice of rows and works on the concatenated bytes, so cost per word is a few array passes and
memory follows the slice, never the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # text per numpy pass; a longer text is a slice of its own

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(0, 1 << 64, 256, dtype=np.uint64)
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANK, _NOTHING = pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary())
_LOWER = np.arange(256, dtype=np.uint8)  # of bytes, A-Z folded
_LOWER[0x41:0x5B] += 0x20


_HASHED_BYTES = 1 << 17  # bytes of words hashed in one go
_PLACES = 64  # places in a word with a table of numbers; those of later places are computed


@lru_cache(maxsize=4)
def _by_place(salt: int) -> np.ndarray:
    """A random number for each byte at each of the first places."""
    return np.random.Generator(np.random.PCG64(20240229 + 1 + salt)).integers(0, 1 << 64, _PLACES << 8, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of an odd root and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, dtype=np.uint64)
        self._inverse = np.uint64(pow(int(_ROOT), -1, 1 << 64))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            steps = np.full(size, _ROOT, dtype=np.uint64)
            steps[0] = 1
            self._up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = self._inverse
            self._down = np.cumprod(steps, dtype=np.uint64)
        return self._up[:n], self._down[:n]


_POWERS = Powers()


def byte_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of weighted bytes, and the factors that make ``(sums[e] - sums[s]) * down[s]`` a hash of ``raw[s:e]``.

    For stretches of fewer than 512 bytes: modulo 2**64, longer ones made of two letters by rule can cancel out.
    """
    up, down = _POWERS.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    return sums, down


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row begins (one entry more than rows).  Null: empty."""
    texts = texts.cast(pa.large_binary()) if not isinstance(texts, pa.LargeBinaryArray) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of text each, at least one row."""
    texts = batch.column(column).cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte ranges, and the first word of each row.

    One space is put behind every row, so no word crosses rows and every word is followed by a separator.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        self.raw, self.rows = text_bytes(pc.binary_join_element_wise(texts, _BLANK, _NOTHING))
        inside = ~_SPACE[self.raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.r_[0, edge]
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.rows)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` folds A-Z.  Hashes of different ``salt`` are independent.

        Each byte at each place has a random number of its own, so no arrangement of bytes cancels out in the sum.
        """
        out = np.empty(len(self.start), dtype=np.uint64)
        ends = np.cumsum(self.end - self.start)
        first = 0
        while first < len(out):  # a bounded number of bytes at a time
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + _HASHED_BYTES, side="right")))
            out[first:last] = self._hashes_of(first, last, lower, salt)
            first = last
        return out

    def _hashes_of(self, first: int, last: int, lower: bool, salt: int) -> np.ndarray:
        start, sizes = self.start[first:last], self.end[first:last] - self.start[first:last]
        begins = np.cumsum(sizes) - sizes
        place = np.arange(begins[-1] + sizes[-1]) - np.repeat(begins, sizes)
        raw = self.raw[place + np.repeat(start, sizes)]
        raw = _LOWER[raw] if lower else raw
        numbers = _by_place(salt)[np.minimum(place, _PLACES - 1) << 8 | raw]
        far = np.flatnonzero(place >= _PLACES)
        if len(far):
            numbers[far] = mix(mix(place[far].astype(np.uint64) + np.uint64(salt << 40)) ^ _BYTE[raw[far]])
        return mix(np.add.reduceat(numbers, begins) + sizes.astype(np.uint64))

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` words by its first word; runs may cross rows, the caller masks those.

    A polynomial of the words' hashes by prefix sums: a few passes whatever the width, which is below 512 (see ``byte_sums``).
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum((words ^ mix(np.uint64([salt]))) * up[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each row, joined by one space."""
    step = np.zeros(len(words.raw) + 1, dtype=np.int8)
    step[words.start[keep]] += 1
    step[words.end[keep] + 1] -= 1
    chosen = np.cumsum(step[:-1], dtype=np.int8) > 0
    raw = np.where(_SPACE[words.raw], np.uint8(0x20), words.raw)[chosen].tobytes()
    at = np.r_[0, np.cumsum(chosen)][words.rows]
    return [raw[s : max(s, e - 1)] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
