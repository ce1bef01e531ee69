"""Word spans, word hashes and n-gram hashes of Arrow string columns, a whole batch at a time.

Everything here runs inside Spark tasks on one Arrow batch; null texts count as empty.
Hashes are 64-bit polynomial hashes over well-mixed words, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: space and \t \n \v \f \r, the same six at which bytes.split() splits.
SPACES = b" \t\n\v\f\r"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Text bytes that are worked on at once; a longer text is still taken whole.
SLICE_BYTES = 1 << 20
#: Bytes that are hashed at once.
CHUNK_BYTES = 1 << 16


def byte_table(separators: bytes) -> np.ndarray:
    """True for the byte values that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


NOT_SPACE = byte_table(SPACES)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=3)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 17, 1 << int(n + 2).bit_length())
    return _powers(size)


def _long_hash(data: np.ndarray) -> np.uint64:
    """The polynomial of the bytes of one long word, piece by piece."""
    power, _ = powers(CHUNK_BYTES)
    total, scale = 0, 1
    with np.errstate(over="ignore"):
        for at in range(0, len(data), CHUNK_BYTES):
            part = data[at : at + CHUNK_BYTES]
            total += scale * int(((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)]).sum(dtype=np.uint64))
            scale = scale * pow(_BASE, CHUNK_BYTES, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices with about `most` bytes of text each (column: texts, or their sizes); one row at least."""
    values = batch.column(column)
    lengths = pc.fill_null(values if pa.types.is_integer(values.type) else pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    total, first = 0, 0
    ends = np.cumsum(lengths)
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, total + most, "right")))
        yield batch.slice(first, last - first)
        total, first = int(ends[last - 1]), last


class Texts:
    """The words of one string column: starts and ends are byte positions in `data`, word i of row r is at ptr[r] + i."""

    def __init__(self, column: pa.Array, is_word: np.ndarray = NOT_SPACE, lower: bool = False):
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type))
        _, offsets, data = column.buffers()
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        o = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            raw = table[raw]
        self.data, self.offsets = raw, o - o[0]
        inside = is_word[raw]
        filled = self.offsets[:-1] < self.offsets[1:]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        before[self.offsets[:-1][filled]] = False
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[self.offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.ptr = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes, some words at a time."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        sizes = self.ends - self.starts
        first = 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + CHUNK_BYTES, "right")))
            begin = self.starts[first]
            if sizes[first] > CHUNK_BYTES:
                out[first] = _long_hash(self.data[begin : self.ends[first]])
            else:
                part = self.data[begin : self.ends[last - 1]]
                power, inverse = powers(CHUNK_BYTES)
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(part) + 1, dtype=np.uint64)
                    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
                    s = self.starts[first:last] - begin
                    out[first:last] = (sums[self.ends[first:last] - begin] - sums[s]) * inverse[s]
            first = last
        with np.errstate(over="ignore"):
            return mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they all stand in one row."""
        power, inverse = powers(len(hashes))
        last = np.repeat(self.ptr[1:], self.counts)
        whole = np.arange(len(hashes)) + n <= last
        with np.errstate(over="ignore"):
            sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
            at = np.minimum(np.arange(len(hashes)) + n, len(hashes))
            return mix((sums[at] - sums[:-1]) * inverse[: len(hashes)]), whole

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def word_hash(word: bytes) -> int:
    """The hash that Texts.hashes() gives this word."""
    return int(Texts(pa.array([word.decode()]), np.ones(256, dtype=bool)).hashes()[0])
