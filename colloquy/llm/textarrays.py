"""Arrow string columns as numpy byte arrays: spans of words and other runs, word hashes and shingle hashes, a block of texts at a time.

Words are maximal runs of bytes other than space and \\x09-\\x0D. Hashes are 64 bits wide, the same on every executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers


def release_memory() -> None:
    """Gives what Arrow and the C allocator hold but don't use back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack48(x: np.ndarray) -> bytes:
    """Six bytes for each number under 2**48."""
    return x.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel().astype(np.uint64)


class Block:
    """Some whole texts of a batch as one byte array; text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def runs(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the maximal runs of members (a table of 256 booleans), and bounds: text i has the runs bounds[i]:bounds[i + 1]."""
        inside = members[self.data]
        if not inside.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        before = np.concatenate([[False], inside[:-1]])
        before[cut] = False
        after = np.concatenate([inside[1:], [False]])
        after[cut - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than white space."""
        return self.runs(~_SPACE)

    def code_points(self) -> np.ndarray:
        """How many code points begin before each byte, and in all."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        codes = (_LOWER[self.data] if lower else self.data).astype(np.uint64) + np.uint64(1)
        power, inverse = _power_tables(len(codes) + 1)
        codes *= power[: len(codes)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes)])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column between texts into blocks of about limit bytes; a null counts as an empty text."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def parts(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The rows of a batch, a block of texts at a time, so that what an operator holds follows the block and not the batch."""
    for block in blocks(batch.column(column), limit):
        yield batch.slice(block.first, block.n), block
    release_memory()


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width consecutive words, in text order, and their bounds by text; a shorter text is one shingle of all its words."""
    counts = np.diff(bounds)
    multipliers = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    short = (counts > 0) & (counts < width)
    per_text = np.where(short, 1, np.maximum(counts - width + 1, 0))
    out_bounds = np.concatenate([[0], np.cumsum(per_text)])
    starts = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], per_text) + np.repeat(bounds[:-1], per_text)
    room = np.concatenate([words, np.zeros(width, np.uint64)])
    out = np.zeros(len(starts), np.uint64)
    lengths = np.repeat(np.minimum(counts, width), per_text)
    for j in range(width):
        part = room[starts + j] * multipliers[j]
        out += np.where(lengths > j, part, np.uint64(0))
    return mix(out + lengths.astype(np.uint64)), out_bounds
