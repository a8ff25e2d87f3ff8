"""Words of Arrow text columns and hashes of words and of runs of words, in numpy.

A chunk is the bytes of some rows and their offsets. Hashes have 64 bits, depend
on content alone and not on the chunk, and mix every step (no polynomial, whose
collisions don't depend on its base).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The low k bytes of a block; longer words than LONG bytes are hashed on their own.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most `most` bytes, or of one longer row; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        stop = min(stop, len(column))
        yield first, data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
        first = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a chunk, and each row's offsets into them."""
    inside = NOT_SPACE[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool, seed: int = 0) -> np.ndarray:
    """A hash of each word, block by block of eight bytes; seeds give independent ones."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(U64) + U64(0xC2B2AE3D27D4EB4F) * U64(seed + 1))
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest()
        out[i] = int.from_bytes(digest, "little")
    left, done = np.flatnonzero(size <= LONG), 0
    while len(left):
        block = blocks[starts[left] + done] & MASKS[np.minimum(size[left] - done, 8)]
        out[left] = mix((out[left] ^ block) * U64(0x9E3779B97F4A7C15) + U64(1))
        done += 8
        left = left[size[left] > done]
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` hashes in a row, joined from those of runs of 1, 2, 4, ... of them."""
    joined, n, run, of = None, 0, hashes, 1
    while True:
        if size & of:
            joined = run if joined is None else pairwise(joined, run, n)
            n += of
        if n == size:
            return joined
        run, of = pairwise(run, run, of), 2 * of


def pairwise(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    """A hash of a[i] and b[i + apart], for every i that has both."""
    many = max(0, min(len(a), len(b) - apart))
    out = a[:many] * U64(0xD1342543DE82EF95)
    out += b[apart : apart + many]
    return mix(out)


def counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many are true in each row."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
