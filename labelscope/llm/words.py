"""Words of many texts at once, as numpy arrays over Arrow string buffers.

Spark partitions the rows; a task cuts its Arrow batches into blocks of a few MB, so what it
holds follows the block (or one text, if a single text is longer), never the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Longer words are hashed one by one by a keyless BLAKE2.
LANE_BYTES = 256
_U = np.uint64

IDENTITY = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte as it is.
LOWER = IDENTITY.copy()
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of the given ranges, ends included."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Words of anything but ASCII white space.
NOT_SPACE = ~byte_set((9, 13), (32, 32))
#: Words of ASCII letters, digits and every non-ASCII character.
ALNUM = byte_set((48, 57), (65, 90), (97, 122), (128, 255))


class Block:
    """Rows `first` to `first + n` of a batch: their bytes and where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks. Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(off, off[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Block(raw[off[first] : off[last]], off[first : last + 1] - off[first], first)
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed)) | _U(1)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range. Ranges are read eight bytes at a time and every
    eight pass through `mix`, which no sum of other bytes can undo."""
    size = end - start
    h = size.astype(_U) * _U(0xA0761D6478BD642F) + _U(0x9E3779B97F4A7C15)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    active, at = np.flatnonzero(size <= LANE_BYTES), 0
    while len(active):
        left = size[active] - at
        lane = lanes[start[active] + at]
        short = left < 8
        keep = (_U(1) << (left[short].astype(_U) << _U(3))) - _U(1)
        lane[short] &= keep
        h[active] = mix(h[active] ^ lane) + _U(0xD1342543DE82EF95)
        active, at = active[left > 8], at + 8
    for i in np.flatnonzero(size > LANE_BYTES):
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


class Words:
    """Byte range and 64-bit hash of each word; words of text i are `bounds[i]:bounds[i + 1]`."""

    def __init__(self, block: Block, inside: np.ndarray, fold: np.ndarray = IDENTITY, hashed: bool = True):
        data = block.data if fold is IDENTITY else fold[block.data]
        mask = inside[data]
        begin, finish = mask.copy(), mask.copy()
        begin[1:] &= ~mask[:-1]
        finish[:-1] &= ~mask[1:]
        edges = block.offsets[(block.offsets > 0) & (block.offsets < len(data))]
        begin[edges] = mask[edges]
        finish[edges - 1] = mask[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.bounds = np.searchsorted(self.start, block.offsets)
        self.counts = np.diff(self.bounds)
        self.data = data
        if hashed:
            self.hash = _hashes(data, self.start, self.end)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, by the word they begin at, and a mask of those that
    end in the text they begin in."""
    h, c = words.hash, multipliers(n, 77)
    size = len(h)
    last = words.bounds[1:][words.owner()] if size else np.zeros(0, np.int64)
    fits = np.arange(size) + n <= last
    total = np.zeros(size, dtype=_U)
    for k in range(n):
        total[: size - k] += h[k:] * c[k]
    return mix(total), fits


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted, one after another, and where each text's
    begin. A text of fewer than n words has its whole sequence as one; one without words none."""
    values, fits = windows(words, n)
    out, sizes = [], np.zeros(len(words.counts), dtype=np.int64)
    c = multipliers(n, 77)
    for i, count in enumerate(words.counts.tolist()):
        if not count:
            continue
        a = words.bounds[i]
        if count >= n:
            own = np.unique(values[a : a + count - n + 1])
        else:
            own = mix(np.sum(words.hash[a : a + count] * c[:count], keepdims=True, dtype=_U) + _U(count))
        out.append(own)
        sizes[i] = len(own)
    joined = np.concatenate(out) if out else np.zeros(0, dtype=_U)
    return joined, np.concatenate(([0], np.cumsum(sizes)))
