"""Words of whole texts as flat arrays, for work on Arrow batches.

A batch of texts is one run of UTF-8 bytes; words are found by byte class, which is exact for word
patterns that treat all characters beyond ASCII alike.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Everything but white space.
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Digits, small letters and everything beyond ASCII.
ALPHANUMERIC = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUE = _RANDOM.integers(1, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``data``: the words' lower-cased bytes one after the other; ``offsets``: where each begins;
    ``bounds``: index of the first word of each text, and one past the last; ``starts``: where each
    word begins in the bytes of all texts."""

    data: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if len(self.offsets) < 2:
            return np.zeros(0, np.uint64)
        lengths = np.diff(self.offsets)
        powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, np.uint64))
        place = np.arange(len(self.data)) - np.repeat(self.offsets[:-1], lengths)
        summed = np.add.reduceat(_BYTE_VALUE[self.data] * powers[place], self.offsets[:-1])
        return mix(summed + lengths.astype(np.uint64))


def words(texts: pa.Array, kind: np.ndarray) -> Words:
    """Words of each text; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = LOWER[data]
    inside = kind[data]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data[inside], np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64), np.searchsorted(starts, offsets), starts)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text, at least one row each, so that memory
    depends neither on the batch size nor on the number of rows."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64))
        first = 0
        while first < batch.num_rows:
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(first, last - first)
            first = last
