"""Blocks of texts with dictionaries of their own, so that corpus-wide facts about words reach whole
texts by a small join.

A block is a slice of a partition (about ``BLOCK_BYTES`` of text, at least one text). It holds its word
sequence as numbers of its own dictionary, whose most frequent word is number 1. Facts per word are
joined to the dictionary rows, a row per distinct word and block, and come back to the block by its
name. Neither occurrences nor texts take part in a join.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from metricloom.llm.tokens import Words

BLOCK_BYTES = 16 << 20


class Names:
    """Names of the blocks of a task. They are read back from a written table, so a repeated task may
    give them anew."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def new(self) -> int:
        self.next += 1
        return self.next


@dataclass
class Coded:
    """``codes``: a number from 1 per word occurrence; ``terms``: the words by number, from 1."""

    codes: np.ndarray
    terms: pa.Array
    counts: np.ndarray


def coded(found: Words) -> Coded:
    encoded = found.array().dictionary_encode()
    codes = encoded.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(encoded.dictionary))
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(1, len(order) + 1)
    return Coded(number[codes], encoded.dictionary.take(pa.array(order)).cast(pa.binary()), counts[order].astype(np.int64))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as two planes of 16 bits; the upper one compresses to next to nothing."""
    numbers = numbers.astype(np.uint32)
    return (numbers & 0xFFFF).astype(np.uint16).tobytes() + (numbers >> 16).astype(np.uint16).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    low, high = np.frombuffer(raw, np.uint16).reshape(2, -1).astype(np.uint32)
    return low | (high << 16)
