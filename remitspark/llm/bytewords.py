"""Words and hashes of whole batches of texts, on their bytes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)

#: A-Z to a-z, byte by byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: White space: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: What words of letters are made of: letters, digits and every byte of a character beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed))


_BYTE_VALUES = {seed: _table(seed) for seed in (1, 2)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 .. n and those of its inverse, modulo 2^64."""
    global _powers, _inverses
    if len(_powers) <= n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _MULTIPLIER, np.uint64))])
            _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))])
    return _powers, _inverses


class Spans:
    """Hashes of any spans of bytes, or of 64-bit numbers: prefix sums of random values times powers of a multiplier."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.power, self.inverse = powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        values = _BYTE_VALUES[seed][data] if data.dtype == np.uint8 else mixed(data * np.uint64(2 * seed + 1) + np.uint64(seed))
        np.cumsum(values * self.power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch and where each text begins (one entry more than texts); null counts as empty."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def byte_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into ranges of texts (first, after the last) of at most ``limit`` bytes each; a longer text is on its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        before = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    doc: np.ndarray  # number of its text in the batch
    bounds: np.ndarray  # words of text i: bounds[i] .. bounds[i + 1]


def find_words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Words:
    """Runs of bytes for which ``inside`` holds; a text's end ends its last run."""
    member = inside[data]
    first = member.copy()
    first[1:] &= ~member[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = member[begins]
    last = member.copy()
    last[:-1] &= ~member[1:]
    ends = at[1:][at[:-1] < at[1:]] - 1
    last[ends] = member[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, at)
    return Words(start, end, np.repeat(np.arange(len(at) - 1), np.diff(bounds)), bounds)
