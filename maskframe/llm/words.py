"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

The hash of a run of bytes is a polynomial in an odd number modulo 2**64, so
the sums up to the run's ends give it; `mix` spreads it afterwards.  It depends
on the bytes alone, so any worker computes the same one.  Two different runs
agree with a chance of about 2**-62.

Long inputs are summed block by block; only what lies at the ends of runs is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Powers of both numbers for a block stay with every worker: 1 MB.
BLOCK = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that lets every bit of the input reach every bit of the output."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def seeded(seed: int, count: int) -> np.ndarray:
    """``count`` fixed 64-bit numbers, the same on every machine."""
    return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed * 0x10001 & _MASK)) * np.uint64(_ODD))


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = seeded(1, 256)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_FOLDED = _BYTES[_LOWER]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of each run ``data[start:end]``; both ends ascend.  ``fold`` takes A-Z as a-z."""
    table, powers, inverse = _FOLDED if fold else _BYTES, _powers(_ODD), _powers(_INVERSE)
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)
    carry, scale = np.uint64(0), 1
    for first in range(0, max(len(data), 1), BLOCK):
        block = data[first:first + BLOCK]
        sums = np.empty(len(block) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[block] * powers[:len(block)], out=sums[1:])
        sums *= np.uint64(scale)
        sums += carry
        for positions, found in ((starts, at_start), (ends, at_end)):
            a, b = np.searchsorted(positions, (first, first + len(block) + (first + BLOCK >= len(data))))
            found[a:b] = sums[positions[a:b] - first]
        carry = sums[-1]
        scale = scale * int(powers[-1]) * _ODD & _MASK
    turns = (starts // BLOCK).astype(np.int64)
    whole = np.array([pow(_INVERSE, BLOCK * int(t), 1 << 64) for t in range(int(turns.max(initial=0)) + 1)], np.uint64)
    sizes = (ends - starts).astype(np.uint64)
    return mix((at_end - at_start) * inverse[starts % BLOCK] * whole[turns] + sizes * np.uint64(0xD6E8FEB86659FD93))


def hash_bytes(value: bytes, fold: bool = True) -> np.uint64:
    """The hash of one run."""
    return hash_runs(np.frombuffer(value, np.uint8), np.zeros(1, np.int64), np.array([len(value)]), fold)[0]


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Bytes between words: white space only, or every ASCII character that is no letter or digit.
SPACES = _separators((0x20, 0x20), (0x09, 0x0D))
MARKS = _separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass(frozen=True)
class Words:
    """Words of a slice of texts: where each starts and ends in the bytes, its
    hash, and the range of words of each text (``at[i]`` to ``at[i + 1]``)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    at: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)


def words_of(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES) -> Words:
    """Words of texts that lie one after the other in ``data``; text i is ``data[at[i]:at[i + 1]]``."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(starts, ends, hash_runs(data, starts, ends), np.searchsorted(starts, at))


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, text by text, and how many each text
    has.  A text of fewer words has one, the whole sequence; without words none."""
    factors, counts = seeded(2, size + 1), words.sizes
    hashes = words.hashes
    total = max(len(hashes) - size + 1, 0)
    joined = np.zeros(total, np.uint64)
    for j in range(size):
        joined += hashes[j:j + total] * factors[j]
    long, short = counts >= size, (counts > 0) & (counts < size)
    sizes = np.where(long, counts - size + 1, short.astype(np.int64))
    out = np.zeros(int(sizes.sum()), np.uint64)
    ends = np.cumsum(sizes)
    take = np.repeat(words.at[:-1] - (ends - sizes), sizes) + np.arange(len(out))
    whole = np.repeat(long, sizes)
    length = np.arange(size + 1, dtype=np.uint64) * factors[size]
    out[whole] = joined[take[whole]] + length[size]
    for i in np.flatnonzero(short):
        own = hashes[words.at[i]:words.at[i + 1]]
        out[ends[i] - 1:ends[i]] = np.add.reduce(own * factors[:len(own)], keepdims=True) + length[len(own):len(own) + 1]
    return mix(out), sizes


def distinct(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each run, ascending, and how many there are."""
    values = values.copy()
    ends = np.cumsum(sizes)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        values[end - size:end].sort()
    row = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.bincount(row[new], minlength=len(sizes))
