"""Content-defined chunking with a rolling gear hash and two masks (normalised FastCDC).

The default parameters are the frozen ones; texts are small, so ``TEXT`` is a preset of the same shape for 1 KiB chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# The gear table is drawn by SplitMix64 from this seed.
GEAR_SEED = 0x2545F4914F6CDD1D
MASK_S = 0x954AA552A9550000
MASK_L = 0x924A494929250000
MIN_SIZE, AVG_SIZE, MAX_SIZE = 256 << 10, 1 << 20, 4 << 20


@dataclass(frozen=True)
class Params:
    """Sizes and masks: cuts are rarer before the average size (``mask_s``) and likelier after it (``mask_l``)."""

    minimum: int = MIN_SIZE
    average: int = AVG_SIZE
    maximum: int = MAX_SIZE
    mask_s: int = MASK_S
    mask_l: int = MASK_L


def spread(bits: int) -> int:
    """A mask of ``bits`` bits spread over the upper half, where the hash has mixed most."""
    return sum(1 << (63 - (i * 32) // bits) for i in range(bits))


TEXT = Params(256, 1024, 4096, spread(12), spread(8))


@lru_cache
def gear() -> np.ndarray:
    """256 64-bit numbers by SplitMix64."""
    state = (GEAR_SEED + np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return state ^ (state >> np.uint64(31))


def fingerprints(data: np.ndarray) -> np.ndarray:
    """Rolling hash ending at each byte over the 64 bytes before it (older ones have shifted out), for all places at once."""
    terms = gear()[data]
    out = terms.copy()
    step = 1
    while step < 64:  # doubling: sums of 2, 4, ... 64 shifted terms
        out[step:] = out[step:] + (out[:-step] << np.uint64(step))
        step *= 2
    return out


def boundaries(data: bytes, p: Params = Params()) -> Iterator[tuple[int, int]]:
    """(offset, length) of every chunk.

    The hash of a chunk starts at its minimum size; places less than 64 bytes after that see a shorter window, so those
    are hashed on their own and the rest taken from one pass over all bytes.
    """
    raw = np.frombuffer(data, np.uint8)
    n, at = len(raw), 0
    full = fingerprints(raw) if n > p.minimum else None
    while at < n:
        left = n - at
        if left <= p.minimum:
            yield at, left
            return
        cut = min(left, p.maximum)
        begin, normal = at + p.minimum, at + min(left, p.average)
        end = at + cut
        early = fingerprints(raw[begin : min(begin + 64, end)])
        prints = np.concatenate([early, full[begin + len(early) : end]])
        short = np.flatnonzero((prints[: normal - begin] & np.uint64(p.mask_s)) == 0)
        if len(short):
            cut = p.minimum + int(short[0])
        else:
            late = np.flatnonzero((prints[max(normal - begin, 0) :] & np.uint64(p.mask_l)) == 0)
            if len(late):
                cut = max(normal - begin, 0) + p.minimum + int(late[0])
        yield at, cut
        at += cut
