"""Count-min sketch with counters that stop at two, merged over partitions."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from redtide.llm.shared import map_rows

LANES = 2
STRIPE = 1 << 16
LEAST_BITS, MOST_BITS = 16, 26
SCHEMA = "lane int, stripe int, counts binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def width_bits(items: float) -> int:
    """Cells for a small error at so many items. The bound keeps the merged sketch at 2**MOST_BITS bits a
    lane (8 MB); beyond it more items pass the filter, and none is lost."""
    return int(np.clip(np.ceil(np.log2(max(1.0, 4 * items))), LEAST_BITS, MOST_BITS))


def cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each lane."""
    low = np.uint64((1 << bits) - 1)
    return [(hashes & low).astype(np.int64), (mixed(hashes + np.uint64(0x9E3779B97F4A7C15)) & low).astype(np.int64)]


class Sketch:
    """The counters of one partition."""

    def __init__(self, bits: int):
        self.bits = bits
        self.counts = np.zeros((LANES, 1 << bits), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for lane, at in zip(self.counts, cells(hashes, self.bits)):
            at, n = np.unique(at, return_counts=True)
            lane[at] = np.minimum(2, lane[at] + np.minimum(n, 2))

    def rows(self):
        """(lane, stripe, counts): bits for at least one and bits for at least two, compressed."""
        for k, lane in enumerate(self.counts):
            for stripe, part in enumerate(lane.reshape(-1, min(STRIPE, lane.size))):
                if part.any():
                    yield k, stripe, zlib.compress(np.packbits(part >= 1).tobytes() + np.packbits(part >= 2).tobytes(), 1)


def _merge(batches):
    at, once, twice = None, None, None
    for lanes, stripes, counts in batches:
        done = []
        for lane, stripe, data in zip(lanes, stripes, counts):
            both = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1)
            if (lane, stripe) != at:
                if at is not None:
                    done.append((*at, twice.tobytes()))
                at, once, twice = (lane, stripe), both[0], both[1]
            else:
                twice = twice | both[1] | (once & both[0])
                once = once | both[0]
        if done:
            yield list(zip(*done))
    if at is not None:
        yield [at[0]], [at[1]], [twice.tobytes()]


class Repeated:
    """The merged sketch: which hashes may have been added twice or more."""

    def __init__(self, bits: int, rows):
        self.bits = bits
        self.lanes = np.zeros((LANES, (1 << bits) // 8), np.uint8)
        for lane, stripe, data in rows:
            self.lanes[lane, stripe * len(data) : (stripe + 1) * len(data)] = np.frombuffer(data, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for lane, at in zip(self.lanes, cells(hashes, self.bits)):
            out &= (lane[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def merged(partitions: DataFrame, bits: int) -> Repeated:
    """Merge the rows of all partition sketches; the result has a fixed size whatever the input."""
    dealt = partitions.repartition("lane", "stripe").sortWithinPartitions("lane", "stripe")
    return Repeated(bits, map_rows(dealt, _merge, SCHEMA).toLocalIterator())
