"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of segments. If two fingerprints differ in at most T
bits and there are m segments, some segment starts a chain in which the first l segments together
differ in at most l * T / m bits, for every l. With the segment counts used here the first segment
of the chain is equal and the second differs in at most one bit, so one of its halves is equal too:
that is the join key. Candidates in one key group are pruned along the rest of the chain before
the whole Hamming distance is counted.

Null and empty texts have fingerprint 0 and are linked like any other; equal rows count as rows;
columns other than the id and the text are neither read nor kept.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redtide.llm.components import components
from redtide.llm.shared import map_rows
from redtide.session import written

SEED = 42
BITS = 64
TILE = 8192
BLOCK = 1 << 20
ALL = (1 << BITS) - 1


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words after lower-casing A-Z; a shorter text is one run."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long, n_shingles) of every row."""

    def run(batches):
        for ids, texts in batches:
            hashes = [shingle_hashes(t, shingle) for t in texts]
            yield ids, [signed(fingerprint_of(h)) for h in hashes], [len(h) for h in hashes]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), run, f"{id_col} {kind}, fp bigint, n_shingles bigint")


class Ring:
    """Segments, budgets and join keys for fingerprints that differ in at most `most` bits."""

    def __init__(self, most: int):
        self.most, self.m = most, most + 1
        while BITS % self.m or BITS // self.m < 2 or (BITS // self.m) % 2:
            self.m += 1
            if self.m > BITS // 2:
                raise ValueError(f"no ring of segments for {most} bits")
        self.width = BITS // self.m
        self.keys = [self._key(t) for t in range(2 * self.m)]

    def _segment(self, i: int) -> int:
        return ((1 << self.width) - 1) << (i % self.m * self.width)

    def _key(self, t: int) -> int:
        start, half = divmod(t, 2)
        piece = ((1 << self.width // 2) - 1) << ((start + 1) % self.m * self.width + half * self.width // 2)
        return self._segment(start) | piece

    def chain(self, t: int) -> list[tuple[int, int]]:
        """(mask of the first l segments, bits they may differ in) for l from 2 to m."""
        mask, out = self._segment(t // 2), []
        for length in range(2, self.m + 1):
            mask |= self._segment(t // 2 + length - 1)
            out.append((mask, length * self.most // self.m))
        return out


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of each pair one label: the least of their classes."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label[:] = parent[label]


def linked_in_tile(fps: np.ndarray, sizes: np.ndarray, chain: list[tuple[int, int]], least_ratio: float) -> np.ndarray:
    """Label of each fingerprint: the least position it is connected with inside the tile."""
    label = np.arange(len(fps))
    step = max(1, (1 << 21) // len(fps))
    for at in range(0, len(fps), step):
        x = fps[at : at + step, None] ^ fps[None, :]
        mask, most = chain[0]
        i, j = np.nonzero(np.bitwise_count(x & np.uint64(mask)) <= most)
        keep = label[i + at] != label[j]
        x, i, j = x[i[keep], j[keep]], i[keep] + at, j[keep]
        for mask, most in chain[1:]:
            keep = np.bitwise_count(x & np.uint64(mask)) <= most
            x, i, j = x[keep], i[keep], j[keep]
        if least_ratio:
            small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            keep = small >= least_ratio * large
            i, j = i[keep], j[keep]
        _merge(label, i, j)
    return label


def _groups(batches):
    """(t, fps, sizes) of each tile from batches sorted by t, key, tile."""
    rest = None
    for batch in batches:
        part = np.column_stack([np.asarray(c, dtype=np.int64) for c in batch])
        part = part if rest is None else np.concatenate([rest, part])
        cuts = np.flatnonzero((part[1:, :3] != part[:-1, :3]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            yield part[lo:hi]
        rest = part[cuts[-1] if len(cuts) else 0 :]
    if rest is not None and len(rest):
        yield rest


def links(points: DataFrame, most: int, least_ratio: float = 0.0) -> DataFrame:
    """Connecting pairs (a, b) of different points (fp, n_shingles) at most `most` bits apart, whose
    shingle counts have at least the given ratio.

    A forest for each tile is returned, not all pairs. Key groups above TILE rows are dealt to
    pairs of blocks, so no task holds more than two blocks of one group.
    """
    ring = Ring(most)
    keyed = points.select(
        "fp",
        "n_shingles",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(k))).alias("key")) for t, k in enumerate(ring.keys)])).alias("k"),
    ).select("k.t", "k.key", "fp", "n_shingles")
    shared = keyed.groupBy("t", "key").count().where("count > 1")
    blocks = F.ceil(F.col("count") / TILE)
    here = F.pmod(F.xxhash64("fp", "n_shingles"), F.col("blocks"))
    tiles = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda other: F.least(F.col("block"), other) * F.col("blocks") + F.greatest(F.col("block"), other),
    )
    dealt = (
        keyed.join(shared, ["t", "key"])
        .withColumn("blocks", blocks.cast("bigint"))
        .withColumn("block", here)
        .withColumn("tile", F.explode(tiles))
        .select("t", "key", "tile", "fp", "n_shingles")
        .repartition("t", "key", "tile")
        .sortWithinPartitions("t", "key", "tile", "fp", "n_shingles")
    )

    def run(batches):
        for rows in _groups(batches):
            fps = rows[:, 3].astype(np.uint64)
            label = linked_in_tile(fps, rows[:, 4], ring.chain(int(rows[0, 0])), least_ratio)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield rows[moved, 3], rows[moved, 4], rows[label[moved], 3], rows[label[moved], 4]

    return map_rows(dealt, run, "fp bigint, n bigint, other_fp bigint, other_n bigint").select(
        F.struct("fp", "n").alias("a"), F.struct(F.col("other_fp").alias("fp"), F.col("other_n").alias("n")).alias("b")
    )


def _alike(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """Columns of `near_duplicates` with links by likeness; the rows of one id and text are equal."""
    from redtide.llm import likeness

    keys = [F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), id_col, text_col).alias("g")]
    found = likeness.classes(docs.select(*keys, F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, least)
    lowest = found.groupBy("root").agg(F.min("id").alias("component_id"))
    named = found.join(lowest, "root").groupBy("h", "g").agg(F.min("component_id").alias("component_id"))
    own = fingerprints(docs.select(F.struct(F.col(id_col).alias("id"), *keys).alias("row"), text_col), "row", text_col, shingle)
    return own.join(named, (own.row.h == named.h) & (own.row.g == named.g)).select(F.col("row.id").alias(id_col), "fp", "n_shingles", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, least_ratio: float = 0.0
) -> DataFrame:
    """(id, fp, n_shingles, component_id) of every row; the component is the least id reachable.

    With `least_ratio` the links are all pairs whose sets of shingles have at least that Jaccard likeness, however
    far apart their fingerprints are: the distance scatters too much to tell a likeness.
    """
    if least_ratio:
        return _alike(docs, id_col, text_col, shingle, least_ratio)
    own = written(fingerprints(docs, id_col, text_col, shingle))
    own_points = own.withColumn("point", F.struct("fp", F.lit(0).cast("bigint").alias("n")))
    points = own_points.groupBy("point").agg(F.min(id_col).alias("least_id"))
    found = components(links(points.select("point.fp", F.col("point.n").alias("n_shingles")), most), "a", "b")
    rooted = points.join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    lowest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("point", "component_id")
    return own_points.join(named, "point").select(id_col, "fp", "n_shingles", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
