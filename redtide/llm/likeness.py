"""Near-duplicate classes by SimHash, with the exact Jaccard likeness of the sets of word runs as the check.

Texts with one set of runs form a class (by 64 bits of the set). The SimHash of the set is linked with all others
at most MOST_BITS bits apart, by pigeonring filtering. Sets at the bound differ in more bits than any filter can afford, so
each class also has BANDS keys of ROWS minima; two sets of likeness j share a key with probability
1 - (1 - j**ROWS)**BANDS: all but 6 in a million at 0.8, one in 2,000 at 0.2. Fingerprints and keys only propose pairs: a link is a
pair whose likeness, counted on the runs themselves, reaches the bound. Fingerprints come first; keys are
asked only where they hold classes of different components, and every class meets the least one of each such key before others.

Null and empty texts have no runs and are one class.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redtide.llm.components import components
from redtide.llm.shared import map_rows
from redtide.llm.simhash import fingerprint_of, links, shingle_hashes, signed
from redtide.session import written

MOST_BITS = 3
BANDS, ROWS = 40, 6
STEP = 256
AT_ONCE = 512  # texts of a batch that a task holds as objects

_rng = np.random.default_rng(42)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def band_keys(runs: np.ndarray) -> list[int]:
    """BANDS keys of a set of run hashes; none for an empty set."""
    if not len(runs):
        return []
    short = (runs >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(short), STEP):
        np.minimum(least, (short[at : at + STEP, None] * _FACTORS).min(axis=0), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * _MIX[:, 0]).astype(np.int64).tolist()


def likeness(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _alike(rows: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose likeness is at least `least`, written."""
    size = lambda end: sets.select(F.col("c").alias(end), F.col("n").alias(f"n_{end}"))
    pairs = pairs.distinct().join(size("a"), "a").join(size("b"), "b")
    pairs = written(pairs.where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-6).select("a", "b"))
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    wanted = sets.join(ends, "c", "left_semi").select("c", "rep.*")

    def of_texts(batches):
        for ids, texts in batches:
            yield ids, [run_set(t, shingle).tobytes() for t in texts]

    texts = rows.join(wanted, ["h", "g"]).select("c", "text").dropDuplicates(["c"])
    runs = written(map_rows(texts, of_texts, "c bigint, runs binary"))
    both = pairs.join(runs.select(F.col("c").alias("a"), F.col("runs").alias("x")), "a").join(runs.select(F.col("c").alias("b"), F.col("runs").alias("y")), "b")

    def compare(batches):
        for a, b, x, y in batches:
            kept = [(i, j) for i, j, s, t in zip(a, b, x, y) if likeness(s, t) >= least]
            yield [i for i, _ in kept], [j for _, j in kept]

    return written(map_rows(both.select("a", "b", "x", "y"), compare, "a bigint, b bigint"))


def _rooted(df: DataFrame, found: DataFrame) -> DataFrame:
    """`df` with the root of the class c."""
    return df.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _near_fingerprints(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes: each with the least of its fingerprint, and those of fingerprints that are linked."""
    centre = written(sets.groupBy("fp").agg(F.min("c").alias("low"), F.count("*").alias("members")))
    equal = sets.join(centre.where("members > 1"), "fp").where("c > low").select(F.col("c").alias("a"), F.col("low").alias("b"))
    near = links(centre.select("fp", F.lit(0).cast("bigint").alias("n_shingles")), MOST_BITS).select(F.col("a.fp").alias("x"), F.col("b.fp").alias("y"))
    ends = lambda fp, end: centre.select(F.col("fp").alias(fp), F.col("low").alias(end))
    return equal.union(near.distinct().join(ends("x", "a"), "x").join(ends("y", "b"), "y").select("a", "b"))


def classes(rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """(h, g, id, root) of every row of (h, g, id, text); rows of one connected group have one root.

    h and g are a key of the row; rows with one key have one text.
    """

    def run(batches):
        for hs, gs, ids, texts in batches:
            own = [run_set(t, shingle) for t in texts]
            named = [signed(xxhash.xxh3_64_intdigest(x.tobytes())) for x in own]
            yield hs, gs, ids, named, [len(x) for x in own], [signed(fingerprint_of(x)) for x in own], [band_keys(x) for x in own]

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"h bigint, g bigint, id {kind}, c bigint, n bigint, fp bigint, bands array<bigint>"
    own = written(map_rows(rows.select("h", "g", "id", "text"), run, schema, AT_ONCE))
    sets = written(own.groupBy("c").agg(F.min(F.struct("h", "g")).alias("rep"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    near = _alike(rows, sets, _near_fingerprints(sets), shingle, least)
    found = components(near, "a", "b")
    keyed = _rooted(sets.select("c", "bands"), found).select("c", "root", F.explode("bands").alias("key"))
    low = keyed.groupBy("key").agg(F.min("c").alias("low"), F.min_by("root", "c").alias("low_root"), F.min("root").alias("m"), F.max("root").alias("w"))
    shared = written(keyed.join(low.where("m < w").select("key", "low", "low_root"), "key"))
    first = _alike(rows, sets, shared.where("root <> low_root").select(F.col("c").alias("a"), F.col("low").alias("b")), shingle, least)
    linked = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(first)
    found = components(linked, "a", "b")
    rooted = _rooted(shared.select("key", "c"), found)
    several = rooted.groupBy("key").agg(F.min("root").alias("m"), F.max("root").alias("w")).where("m < w").select("key")
    rooted = written(rooted.join(several, "key"))
    other = rooted.select("key", F.col("c").alias("b"), F.col("root").alias("other_root"))
    rest = rooted.join(other, "key").where("c < b and root <> other_root").select(F.col("c").alias("a"), "b")
    linked = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_alike(rows, sets, rest, shingle, least))
    return _rooted(own.select("h", "g", "id", "c"), components(linked, "a", "b")).select("h", "g", "id", "root")
