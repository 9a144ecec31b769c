"""Samples and cross-validation folds from a portable hash."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from redtide.functions.hashing import MODULUS, portable_hash, portable_hashes
from redtide.operators.ranking import smallest_by_hash
from redtide.session import written


def hash_sql(ident: str, k: str = "0") -> str:
    """`portable_hash` as SQL text, for other engines."""
    mixed = f"((({ident}) % {MODULUS} * 48271 + ({k}) * 104729 + 42) % {MODULUS})"
    return f"((({mixed} % 46337) * ({mixed} % 46339) + {mixed}) % {MODULUS} * 69621 % {MODULUS})"


def portable_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows with the smallest hash (all rows if there are fewer): a top-n that every
    partition answers with n rows, so nothing is sorted as a whole."""
    return (
        df.withColumn("_h", portable_hash(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")
    )


def shuffle_split(df: DataFrame, id_col: str, n_splits: int = 50, test_size: float = 0.2) -> DataFrame:
    """Independent random splits: one row per (fold, row) with `is_test`; ceil(test_size * n)
    test rows per fold.

    Rows are not ranked. For each fold the hash value that bounds its test set is looked up
    first, from bucket counts; after that membership is a comparison inside the row.
    """
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    cuts = shuffle_cuts(df, id_col, n_splits, test_size)
    exploded = df.withColumn("fold", folds).withColumn("_h", portable_hash(id_col, F.col("fold")))
    inside = (F.col("_h") < F.col("_cut_hash")) | (
        (F.col("_h") == F.col("_cut_hash")) & (F.col(id_col) <= F.col("_cut_tie"))
    )
    # broadcast side: one row per fold
    return (
        exploded.join(F.broadcast(cuts), "fold")
        .withColumn("is_test", inside)
        .drop("_h", "_cut_hash", "_cut_tie")
    )


def shuffle_cuts(df: DataFrame, id_col: str, n_splits: int, test_size: float = 0.2) -> DataFrame:
    """(fold, _cut_hash, _cut_tie): the last row of each test set in (hash, id) order, one row a fold."""
    n = df.count()
    take = -int(-(n * test_size) // 1)
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    hashed = (
        df.select(F.col(id_col).alias("_id"), folds.alias("fold"))
        .withColumn("_h", portable_hash("_id", F.col("fold")))
    )
    wanted = df.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("fold"), F.lit(take).alias("_take"))
    return smallest_by_hash(hashed, ["fold"], "_h", "_id", wanted)


def usable_folds(split: DataFrame, labels: list[str]) -> DataFrame:
    """Folds with test rows and both classes of every label among the training rows."""
    train = ~F.col("is_test")
    classes = [F.count_if(train & (F.col(f"`{c}`") == v)).alias(f"_{v}_{i}") for i, c in enumerate(labels) for v in (0, 1)]
    counted = split.groupBy("fold").agg(F.count_if("is_test").alias("n_test"), F.count_if(train).alias("n_train"), *classes)
    usable = F.col("n_test") > 0
    for i in range(len(labels)):
        usable = usable & (F.col(f"_0_{i}") > 0) & (F.col(f"_1_{i}") > 0)
    return counted.select("fold", "n_train", "n_test", usable.alias("usable"))


def hash_ordinal(df: DataFrame, keys: list[str], id_col: str, buckets: int = 2**16, few_groups: bool = False) -> DataFrame:
    """`ordinal`: position (from 1) in (`_h`, id) order within the keys.

    Hashes are uniform, so equal-width buckets are equally full. Buckets are counted first and
    rows are numbered inside their bucket, so no task orders a whole group. With `few_groups` (tens, such as
    folds) the offsets, a row for each group and bucket, are broadcast; otherwise they meet the rows in a merge join.
    """
    width = (2**31) // buckets
    hashed = df.withColumn("_b", F.floor(F.col("_h") / width).cast("int"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # at most `buckets` rows per group
    offsets = (
        hashed.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_ahead"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    # never the rows: exploded ones look as few to the planner as they were before
    offsets = F.broadcast(offsets) if few_groups else offsets.hint("merge")
    return (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_b"])
        .withColumn("ordinal", F.col("_ahead") + F.col("_rn"))
        .drop("_h", "_b", "_ahead", "_rn")
    )


#: Rows of a fold that are ordered at a time, about.
BUCKET_ROWS = 1 << 18
#: Rows that are dealt to buckets at a time.
DEALT_ROWS = 1 << 18


def split_ordinal(df: DataFrame, id_col: str, n_splits: int, buckets: int = 2**12) -> DataFrame:
    """Random position of every row in every fold. The number of buckets is for balance only; counts of folds
    and buckets combine before the shuffle and are broadcast. A table of nothing but whole ids is dealt and ordered
    in arrays (`_id_ordinals`)."""
    if df.columns == [id_col] and isinstance(df.schema[id_col].dataType, LongType):
        return _id_ordinals(df, id_col, n_splits)
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    exploded = df.withColumn("fold", folds).withColumn("_h", portable_hash(id_col, F.col("fold")))
    return hash_ordinal(exploded, ["fold"], id_col, buckets, few_groups=True)


def _id_ordinals(df: DataFrame, id_col: str, n_splits: int) -> DataFrame:
    """(fold, id, ordinal): ids go to the buckets of all folds as packed arrays, and a task orders one bucket of a fold
    at a time. Hashes are uniform, so buckets are equally full. Null ids have no position."""
    ids = df.select(id_col).where(F.col(id_col).isNotNull())
    buckets = max(1, -(-ids.count() // BUCKET_ROWS))
    bucket_of = lambda h: h * buckets // MODULUS

    def blocks(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            rows += len(held[-1])
            if rows >= DEALT_ROWS:
                yield np.concatenate(held)
                held, rows = [], 0
        if rows:
            yield np.concatenate(held)

    def count(batches):
        total = np.zeros((n_splits, buckets), np.int64)
        for block in blocks(batches):
            for k in range(n_splits):
                total[k] += np.bincount(bucket_of(portable_hashes(block, k)), minlength=buckets)
        fold, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[fold, at])], ["fold", "_b", "_c"])

    def deal(batches):
        for block in blocks(batches):
            for k in range(n_splits):
                at = bucket_of(portable_hashes(block, k))
                dealt = block[np.argsort(at, kind="stable")]
                sizes = np.bincount(at, minlength=buckets)
                full = np.flatnonzero(sizes)
                parts = [p.tobytes() for p in np.split(dealt, np.cumsum(sizes[full])[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), k, np.int32)), pa.array(full.astype(np.int32)), pa.array(parts, pa.binary())], ["fold", "_b", "_ids"])

    def order(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, held = None, []
        for batch in parts:
            ahead = batch.column("_ahead")[0].as_py() if ahead is None else ahead
            held += [np.frombuffer(p, np.int64) for p in batch.column("_ids").to_pylist()]
        own = np.concatenate(held)
        fold = key[0].as_py()
        own = own[np.lexsort((own, portable_hashes(own, fold)))]
        for first in range(0, len(own), 1 << 16):
            part = own[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), fold, np.int32)), pa.array(part), pa.array(ahead + first + 1 + np.arange(len(part)))], ["fold", id_col, "ordinal"])

    earlier = Window.partitionBy("fold").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.mapInArrow(count, "fold int, _b int, _c bigint").groupBy("fold", "_b").agg(F.sum("_c").alias("_c"))
    offsets = counts.select("fold", "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_ahead"))
    dealt = ids.mapInArrow(deal, "fold int, _b int, _ids binary")
    # broadcast side: one row per fold and bucket
    placed = dealt.join(F.broadcast(offsets), ["fold", "_b"])
    return placed.groupBy("fold", "_b").applyInArrow(order, f"fold int, `{id_col}` bigint, ordinal bigint")


def kfold(df: DataFrame, id_col: str, k: int = 10, seed: int = 0) -> DataFrame:
    """Shuffled k folds of equal size: the position in hash order modulo k."""
    ordered = hash_ordinal(df.withColumn("_h", portable_hash(id_col, seed)).withColumn("_all", F.lit(1)), ["_all"], id_col)
    return ordered.withColumn("fold", ((F.col("ordinal") - 1) % k).cast("int")).drop("ordinal", "_all")


def strat_label(df: DataFrame, labels: list[str], min_count: int) -> DataFrame:
    """Label combination packed into bits; combinations rarer than `min_count` become -1.

    There are at most 2**labels combinations: they are counted and joined back, no window.
    """
    packed = sum((F.shiftleft(F.col(f"`{c}`").cast("int"), i) for i, c in enumerate(labels)), F.lit(0))
    combined = df.withColumn("combo", packed)
    counts = combined.groupBy("combo").agg(F.count(F.lit(1)).alias("_c"))
    # broadcast side: one row per label combination
    return (
        combined.join(F.broadcast(counts), "combo")
        .withColumn("strat", F.when(F.col("_c") < min_count, F.lit(-1)).otherwise(F.col("combo")))
        .drop("_c")
    )


def collapse_rare(df: DataFrame, column: str, min_count: int, other: Column | int = -1) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(counts, column).withColumn(
        column, F.when(F.col("_c") < min_count, F.lit(other)).otherwise(F.col(column))
    ).drop("_c")


def _lightest(k: int, _totals: dict):
    """State of a walk that puts a group into the lightest fold, the first one on a tie."""
    loads = [0] * k

    def choose(counts: dict) -> int:
        return min(range(k), key=lambda f: (loads[f], f))

    def add(counts: dict, times: list[int]) -> None:
        for f, t in enumerate(times):
            loads[f] += t * sum(counts.values())

    return choose, add


def _evenest(k: int, totals: dict):
    """State of a walk that keeps the share of every class over the folds most even, the lighter fold on a tie."""
    held = {c: [0] * k for c in totals}
    loads = [0] * k

    def choose(counts: dict) -> int:
        """The fold with the least mean over the classes of the deviation of their shares."""
        spreads = [0.0] * k
        for c, total in totals.items():
            own, more = held[c], counts.get(c, 0)
            first, squares = sum(own) + more, sum(h * h for h in own) + more * more
            for f in range(k):
                spreads[f] += math.sqrt(k * (squares + 2 * more * own[f]) - first * first) / (k * total)
        return min(range(k), key=lambda f: (round(spreads[f] / len(totals), 12), loads[f], f))

    def add(counts: dict, times: list[int]) -> None:
        for f, t in enumerate(times):
            loads[f] += t * sum(counts.values())
            for c, n in counts.items():
                held[c][f] += t * n

    return choose, add


def walk_runs(runs: Iterable[tuple[dict, int]], k: int, state) -> Iterator[tuple[list[int], list[int]]]:
    """Folds of equal groups, run by run: (folds of the first members, folds that the others repeat).

    Equal groups are interchangeable, so a run of m is one step of the walk: once k members in a row went to
    all k folds, the folds differ as they did before, and the choices repeat.
    """
    choose, add = state
    for counts, m in runs:
        chosen: list[int] = []
        while len(chosen) < m and not (len(chosen) >= k and len(set(chosen[-k:])) == k):
            f = choose(counts)
            chosen.append(f)
            add(counts, [int(j == f) for j in range(k)])
        rest = m - len(chosen)
        cycle = chosen[-k:] if rest else []
        if rest:
            whole, more = divmod(rest, k)
            add(counts, [whole + int(f in cycle[:more]) for f in range(k)])
        yield chosen, cycle


def group_order(group: Column) -> Column:
    """28 bits of the MD5 of a group's name, as a hash below 2^31 that other engines compute alike."""
    return F.conv(F.substring(F.md5(group.cast("binary")), 1, 7), 16, 10).cast("bigint") * 8


def _deal(groups: DataFrame, run: list[str], runs: list[tuple], schema: str) -> DataFrame:
    """Folds of the groups: a run's members are numbered by the hash of their name and follow its pattern."""
    numbered = hash_ordinal(groups.withColumn("_h", group_order(F.col("group"))), run, "group")
    patterns = groups.sparkSession.createDataFrame(runs, schema)
    at = F.col("ordinal") - 1
    later = F.get("cycle", F.pmod(at - F.size("first"), F.greatest(F.size("cycle"), F.lit(1))).cast("int"))
    return numbered.join(patterns, run).select("group", F.when(at < F.size("first"), F.get("first", at.cast("int"))).otherwise(later).alias("fold"))


def _join_folds(df: DataFrame, group: str, folds: DataFrame) -> DataFrame:
    return df.join(folds.withColumnRenamed("group", "_group"), F.col(f"`{group}`").cast("string") == F.col("_group")).drop("_group")


def group_kfold(df: DataFrame, group: str, k: int = 10) -> DataFrame:
    """Whole groups per fold: largest first, each to the lightest fold.

    The walk takes one step for each distinct size (at most the root of twice the number of rows), on the driver;
    groups of one size are dealt by their place in hash order, in tasks.
    """
    sizes = df.groupBy(F.col(group).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    runs = sorted(((r.n, r.m) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    walked = walk_runs((({0: n}, m) for n, m in runs), k, _lightest(k, {}))
    patterns = [(n, first, cycle) for (n, _), (first, cycle) in zip(runs, walked)]
    return _join_folds(df, group, _deal(sizes, ["n"], patterns, "n bigint, first array<int>, cycle array<int>"))


def stratified_group_kfold(df: DataFrame, group: str, strat: str, k: int = 10) -> DataFrame:
    """As `group_kfold`, also keeping label combinations balanced; plain when a combination is
    too rare to be in every fold. Groups of uneven combinations go first; equal ones are one step of the walk."""
    sizes = df.groupBy(F.col(group).cast("string").alias("group"), F.col(strat).cast("string").alias("strat")).agg(F.count(F.lit(1)).alias("n"))
    totals = {r.strat: r.n for r in sizes.groupBy("strat").agg(F.sum("n").alias("n")).collect()}
    if not totals or max(totals.values()) < k:
        return group_kfold(df, group, k)
    totals = dict(sorted(totals.items(), key=lambda t: (t[0] is None, t[0])))
    mixes = sizes.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("strat", "n"))).alias("_mix")).withColumn("mix", F.to_json("_mix"))
    mixes = written(mixes)
    runs = [({s.strat: s.n for s in r.a}, r.m, r.mix) for r in mixes.groupBy("mix").agg(F.first("_mix").alias("a"), F.count(F.lit(1)).alias("m")).collect()]

    def unevenness(counts: dict) -> float:
        n, first = len(totals), sum(counts.values())
        return round(math.sqrt(max(0, n * sum(v * v for v in counts.values()) - first * first)) / n, 9)

    runs.sort(key=lambda r: (-unevenness(r[0]), [-r[0].get(c, 0) for c in totals]))
    walked = walk_runs(((counts, m) for counts, m, _ in runs), k, _evenest(k, totals))
    patterns = [(mix, first, cycle) for (_, _, mix), (first, cycle) in zip(runs, walked)]
    return _join_folds(df, group, _deal(mixes.select("group", "mix"), ["mix"], patterns, "mix string, first array<int>, cycle array<int>"))


def split_groups(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups seen in more than one fold; none in a sound group split."""
    return (
        df.groupBy(group).agg(F.min(fold).alias("_lo"), F.max(fold).alias("_hi")).where(F.col("_lo") != F.col("_hi")).select(group)
    )
