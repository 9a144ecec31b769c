"""Order statistics and running totals that hold up when one group has most of the rows.

A window or `percentile` over a group needs the whole group in one task. Group sizes are
checked first; a group above `hot_rows` is cut at approximate quantiles into pieces of similar size, the pieces are summed
first, and each piece is finished on its own; the outcome is exact, the sketch only balances.
Keys must not be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redtide.session import checkpointed

HOT_ROWS = 5_000_000
PIECES = 256


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, *extra: Column) -> DataFrame | None:
    """Groups above `hot_rows` rows with their size `_n`, or None when there are none.

    Group sizes are looked at once, up front, from the key columns alone, and decide which plan
    the caller builds. The kept table, rows / hot_rows groups at most, is checkpointed so that no
    later stage counts again. Callers broadcast it: dealt by its keys, all rows of a hot group would meet in one task.
    """
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    if found.isEmpty():
        return None
    if extra:
        found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *extra).where(F.col("_n") > hot_rows)
    return checkpointed(found)


def running_totals(
    df: DataFrame,
    keys: list[str],
    value: str,
    weights: dict[str, Column],
    descending: bool = False,
    hot_rows: int = HOT_ROWS,
    pieces: int = PIECES,
) -> DataFrame:
    """One row per (keys, value) with each weight's sum and `<weight>_before`, its sum over
    the values that come earlier in the group."""
    names = list(weights)
    flat = df.where(F.col(value).isNotNull()).select(*keys, value, *[w.alias(n) for n, w in weights.items()])
    distinct = flat.groupBy(*keys, value).agg(*[F.sum(n).alias(n) for n in names])
    direction = F.desc if descending else F.asc
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    probabilities = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = hot_groups(
        flat, keys, hot_rows, F.percentile_approx(value, probabilities, F.lit(20 * pieces)).alias("_cuts")
    )
    if cuts is None:
        inside = earlier(Window.partitionBy(*keys).orderBy(direction(value)))
        return distinct.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names})

    side = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    pieced = (
        distinct.join(F.broadcast(cuts.drop("_n")), keys, "left")
        .withColumn("_piece", F.when(F.col("_cuts").isNotNull(), side).otherwise(0))
        .drop("_cuts")
    )
    ahead = earlier(Window.partitionBy(*keys).orderBy(direction("_piece")))
    offsets = (
        distinct.join(F.broadcast(cuts.drop("_n")), keys)
        .groupBy(*keys, side.alias("_piece"))
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(*keys, "_piece", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}_ahead") for n in names])
    )
    inside = earlier(Window.partitionBy(*keys, "_piece").orderBy(direction(value)))
    local = pieced.withColumns({f"_{n}_local": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names})
    return local.join(offsets, [*keys, "_piece"], "left").select(
        *keys,
        value,
        *names,
        *[(F.col(f"_{n}_local") + F.coalesce(f"_{n}_ahead", F.lit(0))).alias(f"{n}_before") for n in names],
    )


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles of `value` per group, nulls ignored.

    Ordinary groups use the hash aggregate `percentile`; hot groups read the two order
    statistics they need off `running_totals`.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    if not keys:
        return quantiles(known.withColumn("_all", F.lit(1)), ["_all"], value, probabilities, hot_rows).drop("_all")
    listed = F.array(*[F.lit(p) for p in probabilities.values()])
    plain = lambda part: (
        part.groupBy(*keys)
        .agg(F.percentile(value, listed).alias("_q"))
        .select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probabilities)])
    )
    hot = hot_groups(known, keys, hot_rows)
    if hot is None:
        return plain(known)

    totals = running_totals(
        known.join(F.broadcast(hot.drop("_n")), keys, "left_semi"), keys, value, {"_c": F.lit(1)}, hot_rows=hot_rows
    ).join(F.broadcast(hot), keys)
    picks, blended = [], []
    for name, p in probabilities.items():
        spot = F.lit(p) * (F.col("_n") - 1)
        for end, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            covers = (F.col("_c_before") <= rank) & (rank < F.col("_c_before") + F.col("_c"))
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{name}_{end}"))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        # the arithmetic of `percentile`, so that a group's size doesn't change the last bits
        between = (F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high
        blended.append(F.when(low == high, low).otherwise(between).alias(name))
    exact = totals.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks).select(*keys, *blended)
    return plain(known.join(F.broadcast(hot.drop("_n")), keys, "left_anti")).unionByName(exact)


def quantiles_wide(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    p: float,
    hot_rows: int = HOT_ROWS,
    beside: list[Column] = (),
) -> DataFrame:
    """The exact `p` quantile of several columns, one output column each, one row per group
    that has any row. Hot groups are unpivoted, ranked per column and pivoted back.

    `beside` are further aggregates of bounded state (first, avg, ...) to compute in the pass.
    """
    plain = lambda part: part.groupBy(*keys).agg(*[F.percentile(F.col(f"`{c}`"), p).alias(c) for c in columns], *beside)
    hot = hot_groups(df.select(*keys), keys, hot_rows)
    if hot is None:
        return plain(df)
    hot = hot.drop("_n")
    picked = [F.struct(F.lit(c).alias("_name"), F.col(f"`{c}`").cast("double").alias("_value")) for c in columns]
    long = (
        df.join(F.broadcast(hot), keys, "left_semi")
        .select(*keys, F.explode(F.array(*picked)).alias("_p"))
        .select(*keys, "_p._name", "_p._value")
    )
    ranked = quantiles(long, [*keys, "_name"], "_value", {"_q": p}, hot_rows)
    warm = hot.join(ranked, keys, "left").groupBy(*keys).pivot("_name", columns).agg(F.first("_q"))
    if beside:
        warm = warm.join(df.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys).agg(*beside), keys)
    return plain(df.join(F.broadcast(hot), keys, "left_anti")).unionByName(warm)


def midrank_totals(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column], **kw) -> DataFrame:
    """Distinct values with their average rank (ties share it), beside the summed weights."""
    totals = running_totals(df, keys, value, {"n": F.lit(1), **weights}, **kw)
    return totals.withColumn("midrank", F.col("n_before") + (F.col("n") + 1) / 2)


def smallest_by_hash(
    df: DataFrame, keys: list[str], rank_hash: str, tie: str, wanted: DataFrame, buckets: int = 2**12
) -> DataFrame:
    """Per group, the last (hash, tie) among its `_take` smallest; `wanted` has keys and `_take`.

    Hashes are uniform, so equal-width buckets are equally full: whole buckets are counted
    first and only the bucket that holds the boundary is put in order. `wanted` is small, a few rows such as
    one a fold; it and the boundaries are named as the sides to broadcast, since the planner takes rows exploded
    into groups to be as few as they were before.
    """
    width = (2**31) // buckets
    bucketed = df.withColumn("_b", F.floor(F.col(rank_hash) / width).cast("int"))
    ordered = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    boundary = (
        bucketed.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_upto", F.sum("_c").over(ordered))
        .join(F.broadcast(wanted), keys)  # one row per group
        .where((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_c") < F.col("_take")))
        .select(*keys, "_b", (F.col("_take") - F.col("_upto") + F.col("_c")).alias("_inner"))
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(rank_hash, tie)
    # broadcast side: one bucket per group
    return (
        bucketed.join(F.broadcast(boundary), [*keys, "_b"])
        .withColumn("_rn", F.row_number().over(inner))
        .where(F.col("_rn") == F.col("_inner"))
        .select(*keys, F.col(rank_hash).alias("_cut_hash"), F.col(tie).alias("_cut_tie"))
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
