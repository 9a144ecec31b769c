"""Rank tests between tracks and between sources."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redtide.functions.scalars import effect_label, normal_two_sided_p
from redtide.operators.joins import source_pairs
from redtide.operators.ranking import HOT_ROWS, midrank_totals


EXACT_UP_TO = 8  # values in the smaller sample; the rule of the library whose results are matched


def exact_tail(u: float, m: int, n: int) -> float:
    """Probability that U of samples of m and n values without ties is u or more, doubled, at most 1.

    The number of orderings with each U is a coefficient of prod((1 - q^(n+i)) / (1 - q^i)), i = 1..m,
    and the same from both ends, so the low end up to m * n - u is summed: whole numbers, built up by
    one difference and one running sum a factor.
    """
    low = int(m * n - u)
    counts = np.zeros(low + 1, object)
    counts[0] = 1
    for i in range(1, m + 1):
        if n + i <= low:
            counts[n + i :] = counts[n + i :] - counts[: low + 1 - n - i]
        for first in range(min(i, low + 1)):
            counts[first::i] = np.cumsum(counts[first::i])
    return min(1.0, 2 * int(counts.sum()) / math.comb(m + n, m))


def exact_rank_p(u: Column, m: Column, n: Column, wanted: Column) -> Column:
    """`exact_tail` where `wanted` holds, else null; batches of the table with one row a test."""

    @F.pandas_udf("double")
    def tails(us: pd.Series, ms: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else exact_tail(a, int(b), int(c)) for a, b, c in zip(us, ms, ns)], dtype="float64")

    return tails(F.when(wanted, u.cast("double")), m, n)


def rank_test(df: DataFrame, keys: list[str], value: str, in_a: str, hot_rows: int = HOT_ROWS, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Two-sided Mann-Whitney test of the rows with `in_a` against the others, per group.

    U belongs to sample a. The p-value is the normal approximation with tie correction and
    continuity, or exact when a sample has at most `exact_up_to` values and nothing ties; groups with fewer
    than two values on a side have no row.
    """
    a = F.col(in_a)
    marked = df.where(F.col(value).isNotNull()).select(
        *keys, value, a.cast("bigint").alias("_a"), F.when(a, F.col(value)).alias("_va"), F.when(~a, F.col(value)).alias("_vb")
    )
    # ranks over distinct values; the means come straight from the rows
    ranked = midrank_totals(marked, keys, value, {"na": F.col("_a")}, hot_rows=hot_rows)
    n = F.col("n").cast("double")
    ranks = ranked.groupBy(*keys).agg(
        F.sum(F.col("na") * F.col("midrank")).alias("_rank_sum"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    means = marked.groupBy(*keys).agg(
        F.count("_va").alias("n_a"), F.count("_vb").alias("n_b"), F.avg("_va").alias("mean_a"), F.avg("_vb").alias("mean_b")
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    total = na + nb
    u = F.col("_rank_sum") - na * (na + 1) / 2
    spread = F.sqrt(na * nb / 12 * (total + 1 - F.col("_ties") / (total * (total - 1))))
    z = F.try_divide(F.greatest(F.col("U_stat"), na * nb - F.col("U_stat")) - na * nb / 2 - 0.5, spread)
    small = (F.least("n_a", "n_b") <= exact_up_to) & (F.col("_ties") == 0)
    exact = exact_rank_p(F.greatest(F.col("U_stat"), na * nb - F.col("U_stat")), F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), small)
    approximate = F.when(z <= 0, 1.0).otherwise(F.least(normal_two_sided_p(z), F.lit(1.0)))
    p = F.when(small, exact).otherwise(approximate)
    return (
        means.where((F.col("n_a") >= 2) & (F.col("n_b") >= 2))
        .join(ranks, keys)
        .withColumn("U_stat", u)
        .withColumn("p_value", F.coalesce(p, F.lit(1.0)))
        .withColumn("rbc", 1 - 2 * F.col("U_stat") / (na * nb))
        .withColumn("delta", F.col("mean_b") - F.col("mean_a"))
        .withColumn("effect_size", effect_label(F.col("rbc")))
        .drop("_rank_sum", "_ties")
    )


def long_metrics(folds: DataFrame, metrics: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    others = [c for c in folds.columns if c not in metrics]
    return folds.select(*others, F.explode(F.array(*pairs)).alias("_p")).select(*others, "_p.*")


def mann_whitney(folds: DataFrame, metrics: list[str] = ("f1", "prauc"), alpha: float = 0.05) -> DataFrame:
    """`_only` (sample a) against `_roms` per source, tier, species and metric.

    The columns called median hold means, as in the published tables."""
    long = long_metrics(folds.select("ac", "track", "tier", "species", *metrics), list(metrics)).withColumn(
        "_only", F.col("track").endswith("_only")
    )
    tested = rank_test(long, ["ac", "tier", "species", "metric"], "value", "_only")
    return tested.select(
        "ac",
        "tier",
        "species",
        "metric",
        F.concat("ac", F.lit("_only")).alias("only_track"),
        F.concat("ac", F.lit("_roms")).alias("roms_track"),
        F.col("n_a").alias("n_only"),
        F.col("n_b").alias("n_roms"),
        F.col("mean_a").alias("median_only"),
        F.col("mean_b").alias("median_roms"),
        "delta",
        "U_stat",
        "p_value",
        (F.col("p_value") < alpha).alias("significant"),
        F.when(F.col("mean_b") > F.col("mean_a"), "roms_better").otherwise("only_better").alias("direction"),
        "rbc",
        "effect_size",
    )


def mann_whitney_pairs(folds: DataFrame, metrics: list[str] = ("f1", "prauc"), alpha: float = 0.05) -> DataFrame:
    """Every pair of sources per track type, tier, species and metric."""
    named = folds.withColumn("track_type", F.regexp_extract("track", r"_(only|roms)$", 1))
    long = long_metrics(named.select("ac", "track_type", "tier", "species", *metrics), list(metrics))
    keys = ["track_type", "tier", "species", "metric"]
    pairs = source_pairs(long, keys)
    # a source takes part in a handful of pairs, so rows are copied that many times
    sided = long.join(pairs, keys).where((F.col("ac") == F.col("ac_a")) | (F.col("ac") == F.col("ac_b")))
    tested = rank_test(sided.withColumn("_in_a", F.col("ac") == F.col("ac_a")), [*keys, "ac_a", "ac_b"], "value", "_in_a")
    better = F.when(F.col("mean_b") > F.col("mean_a"), F.col("ac_b")).otherwise(F.col("ac_a"))
    return tested.withColumns(
        {"significant": F.col("p_value") < alpha, "direction": F.concat(better, F.lit("_better"))}
    )
