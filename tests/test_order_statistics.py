"""Quantiles, ranks and running totals, with and without hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redtide.operators import aggregates, ranking, splits


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_p95_and_median_interpolate(spark):
    df = frame(spark, [(1, v) for v in (1.0, 2.0, 4.0)] + [(2, v) for v in (1.0, 2.0, 4.0, 9.0)], "k int, v double")
    got = {r["k"]: (r["p"], r["m"]) for r in ranking.quantiles(df, ["k"], "v", {"p": 0.95, "m": 0.5}).collect()}
    assert got[1][0] == pytest.approx(3.8)
    assert got[2][1] == pytest.approx(3.0)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    # one key holds most rows; values repeat and some are missing
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.choice([None, *range(40)])) for _ in range(3000)]
    rows = [(k, None if v is None else float(v) + (rng.random() if v % 3 else 0)) for k, v in rows]
    return rows, frame(spark, rows, "k string, v double").repartition(7)


def test_hot_groups_give_the_same_quantiles(skewed):
    rows, df = skewed
    probabilities = {"a": 0.02, "b": 0.5, "c": 0.95}
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in ranking.quantiles(df, ["k"], "v", probabilities, hot_rows=50).collect()}
    for key in {k for k, _ in rows}:
        known = [v for k, v in rows if k == key and v is not None]
        assert got[key] == pytest.approx(tuple(np.quantile(known, list(probabilities.values()))))


def test_hot_groups_give_the_same_wide_quantiles(spark, skewed):
    rows, df = skewed
    wide = df.withColumn("w", F.col("v") * 2)
    aside = [F.count("v").alias("n")]
    hot = ranking.quantiles_wide(wide, ["k"], ["v", "w"], 0.95, 50, aside).orderBy("k").collect()
    cold = ranking.quantiles_wide(wide, ["k"], ["v", "w"], 0.95, 10**9, aside).orderBy("k").collect()
    assert [(r["k"], r["n"]) for r in hot] == [(r["k"], r["n"]) for r in cold]
    for a, b in zip(hot, cold):
        assert (a["v"], a["w"]) == pytest.approx((b["v"], b["w"]))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_hot_and_cold(skewed, descending):
    rows, df = skewed
    args = (["k"], "v", {"n": F.lit(1)})
    hot = ranking.running_totals(df, *args, descending=descending, hot_rows=50, pieces=8).orderBy("k", "v").collect()
    cold = ranking.running_totals(df, *args, descending=descending).orderBy("k", "v").collect()
    assert hot == cold
    known = sorted(v for k, v in rows if k == "hot" and v is not None)
    for r in hot:
        if r["k"] == "hot":
            earlier = sum(1 for v in known if (v > r["v"] if descending else v < r["v"]))
            assert r["n_before"] == earlier


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"))
    once = splits.shuffle_split(df, "row_id", 4).where("is_test")
    again = splits.shuffle_split(df.repartition(9), "row_id", 4).where("is_test")
    assert {r["n"] for r in once.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {201}
    assert once.exceptAll(again).isEmpty()
    folds = splits.kfold(df, "row_id", 10).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [100] * 7 + [101] * 3
    # folds of different repeats are different draws
    shared = once.where("fold = 0").join(once.where("fold = 1"), "row_id").count()
    assert 20 < shared < 65


def test_group_folds_keep_groups_whole(spark):
    df = spark.range(2000).select(
        F.col("id").alias("row_id"), (F.col("id") * 7919 % 83 % 37).cast("string").alias("g"), (F.col("id") % 5 == 0).cast("int").alias("y")
    )
    for folds in (splits.group_kfold(df, "g", 5), splits.stratified_group_kfold(df, "g", "y", 5)):
        assert folds.count() == 2000
        assert splits.split_groups(folds, "g").isEmpty()
        sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) < 120


def test_impute_median_and_dedup(spark):
    df = frame(spark, [(i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 9.0])], "i int, v double")
    assert [r["v"] for r in aggregates.impute_median(df, ["v"]).orderBy("i").collect()] == [1.0, 2.0, 3.0, 4.0, 9.0]
    twice = df.union(df.withColumn("v", F.lit(0.5)))
    assert {r["v"] for r in aggregates.dedup(twice, ["i"], ["v"]).where("v is not null").collect()} == {0.5}


def test_hot_and_cold_quantiles_are_equal_to_the_last_bit(spark):
    rng = random.Random(11)
    df = frame(spark, [(k, rng.gauss(0, 1) * 10 ** rng.randrange(-6, 6)) for k in range(12) for _ in range(400)], "k int, v double")
    wanted = {f"p{i}": i / 23 for i in range(24)}
    hot = ranking.quantiles(df, ["k"], "v", wanted, hot_rows=50).orderBy("k").collect()
    cold = ranking.quantiles(df, ["k"], "v", wanted).orderBy("k").collect()
    assert hot == cold


@pytest.mark.parametrize("seed", range(6))
def test_a_walk_over_runs_equals_one_over_groups(seed):
    rng = random.Random(seed)
    k = rng.choice([2, 3, 10])
    vectors = [{c: rng.randrange(1, 6) for c in "abc" if rng.random() < 0.7} or {"a": 1} for _ in range(12)]
    runs = [(v, rng.choice([1, 2, 7, 40, 333])) for v in vectors]
    totals = {c: sum(v.get(c, 0) * m for v, m in runs) or 1 for c in "abc"}
    for kind in (splits._lightest, splits._evenest):
        choose, add = kind(k, totals)
        plain = []
        for counts, m in runs:
            plain.append([])
            for _ in range(m):
                f = choose(counts)
                plain[-1].append(f)
                add(counts, [int(j == f) for j in range(k)])
        dealt = [first + [cycle[j % k] for j in range(m - len(first))] for (_, m), (first, cycle) in zip(runs, splits.walk_runs(runs, k, kind(k, totals)))]
        assert dealt == plain


def test_many_equal_groups_take_few_steps():
    steps = []
    choose, add = splits._lightest(5, {})

    def counted(counts):
        steps.append(1)
        return choose(counts)

    found = list(splits.walk_runs([({0: 7}, 3), ({0: 1}, 10**9)], 5, (counted, add)))
    assert len(steps) < 60 and len(found[1][1]) == 5
