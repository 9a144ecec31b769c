"""Metrics, tests and blocks against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redtide.functions.scalars import normal_two_sided_p
from redtide.operators import blocking, experiments, metrics, models, significance


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(11)
    rows = []
    for fold in range(4):
        for i in range(120):
            y = int(rng.random() < 0.3) if fold < 3 else 0
            rows.append((fold, i, y, int(rng.random() < 0.4), round(min(1.0, max(0.0, 0.3 * y + rng.random() * 0.7)), 1)))
    return rows, spark.createDataFrame(rows, "fold int, row_id int, y_true int, y_pred int, score double")


def curve_of(rows):
    """(recall, precision) ascending in recall as sklearn lists it: lowest score last."""
    pos = sum(r[2] for r in rows)
    points = [(0.0, 1.0)]
    for score in sorted({r[4] for r in rows}, reverse=True):
        tp = sum(1 for r in rows if r[4] >= score and r[2])
        n = sum(1 for r in rows if r[4] >= score)
        points.append((tp / pos, tp / n))
    return points


@pytest.mark.parametrize("hot_rows", [10**9, 40])
def test_average_precision_with_ties(predictions, hot_rows):
    rows, df = predictions
    got = {r["fold"]: r["prauc"] for r in metrics.average_precision(df, ["fold"], hot_rows).collect()}
    for fold in range(3):
        points = curve_of([r for r in rows if r[0] == fold])
        want = sum((b[0] - a[0]) * b[1] for a, b in zip(points, points[1:]))
        assert got[fold] == pytest.approx(want)
    assert got[3] is None


def test_pr_curve_equals_interp(predictions):
    rows, df = predictions
    got = metrics.fold_pr_curve(df, ["fold"]).collect()
    assert {r["fold"] for r in got} == {0, 1, 2}
    for fold in range(3):
        points = curve_of([r for r in rows if r[0] == fold])
        pos = sum(r[2] for r in rows if r[0] == fold)
        for r in got:
            exact_hit = r["slot"] * pos % 99 == 0 and 0 < r["slot"] < 99
            if r["fold"] == fold and not exact_hit:  # hits depend on rounding in numpy
                want = np.interp(r["slot"] / 99, [p[0] for p in points], [p[1] for p in points])
                assert r["precision"] == pytest.approx(want)


def test_zero_positive_folds(predictions):
    _, df = predictions
    random_f1 = {r["fold"]: r["f1"] for r in metrics.prf(df, ["fold"]).collect()}
    spatial_f1 = {r["fold"]: r["f1"] for r in metrics.prf(df, ["fold"], zero_pos_null=True).collect()}
    assert random_f1[3] == 0.0 and spatial_f1[3] is None
    assert random_f1[0] == spatial_f1[0]


def test_regression_metrics_on_large_values(spark):
    rng = random.Random(2)
    rows = [(1, 1e6 + rng.random(), 1e6 + rng.random()) for _ in range(50)] + [(2, 1.0, 1.0)] * 4
    df = spark.createDataFrame(rows, "fold int, y_true double, y_pred double").withColumn("z", F.lit(0))
    shifted = df.withColumns({"y_true": F.col("y_true") / 1e6, "y_pred": F.col("y_pred") / 1e6})
    got = metrics.regression_metrics(shifted, ["fold"]).collect()
    assert [r["fold"] for r in got] == [1]
    y = np.array([r[1] for r in rows[:50]]) / 1e6
    p = np.array([r[2] for r in rows[:50]]) / 1e6
    assert got[0]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6)


def test_mann_whitney_golden_case(spark):
    # 50 against 50 values with U = 502
    rows = [("A", "A_roms", float(b)) for b in range(1, 51)] + [("A", "A_only", 10.5)] * 48 + [("A", "A_only", 11.5)] * 2
    df = spark.createDataFrame(rows, "ac string, track string, f1 double").withColumns({"tier": F.lit("t"), "species": F.lit("s")})
    r = significance.mann_whitney(df, ["f1"]).first()
    assert r["U_stat"] == 502.0
    assert r["rbc"] == pytest.approx(0.5984)
    assert r["effect_size"] == "large" and r["direction"] == "roms_better" and r["significant"]
    ties = (48**3 - 48) + (2**3 - 2)
    spread = math.sqrt(2500 / 12 * (101 - ties / (100 * 99)))
    assert r["p_value"] == pytest.approx(math.erfc((2500 - 502 - 1250 - 0.5) / spread / math.sqrt(2)), rel=1e-9)


def test_small_samples_are_tested_exactly(spark):
    rng = random.Random(1)
    cells = [("x", [rng.random() for _ in range(4)], [rng.random() + 0.4 for _ in range(7)]), ("y", [1.0, 2.0], [3.0, 4.0, 5.0])]
    rows = [(k, t, v) for k, a, b in cells for t, vs in (("A_only", a), ("A_roms", b)) for v in vs]
    df = spark.createDataFrame(rows, "species string, track string, f1 double").withColumns({"tier": F.lit("t"), "ac": F.lit("A")})
    got = {r["species"]: (r["U_stat"], r["p_value"]) for r in significance.mann_whitney(df, ["f1"]).collect()}
    for k, a, b in cells:
        u = sum(x > y for x in a for y in b)
        m, n = len(a), len(b)
        # all ways to place sample a among the ranks
        us = [sum(c) - m * (m - 1) // 2 for c in itertools.combinations(range(m + n), m)]
        want = min(1.0, 2 * sum(v >= max(u, m * n - u) for v in us) / len(us))
        assert got[k] == (u, pytest.approx(want))


def test_normal_tail(spark):
    zs = [0.001, 0.005, 0.02, 0.3, 1.0, 1.96, 3.3, 4.5, 6.0, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided_p(F.col("z")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), rel=1e-9)


def test_quadtree_splits_above_thirty(spark):
    # two clumps in a wide box, of 30 and of 31 points
    rows = [(float(i), 100.0) for i in range(30)] + [(900_000.0 + 20_000 * (i % 2), 900_000.0 + 20_000 * (i // 2 % 2)) for i in range(31)]
    df = spark.createDataFrame(rows, "x_m double, y_m double")
    out = blocking.quadtree_blocks(df).groupBy("block_id").count().collect()
    sizes = sorted(r["count"] for r in out)
    assert sizes[-1] == 30 and sum(sizes) == 61
    clump = [r for r in out if r["count"] == 30]
    assert len(clump[0]["block_id"]) == 3  # a leaf at depth 2


def test_sparse_blocks_merge_or_go(spark):
    rows = [("big", 0.0, 0.0)] * 6 + [("near", 2_500.0, 0.0)] * 2 + [("far", 50_000.0, 0.0)] * 3
    df = spark.createDataFrame(rows, "block_id string, x_m double, y_m double")
    got = {r["block_id"]: r["count"] for r in blocking.merge_sparse_blocks(df, 5, 1_000).groupBy("block_id").count().collect()}
    assert got == {"big": 8}
    unlimited = blocking.merge_sparse_blocks(df, 5, None).groupBy("block_id").count().collect()
    assert {r["block_id"]: r["count"] for r in unlimited} == {"big": 11}
    assert blocking.merge_sparse_blocks(df.where("block_id = 'far'"), 5, 1_000).count() == 3


@pytest.mark.parametrize("radius", [1_500.0, 4_000.0])
def test_moran_with_repeated_positions(spark, radius):
    rng = random.Random(9)
    places = [(rng.uniform(0, 12_000), rng.uniform(0, 12_000)) for _ in range(40)] + [(90_000.0, 90_000.0)]
    rows = [(i, *places[i % 41], rng.random() * (i % 41)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, x_m double, y_m double, v double")
    got = blocking.moran_sweep(df, "id", "v", [radius], sample_n=None).first()["moran_i"]
    xy, v = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    dist = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    w = (dist <= radius).astype(float)
    np.fill_diagonal(w, 0)
    degree = w.sum(axis=1)
    w = w / np.maximum(degree, 1)[:, None]
    z = v - v.mean()
    assert got == pytest.approx(len(v) / w.sum() * (z @ w @ z) / (z @ z))


def test_cluster_blocks_weigh_repeated_positions(spark):
    rows = [(0.0, 0.0)] * 90 + [(1e5, 1e5)] * 15 + [(1e5, 1e5 + 10)] * 15 + [(2e5, 0.0)] * 30
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(999, None, 1.0)], "id int, x_m double, y_m double")
    got = blocking.cluster_blocks(df).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.min("x_m").alias("x"), F.max("x_m").alias("y")).collect()
    assert sorted((r.n, r.x, r.y) for r in got) == [(30, 1e5, 1e5), (30, 2e5, 2e5), (90, 0.0, 0.0)]
    assert blocking.cluster_blocks(df.limit(0)).collect() == []


def test_cluster_blocks_are_bounded_and_compact(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.uniform(0, 1e5, (40, 2))
    xy = np.vstack([centres[rng.integers(0, 40, 2500)] + rng.normal(0, 300, (2500, 2)), rng.uniform(0, 1e5, (900, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x_m double, y_m double")
    found = {r.id: r.block_id for r in blocking.cluster_blocks(df).collect()}
    members = {}
    for i, block in found.items():
        members.setdefault(block, []).append(i)
    assert len(found) == 3400 and all(21 <= len(m) <= 39 for m in members.values())
    some = xy[np.argsort(xy[:, 0])][:1000]

    def spread(rounds):
        monkeypatch.setattr(blocking, "MOST_ROUNDS", rounds)
        own = blocking.bounded_clusters(some, np.ones(1000), 30, 21, 39)
        return sum(((some[own == c] - some[own == c].mean(0)) ** 2).sum() for c in range(own.max() + 1))

    assert spread(50) < 0.8 * spread(0)



def test_forest_learns_and_repeats(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 20).cast("double").alias("x"),
        (F.col("id") * 7 % 13).cast("double").alias("noise"),
        (F.col("id") % 20 > 14).cast("int").alias("y"),
    )
    first = models.fit_forest(df, ["x", "noise"], "y", trees=10, max_depth=4)
    second = models.fit_forest(df, ["x", "noise"], "y", trees=10, max_depth=4)
    a = models.predict(first, df, ["x", "noise"], ["row_id"], "y")
    b = models.predict(second, df, ["x", "noise"], ["row_id"], "y")
    assert a.exceptAll(b).isEmpty()
    assert metrics.prf(a.withColumn("k", F.lit(1)), ["k"]).first()["f1"] > 0.95
    lost = {r["feature"]: r["perm_mean"] for r in models.permutation_importance(first, df, "row_id", ["x", "noise"], "y", repeats=3).collect()}
    assert lost["x"] > 0.3 > abs(lost["noise"])


@pytest.mark.parametrize("m,n,u", [(8, 1000, 8000), (8, 5000, 40_000), (2, 3, 5), (5, 7, 30), (8, 200, 1100)])
def test_exact_rank_tail_counts_orderings(m, n, u):
    """Against the number of ways to choose m ranks with a sum, counted one rank at a time."""
    from math import comb

    from redtide.operators.significance import exact_tail

    low = m * n - u
    # parts of at most n, at most m of them: partitions of j that fit in an m x n box
    box = [1] + [0] * low
    for i in range(1, m + 1):
        for j in range(i, low + 1):
            box[j] += box[j - i]
    for i in range(1, m + 1):
        for j in range(low, n + i - 1, -1):
            box[j] -= box[j - n - i]
    assert exact_tail(float(u), m, n) == min(1.0, 2 * sum(box) / comb(m + n, m))


def test_exact_rank_tail_of_separated_samples():
    from math import comb

    from redtide.operators.significance import exact_tail

    for n in (10, 1000, 5000):
        assert exact_tail(8.0 * n, 8, n) == 2 / comb(n + 8, 8)
    for u in range(12, 25):
        assert 0 < exact_tail(float(u), 4, 6) <= 1


def test_moran_draws_agree_with_shuffling_by_hand(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(k, float(rng.integers(0, 5)), float(rng.integers(0, 5)), float(rng.normal())) for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, x_m double, y_m double, v double")
    draws = [r["moran_i"] for r in blocking.moran_permutations(df, "id", "v", 1.5, 40).collect()]
    xy, v = np.array([(r[1], r[2]) for r in rows]), np.array([r[3] for r in rows])
    near = (np.linalg.norm(xy[:, None] - xy[None, :], axis=2) <= 1.5) & ~np.eye(60, dtype=bool)
    z, deg = v - v.mean(), near.sum(1)
    by_hand = []
    for _ in range(400):
        p = rng.permutation(z)
        by_hand.append(60 / (deg > 0).sum() * (p * (near @ p) / np.maximum(deg, 1)).sum() / (z * z).sum())
    assert len(draws) == 40 and len(set(draws)) > 30
    assert abs(np.mean(draws) - np.mean(by_hand)) < 4 * np.std(by_hand) / np.sqrt(40)
    assert 0.5 < np.std(draws) / np.std(by_hand) < 2


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 1023])
def test_a_draw_is_a_permutation_and_the_same_on_columns(spark, n):
    seats = np.arange(n)
    drawn = [blocking.drawn_seat(seats, np.int64(p), n) for p in (1, 2, 999)]
    assert all(sorted(d) == list(range(n)) for d in drawn)
    on_columns = spark.range(n).select("id", *[blocking.drawn_seat(F.col("id"), F.lit(p).cast("bigint"), n).alias(f"p{p}") for p in (1, 2, 999)]).orderBy("id").collect()
    assert [[r[k + 1] for r in on_columns] for k in range(3)] == [list(d) for d in drawn]
    if n == 1000:
        moved = np.array([blocking.drawn_seat(seats, np.int64(p), n) for p in range(1, 801)])
        assert abs(moved.mean(0) - 499.5).max() < 5.5 * 288.7 / np.sqrt(800)  # every seat gets values from everywhere
        assert abs((moved == seats).sum(1).mean() - 1) < 0.25  # one fixed point on average
        assert abs((np.diff(moved, axis=1) == 1).sum(1).mean() - 1) < 0.25  # neighbours part


def test_draws_are_the_same_in_tiles_and_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    xy = np.repeat(rng.uniform(0, 30, (40, 2)), [60, *[1 + k % 3 for k in range(39)]], axis=0)  # one busy mooring
    rows = [(k, float(x), float(y), float(v)) for k, ((x, y), v) in enumerate(zip(xy, rng.normal(size=len(xy))))]
    df = spark.createDataFrame(rows, "id int, x_m double, y_m double, v double")
    monkeypatch.setattr(blocking, "SEATS", 16)
    ways = [blocking.moran_permutations(df, "id", "v", 5.0, 12, **kw).orderBy("perm").collect() for kw in ({}, {"drawn_rows": 5}, {"tile_most": 8})]
    z, n = np.array([r[3] for r in rows]), len(rows)
    z = z - z.mean()
    near = (np.linalg.norm(xy[:, None] - xy[None], axis=2) <= 5) & ~np.eye(n, dtype=bool)
    order = sorted(range(n), key=lambda k: (spark_hash(k), k))
    deg, by_hand = near.sum(1), []
    for p in range(1, 13):
        drawn = np.empty(n)
        drawn[order] = z[order][blocking.drawn_seat(np.arange(n), np.int64(p), n)]
        by_hand.append(n / (deg > 0).sum() * (drawn * (near @ drawn) / np.maximum(deg, 1)).sum() / (z * z).sum())
    for way in ways:
        assert [r.perm for r in way] == list(range(1, 13))
        assert np.allclose([r.moran_i for r in way], by_hand)


def spark_hash(ident):
    """`portable_hash` in plain integers."""
    mixed = (ident % 2147483647 * 48271 + 42) % 2147483647
    return ((mixed % 46337) * (mixed % 46339) + mixed) % 2147483647 * 69621 % 2147483647


@pytest.mark.parametrize("most", [8192, 60, 1])
def test_sums_in_reach_of_crowded_tiles(spark, most):
    rng = np.random.default_rng(6)
    xy = np.vstack([rng.normal(0, 3, (300, 2)), rng.uniform(-40, 40, (100, 2))])
    v = rng.normal(size=400)
    places = spark.createDataFrame([(f"p{k}", *map(float, p), 1.0, float(z)) for k, (p, z) in enumerate(zip(xy, v))], "id string, x_m double, y_m double, n double, z double")
    dist = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    found = {(r.radius_m, r.id): r for r in blocking.reach_sums(places, [2.0, 9.0], ["n", "z"], most).collect()}
    assert len(found) == 800
    for radius in (2.0, 9.0):
        near = dist <= radius
        assert all(found[radius, f"p{k}"].n == near[k].sum() and found[radius, f"p{k}"].z == pytest.approx(near[k] @ v) for k in range(400))


def test_regression_matrix(spark):
    rng = random.Random(5)
    rows = [(k, x := rng.random(), rng.random(), 3 * x + 1.0 if k % 4 else None, 2.0 - x) for k in range(120)]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, y_one double, y_two double")
    asked = experiments.Matrix({"t": ["a", "b"]}, {"warning": {"one": "y_one", "two": "y_two"}}, regression=True, trees=20)
    pred, _ = experiments.run_experiments(df, "row_id", experiments.random_folds(df, "row_id", 2), asked)
    found = {(r.fold, r.species): r for r in metrics.regression_metrics(pred, ["track", "tier", "fold", "species"]).collect()}
    assert set(found) == {(f, s) for f in (0, 1) for s in ("one", "two")}
    assert all(r.r2 > 0.5 for r in found.values()) and found[0, "two"].n_valid == 24
