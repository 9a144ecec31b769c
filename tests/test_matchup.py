"""Hand-made matchup cases and brute-force comparisons of the bucket joins."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redtide import constants as K
from redtide.functions.geo import inside_polygon, utm_xy
from redtide.operators import aggregates, clean, joins, matchup

DAY = dt.date(2024, 1, 10)
BANDS = ["a", "b"]


def test_scene_after_the_observation_is_not_matched(spark):
    obs = spark.createDataFrame([(1, DAY)], "id int, obs_date date")
    scenes = spark.createDataFrame([(DAY + dt.timedelta(days=d), d) for d in range(-5, 3)], "scene_date date, d int")
    assert sorted(r["d"] for r in joins.window_join(obs, scenes).collect()) == [-3, -2, -1, 0]
    assert sorted(r["d"] for r in joins.window_join(obs, scenes, 1, 1).collect()) == [-1, 0, 1]


def test_box_join_equals_brute_force(spark):
    rng = random.Random(3)
    half = 0.02
    # many points exactly on cell and box borders
    pick = lambda: rng.choice([rng.uniform(40, 40.3), 40 + half * rng.randrange(12), 40 + half * rng.randrange(12) + 1e-9])
    sites = [(i, pick(), pick() - 110) for i in range(60)]
    pixels = [(i, pick(), pick() - 110) for i in range(400)]
    left = spark.createDataFrame(sites, "s int, latitude double, longitude double")
    right = spark.createDataFrame(pixels, "p int, lat double, lon double")
    want = {(s, p) for s, a, b in sites for p, c, d in pixels if abs(c - a) <= half and abs(d - b) <= half}
    for salts in (1, 4):
        got = joins.box_join(left, right, half, on=(), salts=salts).select("s", "p").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_nearest_cell_equals_brute_force(spark):
    rng = random.Random(4)
    obs = [(i, 41 + rng.random() * 0.2, -70 + rng.random() * 0.2) for i in range(80)]
    grid = [(i, i % 7, 41 + rng.random() * 0.2, -70 + rng.random() * 0.2, rng.choice([-1.0, 5.0, 9.0])) for i in range(300)]
    got = joins.nearest_cell(
        spark.createDataFrame(obs, "id int, latitude double, longitude double"),
        spark.createDataFrame(grid, "eta int, xi int, lat double, lon double, h double"),
    ).collect()
    assert len(got) == 80
    for r in got:
        best = min((math.hypot(r["latitude"] - g[2], r["longitude"] - g[3]), g[0]) for g in grid if g[4] > 0)
        assert r["roms_eta"] == (best[1] if best[0] <= 0.02 else None)
        assert r["in_domain"] == (best[0] <= 0.02)


def test_resample_equals_brute_force(spark):
    rng = random.Random(5)
    lat0, lon0, half, side = 43.0, -69.0, 0.02, 15
    pixels = [(lat0 + rng.uniform(-0.03, 0.03), lon0 + rng.uniform(-0.04, 0.04), float(i)) for i in range(150)]
    sites = spark.createDataFrame([("x", lat0, lon0)], "location_id string, latitude double, longitude double")
    swath = spark.createDataFrame(pixels, "lat double, lon double, v double").withColumn("scene", F.lit(1))
    got = {
        (r["row"], r["col"]): r["v"] for r in joins.resample_nearest(sites, swath, ["scene"], ["v"], on=()).collect()
    }
    assert joins.swath_side() == side

    def xyz(lat, lon):
        phi, lam = math.radians(lat), math.radians(lon)
        return np.array([math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)]) * 6370997.0

    spots = np.array([xyz(a, b) for a, b, _ in pixels])
    step = 2 * half / side
    for row in range(side):
        for col in range(side):
            dist = np.linalg.norm(spots - xyz(lat0 - half + (row + 0.5) * step, lon0 - half + (col + 0.5) * step), axis=1)
            want = pixels[dist.argmin()][2] if dist.min() <= 400 else None
            assert got.get((row, col)) == want


def test_polygon_leaves_its_border_out(spark):
    (x1, y1), (x2, y2) = K.POLYGON_MATCHUP[:2]
    cases = [(-68.0, 42.0, True), (x1, y1, False), ((x1 + x2) / 2, (y1 + y2) / 2, False), (-60.5, 45.0, False), (-72.9, 42.0, False)]
    df = spark.createDataFrame(cases, "lon double, lat double, want boolean")
    bad = df.where(inside_polygon(F.col("lon"), F.col("lat"), K.POLYGON_MATCHUP) != F.col("want"))
    assert bad.isEmpty()


def test_utm_against_another_series(spark):
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    points = [(lat, lon) for lat in (38.2, 41.0, 44.9) for lon in (-71.9, -69.0, -66.1)]
    x, y = utm_xy(F.col("lat"), F.col("lon"))
    got = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", x.alias("x"), y.alias("y")).collect()
    for r in got:
        s = math.sin(math.radians(r["lat"]))
        t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
        lam = math.radians(r["lon"] + 69)
        xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
        east = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
        north = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
        assert r["x"] == pytest.approx(500000 + 0.9996 * radius * east, abs=0.002)
        assert r["y"] == pytest.approx(0.9996 * radius * north, abs=0.002)


def pixels_of(spark, rows):
    return spark.createDataFrame(rows, "scene int, location_id string, a double, b double, quality_flags long, ac_flags long")


def test_grid_mask_falls_back_per_scene_and_location(spark):
    ok, bad = (2, 1 << 31), (0, 1 << 31)
    rows = [
        (1, "x", 1.0, -1.0, *ok),  # flags decide here, whatever the bands
        (1, "x", 1.0, 1.0, *bad),
        (2, "x", 1.0, 1.0, *bad),  # no pixel passes the flags: bands above zero decide
        (2, "x", 1.0, 0.0, *bad),
        (2, "x", float("nan"), 1.0, *bad),
    ]
    out = matchup.mask_grid_pixels(pixels_of(spark, rows), ["scene", "location_id"], BANDS).orderBy("scene", "b").collect()
    kept = [(r["scene"], r["a"], r["b"]) for r in out if r["pixel_ok"]]
    # a NaN compares above zero here but must not survive as a value
    assert (1, 1.0, -1.0) in kept and (2, 1.0, 1.0) in kept
    assert all(r["a"] is None or r["a"] == 1.0 for r in out)
    assert len([r for r in out if r["scene"] == 1 and r["pixel_ok"]]) == 1


def test_mvc_takes_the_valid_scene_and_summary_needs_three_pixels(spark):
    rows = [("o", 1, None, None), ("o", 1, 5.0, None), ("o", 2, 1.0, 2.0), ("o", 2, 3.0, 1.0), ("o", 3, None, None)]
    df = spark.createDataFrame(rows, "obs string, px int, a double, b double")
    composite = matchup.mvc(df, ["obs", "px"], BANDS)
    assert {r["px"]: (r["a"], r["b"]) for r in composite.collect()} == {1: (5.0, None), 2: (3.0, 2.0), 3: (None, None)}
    assert matchup.spatial_summary(composite, ["obs"], BANDS, BANDS).isEmpty()
    kept = matchup.spatial_summary(composite, ["obs"], BANDS, BANDS, min_valid=2).first()
    assert (kept["n_valid_pixels"], kept["a"], kept["b"]) == (2, 4.0, 2.0)
    assert kept["pct_valid_pixels"] == pytest.approx(200 / 3)
    strict = matchup.spatial_summary(composite, ["obs"], BANDS, BANDS, min_valid=1, require_all=True).first()
    assert strict["n_valid_pixels"] == 1


def test_best_acquisition_ties_keep_the_first(spark):
    rows = [(1, 0, 0.2, 9.0, 1), (1, 1, 0.5, 7.0, 1), (1, 2, 0.5, 8.0, 1), (1, 3, 0.9, 1.0, 0), (2, 0, 0.0, 5.0, 1)]
    df = spark.createDataFrame(rows, "px int, acq_idx int, b08 double, b02 double, data_mask int")
    out = {r["px"]: r for r in matchup.best_acquisition(df, ["px"], ["b02", "b08"]).collect()}
    assert (out[1]["b02"], out[1]["b08"], out[1]["optical_valid"]) == (7.0, 0.5, True)
    assert (out[2]["b02"], out[2]["optical_valid"]) == (0.0, False)


def test_accept_matchups(spark):
    rows = [(1, 5, 4, 9, 1.0, 2.0), (2, 5, 2, 9, 1.0, 2.0), (3, 2, 2, 9, 1.0, 2.0), (4, 2, 2, 9, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, n_optical int, n_joint int, n_total int, b double, chl double")
    out = {r["i"]: r for r in matchup.accept_matchups(df, ["b"], ["chl"]).collect()}
    assert set(out) == {1, 3}
    assert (out[1]["n_valid_pixels"], out[1]["b"]) == (4, 1.0)
    assert (out[3]["n_valid_pixels"], out[3]["b"], out[3]["chl"]) == (2, None, 2.0)


def test_cloud_fraction_of_empty_and_invalid_scenes(spark):
    rows = [(1, -68.0, 42.0, 0), (1, -68.1, 42.0, 1 << 10), (2, -68.0, 42.0, 1 << 19), (3, 10.0, 42.0, 0)]
    df = spark.createDataFrame(rows, "s int, lon double, lat double, quality_flags long")
    out = {r["s"]: (r["cloud_frac"], r["usable"]) for r in matchup.scene_cloud_fraction(df, ["s"]).collect()}
    assert out == {1: (0.5, False), 2: (1.0, False), 3: (None, False)}


def test_missing_model_day_drops_the_lag(spark):
    obs = spark.createDataFrame([(DAY, 1, 1)], "obs_date date, roms_eta int, roms_xi int")
    days = [DAY + dt.timedelta(days=d) for d in (-2, 0, 1, 2)]
    fields = spark.createDataFrame([(d, 1, 1, 3.0, 4.0) for d in days], "model_date date, eta int, xi int, u_sur double, v_sur double")
    out = joins.lag_join(obs, fields).collect()
    assert sorted(r["delta_days"] for r in out) == [-2, 0, 1, 2]
    assert {r["roms_current_speed"] for r in out} == {5.0}


def test_labels_and_targets_of_missing_values(spark):
    df = spark.createDataFrame([(1, None, 500.0), (2, 100.0, None), (3, 101.0, 99.0)], "i int, s double, t double")
    limits = clean.thresholds(spark, {"s": {"warning": 100}, "t": {"warning": 100}})
    got = {(r["i"], r["species"]): r["y"] for r in clean.label_long(df, limits, ["i"], ["s", "t"]).collect()}
    assert got == {(1, "s"): 0, (1, "t"): 1, (2, "s"): 0, (2, "t"): 0, (3, "s"): 1, (3, "t"): 0}
    targets = aggregates.bloom_targets(df, ["s", "t"], {"s": 100.0, "t": 100.0}, min_n=1).orderBy("i").collect()
    assert [(r["i"], r["y_s"] is None, r["y_t"] is None) for r in targets] == [(1, True, False), (3, False, True)]


def test_station_override_and_exclusion(spark):
    rows = [(1, "mvco", "zz", 1.0, 1.0, 20), (2, "mvco", "aa", 2.0, 2.0, 10), (3, "nauset", "n", 3.0, 3.0, 1), (4, None, "q", 4.0, 4.0, 1)]
    df = spark.createDataFrame(rows, "bin_id int, dashboardIdName string, location_id string, latitude double, longitude double, datetime int")
    kept = clean.exclude_stations(df)
    assert sorted(r["bin_id"] for r in kept.collect()) == [1, 2, 4]
    out = {r["bin_id"]: r for r in clean.override_stations(kept).collect()}
    assert out[1]["location_id"] == out[2]["location_id"] == "aa"
    assert (out[1]["latitude"], out[1]["longitude"]) == (41.325, -70.566)
    assert (out[4]["location_id"], out[4]["latitude"]) == ("q", 4.0)


def test_sites_that_share_a_label_have_different_ids(spark):
    df = spark.range(300_000).selectExpr("36 + pmod(xxhash64(id), 120000) / 10000 AS latitude", "-78 + pmod(xxhash64(id, 7), 140000) / 10000 AS longitude")
    lat, lon = F.col("latitude"), F.col("longitude")
    ids, labels, places = (F.countDistinct(c) for c in (clean.location_id(lat, lon), clean.location_label(lat, lon), F.struct(lat, lon)))
    row = df.agg(ids.alias("ids"), labels.alias("labels"), places.alias("places")).first()
    assert row.ids == row.places > row.labels
