"""Queries: ocean-model lags, swath and patch sources, scene quality."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from redtide import constants as K
from redtide.operators import aggregates, joins, matchup
from redtide.plans import pipelines
from redtide.plans.fixtures import BANDS, HALF, fields, view, with_views
from redtide.plans.queries_clean import polygon_sql
from redtide.plans.queries_matchup import ANY_BAND, DAILY, OBS, ROLES, SITES, daily, indexed_sql
from redtide.plans.registry import digits, query, rounded, sql_rounded

# ------------------------------------------------------------------ D6, D8, D9, E2, E3, E21

NEAREST = """spots AS (SELECT DISTINCT latitude, longitude FROM daily WHERE latitude BETWEEN 38 AND 48 AND longitude BETWEEN -72 AND -60),
    ranked AS (SELECT s.latitude, s.longitude, eta, xi, sqrt((s.latitude - g.lat) * (s.latitude - g.lat) + (s.longitude - g.lon) * (s.longitude - g.lon)) AS dist,
      row_number() OVER (PARTITION BY s.latitude, s.longitude ORDER BY sqrt((s.latitude - g.lat) * (s.latitude - g.lat) + (s.longitude - g.lon) * (s.longitude - g.lon)), eta, xi) AS rn
      FROM spots s JOIN fx_grid g ON h > 0 AND abs(s.latitude - g.lat) < 0.1 AND abs(s.longitude - g.lon) < 0.1),
    nearest AS (SELECT * FROM ranked WHERE rn = 1 AND dist <= 0.02)"""


def placed(spark, sf):
    return joins.nearest_cell(daily(spark, sf).select("location_id", "obs_date", "latitude", "longitude"), view(spark, sf, "grid"))


@query(
    "d6_nearest_cell",
    f"""{with_views('obs', 'grid')}, {OBS}, {DAILY}, {NEAREST} SELECT location_id, obs_date, latitude, longitude, eta AS roms_eta, xi AS roms_xi,
    round(dist * 111, 6) AS roms_grid_dist_km, dist IS NOT NULL AS in_domain FROM daily LEFT JOIN nearest USING (latitude, longitude)""",
)
def d6(spark, sf):
    return rounded(placed(spark, sf), ["roms_grid_dist_km"])


LAGGED = """lagged AS (SELECT d.location_id, d.obs_date, lag.delta_days, f.model_date, f.temp_sur, f.u_sur, f.v_sur
    FROM daily d JOIN nearest n USING (latitude, longitude) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) lag(delta_days)
    JOIN fx_fields f ON f.model_date = d.obs_date + lag.delta_days AND f.eta = n.eta AND f.xi = n.xi)"""
LAG_CTES = f"{with_views('obs', 'grid', 'fields')}, {OBS}, {DAILY}, {NEAREST}, {LAGGED}"


def lagged(spark, sf):
    return pipelines.ocean_lags(
        daily(spark, sf).select("location_id", "obs_date", "latitude", "longitude"), view(spark, sf, "grid"), fields(spark, sf)
    )


@query(
    "d8_lag_join",
    f"""{LAG_CTES} SELECT location_id, obs_date, delta_days, model_date AS roms_date, round(temp_sur, 6) AS roms_temp_sur, round(u_sur, 6) AS roms_u_sur,
    round(sqrt(u_sur * u_sur + v_sur * v_sur), 6) AS roms_current_speed FROM lagged""",
)
def d8(spark, sf):
    out = lagged(spark, sf).select("location_id", "obs_date", "delta_days", "roms_date", "roms_temp_sur", "roms_u_sur", "roms_current_speed")
    return rounded(out, ["roms_temp_sur", "roms_u_sur", "roms_current_speed"])


@query(
    "d9_distinct_cells",
    f"""{with_views('obs', 'grid')}, {OBS}, {DAILY}, {NEAREST} SELECT DISTINCT d.obs_date + lag.delta_days AS model_date, n.eta, n.xi FROM daily d JOIN nearest n USING (latitude, longitude)
    CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) lag(delta_days)""",
)
def d9(spark, sf):
    return joins.distinct_cells(placed(spark, sf))


LAG_COLUMNS = ["roms_temp_sur", "roms_u_sur"]


@query(
    "e2_lag_mean",
    f"{LAG_CTES} SELECT location_id, obs_date, round(avg(temp_sur), 6) AS roms_temp_sur, round(avg(u_sur), 6) AS roms_u_sur FROM lagged GROUP BY ALL",
)
def e2(spark, sf):
    return rounded(aggregates.lag_mean(lagged(spark, sf), ["location_id", "obs_date"], LAG_COLUMNS), LAG_COLUMNS)


GAPS = "gaps AS (SELECT location_id, obs_date, delta_days, CASE WHEN delta_days <> -2 OR day(obs_date) % 2 = 0 THEN temp_sur END AS temp_sur, CASE WHEN delta_days > -1 THEN u_sur END AS u_sur FROM lagged)"


@query(
    "e3_lag_first",
    f"""{LAG_CTES}, {GAPS} SELECT location_id, obs_date, round(arg_min(temp_sur, delta_days) FILTER (WHERE temp_sur IS NOT NULL), 6) AS roms_temp_sur,
    round(arg_min(u_sur, delta_days) FILTER (WHERE u_sur IS NOT NULL), 6) AS roms_u_sur,
    round(arg_min(temp_sur, (abs(delta_days), delta_days)) FILTER (WHERE temp_sur IS NOT NULL), 6) AS nearest_temp_sur FROM gaps GROUP BY ALL""",
)
def e3(spark, sf):
    gaps = lagged(spark, sf).withColumns(
        {
            "roms_temp_sur": F.when((F.col("delta_days") != -2) | (F.dayofmonth("obs_date") % 2 == 0), F.col("roms_temp_sur")),
            "roms_u_sur": F.when(F.col("delta_days") > -1, F.col("roms_u_sur")),
        }
    )
    keys = ["location_id", "obs_date"]
    first = aggregates.lag_first(gaps, keys, LAG_COLUMNS)
    nearest = aggregates.lag_first(gaps, keys, ["roms_temp_sur"], "nearest").withColumnRenamed("roms_temp_sur", "nearest_temp_sur")
    return rounded(first.join(nearest, keys), [*LAG_COLUMNS, "nearest_temp_sur"])


@query(
    "e21_lag_report",
    f"{LAG_CTES} SELECT delta_days, count(*) AS n_rows, count(DISTINCT (location_id, obs_date)) AS n_obs FROM lagged GROUP BY 1",
)
def e21(spark, sf):
    return aggregates.lag_report(lagged(spark, sf), ["location_id", "obs_date"])


@query(
    "e21_lag_counts",
    f"""{LAG_CTES}, placed AS (SELECT location_id, obs_date, dist IS NOT NULL AS in_domain FROM daily LEFT JOIN nearest USING (latitude, longitude)),
    kept AS (SELECT * FROM lagged WHERE year(obs_date) >= 2024)
    SELECT count(*) AS n_input, count(*) FILTER (WHERE NOT in_domain) AS n_out_of_domain, count(*) FILTER (WHERE in_domain AND year(obs_date) < 2024) AS n_skipped_year,
    count(*) FILTER (WHERE in_domain AND year(obs_date) >= 2024) AS n_eligible, (SELECT count(*) FROM kept) AS n_rows, (SELECT count(DISTINCT (location_id, obs_date)) FROM kept) AS n_obs,
    {len(K.LAGS)} * count(*) FILTER (WHERE in_domain AND year(obs_date) >= 2024) - (SELECT count(*) FROM kept) AS n_dropped FROM placed""",
)
def e21_counts(spark, sf):
    return aggregates.lag_counts(placed(spark, sf), lagged(spark, sf), ["location_id", "obs_date"], len(K.LAGS), 2024)


# ------------------------------------------------------------------ D7 swath

# the swath of the test reads the same pixels, moved a little so that distances do not tie
SWATH_SQL = """swath AS (SELECT scene_date, scene_no, lat + (l_orderkey % 97) * 0.00001e0 AS lat, lon + (acq_idx % 89) * 0.00001e0 AS lon, b02, b04, b06, b08, b09, b10, b11, b12, b17,
    CASE WHEN quality_flags = 0 THEN 1 ELSE 0 END AS l2_flags FROM fx_pixels)"""
N_SIDE = math.ceil(2 * K.HALF_BOX_DEG / K.SWATH_RESOLUTION_DEG) + 1
STEP = 2 * K.HALF_BOX_DEG / N_SIDE


def _chord(a_lat, a_lon, b_lat, b_lon):
    dx = f"(cos(radians({a_lat})) * cos(radians({a_lon})) - cos(radians({b_lat})) * cos(radians({b_lon})))"
    dy = f"(cos(radians({a_lat})) * sin(radians({a_lon})) - cos(radians({b_lat})) * sin(radians({b_lon})))"
    dz = f"(sin(radians({a_lat})) - sin(radians({b_lat})))"
    return f"6370997e0 * sqrt({dx} * {dx} + {dy} * {dy} + {dz} * {dz})"


RESAMPLED = f"""{SWATH_SQL}, spots AS (SELECT DISTINCT location_id, latitude, longitude FROM daily),
    targets AS (SELECT *, latitude - 0.02e0 + (r + 0.5e0) * {STEP} AS t_lat, longitude - 0.02e0 + (c + 0.5e0) * {STEP} AS t_lon
      FROM spots CROSS JOIN generate_series(0, {N_SIDE - 1}) a(r) CROSS JOIN generate_series(0, {N_SIDE - 1}) b(c)),
    near AS (SELECT location_id, r, c, scene_date, scene_no, s.*, {_chord('t_lat', 't_lon', 's.lat', 's.lon')} AS dist
      FROM targets JOIN swath s ON abs(s.lat - t_lat) < 0.004 AND abs(s.lon - t_lon) < 0.006),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id, scene_date, scene_no, r, c ORDER BY dist, lat, lon, b02, b04, b06, b08, b09, b10, b11, b12, b17, l2_flags) AS rn FROM near WHERE dist <= 400) t WHERE rn = 1)"""


def swath(spark, sf):
    return view(spark, sf, "pixels").selectExpr(
        "scene_date",
        "scene_no",
        "lat + (l_orderkey % 97) * 0.00001e0 AS lat",
        "lon + (acq_idx % 89) * 0.00001e0 AS lon",
        *BANDS,
        "CASE WHEN quality_flags = 0 THEN 1 ELSE 0 END AS l2_flags",
    )


@query(
    "d7_resample_nearest",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, {RESAMPLED} SELECT location_id, scene_date, scene_no, r AS row, c AS col, b04, round(b06, 12) AS b06, l2_flags FROM best""",
)
def d7(spark, sf):
    spots = daily(spark, sf).select("location_id", "latitude", "longitude").distinct()
    out = joins.resample_nearest(spots, swath(spark, sf), ["scene_date", "scene_no"], [*BANDS, "l2_flags"], on=())
    return rounded(out.select("location_id", "scene_date", "scene_no", "row", "col", "b04", "b06", "l2_flags"), ["b06"], 12)


SWATH_ROLES = {b: b for b in BANDS}
SWATH_COLUMNS = ["b06", "b08", "NDCI", "MCI", "FLHmax"]


@query(
    "e5_swath_matchup",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, {RESAMPLED},
    sites AS (SELECT location_id, obs_date, latitude, longitude FROM daily),
    cleared AS (SELECT location_id, scene_date, r, c, {", ".join(f"CASE WHEN l2_flags = 0 THEN {b} END AS {b}" for b in BANDS)} FROM best),
    composite AS (SELECT s.location_id, s.obs_date, r, c, {", ".join(f"max({b}) AS {b}" for b in BANDS)} FROM sites s JOIN cleared k
      ON k.location_id = s.location_id AND k.scene_date BETWEEN s.obs_date - 3 AND s.obs_date GROUP BY ALL),
    {indexed_sql('composite', '*')},
    outline AS (SELECT scene_date, scene_no, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM swath GROUP BY ALL),
    used AS (SELECT location_id, obs_date, count(*) AS n_scenes FROM sites JOIN outline o ON o.scene_date BETWEEN obs_date - 3 AND obs_date
      AND e >= longitude - 0.02 AND w <= longitude + 0.02 AND n >= latitude - 0.02 AND s <= latitude + 0.02 GROUP BY ALL)
    SELECT location_id, obs_date, count(*) FILTER (WHERE {ANY_BAND}) AS n_valid_pixels, round(100e0 * count(*) FILTER (WHERE {ANY_BAND}) / {N_SIDE * N_SIDE}, 6) AS pct_valid_pixels,
    any_value(n_scenes) AS n_scenes, {", ".join(f"floor(quantile_cont({c}, 0.5) * 1e{digits(c)} + 0.5e0) / 1e{digits(c)} AS {c}" for c in SWATH_COLUMNS)}
    FROM indexed JOIN used USING (location_id, obs_date) GROUP BY location_id, obs_date HAVING count(*) FILTER (WHERE {ANY_BAND}) >= 3""",
)
def e5_swath(spark, sf):
    obs = daily(spark, sf).select("location_id", "obs_date", "latitude", "longitude")
    out = pipelines.swath_matchup(obs, swath(spark, sf), ["scene_date", "scene_no"], BANDS, SWATH_ROLES)
    out = out.select("location_id", "obs_date", "n_valid_pixels", "pct_valid_pixels", "n_scenes", *SWATH_COLUMNS)
    return rounded(rounded(out, ["pct_valid_pixels"]), SWATH_COLUMNS, None)


# ------------------------------------------------------------------ E6-E9 patches and scenes

def acquisitions(spark, sf):
    return view(spark, sf, "pixels").withColumn("acq_idx", F.col("l_orderkey") * 100000000 + F.col("acq_idx"))


ORDERED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY loc, px_row, px_col ORDER BY CASE WHEN data_mask = 1 AND b08 > 0 THEN 0 ELSE 1 END, b08 DESC, l_orderkey * 100000000 + acq_idx,
      {", ".join(f"{b} DESC" for b in BANDS)}) AS rn FROM fx_pixels),
    best AS (SELECT loc, px_row, px_col, data_mask = 1 AND b08 > 0 AS optical_valid, {", ".join(f"CASE WHEN data_mask = 1 AND b08 > 0 THEN {b} ELSE 0 END AS {b}" for b in BANDS)} FROM ranked WHERE rn = 1)"""


@query(
    "e6_best_acquisition",
    f"{with_views('pixels')}, {ORDERED} SELECT loc, px_row, px_col, optical_valid, {sql_rounded(BANDS, None)} FROM best",
)
def e6(spark, sf):
    out = matchup.best_acquisition(acquisitions(spark, sf), ["loc", "px_row", "px_col"], BANDS)
    return rounded(out, BANDS, None)


DERIVED = ["chl", "tsm"]
DERIVED_SQL = """products AS (SELECT loc, px_row, px_col, greatest(coalesce(max(CASE WHEN data_mask = 1 THEN kd489 END), 0), 0) AS chl,
      greatest(coalesce(max(CASE WHEN data_mask = 1 THEN iop_apig END), 0), 0) AS tsm FROM fx_pixels GROUP BY ALL),
    product_medians AS (SELECT loc, quantile_cont(CASE WHEN chl > 0 THEN chl END, 0.5) AS chl, quantile_cont(CASE WHEN tsm > 0 THEN tsm END, 0.5) AS tsm FROM products GROUP BY loc)"""


@query(
    "e7_derived_max_median",
    f"{with_views('pixels')}, {DERIVED_SQL} SELECT loc, round(chl, 9) AS chl, round(tsm, 9) AS tsm FROM product_medians",
)
def e7(spark, sf):
    df = view(spark, sf, "pixels").withColumnsRenamed({"kd489": "chl", "iop_apig": "tsm"})
    return rounded(matchup.derived_max_median(df, ["loc", "px_row", "px_col"], ["loc"], DERIVED), DERIVED, 9)


PATCH_COLUMNS = ["b04", "b08", "NDCI", "MCI"]
ALL_POSITIVE = " AND ".join(f"{b} > 0" for b in BANDS)


@query(
    "e8_patch_matchup",
    f"""{with_views('obs', 'pixels')}, keyed AS (SELECT DISTINCT loc, obs_date FROM fx_obs),
    seen AS (SELECT k.obs_date, p.* FROM keyed k JOIN fx_pixels p ON p.loc = k.loc AND p.scene_date BETWEEN k.obs_date - 3 AND k.obs_date),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY loc, obs_date, px_row, px_col ORDER BY CASE WHEN data_mask = 1 AND b08 > 0 THEN 0 ELSE 1 END, b08 DESC, l_orderkey * 100000000 + acq_idx, {", ".join(f"{b} DESC" for b in BANDS)}) AS rn FROM seen),
    best AS (SELECT loc, obs_date, px_row, px_col, data_mask = 1 AND b08 > 0 AS optical_valid, {", ".join(f"CASE WHEN data_mask = 1 AND b08 > 0 THEN {b} ELSE 0 END AS {b}" for b in BANDS)} FROM ranked WHERE rn = 1),
    joint AS (SELECT *, optical_valid AND {ALL_POSITIVE} AS joint_ok FROM best),
    {indexed_sql('joint', '*')},
    optical AS (SELECT loc, obs_date, count(*) AS n_total, count(*) FILTER (WHERE optical_valid) AS n_optical, count(*) FILTER (WHERE joint_ok) AS n_joint,
      {", ".join(f"quantile_cont(CASE WHEN joint_ok THEN {c} END, 0.5) AS {c}" for c in PATCH_COLUMNS)} FROM indexed GROUP BY ALL),
    products AS (SELECT loc, obs_date, px_row, px_col, greatest(coalesce(max(CASE WHEN data_mask = 1 THEN kd489 END), 0), 0) AS chl FROM seen GROUP BY ALL),
    medians AS (SELECT loc, obs_date, quantile_cont(CASE WHEN chl > 0 THEN chl END, 0.5) AS chl FROM products GROUP BY ALL)
    SELECT loc, obs_date, CASE WHEN n_optical >= 3 THEN n_joint ELSE n_optical END AS n_valid_pixels,
      round(100e0 * CASE WHEN n_optical >= 3 THEN n_joint ELSE n_optical END / n_total, 6) AS pct_valid_pixels, round(chl, 9) AS chl,
      {", ".join(f"floor(CASE WHEN n_optical >= 3 THEN {c} END * 1e{digits(c)} + 0.5e0) / 1e{digits(c)} AS {c}" for c in PATCH_COLUMNS)}
    FROM optical JOIN medians USING (loc, obs_date) WHERE (n_optical >= 3 AND n_joint >= 3) OR (n_optical < 3 AND chl IS NOT NULL)""",
)
def e8(spark, sf):
    keyed = view(spark, sf, "obs").select(F.col("loc").alias("location_id"), "obs_date").distinct()
    acq = acquisitions(spark, sf).withColumnsRenamed({"loc": "location_id", "kd489": "chl"})
    out = pipelines.patch_matchup(keyed, acq, BANDS, ["chl"], ROLES)
    out = out.select(F.col("location_id").alias("loc"), "obs_date", "n_valid_pixels", "pct_valid_pixels", "chl", *PATCH_COLUMNS)
    return rounded(rounded(rounded(out, ["pct_valid_pixels"]), ["chl"], 9), PATCH_COLUMNS, None)


@query(
    "e9_scene_cloud_fraction",
    f"""{with_views('pixels')}, aoi AS (SELECT *, {polygon_sql(K.POLYGON_CLOUD, 'lon', 'lat')} AS inside FROM fx_pixels),
    counted AS (SELECT scene_date, scene_no, count(*) FILTER (WHERE inside) AS n_pixels_aoi, count(*) FILTER (WHERE inside AND (cloud_flags & 524288) = 0) AS n_valid,
      count(*) FILTER (WHERE inside AND (cloud_flags & 524288) = 0 AND (cloud_flags & 3072) <> 0) AS n_cloud FROM aoi GROUP BY ALL)
    SELECT *, round(CASE WHEN n_pixels_aoi = 0 THEN NULL WHEN n_valid = 0 THEN 1 ELSE n_cloud / n_valid END, 9) AS cloud_frac,
      coalesce(CASE WHEN n_pixels_aoi = 0 THEN NULL WHEN n_valid = 0 THEN 1 ELSE n_cloud / n_valid END < 0.5, false) AS usable FROM counted""",
)
def e9(spark, sf):
    out = matchup.scene_cloud_fraction(view(spark, sf, "pixels"), ["scene_date", "scene_no"], flags="cloud_flags")
    return rounded(out, ["cloud_frac"], 9)
