"""Queries: pixel matchup, ocean-model lags, the three sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from redtide import constants as K
from redtide.functions.spectral import spectral_indices
from redtide.operators import aggregates, clean, joins, matchup
from redtide.plans import pipelines
from redtide.plans.fixtures import BANDS, HALF, SPECIES, view, with_views
from redtide.plans.registry import query, r, rounded, sql_rounded
from redtide.session import written

ROLES = {b: b for b in BANDS}
LOCATION_SQL = (
    "lpad(cast((cast(round(latitude * 10000) AS bigint) + 900000) * 3600001 + cast(round(longitude * 10000) AS bigint) + 1800000"
    " AS varchar), 13, '0')"
)
LABEL_SQL = (
    "lpad(cast((((cast(round(latitude * 10000) AS bigint) * 73856093 + cast(round(longitude * 10000) AS bigint) * 19349663)"
    " % 100000000) + 100000000) % 100000000 AS varchar), 8, '0')"
)


def located(spark, sf):
    return clean.with_location_id(view(spark, sf, "obs"))


def daily(spark, sf):
    return aggregates.daily_p95(located(spark, sf), SPECIES, ["latitude", "longitude", "station", "depth"])


OBS = f"obs AS (SELECT *, {LOCATION_SQL} AS location_id FROM fx_obs)"
DAILY = (
    "daily AS (SELECT location_id, obs_date, "
    + ", ".join(f"arg_min({c}, (sample_time, bin_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ["latitude", "longitude", "station", "depth"])
    + ", "
    + ", ".join(f"quantile_cont({s}, 0.95) AS {s}" for s in SPECIES)
    + " FROM obs GROUP BY location_id, obs_date)"
)


@query(
    "e1_daily_p95",
    f"{with_views('obs')}, {OBS}, {DAILY} SELECT location_id, obs_date, latitude, longitude, station, depth, {sql_rounded(SPECIES)} FROM daily",
)
def e1(spark, sf):
    return rounded(daily(spark, sf), SPECIES)


# ------------------------------------------------------------------ window and box joins

SITES = "sites AS (SELECT DISTINCT location_id, latitude, longitude, obs_date FROM daily)"


@query(
    "d4_window_join",
    f"""{with_views('obs', 'pixels')}, {OBS}, sites AS (SELECT DISTINCT location_id, obs_date FROM obs),
    scenes AS (SELECT scene_date, scene_no, count(*) AS n_pixels FROM fx_pixels GROUP BY ALL)
    SELECT location_id, obs_date, scene_date, scene_no, n_pixels
    FROM sites JOIN scenes ON scene_date BETWEEN obs_date - 3 AND obs_date""",
)
def d4(spark, sf):
    sites = located(spark, sf).select("location_id", "obs_date").distinct()
    scenes = view(spark, sf, "pixels").groupBy("scene_date", "scene_no").agg(F.count(F.lit(1)).alias("n_pixels"))
    return joins.window_join(sites, scenes).select("location_id", "obs_date", "scene_date", "scene_no", "n_pixels")


MATCHED = f"""matched AS (SELECT s.location_id, s.obs_date, p.* FROM sites s JOIN fx_pixels p
    ON p.scene_date BETWEEN s.obs_date - 3 AND s.obs_date
    AND abs(p.lat - s.latitude) <= {HALF} AND abs(p.lon - s.longitude) <= {HALF})"""


@query(
    "d5_box_join",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, {SITES}, {MATCHED}
    SELECT location_id, obs_date, count(*) AS n_pixels, count(DISTINCT scene_date) AS n_days, round(sum(b06), 12) AS sum_b06
    FROM matched GROUP BY ALL""",
)
def d5(spark, sf):
    spots = pipelines.site_days(daily(spark, sf))
    return (
        joins.box_join(spots, view(spark, sf, "pixels"), HALF)
        .withColumn("obs_date", F.explode("obs_dates"))
        .groupBy("location_id", "obs_date")
        .agg(F.count(F.lit(1)).alias("n_pixels"), F.countDistinct("scene_date").alias("n_days"), r(F.sum("b06"), 12).alias("sum_b06"))
    )


IOPS = ["kd489", "iop_apig"]
FLAG_OK = "((quality_flags & 2) <> 0 AND (ac_flags & 2147483648) <> 0)"
ALL_POSITIVE = "(" + " AND ".join(f"{b} > 0" for b in BANDS) + ")"
MASKED = f"""flagged AS (SELECT *, max(CASE WHEN {FLAG_OK} THEN 1 ELSE 0 END) OVER (PARTITION BY location_id, obs_date, scene_date, scene_no) AS flag_any FROM matched),
    checked AS (SELECT *, CASE WHEN flag_any = 1 THEN {FLAG_OK} ELSE {ALL_POSITIVE} END AS pixel_ok FROM flagged),
    masked AS (SELECT location_id, obs_date, scene_date, scene_no, pixel_ok,
      cast(round(lat * 1000000) AS bigint) AS lat_px, cast(round(lon * 1000000) AS bigint) AS lon_px,
      {", ".join(f"CASE WHEN pixel_ok THEN {b} END AS {b}" for b in BANDS)},
      {", ".join(f"CASE WHEN pixel_ok AND {c} > 0 THEN {c} END AS {c}" for c in IOPS)} FROM checked)"""


def candidates(spark, sf):
    return joins.box_join(pipelines.site_days(daily(spark, sf)), view(spark, sf, "pixels"), HALF)


def masked(spark, sf):
    return matchup.mask_iops(
        matchup.mask_grid_pixels(written(candidates(spark, sf)), ["location_id", "scene_date", "scene_no"], BANDS), IOPS
    )


@query(
    "b11_grid_pixel_mask",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, {SITES}, {MATCHED}, {MASKED}
    SELECT location_id, obs_date, scene_date, scene_no, count(*) AS n_pixels, count(*) FILTER (WHERE pixel_ok) AS n_ok,
    round(sum(b06), 12) AS sum_b06, count(b02) AS n_b02 FROM masked GROUP BY ALL""",
)
def b11(spark, sf):
    return (
        masked(spark, sf)
        .withColumn("obs_date", F.explode("obs_dates"))
        .groupBy("location_id", "obs_date", "scene_date", "scene_no")
        .agg(
            F.count(F.lit(1)).alias("n_pixels"),
            F.count_if("pixel_ok").alias("n_ok"),
            r(F.sum("b06"), 12).alias("sum_b06"),
            F.count("b02").alias("n_b02"),
        )
    )


@query(
    "b14_iop_mask",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, {SITES}, {MATCHED}, {MASKED}
    SELECT location_id, obs_date, {", ".join(f"count({c}) AS n_{c}, round(sum({c}), 12) AS sum_{c}" for c in IOPS)} FROM masked GROUP BY ALL""",
)
def b14(spark, sf):
    return (
        masked(spark, sf)
        .withColumn("obs_date", F.explode("obs_dates"))
        .groupBy("location_id", "obs_date")
        .agg(*[x for c in IOPS for x in (F.count(c).alias(f"n_{c}"), r(F.sum(c), 12).alias(f"sum_{c}"))])
    )


MVC = f"""composite AS (SELECT location_id, obs_date, lat_px, lon_px, {", ".join(f"max({b}) AS {b}" for b in BANDS + IOPS)}
    FROM masked GROUP BY location_id, obs_date, lat_px, lon_px)"""


@query(
    "e4_pixel_mvc",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, {SITES}, {MATCHED}, {MASKED}, {MVC}
    SELECT location_id, obs_date, lat_px, lon_px, {sql_rounded(BANDS + IOPS, None)} FROM composite""",
)
def e4(spark, sf):
    per_obs = joins.pixel_keys(masked(spark, sf).withColumn("obs_date", F.explode("obs_dates")))
    return rounded(matchup.mvc(per_obs, ["location_id", "obs_date", "lat_px", "lon_px"], BANDS + IOPS), BANDS + IOPS, None)


# index formulas written out for the oracle, independently of the Column code
INDEX_SQL = {
    "FLH_681": "b10 - (b09 + (b11 - b09) * (681.25e0 - 673.75e0) / (708.75e0 - 673.75e0))",
    "FLH_665": "b08 - (b09 + (b11 - b09) * (665e0 - 673.75e0) / (708.75e0 - 673.75e0))",
    "GLH": "b06 - (b04 + (b08 - b04) * (560e0 - 490e0) / (665e0 - 490e0))",
    "BLH": "b04 - (b02 + (b06 - b02) * (490e0 - 412.5e0) / (560e0 - 412.5e0))",
    "MCI": "b11 - (b08 + (b12 - b08) * (708.75e0 - 665e0) / (753.75e0 - 665e0))",
    "RBD": "b10 - b08",
    "KBBI": "(b10 - b08) / (b10 + b08 + 1e-10)",
    "NDNI": "(b11 - b04) / (b11 + b04 + 1e-10)",
    "NDCI": "(b11 - b08) / (b11 + b08 + 1e-10)",
    "NDWI": "(b06 - b17) / (b06 + b17 + 1e-10)",
    "RedEdge_Ratio": "b11 / (b08 + 1e-10)",
    "CI": "b08 / (b06 + 1e-10)",
    "BlueGreen_Ratio": "b04 / (b06 + 1e-10)",
    "Green_Red_Ratio": "b06 / (b08 + 1e-10)",
    "Blue_Red_Ratio": "b04 / (b08 + 1e-10)",
    "Red_NIR_Ratio": "b08 / (b12 + 1e-10)",
    "Fluorescence_Peak": "b10",
}
INDEX_SQL_2 = {
    "FLHmax": "FLH_681 - FLH_665",
    "DINI": "(FLH_681 - FLH_665) / (GLH * b04 + 1e-10)",
    "EBI": "(FLH_681 - FLH_665) * BLH",
    "GBI": "FLH_681 * GLH * 1e6",
}


def indexed_sql(source: str, carried: str) -> str:
    first = ", ".join(f"{e} AS {n}" for n, e in INDEX_SQL.items())
    second = ", ".join(f"{e} AS {n}" for n, e in INDEX_SQL_2.items())
    return f"indexed AS (SELECT *, {second} FROM (SELECT {carried}, {first} FROM {source}) t)"


@query(
    "x_spectral_indices",
    f"""{with_views('pixels')}, {indexed_sql('fx_pixels', '*')}
    SELECT l_orderkey, acq_idx, lat, lon, {sql_rounded(K.INDEX_NAMES, None)} FROM indexed""",
)
def x_indices(spark, sf):
    df = spectral_indices(view(spark, sf, "pixels"), ROLES)
    return rounded(df.select("l_orderkey", "acq_idx", "lat", "lon", *K.INDEX_NAMES), K.INDEX_NAMES, None)


SUMMARY_COLUMNS = BANDS + K.INDEX_NAMES + IOPS
ANY_BAND = "(" + " OR ".join(f"{b} IS NOT NULL" for b in BANDS) + ")"


@query(
    "e5_grid_matchup",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, {SITES}, {MATCHED}, {MASKED}, {MVC}, {indexed_sql('composite', '*')},
    used AS (SELECT location_id, obs_date, count(DISTINCT (scene_date, scene_no)) AS n_mosaics_used FROM matched GROUP BY ALL),
    features AS (SELECT location_id, obs_date, count(*) FILTER (WHERE {ANY_BAND}) AS n_valid_pixels,
      100e0 * count(*) FILTER (WHERE {ANY_BAND}) / count(*) AS pct_valid_pixels,
      {", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in SUMMARY_COLUMNS)}
      FROM indexed GROUP BY location_id, obs_date HAVING count(*) FILTER (WHERE {ANY_BAND}) >= 3)
    SELECT d.location_id, d.obs_date, d.latitude, d.longitude, d.station, {sql_rounded(SPECIES)},
      n_valid_pixels, round(pct_valid_pixels, 6) AS pct_valid_pixels, n_mosaics_used, {sql_rounded(SUMMARY_COLUMNS, None)},
      b08 IS NOT NULL AS data_available
    FROM daily d LEFT JOIN (SELECT * FROM features JOIN used USING (location_id, obs_date)) f
      ON f.location_id = d.location_id AND f.obs_date = d.obs_date""",
)
def e5(spark, sf):
    obs = written(daily(spark, sf).drop("depth"))
    features = pipelines.grid_matchup(
        obs, view(spark, sf, "pixels"), ["scene_date", "scene_no"], BANDS, IOPS, ROLES, HALF
    )
    out = joins.attach_features(obs, features, "b08")
    return rounded(rounded(out, [*SPECIES, "pct_valid_pixels"]), SUMMARY_COLUMNS, None)
