"""Queries: filters, typing, keys, labels, scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from redtide import constants as K
from redtide.functions import scalars
from redtide.operators import aggregates, clean
from redtide.plans.fixtures import SPECIES, fields, read, view, with_views
from redtide.plans.queries_matchup import DAILY, LABEL_SQL, LOCATION_SQL, OBS, daily, located
from redtide.plans.registry import query, r, rounded, sql_rounded

THRESHOLDS = {s: {"warning": 2000 + 1000 * i, "closure": 9000 + 1000 * i} for i, s in enumerate(SPECIES)}


@query(
    "b1_bbox_filter",
    f"{with_views('obs')} SELECT bin_id FROM fx_obs WHERE latitude >= 40 AND latitude <= 43 AND longitude >= -70 AND longitude <= -66",
)
def b1(spark, sf):
    return clean.filter_bbox(view(spark, sf, "obs"), -70.0, 40.0, -66.0, 43.0).select("bin_id")


def polygon_sql(ring, lon="longitude", lat="latitude") -> str:
    """Inside test by winding: a point is inside a convex ring when it lies strictly on the
    same side of every edge. The three rings used are convex."""
    sides = [
        f"(({lon} - ({x1}e0)) * ({y2 - y1}e0) - ({lat} - ({y1}e0)) * ({x2 - x1}e0))"
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
    ]
    return "((" + " AND ".join(f"{s} < 0" for s in sides) + ") OR (" + " AND ".join(f"{s} > 0" for s in sides) + "))"


@query(
    "b2_polygon_filter",
    f"""{with_views('obs')} SELECT bin_id, {polygon_sql(K.POLYGON_MATCHUP)} AS in_matchup, {polygon_sql(K.POLYGON_ACQUISITION)} AS in_acquisition,
    {polygon_sql(K.POLYGON_CLOUD)} AS in_cloud FROM fx_obs WHERE {polygon_sql(K.POLYGON_CLOUD)}""",
)
def b2(spark, sf):
    from redtide.functions.geo import inside_polygon

    lon, lat = F.col("longitude"), F.col("latitude")
    return clean.filter_polygon(view(spark, sf, "obs"), K.POLYGON_CLOUD).select(
        "bin_id",
        inside_polygon(lon, lat, K.POLYGON_MATCHUP).alias("in_matchup"),
        inside_polygon(lon, lat, K.POLYGON_ACQUISITION).alias("in_acquisition"),
        inside_polygon(lon, lat, K.POLYGON_CLOUD).alias("in_cloud"),
    )


@query(
    "b3_station_exclusion",
    f"{with_views('obs')} SELECT bin_id FROM (SELECT bin_id, CASE WHEN loc % 5 > 0 THEN station END AS station FROM fx_obs) t WHERE station IS NULL OR station NOT IN ('st1', 'st2', 'st3')",
)
def b3(spark, sf):
    gaps = view(spark, sf, "obs").withColumn("station", F.when(F.col("loc") % 5 > 0, F.col("station")))
    return clean.exclude_stations(gaps, ["st1", "st2", "st3"], "station").select("bin_id")


STATIONS = {"st1": (43.781, -69.975), "st4": (41.645, -70.675), "st7": (41.57, -71.41)}
STATION_CASE = lambda i: "CASE station " + " ".join(f"WHEN '{s}' THEN {c[i]}e0" for s, c in STATIONS.items())


@query(
    "b4_station_override",
    f"""{with_views('obs')}, {OBS}, firsts AS (SELECT station, arg_min(location_id, (sample_time, bin_id)) AS first_id FROM obs
      WHERE station IN ('st1', 'st4', 'st7') GROUP BY station)
    SELECT bin_id, {STATION_CASE(0)} ELSE latitude END AS latitude, {STATION_CASE(1)} ELSE longitude END AS longitude,
      coalesce(first_id, location_id) AS location_id FROM obs LEFT JOIN firsts USING (station)""",
)
def b4(spark, sf):
    out = clean.override_stations(located(spark, sf), STATIONS, "station", ("sample_time", "bin_id"))
    return out.select("bin_id", "latitude", "longitude", "location_id")


RING_SQL = polygon_sql(K.POLYGON_MATCHUP)


@query(
    "e1_prepared_observations",
    f"""{with_views('obs')}, {OBS}, kept AS (SELECT * FROM obs WHERE year(obs_date) >= 2024 AND station NOT IN ('st2', 'st9')),
    firsts AS (SELECT station, arg_min(location_id, (sample_time, bin_id)) AS first_id FROM kept WHERE station IN ('st1', 'st4', 'st7') GROUP BY station),
    placed AS (SELECT sample_time, bin_id, obs_date, station, {", ".join(SPECIES)}, {STATION_CASE(0)} ELSE latitude END AS latitude, {STATION_CASE(1)} ELSE longitude END AS longitude,
      coalesce(first_id, location_id) AS location_id FROM kept LEFT JOIN firsts USING (station)),
    daily AS (SELECT location_id, obs_date, arg_min(latitude, (sample_time, bin_id)) AS latitude, arg_min(longitude, (sample_time, bin_id)) AS longitude, arg_min(station, (sample_time, bin_id)) AS station,
      {", ".join(f"quantile_cont({s}, 0.95) AS {s}" for s in SPECIES)} FROM placed GROUP BY location_id, obs_date)
    SELECT location_id, obs_date, latitude, longitude, station, {sql_rounded(SPECIES)} FROM daily WHERE {RING_SQL}""",
)
def e1_prepared(spark, sf):
    from redtide.plans.pipelines import prepare_observations

    out = prepare_observations(
        located(spark, sf),
        SPECIES,
        ["latitude", "longitude", "station"],
        ring=K.POLYGON_MATCHUP,
        from_year=2024,
        stations=STATIONS,
        excluded=["st2", "st9"],
    )
    return rounded(out, SPECIES)


@query(
    "b5_year_filter",
    "SELECT o_orderkey FROM orders WHERE year(o_orderdate) > 1996 AND year(o_orderdate) <= 1999",
)
def b5(spark, sf):
    return clean.filter_years(read(spark, sf, "orders"), 1997, 1999, "o_orderdate").select("o_orderkey")


@query("b6_location_id", f"{with_views('obs')} SELECT bin_id, {LOCATION_SQL} AS location_id, {LABEL_SQL} AS location_label FROM fx_obs")
def b6(spark, sf):
    return located(spark, sf).select("bin_id", "location_id", clean.location_label(F.col("latitude"), F.col("longitude")).alias("location_label"))


@query(
    "b7_lenient_types",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS t, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v,
    cast(user_id AS varchar) AS dataset_id FROM events""",
)
def b7(spark, sf):
    raw = read(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 4 = 0 THEN 'not a time' ELSE cast(ts AS string) END AS t",
        "CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE cast(value AS string) END AS v",
        "user_id AS dataset_id",
    )
    return clean.coerce_types(raw, {"t": "timestamp", "v": "double", "dataset_id": "string"}).withColumn(
        "t", F.to_timestamp_ntz(F.col("t").cast("string"))
    )


@query("b8_day_key", "SELECT event_id, strftime(ts, '%Y%m%d') AS obs_day FROM events WHERE event_id % 6 <> 0")
def b8(spark, sf):
    gaps = read(spark, sf, "events").withColumn("ts", F.when(F.col("event_id") % 6 != 0, F.col("ts")))
    return clean.with_obs_date(gaps, "ts").select("event_id", F.date_format("obs_date", "yyyyMMdd").alias("obs_day"))


@query(
    "b9_season",
    f"""SELECT o_orderkey, round(sin(2 * {math.pi} * dayofyear(o_orderdate) / 365), 9) AS doy_sin,
    round(cos(2 * {math.pi} * dayofyear(o_orderdate) / 365), 9) AS doy_cos FROM orders""",
)
def b9(spark, sf):
    out = clean.with_season(read(spark, sf, "orders"), "o_orderdate").select("o_orderkey", "doy_sin", "doy_cos")
    return rounded(out, ["doy_sin", "doy_cos"], 9)


@query(
    "b10_rename_bands",
    f"{with_views('pixels')} SELECT l_orderkey, acq_idx, b02 AS C_rrs_412, b08 AS C_rrs_665, b17 AS C_rrs_865 FROM fx_pixels",
)
def b10(spark, sf):
    raw = view(spark, sf, "pixels").selectExpr("l_orderkey", "acq_idx", "b02 AS C_rrs_2", "b08 AS C_rrs_8", "b17 AS C_rrs_17")
    return clean.rename_bands(raw, prefix="C_")


@query(
    "b12_swath_pixel_mask",
    f"{with_views('pixels')} SELECT scene_date, count(*) AS n, count(b06) AS n_ok, round(sum(b06), 12) AS sum_b06 FROM (SELECT scene_date, CASE WHEN flags = 0 AND NOT isnan(b06) THEN b06 END AS b06 FROM (SELECT scene_date, CASE WHEN loc % 11 = 0 THEN NULL ELSE quality_flags END AS flags, CASE WHEN loc % 7 = 0 THEN cast('nan' AS double) ELSE b06 END AS b06 FROM fx_pixels) s) t GROUP BY 1",
)
def b12(spark, sf):
    from redtide.operators.matchup import mask_swath_pixels

    raw = view(spark, sf, "pixels").withColumns(
        {
            "l2_flags": F.when(F.col("loc") % 11 != 0, F.col("quality_flags")),
            "b06": F.when(F.col("loc") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("b06")),
        }
    )
    return mask_swath_pixels(raw, ["b06"]).groupBy("scene_date").agg(
        F.count(F.lit(1)).alias("n"), F.count("b06").alias("n_ok"), r(F.sum("b06"), 12).alias("sum_b06")
    )


@query(
    "b13_joint_mask",
    f"{with_views('pixels')} SELECT loc, count(*) FILTER (WHERE ok) AS n_ok, round(sum(CASE WHEN ok THEN b04 END), 12) AS sum_b04 FROM (SELECT *, data_mask = 1 AND b02 > 0 AND b04 > 0 AND b06 > 0 AS ok FROM fx_pixels) t GROUP BY 1",
)
def b13(spark, sf):
    from redtide.operators.matchup import mask_joint

    raw = view(spark, sf, "pixels").withColumn("optical_valid", F.col("data_mask") == 1)
    masked = mask_joint(raw, ["b02", "b04", "b06"])
    return masked.groupBy("loc").agg(F.count_if("joint_ok").alias("n_ok"), r(F.sum("b04"), 12).alias("sum_b04"))


LIMITS_SQL = "(VALUES " + ", ".join(f"('{s}', '{t}', {v}e0)" for s, ts in THRESHOLDS.items() for t, v in ts.items()) + ") AS l(species, tier, threshold)"
LONG_SQL = " UNION ALL ".join(f"SELECT location_id, obs_date, '{s}' AS species, {s} AS value FROM daily" for s in SPECIES)
LABELS_SQL = f"long AS ({LONG_SQL}), labels AS (SELECT location_id, obs_date, species, tier, threshold, CASE WHEN value > threshold THEN 1 ELSE 0 END AS y FROM long JOIN {LIMITS_SQL} USING (species))"


def labels(spark, sf):
    return clean.label_long(daily(spark, sf), clean.thresholds(spark, THRESHOLDS), ["location_id", "obs_date"], SPECIES)


@query(
    "b15_label_threshold",
    f"{with_views('obs')}, {OBS}, {DAILY}, {LABELS_SQL} SELECT location_id, obs_date, species, tier, threshold, y FROM labels",
)
def b15(spark, sf):
    return labels(spark, sf).drop("value")


@query(
    "e12_label_stats",
    f"""{with_views('obs')}, {OBS}, {DAILY}, {LABELS_SQL}, per AS (SELECT tier, location_id, obs_date, sum(y) AS k FROM labels GROUP BY ALL),
    tot AS (SELECT tier, count(*) AS n_rows, count(*) FILTER (WHERE k >= 1) AS n_any, count(*) FILTER (WHERE k >= 2) AS n_multi FROM per GROUP BY 1)
    SELECT tier, species, cast(sum(y) AS bigint) AS n_positive, any_value(n_rows) AS n_rows, any_value(n_any) AS n_any, any_value(n_multi) AS n_multi
    FROM labels JOIN tot USING (tier) GROUP BY tier, species""",
)
def e12(spark, sf):
    return aggregates.label_stats(labels(spark, sf), ["location_id", "obs_date"])


@query("b16_dataset_scope", f"{with_views('obs')} SELECT bin_id FROM fx_obs WHERE station IN ('st0', 'st5', 'st12')")
def b16(spark, sf):
    return clean.scope(view(spark, sf, "obs"), ["st0", "st5", "st12"], "station").select("bin_id")


@query("b17_location_exclusion", f"{with_views('obs')}, {OBS} SELECT bin_id FROM obs WHERE {LABEL_SQL} <> '00719000'")
def b17(spark, sf):
    return clean.exclude_locations(
        located(spark, sf).withColumn("location_label", clean.location_label(F.col("latitude"), F.col("longitude"))), ["00719000"], "location_label"
    ).select("bin_id")


@query(
    "b18_same_day",
    "SELECT event_id FROM events WHERE event_id % 5 - 2 = 0",
)
def b18(spark, sf):
    lagged = read(spark, sf, "events").withColumn("delta_days", F.col("event_id") % 5 - 2)
    return clean.same_day(lagged).select("event_id")


@query(
    "b19_slim",
    f"{with_views('pixels')} SELECT lat, lon, kd489, b02 AS C_b02, b04 AS C_b04 FROM fx_pixels",
)
def b19(spark, sf):
    raw = view(spark, sf, "pixels").select("lat", "lon", "scene_no", "kd489", "b02", "b04")
    return clean.slim(raw, "C", ["scene_no"], ["kd489"], ["lat", "lon"])


# Snyder 1987, equations 3-21 and 8-9 to 8-15, zone 19; tests compare with another series
_E2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
_EP2 = _E2 / (1 - _E2)
UTM_SQL = f"""geo AS (SELECT *, radians(latitude) AS phi FROM sites),
    trig AS (SELECT *, 6378137e0 / sqrt(1 - {_E2} * sin(phi) * sin(phi)) AS nn, tan(phi) * tan(phi) AS tt, {_EP2} * cos(phi) * cos(phi) AS cc, radians(longitude + 69) * cos(phi) AS aa,
      6378137e0 * ({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256} * phi - {3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024} * sin(2 * phi)
        + {15 * _E2**2 / 256 + 45 * _E2**3 / 1024} * sin(4 * phi) - {35 * _E2**3 / 3072} * sin(6 * phi)) AS mm FROM geo),
    xy AS (SELECT *, 500000e0 + 0.9996e0 * nn * (aa + (1 - tt + cc) * power(aa, 3) / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * {_EP2}) * power(aa, 5) / 120) AS x_m,
      0.9996e0 * (mm + nn * tan(phi) * (power(aa, 2) / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * power(aa, 4) / 24 + (61 - 58 * tt + tt * tt + 600 * cc - 330 * {_EP2}) * power(aa, 6) / 720)) AS y_m FROM trig)"""


@query(
    "b20_utm_projection",
    f"{with_views('obs')}, sites AS (SELECT DISTINCT loc, latitude, longitude FROM fx_obs), {UTM_SQL} SELECT loc, round(x_m, 5) AS x_m, round(y_m, 5) AS y_m FROM xy",
)
def b20(spark, sf):
    sites = view(spark, sf, "obs").select("loc", "latitude", "longitude").distinct()
    return rounded(clean.project_utm(sites).select("loc", "x_m", "y_m"), ["x_m", "y_m"], 5)


CANDIDATES = ["depth", "view", "nothing", "absent", "click"]


@query("b21_resolve_features", "SELECT * FROM (VALUES (0, 'depth'), (1, 'view'), (2, 'click')) AS t(ordinal, feature) WHERE (SELECT count(*) FROM events) > 0")
def b21(spark, sf):
    df = view(spark, sf, "obs").withColumn("nothing", F.lit(None).cast("double"))
    found = clean.resolve_features(df, CANDIDATES)
    return spark.createDataFrame(list(enumerate(found)), "ordinal int, feature string")


GREATEST = "greatest(" + ", ".join(f"coalesce({s}, 0e0)" for s in SPECIES) + ")"


@query("b22_bloom_index", f"{with_views('obs')}, {OBS}, {DAILY} SELECT location_id, obs_date, round(log10({GREATEST} + 1), 9) AS bloom_index FROM daily")
def b22(spark, sf):
    out = clean.with_bloom_index(daily(spark, sf), SPECIES)
    return rounded(out.select("location_id", "obs_date", "bloom_index"), ["bloom_index"], 9)


@query(
    "b23_relabel",
    f"{with_views('folds')} SELECT fold, species, replace(ac, 'ac2', 'OC-SAC') AS ac, replace(track, 'ac2', 'OC-SAC') AS track, CASE WHEN track LIKE '%\\_roms' ESCAPE '\\' THEN 'Hybrid' ELSE 'OC' END AS model FROM fx_folds",
)
def b23(spark, sf):
    return clean.relabel(view(spark, sf, "folds").select("fold", "species", "ac", "track"), {"ac2": "OC-SAC"})


@query(
    "b25_micro_keys",
    f"{with_views('obs')} SELECT bin_id, cast(round(latitude * 10000) AS bigint) AS lat_key, cast(round(longitude * 10000) AS bigint) AS lon_key FROM fx_obs",
)
def b25(spark, sf):
    return clean.with_micro_keys(view(spark, sf, "obs")).select("bin_id", "lat_key", "lon_key")


# ------------------------------------------------------------------ scalar functions

DEG = 180 / math.pi


@query(
    "y1_flow_vectors",
    f"""{with_views('fields')} SELECT model_date, eta, xi, round(sqrt(u * u + v * v), 9) AS current_speed,
    CASE WHEN isnan(v) OR u IS NULL THEN NULL ELSE round(atan2(v, u) * {DEG}, 9) END AS current_dir
    FROM (SELECT model_date, eta, xi, u_sur AS u, CASE WHEN xi % 3 = 0 THEN NULL ELSE v_sur END AS v FROM fx_fields) t""",
)
def y1(spark, sf):
    df = fields(spark, sf).select(
        "model_date", "eta", "xi", F.col("u_sur").alias("roms_u_sur"), F.when(F.col("xi") % 3 != 0, F.col("v_sur")).alias("roms_v_sur")
    )
    return scalars.flow_vectors(df).select(
        "model_date", "eta", "xi", r("roms_current_speed", 9).alias("current_speed"), r("roms_current_dir", 9).alias("current_dir")
    )


@query(
    "y2_log_transforms",
    "SELECT event_id, round(log10(value * 100 + 1), 9) AS y, round(power(10e0, log10(value * 100 + 1)) - 1, 6) AS cells FROM events",
)
def y2(spark, sf):
    y = scalars.log_cells(F.col("value") * 100)
    return read(spark, sf, "events").select("event_id", r(y, 9).alias("y"), r(scalars.cells_from_log(y)).alias("cells"))


@query(
    "y3_date_arithmetic",
    """SELECT event_id, cast(ts AS date) - 3 AS start_day, cast(ts AS date) + 2 AS end_day, cast(unnest(generate_series(cast(ts AS date) - 3, cast(ts AS date), interval 1 day)) AS date) AS day FROM events""",
)
def y3(spark, sf):
    d = F.to_date("ts")
    return read(spark, sf, "events").select(
        "event_id",
        F.date_sub(d, 3).alias("start_day"),
        F.date_add(d, 2).alias("end_day"),
        F.explode(F.sequence(F.date_sub(d, 3), d)).alias("day"),
    )


@query(
    "y4_y5_date_parts",
    """SELECT o_orderkey, cast(year(o_orderdate) AS int) AS y, cast(dayofyear(o_orderdate) AS int) AS doy, cast(o_orderdate AS date) AS day,
    strftime(o_orderdate, '%Y') AS yyyy, strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%Y%m%d') AS ymd FROM orders""",
)
def y4(spark, sf):
    d = F.col("o_orderdate")
    return read(spark, sf, "orders").select(
        "o_orderkey",
        F.year(d).alias("y"),
        F.dayofyear(d).alias("doy"),
        F.to_date(d).alias("day"),
        F.date_format(d, "yyyy").alias("yyyy"),
        F.date_format(d, "MM").alias("mm"),
        F.date_format(d, "yyyyMMdd").alias("ymd"),
    )


@query(
    "y6_strings",
    """SELECT p_partkey, lower(trim(' ' || p_brand || ' ')) AS low, replace(p_type, 'E', 'e') AS swapped, split_part(p_name, ' ', 2) AS second,
    p_name LIKE 'red%' AS starts, p_name LIKE '%widget' AS ends, contains(p_type, 'ON') AS has, lpad(cast(p_partkey % 1000 AS varchar), 8, '0') AS padded,
    regexp_extract(p_brand, '#(\\d+)', 1) AS digits FROM part""",
)
def y6(spark, sf):
    return read(spark, sf, "part").select(
        "p_partkey",
        F.lower(F.trim(F.concat(F.lit(" "), "p_brand", F.lit(" ")))).alias("low"),
        F.replace("p_type", F.lit("E"), F.lit("e")).alias("swapped"),
        F.get(F.split("p_name", " "), F.lit(1)).alias("second"),
        F.col("p_name").startswith("red").alias("starts"),
        F.col("p_name").endswith("widget").alias("ends"),
        F.col("p_type").contains("ON").alias("has"),
        F.lpad((F.col("p_partkey") % 1000).cast("string"), 8, "0").alias("padded"),
        F.regexp_extract("p_brand", r"#(\d+)", 1).alias("digits"),
    )


@query(
    "y7_effect_label",
    "SELECT event_id, CASE WHEN value / 600 < 0.1 THEN 'negligible' WHEN value / 600 < 0.3 THEN 'small' WHEN value / 600 < 0.5 THEN 'medium' ELSE 'large' END AS effect FROM events",
)
def y7(spark, sf):
    return read(spark, sf, "events").select("event_id", scalars.effect_label(-F.col("value") / 600).alias("effect"))


@query(
    "y10_rounding",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_extendedprice), 1) AS r1, round(sqrt(l_extendedprice), 3) AS r3, round(sqrt(l_extendedprice), 5) AS r5 FROM lineitem",
)
def y10(spark, sf):
    v = F.sqrt("l_extendedprice")
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.round(v, d).alias(f"r{d}") for d in (1, 3, 5)]
    )


@query(
    "y13_json_access",
    "SELECT event_id, coalesce(cast(json_extract_string(props, '$.k') AS bigint), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events",
)
def y13(spark, sf):
    return read(spark, sf, "events").select(
        "event_id",
        F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("k"),
        F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"),
    )
