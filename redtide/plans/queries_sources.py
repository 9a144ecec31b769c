"""Queries: sources, sinks, manifests, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from redtide.operators import aggregates, clean, splits
from redtide.plans.fixtures import SPECIES, read, view, with_views
from redtide.plans.queries_matchup import LOCATION_SQL, OBS
from redtide.plans.registry import query, r
from redtide.session import fresh_path
from redtide.sources import counts, manifests, tables

# ------------------------------------------------------------------ A1-A9 tables


def responses(spark, sf):
    """One nested count response per event, as JSON text, parsed with the declared schema."""
    sample = (
        "named_struct('binPid', concat('{p}', cast(event_id AS string)), 'sampleTime', cast(ts AS string), "
        "'latitude', {lat}, 'longitude', -70e0, 'metrics', {metrics})"
    )
    metric = "named_struct('metricId', '{m}', 'value', {v})"
    conc = "cell_concentration"
    full = f"array({metric.format(m=conc, v='value')}, {metric.format(m='biovolume', v='value * 2')}, {metric.format(m=conc, v='value + 1')})"
    bare = f"array({metric.format(m='biovolume', v='value * 2')})"
    first = sample.format(p="b", lat="cast(user_id AS double)", metrics=f"CASE WHEN event_id % 3 = 0 THEN {bare} ELSE {full} END")
    empty = sample.format(p="c", lat="1e0", metrics="cast(array() AS array<struct<metricId: string, value: double>>)")
    again = sample.format(p="b", lat="99e0", metrics=f"array({metric.format(m=conc, v='value * 3')})")
    entries = (
        f"array(named_struct('species', 'first', 'data', array({first}, {empty})), "
        f"named_struct('species', event_type, 'data', array({again}, {empty})))"
    )
    text = read(spark, sf, "events").selectExpr(
        "event_id", f"to_json(named_struct('properties', named_struct('timeseriesData', {entries}))) AS body"
    )
    return text.select("event_id", F.from_json("body", counts.COUNTS_SCHEMA).alias("_b")).select("event_id", "_b.*")


@query(
    "a1_flatten_counts",
    """SELECT event_id, 'b' || event_id AS bin_pid, cast(user_id AS double) AS latitude, 'first' AS species, value + 1 AS concentration
    FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT event_id, 'b' || event_id, cast(user_id AS double), event_type, value * 3 FROM events
    UNION ALL SELECT event_id, 'c' || event_id, 1e0, NULL, NULL FROM events""",
)
def a1(spark, sf):
    return counts.flatten_counts(responses(spark, sf), ["event_id"]).drop("sample_time", "longitude")


@query(
    "a2_bin_metadata",
    """SELECT cast(event_id AS varchar) AS pid, CASE WHEN user_id % 7 = 0 THEN NULL ELSE cast(user_id AS double) END AS latitude,
    value AS depth, event_type AS cruise FROM events WHERE event_id % 5 <> 1""",
)
def a2(spark, sf):
    raw = read(spark, sf, "events").selectExpr(
        "cast(event_id AS string) AS ` PID `",
        "CASE WHEN user_id % 7 = 0 THEN 'n/a' ELSE cast(user_id AS string) END AS Latitude",
        "cast(value AS string) AS `DEPTH`",
        "event_type AS `Cruise `",
        "CASE WHEN event_id % 5 = 1 THEN '1' WHEN event_id % 5 = 2 THEN '0' END AS Skip",
        "props AS remark",
    )
    return counts.clean_bin_metadata(raw)


@query(
    "a3_union_yearly",
    """SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN value END AS value, CASE WHEN user_id % 2 = 1 THEN event_type END AS event_type
    FROM events""",
)
def a3(spark, sf):
    events = read(spark, sf, "events")
    return tables.union_yearly(
        events.where("user_id % 2 = 0").select("event_id", "user_id", "value"),
        events.where("user_id % 2 = 1").select("event_type", "event_id", "user_id"),
    )


@query(
    "a4_write_partition_once",
    """SELECT o_orderpriority, count(*) AS n, cast(sum(o_orderkey) AS bigint) AS key_sum FROM orders GROUP BY 1""",
)
def a4(spark, sf):
    path = fresh_path(spark, "once")
    orders = read(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    tables.write_partition_once(orders.where("o_orderpriority = '5-LOW'"), path, "o_orderpriority")
    tables.write_partition_once(orders, path, "o_orderpriority")  # writes only what is missing
    tables.write_partition_once(orders, path, "o_orderpriority")
    return (
        spark.read.parquet(path)
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
    )


@query("a5_parquet_scan", "SELECT event_id, value FROM events WHERE value > 100 AND event_type = 'view'")
def a5(spark, sf):
    scan = tables.read_table(spark, f"{sf}/events.parquet", "event_id bigint, event_type string, value double")
    return scan.where((F.col("value") > 100) & (F.col("event_type") == "view")).select("event_id", "value")


FOLD_MEANS = f"""{with_views('folds')} SELECT ac, track, tier, species, round(avg(f1), 5) AS f1, count(*) AS n FROM fx_folds GROUP BY ALL"""


def fold_means(spark, sf):
    return view(spark, sf, "folds").groupBy("ac", "track", "tier", "species").agg(F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n"))


@query("a6_results_csv", FOLD_MEANS)
def a6(spark, sf):
    path = fresh_path(spark, "results")
    tables.write_csv_rounded(fold_means(spark, sf), path, ["tier", "ac", "track"])
    return tables.read_results_csv(spark, path, "ac string, track string, tier string, species string, f1 double, n bigint")


@query("a7_parquet_sink", FOLD_MEANS)
def a7(spark, sf):
    path = fresh_path(spark, "means")
    tables.write_parquet(tables.rounded_floats(fold_means(spark, sf)), path)
    return spark.read.parquet(path)


@query("a8_csv_sink", FOLD_MEANS)
def a8(spark, sf):
    path = fresh_path(spark, "comparison")
    tables.write_csv_rounded(fold_means(spark, sf), path, ["tier", "ac", "track", F.desc("f1")])
    return tables.read_results_csv(spark, path, "ac string, track string, tier string, species string, f1 double, n bigint")


@query("a9_append_checkpoint", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a9(spark, sf):
    path = fresh_path(spark, "partial")
    events = read(spark, sf, "events").select("event_type", "event_id")
    tables.append_checkpoint(events.where("event_type <> 'view'"), path, "event_type")
    tables.append_checkpoint(events.where("event_type IN ('view', 'error')"), path, "event_type")  # a rerun of one part
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ A10-A16 manifests

DATE_STR = {
    "mosaic": "CASE WHEN file_id % 6 = 0 THEN strftime(day, '%Y%m%d') END",
    "swath": "CASE WHEN file_id % 6 IN (1, 5) THEN strftime(day, '%Y%m%d') END",
    "model": "CASE WHEN file_id % 6 IN (2, 3) THEN strftime(day, '%Y%m%d') END",
}


@query(
    "a10_index_files",
    f"""{with_views('files')} SELECT file_id, {DATE_STR['mosaic']} AS mosaic_date, {DATE_STR['swath']} AS swath_date, {DATE_STR['model']} AS model_date,
    CASE WHEN file_id % 6 IN (2, 3) THEN '2ds' END AS product, CASE WHEN file_id % 6 IN (2, 3) THEN 'n00' || (1 + file_id % 6) END AS fhour,
    CASE WHEN file_id % 6 IN (2, 3) THEN 't12z' END AS cycle, CASE file_id % 6 WHEN 2 THEN 'A' WHEN 3 THEN 'B' END AS format FROM fx_files""",
)
def a10(spark, sf):
    return indexed(spark, sf).drop("day", "name")


def indexed(spark, sf):
    files = view(spark, sf, "files")
    for kind in ("mosaic", "swath", "model"):
        files = manifests.index_files(files, kind).withColumnRenamed("date_str", f"{kind}_date")
    return files


@query(
    "a10_unrecognised_names",
    f"""{with_views('files')}, dated AS (SELECT {DATE_STR['mosaic']} AS mosaic_date, {DATE_STR['swath']} AS swath_date, {DATE_STR['model']} AS model_date FROM fx_files)
    SELECT count(*) AS n_files, count(*) FILTER (WHERE mosaic_date IS NULL AND swath_date IS NULL AND model_date IS NULL) AS n_unrecognised FROM dated""",
)
def a10_unrecognised(spark, sf):
    return manifests.unrecognised(indexed(spark, sf), ["mosaic_date", "swath_date", "model_date"])


@query(
    "a11_one_file_per_date",
    f"""{with_views('files')} SELECT strftime(day, '%Y%m%d') AS date_str, max(name) AS name FROM fx_files WHERE file_id % 6 IN (2, 3) GROUP BY 1""",
)
def a11(spark, sf):
    return manifests.one_file_per_date(manifests.index_files(view(spark, sf, "files"), "model"))


BASE_URL = "https://example.org/model/"


@query(
    "a12_acquisition_manifest",
    f"""WITH days AS (SELECT DISTINCT cast(o_orderdate AS date) AS day FROM orders),
    variants AS (SELECT p.product, d.detail, c.cycle FROM (VALUES ('2ds'), ('fields'), ('stations')) p(product)
      JOIN (VALUES ('n001', 'h'), ('f024', 'h'), ('nowcast', 's'), ('forecast', 's')) d(detail, kind)
        ON (p.product = 'stations') = (d.kind = 's') CROSS JOIN (VALUES ('t00z'), ('t12z')) c(cycle))
    SELECT day, product, detail, cycle, 'nos.gomofs.' || product || '.' || detail || '.' || strftime(day, '%Y%m%d') || '.' || cycle || '.nc' AS file_name,
    '{BASE_URL}' || strftime(day, '%Y/%m/') || 'nos.gomofs.' || product || '.' || detail || '.' || strftime(day, '%Y%m%d') || '.' || cycle || '.nc' AS url
    FROM days CROSS JOIN variants""",
)
def a12(spark, sf):
    days = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return manifests.acquisition_manifest(
        days, ["t00z", "t12z"], ["2ds", "fields", "stations"], ["n001", "f024"], ["nowcast", "forecast"], BASE_URL
    )


@query(
    "a12_model_urls",
    f"""SELECT DISTINCT cast(ts AS date) AS obs_date, '{BASE_URL}' || strftime(ts, '%Y/%m/') || 'gomofs.t12z.' || strftime(ts, '%Y%m%d') || '.2ds.n001.nc' AS url FROM events""",
)
def a12_urls(spark, sf):
    return manifests.model_urls(view(spark, sf, "obs"), BASE_URL)


# scene ids of the swath entries of the file list, spelled out
SCENES = """scenes AS (SELECT file_id, day, trim(regexp_replace(name, '^/data/in/', '')) AS base FROM fx_files WHERE file_id % 6 IN (1, 5)),
    stems AS (SELECT DISTINCT CASE WHEN base LIKE '%.SEN3.zip' THEN left(base, length(base) - 9) ELSE left(base, length(base) - 5) END AS scene FROM scenes),
    named AS (SELECT scene, left(scene, 31) AS short_id, left(scene, 3) AS satellite, substr(scene, 17, 15) AS sensing_time FROM stems)"""


@query("a15_normalize_scene_list", f"{with_views('files')}, {SCENES} SELECT scene, short_id, satellite, sensing_time FROM named")
def a15(spark, sf):
    lines = view(spark, sf, "files").where("file_id % 6 IN (1, 5)").select(F.concat(F.lit(" "), "name").alias("line"))
    noise = view(spark, sf, "files").where("file_id % 6 = 0").select(F.concat(F.lit("# "), "name").alias("line"))
    return manifests.normalize_scene_list(lines.union(noise))


@query(
    "a13_pending_work",
    f"""{with_views('files')}, {SCENES} SELECT scene FROM named WHERE satellite = 'S3A'
    AND scene NOT IN (SELECT scene FROM named WHERE substr(scene, 23, 1) IN ('1', '2'))
    AND short_id NOT IN (SELECT short_id FROM named WHERE substr(scene, 23, 1) = '3')""",
)
def a13(spark, sf):
    scenes = manifests.normalize_scene_list(
        view(spark, sf, "files").where("file_id % 6 IN (1, 5)").select(F.col("name").alias("line"))
    )
    # some are finished under the full id, some under the short one
    digit = F.substring("scene", 23, 1)
    done = scenes.where(digit.isin("1", "2")).select("scene").union(scenes.where(digit == "3").select("short_id"))
    return manifests.pending_work(scenes.select("scene"), scenes.where("satellite = 'S3A'").select("scene"), done)


@query(
    "a14_catalog_search",
    f"""{with_views('catalog')} SELECT scene_id, name FROM fx_catalog WHERE name LIKE '%OL_1_EFR%' AND west <= -63 AND east >= -73 AND south <= 45 AND north >= 39
    AND start_time BETWEEN timestamp '1996-01-01 00:00:00' AND timestamp '1999-12-31 23:59:59.999'""",
)
def a14(spark, sf):
    found = manifests.catalog_search(view(spark, sf, "catalog"), (-73.0, 39.0, -63.0, 45.0), "1996-01-01", "1999-12-31")
    return found.select("scene_id", "name")


@query(
    "t2_head_of_catalog",
    f"""{with_views('catalog')} SELECT scene_id, name FROM fx_catalog ORDER BY start_time, name LIMIT 50 OFFSET 20""",
)
def t2(spark, sf):
    return view(spark, sf, "catalog").orderBy("start_time", "name").offset(20).limit(50).select("scene_id", "name")


@query(
    "a16_scene_ledger_summary",
    """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'skipped_exists' WHEN o_custkey % 9 = 0 THEN 'failed' WHEN o_totalprice > 300000 THEN 'skipped_cloud'
    WHEN o_orderstatus <> 'P' THEN 'success' ELSE 'failed_gpt' END AS status, count(*) AS n_scenes FROM orders GROUP BY 1""",
)
def a16(spark, sf):
    ledger = read(spark, sf, "orders").selectExpr(
        "o_orderkey AS scene",
        "o_orderkey % 7 = 0 AS output_exists",
        "o_custkey % 9 <> 0 AS found",
        "o_totalprice <= 300000 AS usable",
        "o_orderstatus <> 'P' AS processed",
    )
    return manifests.scene_ledger_summary(manifests.scene_status(ledger))


# ------------------------------------------------------------------ U and T


@query("u1_union_all", "SELECT user_id AS id FROM events UNION ALL SELECT o_custkey FROM orders")
def u1(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias("id")).unionByName(
        read(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    )


@query(
    "u2_intersect_dates",
    f"{with_views('obs', 'pixels')} SELECT obs_date AS day FROM fx_obs INTERSECT SELECT scene_date FROM fx_pixels WHERE scene_no = 1",
)
def u2(spark, sf):
    days = view(spark, sf, "obs").select(F.col("obs_date").alias("day"))
    scenes = view(spark, sf, "pixels").where("scene_no = 1").select("scene_date")
    # days first: rows of one day would all meet in one task
    return days.distinct().intersect(scenes.distinct())


@query("u3_distinct_union", "SELECT event_type AS name FROM events UNION SELECT o_orderpriority FROM orders")
def u3(spark, sf):
    a = read(spark, sf, "events").select(F.col("event_type").alias("name"))
    return a.union(read(spark, sf, "orders").select("o_orderpriority")).distinct()


@query("u4_difference", "SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def u4(spark, sf):
    return read(spark, sf, "customer").select("c_custkey").exceptAll(
        read(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey")
    )


@query(
    "t1_result_sort",
    f"{with_views('folds')} SELECT tier, ac, species, round(avg(f1), 6) AS f1 FROM fx_folds GROUP BY ALL ORDER BY tier, ac, f1 DESC",
)
def t1(spark, sf):
    return (
        view(spark, sf, "folds").groupBy("tier", "ac", "species").agg(r(F.avg("f1")).alias("f1")).orderBy("tier", "ac", F.desc("f1"))
    )


@query(
    "t3_importance_order",
    """SELECT p_brand AS feature, round(avg(p_retailprice) FILTER (WHERE p_size < 20), 6) AS a, round(avg(p_retailprice) FILTER (WHERE p_size >= 45), 6) AS b,
    round((coalesce(avg(p_retailprice) FILTER (WHERE p_size < 20), 0) + coalesce(avg(p_retailprice) FILTER (WHERE p_size >= 45), 0))
      / ((count(p_size) FILTER (WHERE p_size < 20) > 0)::int + (count(p_size) FILTER (WHERE p_size >= 45) > 0)::int), 6) AS avg_importance
    FROM part GROUP BY 1""",
)
def t3(spark, sf):
    scores = read(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.avg(F.when(F.col("p_size") < 20, F.col("p_retailprice"))).alias("a"),
        F.avg(F.when(F.col("p_size") >= 45, F.col("p_retailprice"))).alias("b"),
    )
    ordered = aggregates.importance_order(scores, ["a", "b"])
    return ordered.select("feature", r("a").alias("a"), r("b").alias("b"), r("avg_importance").alias("avg_importance"))


@query(
    "t4_portable_sample",
    f"SELECT o_orderkey FROM orders ORDER BY {splits.hash_sql('o_orderkey', '7')}, o_orderkey LIMIT 2000",
)
def t4(spark, sf):
    return splits.portable_sample(read(spark, sf, "orders"), "o_orderkey", 2000, 7).select("o_orderkey")
