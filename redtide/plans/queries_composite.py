"""Queries: metadata and feature joins, the composite, reports, result-table summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redtide.operators import aggregates, clean, joins
from redtide.plans import pipelines
from redtide.plans.fixtures import SPECIES, fields, read, view, with_views
from redtide.plans.queries_clean import THRESHOLDS
from redtide.plans.queries_matchup import DAILY, OBS, daily, located
from redtide.plans.queries_ocean import LAGGED, NEAREST
from redtide.plans.registry import query, r, rounded, sql_rounded
from redtide.session import written

# ------------------------------------------------------------------ D1, D2, W1


@query(
    "d1_metadata_join",
    """SELECT e.event_id AS bin_pid, event_type AS dataset_id, CASE WHEN event_type IN ('view', 'click') THEN m.latitude ELSE cast(user_id AS double) END AS latitude, m.depth
    FROM events e LEFT JOIN (SELECT o_orderkey AS pid, o_totalprice AS latitude, cast(o_custkey AS double) AS depth FROM orders WHERE o_orderkey % 3 <> 0) m
      ON m.pid = e.event_id AND e.event_type IN ('view', 'click')""",
)
def d1(spark, sf):
    counts = read(spark, sf, "events").select(
        F.col("event_id").alias("bin_pid"), F.col("event_type").alias("dataset_id"), F.col("user_id").cast("double").alias("latitude")
    )
    meta = (
        read(spark, sf, "orders")
        .where("o_orderkey % 3 <> 0")
        .select(
            F.col("o_orderkey").alias("pid"),
            F.explode(F.array(F.lit("view"), F.lit("click"))).alias("dataset_id"),
            F.col("o_totalprice").alias("latitude"),
            F.col("o_custkey").cast("double").alias("depth"),
        )
    )
    return joins.attach_metadata(counts, meta).select("bin_pid", "dataset_id", "latitude", "depth")


@query(
    "d2_feature_back_join",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, feats AS (SELECT loc, scene_date AS obs_date, avg(b08) AS rrs_8 FROM fx_pixels WHERE data_mask = 1 GROUP BY ALL),
    keyed AS (SELECT DISTINCT loc, location_id FROM obs)
    SELECT d.location_id, d.obs_date, round(rrs_8, 9) AS rrs_8, rrs_8 IS NOT NULL AS data_available FROM daily d
    LEFT JOIN (SELECT location_id, obs_date, rrs_8 FROM feats JOIN keyed USING (loc)) f ON f.location_id = d.location_id AND f.obs_date = d.obs_date""",
)
def d2(spark, sf):
    return rounded(with_band(spark, sf).select("location_id", "obs_date", "rrs_8", "data_available"), ["rrs_8"], 9)


def with_band(spark, sf):
    """Daily observations with one band averaged over their own day."""
    keyed = located(spark, sf).select("loc", "location_id").distinct()
    feats = (
        view(spark, sf, "pixels")
        .where("data_mask = 1")
        .groupBy("loc", F.col("scene_date").alias("obs_date"))
        .agg(F.avg("b08").alias("rrs_8"))
        .join(keyed, "loc")
        .drop("loc")
    )
    return joins.attach_features(daily(spark, sf), feats, "rrs_8")


BANDED = """feats AS (SELECT loc, scene_date AS obs_date, avg(b08) AS rrs_8 FROM fx_pixels WHERE data_mask = 1 GROUP BY ALL),
    keyed AS (SELECT DISTINCT loc, location_id FROM obs),
    banded AS (SELECT d.*, f.rrs_8 FROM daily d LEFT JOIN (SELECT location_id, obs_date, rrs_8 FROM feats JOIN keyed USING (loc)) f
      ON f.location_id = d.location_id AND f.obs_date = d.obs_date)"""


@query(
    "e10_match_rate",
    f"""{with_views('obs', 'pixels')}, {OBS}, {DAILY}, {BANDED} SELECT station, count(*) AS total, count(rrs_8) AS matched, round(100e0 * count(rrs_8) / count(*), 6) AS pct FROM banded GROUP BY 1""",
)
def e10(spark, sf):
    return rounded(aggregates.match_rate(with_band(spark, sf), "station"), ["pct"])


@query(
    "w1_first_in_time",
    f"""{with_views('obs')} SELECT station, bin_id, latitude FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY sample_time, bin_id) AS rn FROM fx_obs) t WHERE rn = 1""",
)
def w1(spark, sf):
    obs = view(spark, sf, "obs").select("station", "bin_id", "latitude", "sample_time")
    return aggregates.dedup(obs, ["station"], ["sample_time", "bin_id"]).drop("sample_time")


@query(
    "w9_last_name_per_date",
    f"""{with_views('files')} SELECT strftime(day, '%Y%m%d') AS date_str, max(name) AS name FROM fx_files WHERE file_id % 6 = 0 GROUP BY 1""",
)
def w9(spark, sf):
    from redtide.sources import manifests

    return manifests.one_file_per_date(manifests.index_files(view(spark, sf, "files"), "mosaic"))


# ------------------------------------------------------------------ composite


def sources(spark, sf):
    """Three per-day feature tables keyed by position and day, on overlapping thirds of days."""
    keyed = located(spark, sf).select("loc", "location_id", "latitude", "longitude").distinct()
    pixels = view(spark, sf, "pixels").withColumn("obs_date", F.col("scene_date"))
    means = {"C": ["b02", "b08"], "A": ["b06", "b08"], "B": ["b09", "b10"]}
    out = {}
    for i, (prefix, bands) in enumerate(means.items()):
        out[prefix] = (
            pixels.where(f"scene_no <> {i}")
            .groupBy("loc", "obs_date")
            .agg(*[F.avg(b).alias(f"rrs_{412 + j}") for j, b in enumerate(bands)], F.max("kd489").alias("CHL_NN"))
            .join(keyed, "loc")
            .drop("loc")
        )
    return out


def source_sql(prefix, i, bands):
    cols = ", ".join(f"avg({b}) AS {prefix}_rrs_{412 + j}" for j, b in enumerate(bands))
    chl = "max(kd489) AS CHL_NN" if prefix == "B" else f"max(kd489) AS {prefix}_CHL_NN"
    return f"src_{prefix} AS (SELECT location_id, scene_date AS obs_date, {cols}, {chl} FROM fx_pixels JOIN keyed USING (loc) WHERE scene_no <> {i} GROUP BY ALL)"


COMPOSITE_COLUMNS = ["C_rrs_412", "C_rrs_413", "C_CHL_NN", "A_rrs_412", "A_rrs_413", "A_CHL_NN", "B_rrs_412", "B_rrs_413", "CHL_NN"]
LAG_PIXEL_CTES = f"{with_views('obs', 'grid', 'fields', 'pixels')}, {OBS}, {DAILY}, {NEAREST}, {LAGGED}"
COMPOSITE = f"""{LAG_PIXEL_CTES}, keyed AS (SELECT DISTINCT loc, location_id FROM obs),
    {source_sql('C', 0, ['b02', 'b08'])}, {source_sql('A', 1, ['b06', 'b08'])}, {source_sql('B', 2, ['b09', 'b10'])},
    composite AS (SELECT l.location_id, l.obs_date, d.station, {", ".join(f"d.{s}" for s in SPECIES)}, l.temp_sur AS roms_temp_sur, l.u_sur AS roms_u_sur, {", ".join(COMPOSITE_COLUMNS)}
      FROM lagged l JOIN daily d USING (location_id, obs_date) LEFT JOIN src_C USING (location_id, obs_date)
      LEFT JOIN src_A USING (location_id, obs_date) LEFT JOIN src_B USING (location_id, obs_date) WHERE l.delta_days = 0)"""


def composite(spark, sf):
    base = pipelines.ocean_lags(daily(spark, sf), view(spark, sf, "grid"), fields(spark, sf))
    return pipelines.composite_table(base, sources(spark, sf), ["location_id"], {"B": ["CHL_NN"]})


@query(
    "d3_composite",
    f"{COMPOSITE} SELECT location_id, obs_date, round(roms_temp_sur, 6) AS roms_temp_sur, {sql_rounded(COMPOSITE_COLUMNS, 15)} FROM composite",
)
def d3(spark, sf):
    out = composite(spark, sf).select("location_id", "obs_date", "roms_temp_sur", *COMPOSITE_COLUMNS)
    return rounded(rounded(out, ["roms_temp_sur"]), COMPOSITE_COLUMNS, 15)


@query(
    "b24_no_suffix_columns",
    f"{COMPOSITE} SELECT count(*) AS n_rows, 0 AS n_suffixed FROM composite",
)
def b24(spark, sf):
    df = clean.assert_no_suffix_columns(composite(spark, sf))
    suffixed = [c for c in df.columns if c.endswith(("_dup", "_x", "_y"))]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_suffixed", F.lit(len(suffixed)))


ANCHORS = ["roms_temp_sur", "C_rrs_412", "A_rrs_412", "CHL_NN"]


@query(
    "e11_availability",
    COMPOSITE
    + " SELECT kind, name, n, base, round(CASE WHEN base > 0 THEN 100e0 * n / base ELSE 0 END, 6) AS pct FROM ("
    + " UNION ALL ".join(f"SELECT 'source' AS kind, '{a}' AS name, count({a}) AS n, count(*) AS base FROM composite" for a in ANCHORS)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'species', '{s}', count(*) FILTER (WHERE {s} > 0), count({s}) FROM composite" for s in SPECIES)
    + ") t",
)
def e11(spark, sf):
    return rounded(aggregates.availability(composite(spark, sf), ANCHORS, SPECIES), ["pct"])


@query(
    "e11_composite_summary",
    COMPOSITE + " SELECT count(*) AS n_rows, count(DISTINCT obs_date) AS n_dates, count(DISTINCT location_id) AS n_locations FROM composite",
)
def e11_summary(spark, sf):
    return aggregates.composite_summary(composite(spark, sf), ["C", "A", "B"]).select("n_rows", "n_dates", "n_locations")


@query(
    "d15_common_rows",
    f"{COMPOSITE} SELECT location_id, obs_date FROM composite WHERE C_rrs_412 IS NOT NULL AND A_rrs_412 IS NOT NULL AND B_rrs_412 IS NOT NULL",
)
def d15(spark, sf):
    return joins.common_rows(composite(spark, sf)).select("location_id", "obs_date")


@query(
    "d16_optional_filter",
    f"{with_views('obs')} SELECT bin_id, 'kept' AS branch FROM fx_obs WHERE depth > 5 UNION ALL SELECT bin_id, 'all' FROM fx_obs",
)
def d16(spark, sf):
    obs = view(spark, sf, "obs").select("bin_id", "depth")
    kept = joins.filter_if_present(obs.withColumn("roms_available", F.col("depth") > 5)).select("bin_id", F.lit("kept").alias("branch"))
    return kept.unionByName(joins.filter_if_present(obs).select("bin_id", F.lit("all").alias("branch")))


TRACKS = {
    "C_only": ["C_rrs_412", "C_rrs_413"],
    "C_roms": ["C_rrs_412", "C_rrs_413", "roms_temp_sur"],
    "A_only": ["A_rrs_412", "A_rrs_413"],
}
AUDITED = sorted({f for fs in TRACKS.values() for f in fs})


@query(
    "e13_feature_audit",
    COMPOSITE
    + " "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, "
        + ", ".join((f"count({f})" if f in fs else "cast(NULL AS bigint)") + f" AS {t}" for t, fs in TRACKS.items())
        + " FROM composite"
        for f in AUDITED
    ),
)
def e13(spark, sf):
    return aggregates.feature_audit(composite(spark, sf), TRACKS)


@query(
    "b26_tracks",
    COMPOSITE
    + " "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS track, {n} AS n_features, {m} AS n_resolved, cast(count(C_rrs_412) * {c} + count(A_rrs_412) * {a} + count(B_rrs_412) * {b} + count(roms_temp_sur) * {o} AS bigint) AS n_known FROM composite"
        for t, n, m, c, a, b, o in [
            ("C2RCC_only", 32, 1, 1, 0, 0, 0),
            ("C2RCC_roms", 44, 3, 1, 0, 0, 2),
            ("ACOLITE_only", 32, 1, 0, 1, 0, 0),
            ("ACOLITE_roms", 44, 3, 0, 1, 0, 2),
            ("Baseline_only", 32, 1, 0, 0, 1, 0),
            ("Baseline_roms", 44, 3, 0, 0, 1, 2),
        ]
    ),
)
def b26(spark, sf):
    columns = ["C_rrs_412", "A_rrs_412", "B_rrs_412", "roms_temp_sur", "roms_u_sur"]
    known = aggregates.unpivot(composite(spark, sf).select(*columns), [], columns, "feature").groupBy("feature").agg(
        F.count("value").alias("n_known")
    )
    return (
        clean.tracks(spark)
        .join(known, "feature", "left")
        .groupBy("track")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_features"),
            F.count_if(F.col("n_known") > 0).cast("int").alias("n_resolved"),
            F.sum("n_known").alias("n_known"),
        )
    )


IMPUTED = ["C_rrs_412", "A_rrs_412", "CHL_NN", "roms_temp_sur"]


@query(
    "e14_impute_median",
    f"{COMPOSITE}, med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in IMPUTED)} FROM composite) SELECT location_id, obs_date, "
    + ", ".join(f"round(coalesce({c}, m_{c}), {6 if 'roms' in c else 15}) AS {c}" for c in IMPUTED)
    + " FROM composite CROSS JOIN med",
)
def e14(spark, sf):
    # written once: the medians and the filling read the same rows
    rows = written(composite(spark, sf).select("location_id", "obs_date", *IMPUTED))
    out = aggregates.impute_median(rows, IMPUTED)
    return rounded(rounded(out, IMPUTED[:-1], 15), IMPUTED[-1:])


# the evaluation frame: anchors are known in every row, model features are filled by their median
@query(
    "e14_evaluation_frame",
    f"""{COMPOSITE}, common AS (SELECT * FROM composite WHERE C_rrs_412 IS NOT NULL AND A_rrs_412 IS NOT NULL AND B_rrs_412 IS NOT NULL AND location_id <> 'drqnp'),
    med AS (SELECT quantile_cont(roms_temp_sur, 0.5) AS mt, quantile_cont(roms_u_sur, 0.5) AS mu FROM common)
    SELECT location_id, obs_date, round(sin(2 * pi() * dayofyear(obs_date) / 365), 9) AS doy_sin, round(C_rrs_412, 15) AS C_rrs_412, round(A_rrs_412, 15) AS A_rrs_412,
    round(coalesce(roms_temp_sur, mt), 6) AS roms_temp_sur, round(coalesce(roms_u_sur, mu), 6) AS roms_u_sur, 3 AS n_only, 8 AS n_roms FROM common CROSS JOIN med""",
)
def e14_frame(spark, sf):
    _, hybrid, tracks = pipelines.evaluation_frames(composite(spark, sf))
    out = hybrid.select("location_id", "obs_date", "doy_sin", "C_rrs_412", "A_rrs_412", "roms_temp_sur", "roms_u_sur")
    out = out.withColumns({"n_only": F.lit(len(tracks["C2RCC_only"])), "n_roms": F.lit(len(tracks["C2RCC_roms"]))})
    return rounded(rounded(rounded(out, ["doy_sin"], 9), ["C_rrs_412", "A_rrs_412"], 15), ["roms_temp_sur", "roms_u_sur"])


# ------------------------------------------------------------------ D10, E23, E26-E30


AGREE_SQL = """{ctes}, a AS (SELECT loc, obs_date, max(view) AS view, max(click) AS click FROM fx_obs WHERE bin_id % 2 = 0 GROUP BY ALL),
    b AS (SELECT loc, obs_date, max(view) AS view, max(click) AS click FROM fx_obs WHERE bin_id % 3 <> 0 GROUP BY ALL),
    m AS (SELECT abs(a.view - b.view) AS dv, abs(a.click - b.click) AS dc FROM a JOIN b USING (loc, obs_date))
    SELECT 'view' AS species, count(*) AS n_overlap, round(max(dv), 6) AS max_diff, count(*) FILTER (WHERE dv > 1e-3) AS n_differ FROM m
    UNION ALL SELECT 'click', count(*), round(max(dc), 6), count(*) FILTER (WHERE dc > 1e-3) FROM m"""


@query("d10_check_agreement", AGREE_SQL.format(ctes=with_views("obs")))
def d10(spark, sf):
    obs = view(spark, sf, "obs")
    top = lambda cond: obs.where(cond).groupBy("loc", "obs_date").agg(F.max("view").alias("view"), F.max("click").alias("click"))
    out = joins.check_agreement(top("bin_id % 2 = 0"), top("bin_id % 3 <> 0"), ["loc", "obs_date"], ["view", "click"])
    return rounded(out, ["max_diff"])


@query(
    "e23_site_summary",
    f"""{with_views('obs')}, {OBS} SELECT location_id, count(*) AS n_obs, arg_min(latitude, (sample_time, bin_id)) AS latitude, arg_min(station, (sample_time, bin_id)) AS station,
    arg_min(depth, (sample_time, bin_id)) FILTER (WHERE depth IS NOT NULL) AS depth, CASE WHEN count(*) > 65 THEN 'fixed' ELSE 'ship' END AS platform FROM obs GROUP BY 1""",
)
def e23(spark, sf):
    return aggregates.site_summary(located(spark, sf), ["latitude", "station", "depth"], ["sample_time", "bin_id"], 65)


WARNING = {s: float(t["warning"]) for s, t in THRESHOLDS.items()}


@query(
    "e26_bloom_targets",
    f"""{with_views('obs')}, {OBS}, {DAILY} SELECT location_id, obs_date, {", ".join(f"round(CASE WHEN {s} > {w}e0 THEN log10({s} + 1) END, 9) AS y_{s}" for s, w in ((s, int(w)) for s, w in WARNING.items()))}
    FROM daily WHERE {" OR ".join(f"{s} > {int(w)}e0" for s, w in WARNING.items())}""",
)
def e26(spark, sf):
    targets = [f"y_{s}" for s in SPECIES]
    out = aggregates.bloom_targets(daily(spark, sf), SPECIES, WARNING)
    return rounded(out.select("location_id", "obs_date", *targets), targets, 9)


@query(
    "e26_target_stats",
    f"""{with_views('obs')}, {OBS}, {DAILY}, long AS ({" UNION ALL ".join(f"SELECT '{s}' AS species, log10({s} + 1) AS y FROM daily WHERE {s} > {int(w)}e0" for s, w in WARNING.items())})
    SELECT species, count(*) AS n, round(min(y), 9) AS y_min, round(max(y), 9) AS y_max, round(avg(y), 9) AS y_mean FROM long GROUP BY 1""",
)
def e26_stats(spark, sf):
    out = aggregates.target_stats(aggregates.bloom_targets(daily(spark, sf), SPECIES, WARNING), SPECIES)
    return rounded(out, ["y_min", "y_max", "y_mean"], 9)


@query(
    "e27_dataset_summary",
    f"""{with_views('obs')}, {OBS} SELECT count(*) AS n_rows, count(DISTINCT location_id) AS n_locations, count(DISTINCT station) AS n_datasets, min(obs_date) AS first_date, max(obs_date) AS last_date, count(depth) AS n_depth FROM obs""",
)
def e27(spark, sf):
    return aggregates.dataset_summary(located(spark, sf).withColumnRenamed("station", "dataset_id"))


@query(
    "e28_dedup",
    f"""{with_views('obs')} SELECT loc, obs_date, bin_id, species FROM (SELECT *, row_number() OVER (PARTITION BY loc, obs_date ORDER BY concentration DESC, bin_id) AS rn FROM fx_obs) t WHERE rn = 1""",
)
def e28(spark, sf):
    obs = view(spark, sf, "obs").withColumn("_rank", -F.col("concentration")).select("loc", "obs_date", "bin_id", "species", "_rank")
    return aggregates.dedup(obs, ["loc", "obs_date"], ["_rank", "bin_id"]).drop("_rank")


@query(
    "e29_distribution_report",
    f"{with_views('pixels')} "
    + " UNION ALL ".join(
        f"SELECT '{b}' AS name, count({b}) AS n, round(avg({b}), 9) AS mean, round(min({b}), 9) AS min, round(max({b}), 9) AS max, round(quantile_cont({b}, 0.5), 9) AS median FROM fx_pixels"
        for b in ["b02", "b04", "b06", "kd489"]
    ),
)
def e29(spark, sf):
    out = aggregates.distribution_report(view(spark, sf, "pixels"), ["b02", "b04", "b06", "kd489"])
    return rounded(out, ["mean", "min", "max", "median"], 9)


@query(
    "e30_percentile_stretch",
    f"""{with_views('pixels')}, lim AS (SELECT quantile_cont(b04, 0.02) AS lo4, quantile_cont(b04, 0.98) AS hi4, quantile_cont(b06, 0.02) AS lo6, quantile_cont(b06, 0.98) AS hi6 FROM fx_pixels)
    SELECT l_orderkey, acq_idx, round(least(greatest((b04 - lo4) / (hi4 - lo4), 0), 1), 6) AS b04, round(least(greatest((b06 - lo6) / (hi6 - lo6), 0), 1), 6) AS b06 FROM fx_pixels CROSS JOIN lim""",
)
def e30(spark, sf):
    df = view(spark, sf, "pixels").select("l_orderkey", "acq_idx", "b04", "b06")
    return rounded(aggregates.percentile_stretch(df, ["b04", "b06"]), ["b04", "b06"])


# ------------------------------------------------------------------ result tables: D11, D12, E15-E20, E24, E25, W5

METRICS = ["f1", "prauc", "recall"]
CELL = "ac, tier, species"


def cells(spark, sf):
    """Fold means per cell, the shape of a species comparison table."""
    return view(spark, sf, "folds").groupBy("ac", "track", "tier", "species").agg(*[F.avg(m).alias(m) for m in METRICS])


CELLS = f"{with_views('folds')}, cells AS (SELECT ac, track, track_type, tier, species, avg(f1) AS f1, avg(prauc) AS prauc, avg(recall) AS recall FROM fx_folds GROUP BY ALL)"
PAIRED = "o AS (SELECT * FROM cells WHERE track_type = '_only'), m AS (SELECT * FROM cells WHERE track_type = '_roms')"


@query(
    "d11_track_delta",
    f"""{CELLS}, {PAIRED} SELECT ac, tier, species, round(o.f1, 6) AS f1_only, round(m.f1, 6) AS f1_roms, round(m.f1 - o.f1, 6) AS delta_f1 FROM o JOIN m USING (ac, tier, species)""",
)
def d11(spark, sf):
    out = joins.track_delta(cells(spark, sf), ["ac", "tier", "species"], ["f1"])
    return rounded(out, ["f1_only", "f1_roms", "delta_f1"])


@query(
    "d12_source_pairs",
    f"""{with_views('folds')}, s AS (SELECT DISTINCT tier, species, ac FROM fx_folds) SELECT a.tier, a.species, a.ac AS ac_a, b.ac AS ac_b FROM s a JOIN s b ON a.tier = b.tier AND a.species = b.species AND a.ac < b.ac""",
)
def d12(spark, sf):
    return joins.source_pairs(view(spark, sf, "folds"), ["tier", "species"])


STAT_COLUMNS = [f"cv_{m}_{s}" for m in ("f1", "prauc") for s in ("mean", "median", "std")]


@query(
    "e15_fold_stats",
    f"""{with_views('folds')} SELECT ac, track, tier, species, {", ".join(f"round(avg({m}), 9) AS cv_{m}_mean, round(quantile_cont({m}, 0.5), 9) AS cv_{m}_median, round(stddev_pop({m}), 9) AS cv_{m}_std" for m in ("f1", "prauc"))} FROM fx_folds GROUP BY ALL""",
)
def e15(spark, sf):
    out = aggregates.fold_stats(view(spark, sf, "folds"), ["ac", "track", "tier", "species"], ["f1", "prauc"])
    return rounded(out, STAT_COLUMNS, 9)


MACRO = [f"{m}{end}" for m in ("f1", "prauc") for end in ("", "_median", "_std")]


@query(
    "e16_macro_stats",
    f"""{with_views('folds')}, per AS (SELECT ac, track, tier, species, {", ".join(f"avg({m}) AS {m}, quantile_cont({m}, 0.5) AS {m}_median, stddev_pop({m}) AS {m}_std" for m in ("f1", "prauc"))} FROM fx_folds GROUP BY ALL)
    SELECT ac, track, tier, {", ".join(f"round(avg({c}), 9) AS macro_{c}" for c in MACRO)} FROM per GROUP BY ALL""",
)
def e16(spark, sf):
    out = aggregates.macro_stats(view(spark, sf, "folds"), ["ac", "track", "tier"], ["f1", "prauc"])
    return rounded(out, [f"macro_{c}" for c in MACRO], 9)


@query(
    "e17_pivot",
    f"""{CELLS} SELECT ac, tier, species, {", ".join(f"round(any_value(f1) FILTER (WHERE track_type = '{t}'), 9) AS {t}" for t in ("_only", "_roms"))} FROM cells GROUP BY ALL""",
)
def e17(spark, sf):
    df = cells(spark, sf).withColumn("track_type", F.right("track", F.lit(5)))
    return rounded(aggregates.pivot_first(df, ["ac", "tier", "species"], "track_type", "f1", ["_only", "_roms"]), ["_only", "_roms"], 9)


@query(
    "e18_delta_summary",
    f"""{CELLS}, {PAIRED} SELECT ac, tier, species, round(o.f1, 6) AS f1_only, round(m.f1, 6) AS f1_roms, round(m.f1 - o.f1, 6) AS delta_f1, round(o.prauc, 6) AS prauc_only, round(m.prauc, 6) AS prauc_roms,
    round(m.prauc - o.prauc, 6) AS delta_prauc FROM o JOIN m USING (ac, tier, species)""",
)
def e18(spark, sf):
    out = aggregates.delta_summary(cells(spark, sf))
    return rounded(out, [c for c in out.columns if "f1" in c or "prauc" in c])


@query(
    "e18_recall_gain",
    f"""{CELLS}, {PAIRED} SELECT ac, tier, species, round(o.recall, 6) AS recall_only, round(m.recall, 6) AS recall_roms, round(m.recall - o.recall, 6) AS delta_recall,
    round(100 * (m.recall - o.recall), 1) AS extra_blooms_per_100 FROM o JOIN m USING (ac, tier, species)""",
)
def e18_recall(spark, sf):
    return rounded(aggregates.recall_gain(cells(spark, sf)), ["recall_only", "recall_roms", "delta_recall"])


@query(
    "e20_fold_macro",
    f"{with_views('folds')} SELECT ac, track, tier, fold, round(avg(f1), 9) AS f1_macro FROM fx_folds GROUP BY ALL",
)
def e20(spark, sf):
    return rounded(aggregates.fold_macro(view(spark, sf, "folds"), ["ac", "track", "tier", "fold"]), ["f1_macro"], 9)


@query(
    "e24_leakage_gate",
    f"""{with_views('folds')}, a AS (SELECT ac, track, tier, avg(f1) AS f1 FROM fx_folds WHERE fold % 2 = 0 GROUP BY ALL), b AS (SELECT ac, track, tier, avg(f1) AS f1 FROM fx_folds WHERE fold % 2 = 1 OR fold % 4 = 0 GROUP BY ALL)
    SELECT ac, track, tier, round(a.f1, 6) AS spatial_f1, round(b.f1, 6) AS random_f1, round(a.f1 / b.f1, 6) AS leakage_ratio, a.f1 / b.f1 >= 0.99 AS leakage_gate_pass FROM a JOIN b USING (ac, track, tier)""",
)
def e24(spark, sf):
    return rounded(gated(spark, sf), ["spatial_f1", "random_f1", "leakage_ratio"])


@query(
    "e24_gate_failures",
    f"""{with_views('folds')}, a AS (SELECT ac, track, tier, avg(f1) AS f1 FROM fx_folds WHERE fold % 2 = 0 GROUP BY ALL), b AS (SELECT ac, track, tier, avg(f1) AS f1 FROM fx_folds WHERE fold % 2 = 1 OR fold % 4 = 0 GROUP BY ALL)
    SELECT count(*) AS n_cells, count(*) FILTER (WHERE a.f1 / b.f1 < 0.99) AS n_failing FROM a JOIN b USING (ac, track, tier)""",
)
def e24_failures(spark, sf):
    return aggregates.gate_failures(gated(spark, sf))


def gated(spark, sf):
    keys = ["ac", "track", "tier"]
    folds = view(spark, sf, "folds")
    spatial = aggregates.fold_macro(folds.where("fold % 2 = 0"), keys).withColumnRenamed("f1_macro", "f1")
    random = aggregates.fold_macro(folds.where("fold % 2 = 1 OR fold % 4 = 0"), keys).withColumnRenamed("f1_macro", "f1")
    return aggregates.leakage_gate(spatial, random, keys, 0.99)


@query(
    "e25_box_stats",
    f"""{with_views('folds')}, q AS (SELECT ac, tier, species, quantile_cont(f1, 0.25) AS q1, quantile_cont(f1, 0.5) AS median, quantile_cont(f1, 0.75) AS q3 FROM fx_folds GROUP BY ALL)
    SELECT ac, tier, species, round(any_value(q1), 9) AS q1, round(any_value(median), 9) AS median, round(any_value(q3), 9) AS q3, round(min(f1) FILTER (WHERE f1 >= q1 - 1.5 * (q3 - q1)), 9) AS whisker_low,
    round(max(f1) FILTER (WHERE f1 <= q3 + 1.5 * (q3 - q1)), 9) AS whisker_high, count(*) FILTER (WHERE f1 < q1 - 1.5 * (q3 - q1) OR f1 > q3 + 1.5 * (q3 - q1)) AS n_fliers FROM fx_folds JOIN q USING (ac, tier, species) GROUP BY ALL""",
)
def e25(spark, sf):
    out = aggregates.box_stats(view(spark, sf, "folds"), ["ac", "tier", "species"], "f1")
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high"], 9)


@query(
    "w5_top_features",
    """SELECT * FROM (SELECT species, feature, round(importance, 6) AS importance, cast(row_number() OVER (PARTITION BY species ORDER BY importance DESC, feature) AS int) AS rank
    FROM (SELECT p_type AS species, p_brand AS feature, avg(p_size) - 25 AS importance FROM part GROUP BY ALL) t WHERE importance > 0) u WHERE rank <= 10""",
)
def w5(spark, sf):
    scores = read(spark, sf, "part").groupBy(F.col("p_type").alias("species"), F.col("p_brand").alias("feature")).agg(
        (F.avg("p_size") - 25).alias("importance")
    )
    return rounded(aggregates.top_features(scores), ["importance"])
