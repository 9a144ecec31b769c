"""The reference's end-to-end runs, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redtide import constants as K
from redtide.functions.spectral import GRID_ROLES, SWATH_ROLES, spectral_indices
from redtide.operators import blocking, clean, joins, matchup, metrics
from redtide.operators.aggregates import daily_p95, fold_stats, impute_median
from redtide.session import written


def prepare_observations(
    raw: DataFrame,
    species: list[str] = K.CONCENTRATION_COLUMNS,
    first: list[str] = ("latitude", "longitude", "station", "depth"),
    ring=None,
    from_year: int | None = None,
    stations: dict | None = None,
    excluded=(),
    station_col: str = "station",
    order=("sample_time", "bin_id"),
) -> DataFrame:
    """Raw bins to daily observations: years, excluded stations, canonical station positions,
    day key, daily p95, polygon."""
    obs = clean.filter_years(raw, from_year) if from_year else raw
    if excluded:
        obs = clean.exclude_stations(obs, excluded, station_col)
    if stations:
        obs = clean.override_stations(obs, stations, station_col, order)
    daily = daily_p95(obs, species, list(first), order=list(order))
    return clean.filter_polygon(daily, ring) if ring else daily


def site_days(daily: DataFrame, days: int = K.WINDOW_DAYS) -> DataFrame:
    """Every (location, day) some observation looks at, with the observation days that do.

    A pixel is then matched once per location and day instead of once per observation; the
    array has at most days + 1 entries.
    """
    return (
        joins.window_days(daily.select("location_id", "latitude", "longitude", "obs_date"), days)
        .groupBy("location_id", "latitude", "longitude", "scene_date")
        .agg(F.collect_set("obs_date").alias("obs_dates"))
    )


def grid_matchup(
    daily: DataFrame,
    pixels: DataFrame,
    scene_keys: list[str],
    bands: list[str] = K.GRID_BANDS,
    iops: list[str] = (),
    roles: dict[str, str] = GRID_ROLES,
    half_deg: float = K.HALF_BOX_DEG,
    days: int = K.WINDOW_DAYS,
    min_valid: int = K.MIN_VALID_PIXELS,
) -> DataFrame:
    """Features per (location, day): composite of the past days' scenes in the box around the
    location, indices per composite pixel, medians over the pixels."""
    spots = written(site_days(daily, days))
    pixels = joins.prune_pixels(pixels, spots, half_deg * 1.001)
    scene_loc = ["location_id", *scene_keys]
    # the few pixels near a location are written once; flags and bands then read that copy
    # instead of scanning all pixels twice
    candidates = written(joins.box_join(spots, pixels, half_deg))
    flags = matchup.scene_site_flags(candidates, scene_loc)
    masked = matchup.mask_grid_pixels(candidates, scene_loc, list(bands), flags)
    if iops:
        masked = matchup.mask_iops(masked, list(iops))
    per_obs = joins.pixel_keys(masked.withColumn("obs_date", F.explode("obs_dates")))
    composite = matchup.mvc(per_obs, ["location_id", "obs_date", "lat_px", "lon_px"], [*bands, *iops])
    # one shuffle on the observation carries the bands; indices are worked out behind it
    indexed = spectral_indices(composite.repartition("location_id", "obs_date"), roles)
    summary = matchup.spatial_summary(
        indexed, ["location_id", "obs_date"], list(bands), [*bands, *K.INDEX_NAMES, *iops], min_valid
    )
    used = (
        flags.join(spots.select("location_id", "scene_date", "obs_dates"), ["location_id", "scene_date"])
        .withColumn("obs_date", F.explode("obs_dates"))
        .groupBy("location_id", "obs_date")
        .agg(F.count(F.lit(1)).alias("n_mosaics_used"))
    )
    return summary.join(used, ["location_id", "obs_date"])


def swath_matchup(
    daily: DataFrame,
    pixels: DataFrame,
    scene_keys: list[str],
    bands: list[str] = K.SWATH_BANDS,
    roles: dict[str, str] = SWATH_ROLES,
    flag: str = "l2_flags",
    half_deg: float = K.HALF_BOX_DEG,
    res_deg: float = K.SWATH_RESOLUTION_DEG,
    radius_m: float = K.SWATH_RADIUS_M,
    days: int = K.WINDOW_DAYS,
    min_valid: int = K.MIN_VALID_PIXELS,
) -> DataFrame:
    """As `grid_matchup` for irregular swaths, resampled to a fixed local grid first."""
    spots = written(site_days(daily, days))
    # a pixel up to the search radius outside the box can still be the nearest; a scene's outline
    # needs all its pixels, so only the days are cut for it
    outlines = scenes_in_reach(spots, joins.prune_days(pixels, spots), scene_keys, half_deg)
    pixels = joins.prune_pixels(pixels, spots, half_deg + 0.1)
    gridded = joins.resample_nearest(spots, pixels, scene_keys, [*bands, flag], half_deg, res_deg, radius_m)
    masked = matchup.mask_swath_pixels(gridded, list(bands), flag)
    composite = matchup.mvc(
        masked.withColumn("obs_date", F.explode("obs_dates")), ["location_id", "obs_date", "row", "col"], list(bands)
    )
    summary = matchup.spatial_summary(
        spectral_indices(composite.repartition("location_id", "obs_date"), roles),
        ["location_id", "obs_date"],
        list(bands),
        [*bands, *K.INDEX_NAMES],
        min_valid,
        total=joins.swath_side(half_deg, res_deg) ** 2,
    )
    return summary.join(outlines, ["location_id", "obs_date"])


def scenes_in_reach(spots: DataFrame, pixels: DataFrame, scene_keys: list[str], half_deg: float) -> DataFrame:
    """Scenes per observation whose outline meets the local grid's.

    Outlines and grids meet in cells of one degree, so a day's scenes and sites are not all paired; the
    cell of the corner where the two boxes begin to overlap counts a pair once.
    """
    outline = pixels.groupBy(*scene_keys).agg(
        F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e")
    )
    meets = (
        (F.col("_e") >= F.col("longitude") - half_deg)
        & (F.col("_w") <= F.col("longitude") + half_deg)
        & (F.col("_n") >= F.col("latitude") - half_deg)
        & (F.col("_s") <= F.col("latitude") + half_deg)
    )
    cells = lambda low, high: F.explode(F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int")))
    lat, lon = F.col("latitude"), F.col("longitude")
    outline = outline.withColumn("_cy", cells(F.col("_s"), F.col("_n"))).withColumn("_cx", cells(F.col("_w"), F.col("_e")))
    spots = spots.withColumn("_cy", cells(lat - half_deg, lat + half_deg)).withColumn("_cx", cells(lon - half_deg, lon + half_deg))
    once = (F.floor(F.greatest("_s", lat - half_deg)) == F.col("_cy")) & (F.floor(F.greatest("_w", lon - half_deg)) == F.col("_cx"))
    return (
        spots.join(outline, ["scene_date", "_cy", "_cx"])
        .where(meets & once)
        .withColumn("obs_date", F.explode("obs_dates"))
        .groupBy("location_id", "obs_date")
        .agg(F.count(F.lit(1)).alias("n_scenes"))
    )


def patch_matchup(
    daily: DataFrame,
    acquisitions: DataFrame,
    bands: list[str],
    derived: list[str],
    roles: dict[str, str],
    pixel: tuple[str, str] = ("px_row", "px_col"),
    lead: str = "b08",
    days: int = K.WINDOW_DAYS,
    min_valid: int = K.MIN_VALID_PIXELS,
) -> DataFrame:
    """Features from patches of acquisitions (location_id, scene_date, pixel, acq_idx, bands,
    products): best acquisition per pixel, joint validity, medians, acceptance."""
    obs_keys = ["location_id", "obs_date"]
    pixel_keys = [*obs_keys, *pixel]
    # both reductions of a patch read the same acquisitions
    seen = written(joins.window_days(daily.select(*obs_keys), days).join(acquisitions, ["location_id", "scene_date"]))
    best = matchup.best_acquisition(seen, pixel_keys, bands, lead)
    masked = spectral_indices(matchup.mask_joint(best, bands).repartition(*obs_keys), roles)
    optical = matchup.few_medians(
        masked,
        obs_keys,
        {c: F.when(F.col("joint_ok"), F.col(c)) for c in [*bands, *K.INDEX_NAMES]},
        [
            F.count(F.lit(1)).alias("n_total"),
            F.count_if("optical_valid").alias("n_optical"),
            F.count_if("joint_ok").alias("n_joint"),
        ],
    )
    products = matchup.derived_max_median(seen, pixel_keys, obs_keys, derived)
    return matchup.accept_matchups(optical.join(products, obs_keys), [*bands, *K.INDEX_NAMES], derived, min_valid)


def ocean_lags(daily: DataFrame, grid: DataFrame, fields: DataFrame, from_year: int | None = None, lags=K.LAGS) -> DataFrame:
    """Nearest ocean cell, then the model variables at each lag."""
    placed = joins.nearest_cell(clean.filter_years(daily, from_year) if from_year else daily, grid)
    return joins.lag_join(placed.where("in_domain").drop("in_domain"), fields, lags)


def composite_table(base: DataFrame, sources: dict[str, DataFrame], shared: list[str], keep: dict[str, list[str]]) -> DataFrame:
    """Model features at lag 0 with the satellite features of every source beside them, joined
    on integer positions and the day."""
    keys = ["lat_key", "lon_key", "obs_date"]
    sides = [
        clean.slim(clean.with_micro_keys(df), prefix, [*shared, "latitude", "longitude"], keep.get(prefix, []), keys)
        for prefix, df in sources.items()
    ]
    return clean.assert_no_suffix_columns(joins.compose(clean.with_micro_keys(clean.same_day(base)), sides, keys))


# ---------------------------------------------------------------- evaluation


def evaluation_frames(
    composite: DataFrame,
    prefixes: dict[str, str] = K.SOURCE_PREFIXES,
    model_features: list[str] = K.MODEL_FEATURES,
    numbered: str = "C_",
    spatial_block=None,
) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """Rows and features of the random evaluation: same-day rows with season, one band naming,
    excluded locations gone, only rows every source has, medians in the gaps.

    Returns the colour-only frame, the frame with model features (filled by its own medians)
    and the features of each track. `spatial_block` is applied before the common rows are
    taken, the order spatial evaluation needs.
    """
    rows = clean.same_day(composite) if "delta_days" in composite.columns else composite
    rows = clean.rename_bands(clean.with_season(rows), prefix=numbered)
    rows = clean.exclude_locations(rows)
    if spatial_block is not None:
        rows = spatial_block(rows)
    common = written(joins.common_rows(rows, prefixes))
    hybrid = joins.filter_if_present(common)
    wanted = clean.track_features(prefixes, model_features)
    colour = {t: clean.resolve_features(common, fs) for t, fs in wanted.items() if t.endswith("_only")}
    model = clean.resolve_features(hybrid, list(model_features))
    tracks = {}
    for track, features in colour.items():
        if features:
            base = track.removesuffix("_only")
            tracks[track] = features
            tracks[f"{base}_roms"] = clean.resolve_features(hybrid, features) + model
    filled = list(dict.fromkeys(f for fs in tracks.values() for f in fs))
    only_columns = [f for f in filled if f in common.columns]
    return impute_median(common, only_columns), impute_median(hybrid, filled), tracks


def spatial_blocks(rows: DataFrame, datasets, species: list[str], size_m: float, min_obs: int = 5, dataset_col: str = "dashboardIdName"):
    """Spatial twin of the preparation: dataset scope, metres, bloom index, grid blocks, sparse
    blocks merged."""
    scoped = clean.with_bloom_index(clean.project_utm(clean.scope(rows, datasets, dataset_col)), species)
    return blocking.merge_sparse_blocks(blocking.grid_blocks(scoped, size_m), min_obs, size_m)


def fold_results(predictions: DataFrame, tags: list[str], spatial: bool = False) -> DataFrame:
    """F1, precision, recall and average precision per tag, fold and species."""
    keys = [*tags, "fold", "species"]
    return metrics.prf(predictions, keys, spatial).join(metrics.average_precision(predictions, keys), keys)


def species_comparison(folds: DataFrame, tags: list[str]) -> DataFrame:
    return fold_stats(folds, [*tags, "species"], ["f1", "prauc", "recall", "precision"])


def global_comparison(predictions: DataFrame, folds: DataFrame, tags: list[str], row_id: list[str] = ("row_id",)) -> DataFrame:
    """Macro F1 and AP, Hamming loss, subset accuracy and Jaccard per fold, summed up over the
    folds of each tag."""
    keys = [*tags, "fold"]
    per_fold = (
        metrics.macro_by_fold(folds, keys)
        .join(metrics.hamming_subset(predictions, keys, row_id), keys)
        .join(metrics.jaccard_macro(predictions, keys), keys)
    )
    stats = fold_stats(per_fold, tags, ["f1_macro", "prauc_macro", "hamming", "subset_acc", "jaccard"])
    counts = per_fold.groupBy(*tags).agg(
        F.count(F.lit(1)).alias("n_folds_used"), F.avg("n_zero_positive").alias("avg_zero_pos_species_per_fold")
    )
    return stats.join(counts, tags)
