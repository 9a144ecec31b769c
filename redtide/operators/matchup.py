"""Pixel validity, compositing over scenes, spatial summaries, scene quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redtide import constants as K
from redtide.functions.geo import inside_polygon
from redtide.functions.scalars import nan_to_null
from redtide.operators.ranking import all_of, any_of


def grid_flag_ok(quality="quality_flags", processor="ac_flags"):
    water = F.col(quality).cast("bigint").bitwiseAND(F.lit(K.WATER_BIT).cast("bigint")) != 0
    retrieved = F.col(processor).cast("bigint").bitwiseAND(F.lit(K.VALID_PE_BIT).cast("bigint")) != 0
    return water & retrieved


def scene_site_flags(candidates: DataFrame, scene_loc: list[str], *extra) -> DataFrame:
    """One row per (scene, location): does any of its pixels pass the flags? Few columns are
    read and the aggregate combines before its shuffle."""
    return candidates.groupBy(*scene_loc).agg(F.max(grid_flag_ok()).alias("flag_any"), *extra)


def mask_grid_pixels(
    candidates: DataFrame, scene_loc: list[str], bands: list[str], flags: DataFrame | None = None
) -> DataFrame:
    """Null all bands of invalid pixels: by the flags where the (scene, location) has any pixel
    that passes them, otherwise by 'every band above zero'. Adds `pixel_ok`.

    The decision joins a table of one row per (scene, location) instead of running a window
    over its pixels, so a scene with very many candidates is not drawn into one task.
    """
    flags = scene_site_flags(candidates, scene_loc) if flags is None else flags
    positive = all_of([F.coalesce(F.col(b) > 0, F.lit(False)) for b in bands])
    ok = F.when(F.col("flag_any"), grid_flag_ok()).otherwise(positive)
    return (
        candidates.join(flags.select(*scene_loc, "flag_any"), scene_loc)
        .withColumn("pixel_ok", ok)
        .withColumns({b: F.when(F.col("pixel_ok"), nan_to_null(F.col(b))) for b in bands})
        .drop("flag_any")
    )


def mask_iops(df: DataFrame, iops: list[str], ok: str = "pixel_ok") -> DataFrame:
    """Inherent optical properties count where the pixel does and they are positive and finite."""
    return df.withColumns({c: F.when(F.col(ok) & (F.col(c) > 0), nan_to_null(F.col(c))) for c in iops})


def mask_swath_pixels(df: DataFrame, bands: list[str], flag: str = "l2_flags") -> DataFrame:
    """A pixel counts when its flag is exactly 0; a missing flag makes it invalid."""
    clear = F.coalesce(F.col(flag) == 0, F.lit(False))
    return df.withColumns({b: F.when(clear, nan_to_null(F.col(b))) for b in bands})


def joint_ok(bands: list[str], optical: str = "optical_valid"):
    return F.col(optical) & all_of([F.coalesce(nan_to_null(F.col(b)) > 0, F.lit(False)) for b in bands])


def mask_joint(df: DataFrame, bands: list[str], optical: str = "optical_valid") -> DataFrame:
    """All bands of a pixel, or none: valid retrieval and every band positive and finite."""
    ok = joint_ok(bands, optical)
    return df.withColumn("joint_ok", ok).withColumns({b: F.when(F.col("joint_ok"), F.col(b)) for b in bands})


def mvc(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Maximum-value composite: every band on its own, over all scenes of a pixel."""
    return pixels.groupBy(*keys).agg(*[F.max(b).alias(b) for b in bands])


def few_medians(df: DataFrame, keys: list[str], columns: dict[str, Column], beside: list[Column] = ()) -> DataFrame:
    """Exact medians of many columns for groups known to be small, nulls ignored.

    Sorting a short list per column costs a fraction of the value map `percentile` keeps. Only
    for groups with a bound of their own, such as the lattice positions of one box; anything
    else goes through `ranking.quantiles`.
    """
    listed = df.groupBy(*keys).agg(*beside, *[F.sort_array(F.collect_list(c)).alias(n) for n, c in columns.items()])
    last = lambda n: F.size(n) - 1
    middle = lambda n: (F.get(n, F.shiftright(last(n), 1)) + F.get(n, F.shiftright(last(n) + 1, 1))) / 2
    return listed.withColumns({n: middle(n) for n in columns})


def spatial_summary(
    composite: DataFrame,
    keys: list[str],
    bands: list[str],
    columns: list[str],
    min_valid: int = K.MIN_VALID_PIXELS,
    require_all: bool = False,
    total: int | None = None,
) -> DataFrame:
    """Median per column over the pixels of an observation with any (or all) bands valid.

    After compositing a group has one row per lattice position inside the box, about 225,
    whatever the number of scenes.
    """
    present = [F.col(b).isNotNull() for b in bands]
    valid = all_of(present) if require_all else any_of(present)
    n_total = F.lit(total) if total else F.count(F.lit(1))
    medians = few_medians(
        composite.withColumn("_ok", valid),
        keys,
        {c: F.when(F.col("_ok"), nan_to_null(F.col(c))) for c in columns},
        [
            F.count_if("_ok").alias("n_valid_pixels"),
            (100.0 * F.count_if("_ok") / n_total).alias("pct_valid_pixels"),
        ],
    )
    return medians.where(F.col("n_valid_pixels") >= min_valid)


def best_acquisition(
    df: DataFrame, keys: list[str], bands: list[str], lead: str = "b08", order: str = "acq_idx", mask: str = "data_mask"
) -> DataFrame:
    """All bands of the acquisition with the highest lead band among usable ones (mask = 1 and
    lead > 0); the first acquisition wins a tie. `optical_valid` tells whether there was one."""
    usable = (F.col(mask) == 1) & (F.col(lead) > 0)
    rank = F.when(usable, F.struct(F.col(lead), -F.col(order)))
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*bands), rank).alias("_best"), F.coalesce(F.max(usable), F.lit(False)).alias("optical_valid"))
        .select(*keys, "optical_valid", *[F.coalesce(F.col(f"_best.{b}"), F.lit(0.0)).alias(b) for b in bands])
    )


def derived_max(df: DataFrame, keys: list[str], columns: list[str], mask: str = "data_mask") -> DataFrame:
    """Largest value of each product over the usable acquisitions, never below zero."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.greatest(F.max(F.when(F.col(mask) == 1, F.col(c))), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]
    )


def derived_max_median(
    df: DataFrame, pixel_keys: list[str], keys: list[str], columns: list[str], mask: str = "data_mask"
) -> DataFrame:
    """Per pixel the largest value, then the median over pixels above zero (one row per patch
    position, so the group is bounded by the patch)."""
    peaks = derived_max(df, pixel_keys, columns, mask)
    return few_medians(peaks, keys, {c: F.when(F.col(c) > 0, nan_to_null(F.col(c))) for c in columns})


def accept_matchups(
    summary: DataFrame, bands: list[str], derived: list[str], min_valid: int = K.MIN_VALID_PIXELS
) -> DataFrame:
    """Keep optical records with enough jointly valid pixels. With too few optical pixels keep
    the derived products alone if there are any; otherwise drop the record.

    Expects n_optical, n_joint and n_total beside the medians.
    """
    optical = F.col("n_optical") >= min_valid
    has_derived = any_of([F.col(d).isNotNull() for d in derived])
    count = F.when(optical, F.col("n_joint")).otherwise(F.col("n_optical"))
    return (
        summary.where((optical & (F.col("n_joint") >= min_valid)) | (~optical & has_derived))
        .withColumns({b: F.when(optical, F.col(b)) for b in bands})
        .withColumns({"n_valid_pixels": count, "pct_valid_pixels": 100.0 * count / F.col("n_total")})
        .drop("n_optical", "n_joint", "n_total")
    )


def scene_cloud_fraction(
    df: DataFrame, scene: list[str], ring=K.POLYGON_CLOUD, max_frac: float = 0.5, flags: str = "quality_flags"
) -> DataFrame:
    """Cloud share of each scene inside the polygon and whether the scene is usable.

    A scene with no pixel inside has a null share; one with no valid pixel counts as cloudy.
    """
    bit = lambda mask: F.col(flags).cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")) != 0
    inside = F.coalesce(inside_polygon(F.col("lon"), F.col("lat"), ring), F.lit(False))
    valid = inside & ~bit(K.INVALID_BIT)
    cloudy = valid & bit(K.CLOUD_BIT | K.CLOUD_AMBIGUOUS_BIT)
    counted = df.groupBy(*scene).agg(
        F.count_if(inside).alias("n_pixels_aoi"), F.count_if(valid).alias("n_valid"), F.count_if(cloudy).alias("n_cloud")
    )
    share = F.when(F.col("n_valid") > 0, F.col("n_cloud") / F.col("n_valid")).when(F.col("n_pixels_aoi") > 0, 1.0)
    return counted.withColumn("cloud_frac", share).withColumn(
        "usable", F.coalesce(F.col("cloud_frac") < max_frac, F.lit(False))
    )
