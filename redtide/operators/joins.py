"""Space and time joins, all as equi joins on buckets with the true predicate on top."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redtide import constants as K
from redtide.functions.geo import cell_of, cells_around, chord_m, degrees_of, micro_key
from redtide.functions.scalars import flow_vectors
from redtide.operators.clean import resolve_features
from redtide.operators.ranking import all_of


MOST_DATASETS = 10_000

def window_days(obs: DataFrame, days: int = K.WINDOW_DAYS, after: int = 0, day: str = "scene_date") -> DataFrame:
    """One row per observation and calendar day from `days` before it to `after` days past it.

    The default looks back only; `after=days` gives the symmetric variant.
    """
    span = F.sequence(F.date_sub("obs_date", days), F.date_add("obs_date", after))
    return obs.withColumn(day, F.explode(span))


def window_join(obs: DataFrame, scenes: DataFrame, days: int = K.WINDOW_DAYS, after: int = 0) -> DataFrame:
    """Observations with every scene of their window; an equi join on the day."""
    return window_days(obs, days, after).join(scenes, "scene_date")


def box_join(
    sites: DataFrame,
    pixels: DataFrame,
    half_deg: float = K.HALF_BOX_DEG,
    on: tuple[str, ...] = ("scene_date",),
    salts: int = 1,
) -> DataFrame:
    """Pixels (lat, lon) within `half_deg` of a site (latitude, longitude) in both directions.

    A site is copied to the at most four cells its box meets; a pixel stays in its one cell,
    so the big side is never multiplied before the join. `salts` cuts the pixels of every cell
    into that many parts (and copies the sites), for data where one cell is hot and the join
    cannot be a broadcast; adaptive execution splits a skewed cell by itself otherwise.
    """
    size = 2 * half_deg
    left = sites.withColumn("_cy", F.explode(cells_around(F.col("latitude"), half_deg, size))).withColumn(
        "_cx", F.explode(cells_around(F.col("longitude"), half_deg, size))
    )
    right = pixels.withColumns({"_cy": cell_of(F.col("lat"), size), "_cx": cell_of(F.col("lon"), size)})
    keys = [*on, "_cy", "_cx"]
    if salts > 1:
        left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        right = right.withColumn("_salt", F.pmod(F.xxhash64("lat", "lon"), F.lit(salts)).cast("int"))
        keys.append("_salt")
    near = (F.abs(F.col("lat") - F.col("latitude")) <= half_deg) & (
        F.abs(F.col("lon") - F.col("longitude")) <= half_deg
    )
    return right.join(left, keys).where(near).drop("_cy", "_cx", "_salt")


def prune_pixels(pixels: DataFrame, sites: DataFrame, reach_deg: float, day: str = "scene_date") -> DataFrame:
    """Pixels in the days and the bounding box of the sites, widened by `reach_deg`.

    Six numbers of the (small) site table become literals, so the scan of the pixels can skip
    partitions and row groups before any join.
    """
    box = sites.agg(
        F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude"), F.min(day), F.max(day)
    ).first()
    if box[0] is None:
        return pixels.limit(0)
    south, north, west, east = box[0] - reach_deg, box[1] + reach_deg, box[2] - reach_deg, box[3] + reach_deg
    return pixels.where(
        F.col("lat").between(south, north) & F.col("lon").between(west, east) & F.col(day).between(box[4], box[5])
    )


def prune_days(pixels: DataFrame, sites: DataFrame, day: str = "scene_date") -> DataFrame:
    """Pixels between the first and the last day of the sites."""
    first, last = sites.agg(F.min(day), F.max(day)).first()
    return pixels.limit(0) if first is None else pixels.where(F.col(day).between(first, last))


def nearest_cell(obs: DataFrame, grid: DataFrame, max_deg: float = K.MAX_GRID_DIST_DEG, bbox=K.MODEL_BBOX) -> DataFrame:
    """The nearest ocean cell of every observation, null beyond `max_deg` or outside the box.

    Distinct positions are searched once and joined back, so a mooring with a third of all
    rows costs one search. Distances are Euclidean in degrees; ties go to the lower index.
    """
    sea = grid.where((F.col("h") > 0) & ~F.isnan("h")) if "h" in grid.columns else grid.where(F.col("lat").isNotNull())
    places = obs.select("latitude", "longitude").where(
        F.col("latitude").between(bbox["south"], bbox["north"])
        & F.col("longitude").between(bbox["west"], bbox["east"])
    ).distinct()
    spots = places.withColumn("_cy", F.explode(cells_around(F.col("latitude"), max_deg, 2 * max_deg))).withColumn(
        "_cx", F.explode(cells_around(F.col("longitude"), max_deg, 2 * max_deg))
    )
    cells = sea.select(
        "eta", "xi", "lat", "lon", cell_of(F.col("lat"), 2 * max_deg).alias("_cy"), cell_of(F.col("lon"), 2 * max_deg).alias("_cx")
    )
    dlat, dlon = F.col("latitude") - F.col("lat"), F.col("longitude") - F.col("lon")
    best = (
        spots.join(cells, ["_cy", "_cx"])
        .withColumn("_dist", F.sqrt(dlat * dlat + dlon * dlon))
        .where(F.col("_dist") <= max_deg)
        .groupBy("latitude", "longitude")
        .agg(F.min(F.struct("_dist", "eta", "xi")).alias("_best"))
    )
    return obs.join(best, ["latitude", "longitude"], "left").select(
        *[f"`{c}`" for c in obs.columns],
        F.col("_best.eta").alias("roms_eta"),
        F.col("_best.xi").alias("roms_xi"),
        (F.col("_best._dist") * 111.0).alias("roms_grid_dist_km"),
        F.col("_best").isNotNull().alias("in_domain"),
    )


def resample_nearest(
    sites: DataFrame,
    pixels: DataFrame,
    scene_keys: list[str],
    values: list[str],
    half_deg: float = K.HALF_BOX_DEG,
    res_deg: float = K.SWATH_RESOLUTION_DEG,
    radius_m: float = K.SWATH_RADIUS_M,
    on: tuple[str, ...] = ("scene_date",),
) -> DataFrame:
    """Swath pixels on the n x n grid around each site: the nearest pixel within `radius_m`.

    n = ceil(2 * half / res) + 1 targets per side, 2 * half / n apart. Instead of searching
    from every target, each candidate pixel is offered to the few targets it can reach, and
    the closest offer wins. Pixels are shuffled once for a site and scene, before they become several
    offers each. Ties go to the lower latitude, then longitude.
    """
    side = swath_side(half_deg, res_deg)
    step = 2 * half_deg / side
    reach_lat = degrees_of(radius_m)
    # box wide enough for both axes at any latitude a site can have
    reach_lon = F.lit(reach_lat) / F.cos(F.radians(F.least(F.abs(F.col("latitude")) + half_deg + reach_lat, F.lit(89.9))))
    size = 4 * half_deg
    spots = sites.withColumn("_rl", reach_lon)
    left = spots.withColumn(
        "_cy", F.explode(cells_around(F.col("latitude"), half_deg + reach_lat, size))
    ).withColumn("_cx", F.explode(cells_around(F.col("longitude"), F.col("_rl") + half_deg, size)))
    right = pixels.withColumns({"_cy": cell_of(F.col("lat"), size), "_cx": cell_of(F.col("lon"), size)})

    def reached(offset, reach):
        """First and last of the targets whose centre is within `reach` of a pixel at `offset`."""
        low = F.greatest(F.ceil((offset - reach) / step - 0.5 - 1e-9), F.lit(0)).cast("int")
        high = F.least(F.floor((offset + reach) / step - 0.5 + 1e-9), F.lit(side - 1)).cast("int")
        return F.struct(low.alias("low"), high.alias("high"))

    each = lambda span: F.explode(F.sequence(f"{span}.low", f"{span}.high"))
    keys = [*sites.columns, *[k for k in scene_keys if k not in sites.columns]]
    met = (
        right.join(left, [*on, "_cy", "_cx"])
        .withColumn("_rows", reached(F.col("lat") - F.col("latitude") + half_deg, F.lit(reach_lat)))
        .withColumn("_cols", reached(F.col("lon") - F.col("longitude") + half_deg, F.col("_rl")))
        .where("_rows.low <= _rows.high and _cols.low <= _cols.high")
        .select(*keys, "lat", "lon", *values, "_rows", "_cols")
        .repartition(*keys)
    )
    offered = (
        met.withColumn("row", each("_rows"))
        .withColumn("col", each("_cols"))
        .withColumn(
            "_dist",
            chord_m(
                F.col("latitude") - half_deg + (F.col("row") + 0.5) * step,
                F.col("longitude") - half_deg + (F.col("col") + 0.5) * step,
                F.col("lat"),
                F.col("lon"),
            ),
        )
        .where(F.col("_dist") <= radius_m)
    )
    nearest = F.min(F.struct("_dist", "lat", "lon", *values)).alias("_near")
    return offered.groupBy(*keys, "row", "col").agg(nearest).select(*keys, "row", "col", *[f"_near.{v}" for v in values])


def swath_side(half_deg: float = K.HALF_BOX_DEG, res_deg: float = K.SWATH_RESOLUTION_DEG) -> int:
    """Targets per side of the local grid."""
    return math.ceil(2 * half_deg / res_deg) + 1


def distinct_cells(obs: DataFrame, lags=K.LAGS) -> DataFrame:
    """Distinct (model_date, eta, xi) the lag join will read."""
    return lag_rows(obs, lags).select("model_date", "eta", "xi").distinct()


def lag_rows(obs: DataFrame, lags=K.LAGS) -> DataFrame:
    return (
        obs.where(F.col("roms_eta").isNotNull())
        .withColumn("delta_days", F.explode(F.array(*[F.lit(d).cast("tinyint") for d in lags])))
        .withColumn("model_date", F.date_add("obs_date", F.col("delta_days").cast("int")))
        .withColumns({"eta": F.col("roms_eta"), "xi": F.col("roms_xi")})
    )


def lag_join(obs: DataFrame, fields: DataFrame, lags=K.LAGS) -> DataFrame:
    """Model variables at lagged days for observations that have a cell; a lag whose model day
    is missing has no row. The fields are cut to the wanted cells before they are shuffled."""
    variables = [c for c in fields.columns if c not in ("model_date", "eta", "xi")]
    wanted = fields.join(distinct_cells(obs, lags), ["model_date", "eta", "xi"], "left_semi")
    named = wanted.select("model_date", "eta", "xi", *[F.col(c).alias(f"roms_{c}") for c in variables])
    joined = lag_rows(obs, lags).join(named, ["model_date", "eta", "xi"])
    return flow_vectors(joined).withColumnRenamed("model_date", "roms_date").drop("eta", "xi")


def attach_metadata(counts: DataFrame, meta: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """Counts LEFT JOIN bin metadata. In a dataset with metadata its position and time replace
    the inline ones (null where a bin has none); in a dataset without any, inline ones stay."""
    taken = [c for c in ("sample_time", "latitude", "longitude") if c in meta.columns]
    other = [c for c in meta.columns if c not in {"pid", dataset, *taken}]
    side = meta.select(
        dataset, F.col("pid").alias("bin_pid"), *[F.col(c).alias(f"_m_{c}") for c in taken], *other
    )
    # one row per dataset. Datasets are few and can hold most rows, so the table of them is sent to all
    # tasks when it is seen to be small; otherwise the planner decides
    described = meta.select(dataset).distinct().withColumn("_has_meta", F.lit(True))
    if described.limit(MOST_DATASETS + 1).count() <= MOST_DATASETS:
        described = F.broadcast(described)
    joined = counts.join(side, [dataset, "bin_pid"], "left").join(described, dataset, "left")
    return joined.withColumns(
        {c: F.when(F.col("_has_meta"), F.col(f"_m_{c}")).otherwise(F.col(c)) for c in taken}
    ).drop("_has_meta", *[f"_m_{c}" for c in taken])


def attach_features(obs: DataFrame, features: DataFrame, anchor: str, keys=("obs_date", "location_id")) -> DataFrame:
    """Observations LEFT JOIN features, with `data_available` where the anchor band is there."""
    return obs.join(features, list(keys), "left").withColumn("data_available", F.col(anchor).isNotNull())


def compose(base: DataFrame, sources: list[DataFrame], keys=("lat_key", "lon_key", "obs_date")) -> DataFrame:
    """Left-join chain on integer position keys; duplicates on a right side fan rows out."""
    for side in sources:
        base = base.join(side, list(keys), "left")
    return base


def check_agreement(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tol: float = 1e-3) -> DataFrame:
    """Per column: overlapping rows, largest absolute difference, differences above `tol`.

    Both sides are made unique first; the row kept is the smallest, so reruns agree.
    """

    def unique(df: DataFrame, suffix: str) -> DataFrame:
        packed = F.min(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_v")
        return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_v.`{c}`").alias(f"{c}{suffix}") for c in columns])

    merged = unique(a, "_a").join(unique(b, "_b"), keys)
    pairs = [
        F.struct(F.lit(c).alias("species"), F.abs(F.col(f"`{c}_a`") - F.col(f"`{c}_b`")).alias("diff")) for c in columns
    ]
    return (
        merged.select(F.explode(F.array(*pairs)).alias("_p"))
        .groupBy("_p.species")
        .agg(
            F.count(F.lit(1)).alias("n_overlap"),
            F.max("_p.diff").alias("max_diff"),
            F.count_if(F.col("_p.diff") > tol).alias("n_differ"),
        )
    )


def track_delta(df: DataFrame, keys: list[str], metrics: list[str], track: str = "track") -> DataFrame:
    """`_only` and `_roms` values side by side with their difference, in one aggregation."""
    only, roms = F.col(track).endswith("_only"), F.col(track).endswith("_roms")
    paired = df.groupBy(*keys).agg(
        *[
            F.max(F.when(side, F.col(m))).alias(f"{m}{suffix}")
            for m in metrics
            for side, suffix in ((only, "_only"), (roms, "_roms"))
        ],
        F.count_if(only).alias("_n_only"),
        F.count_if(roms).alias("_n_roms"),
    )
    return (
        paired.where((F.col("_n_only") > 0) & (F.col("_n_roms") > 0))
        .withColumns({f"delta_{m}": F.col(f"{m}_roms") - F.col(f"{m}_only") for m in metrics})
        .drop("_n_only", "_n_roms")
    )


def source_pairs(df: DataFrame, keys: list[str], source: str = "ac") -> DataFrame:
    """Unordered pairs of the sources each group has. The join runs on distinct sources, of
    which there are a handful, never on rows."""
    present = df.select(*keys, source).distinct()
    a = present.withColumnRenamed(source, "ac_a")
    b = present.withColumnRenamed(source, "ac_b")
    return a.join(b, keys).where(F.col("ac_a") < F.col("ac_b"))


def distance_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """Pairs i != j of distinct points (id, x_m, y_m) at most `radius_m` apart, both orders.

    Callers collapse equal positions first, so that rows of one busy place never pair up.
    """
    here = points.select(F.col("id").alias("i"), F.col("x_m").alias("xi"), F.col("y_m").alias("yi"))
    there = points.select(F.col("id").alias("j"), F.col("x_m").alias("xj"), F.col("y_m").alias("yj"))
    # cells as wide as the radius: the 3 x 3 around a point hold all its neighbours
    left = here.withColumn("_cy", F.explode(cells_around(F.col("yi"), radius_m, radius_m))).withColumn(
        "_cx", F.explode(cells_around(F.col("xi"), radius_m, radius_m))
    )
    right = there.withColumns({"_cy": cell_of(F.col("yj"), radius_m), "_cx": cell_of(F.col("xj"), radius_m)})
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    return (
        left.join(right, ["_cy", "_cx"])
        .withColumn("dist_m", F.sqrt(dx * dx + dy * dy))
        .where((F.col("i") != F.col("j")) & (F.col("dist_m") <= radius_m))
        .select("i", "j", "dist_m")
    )


def common_rows(df: DataFrame, prefixes=K.SOURCE_PREFIXES, anchor: str = "rrs_412") -> DataFrame:
    """Rows where every source has its anchor band; a source without that column is judged by
    its first reflectance column that holds any value, and matches nothing if it has none."""
    masks = []
    for prefix in prefixes.values():
        column = f"{prefix}_{anchor}"
        if column not in df.columns:
            found = resolve_features(df, [c for c in df.columns if c.startswith(f"{prefix}_rrs_")])
            column = found[0] if found else None
        masks.append(F.col(column).isNotNull() if column else F.lit(False))
    return df.where(all_of(masks))


def filter_if_present(df: DataFrame, column: str = "roms_available") -> DataFrame:
    return df.where(F.col(column)) if column in df.columns else df


def pixel_keys(df: DataFrame, dp: int = 6) -> DataFrame:
    """Integer pixel position, the grouping key of composites on a fixed lattice."""
    return df.withColumns({"lat_px": micro_key(F.col("lat"), dp), "lon_px": micro_key(F.col("lon"), dp)})
