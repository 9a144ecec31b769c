"""Filters, typing, keys and labels of observation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redtide import constants as K
from redtide.functions.geo import inside_polygon, micro_key, utm_xy
from redtide.functions.scalars import log_cells, season


def filter_bbox(df: DataFrame, west: float, south: float, east: float, north: float, lat="latitude", lon="longitude"):
    """Rows inside the box, borders included; null coordinates drop."""
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def filter_polygon(df: DataFrame, ring, lat="latitude", lon="longitude") -> DataFrame:
    """Rows strictly inside the ring; the box test comes first and reaches the scan."""
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    boxed = filter_bbox(df, min(xs), min(ys), max(xs), max(ys), lat, lon)
    return boxed.where(inside_polygon(F.col(lon), F.col(lat), ring))


def exclude_stations(df: DataFrame, ids=K.EXCLUDED_STATIONS, col="dashboardIdName") -> DataFrame:
    """Drop the listed stations; a row without a station stays."""
    return df.where(~F.coalesce(F.col(col).isin(list(ids)), F.lit(False)))


def exclude_locations(df: DataFrame, ids=K.EXCLUDED_LOCATIONS, col="location_id") -> DataFrame:
    return exclude_stations(df, ids, col)


def scope(df: DataFrame, ids, col="dashboardIdName") -> DataFrame:
    return df.where(F.col(col).isin(list(ids)))


def override_stations(
    df: DataFrame, coordinates=K.STATION_COORDINATES, col="dashboardIdName", order=("datetime", "bin_id")
) -> DataFrame:
    """Fixed stations get their canonical position and one location_id, the first in time.

    The position is a literal map lookup; the id comes from a per-station `min_by`, a table
    of at most one row per listed station.
    """
    literal = lambda i: F.create_map(*[x for s, c in coordinates.items() for x in (F.lit(s), F.lit(float(c[i])))])
    listed = F.col(col).isin(list(coordinates))
    first_id = (
        df.where(listed)
        .groupBy(col)
        .agg(F.min_by("location_id", F.struct(*order)).alias("_first_id"))
    )
    # broadcast side: one row per listed station
    return (
        df.join(F.broadcast(first_id), col, "left")
        .withColumns(
            {
                "latitude": F.coalesce(F.try_element_at(literal(0), F.col(col)), F.col("latitude")),
                "longitude": F.coalesce(F.try_element_at(literal(1), F.col(col)), F.col("longitude")),
                "location_id": F.when(listed, F.coalesce("_first_id", F.col(col))).otherwise(F.col("location_id")),
            }
        )
        .drop("_first_id")
    )


def filter_years(df: DataFrame, first: int | None = None, last: int | None = None, col="obs_date") -> DataFrame:
    """Years `first`..`last`, both included, compared on the date itself so that partitions
    and row groups can be skipped."""
    if first is not None:
        df = df.where(F.col(col) >= F.to_date(F.lit(f"{first:04d}-01-01")))
    if last is not None:
        df = df.where(F.col(col) < F.to_date(F.lit(f"{last + 1:04d}-01-01")))
    return df


def location_id(lat: Column, lon: Column) -> Column:
    """Id of a position rounded to four decimals. Different positions have different ids, so it may be grouped
    and joined on at any number of sites."""
    number = (micro_key(lat) + 900_000) * 3_600_001 + micro_key(lon) + 1_800_000
    return F.lpad(number.cast("string"), 13, "0")


def location_label(lat: Column, lon: Column) -> Column:
    """Eight-digit label of a position, for reading; positions can share one."""
    mixed = micro_key(lat) * 73856093 + micro_key(lon) * 19349663
    return F.lpad(F.pmod(mixed, F.lit(100_000_000)).cast("string"), 8, "0")


def with_location_id(df: DataFrame) -> DataFrame:
    return df.withColumn("location_id", location_id(F.col("latitude"), F.col("longitude")))


def with_micro_keys(df: DataFrame, dp: int = 4) -> DataFrame:
    return df.withColumns({"lat_key": micro_key(F.col("latitude"), dp), "lon_key": micro_key(F.col("longitude"), dp)})


def coerce_types(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Cast the named columns; text that does not parse becomes null instead of failing."""
    return df.withColumns(
        {
            c: F.expr(f"try_to_timestamp(cast(`{c}` as string))") if t == "timestamp" else F.expr(f"try_cast(`{c}` as {t})")
            for c, t in spec.items()
            if c in df.columns
        }
    )


def with_obs_date(df: DataFrame, ts_col: str = "sample_time") -> DataFrame:
    return df.withColumn("obs_date", F.to_date(ts_col)).where(F.col("obs_date").isNotNull())


def with_season(df: DataFrame, col: str = "obs_date") -> DataFrame:
    doy_sin, doy_cos = season(F.col(col))
    return df.withColumns({"doy_sin": doy_sin, "doy_cos": doy_cos})


def rename_bands(df: DataFrame, mapping=K.BAND_TO_WAVELENGTH, prefix: str = "") -> DataFrame:
    return df.withColumnsRenamed({prefix + a: prefix + b for a, b in mapping.items()})


def same_day(df: DataFrame) -> DataFrame:
    return df.where(F.col("delta_days") == 0)


def slim(df: DataFrame, prefix: str, drop: list[str], keep: list[str], keys: list[str]) -> DataFrame:
    """Keys and `keep` as they are, every other column prefixed, shared columns left out."""
    kept = [c for c in keep if c in df.columns]
    rest = [c for c in df.columns if c not in {*drop, *keys, *kept}]
    return df.select(*keys, *kept, *[F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in rest])


def project_utm(df: DataFrame, zone: int = 19, lat="latitude", lon="longitude") -> DataFrame:
    x, y = utm_xy(F.col(lat), F.col(lon), zone)
    return df.withColumns({"x_m": x, "y_m": y})


def resolve_features(df: DataFrame, candidates: list[str]) -> list[str]:
    """Candidates that exist and hold any value, in order. One pass; one row reaches the driver."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return []
    seen = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in present]).first()
    return [c for c in present if seen[c]]


def with_bloom_index(df: DataFrame, species: list[str]) -> DataFrame:
    filled = [F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in species]
    top = F.greatest(*filled) if len(filled) > 1 else filled[0]
    return df.withColumn("bloom_index", log_cells(top))


def relabel(df: DataFrame, mapping: dict[str, str], columns=("ac", "track")) -> DataFrame:
    """Replace a source name wherever it occurs and name the model by the track's ending."""
    for old, new in mapping.items():
        df = df.withColumns({c: F.replace(F.col(c), F.lit(old), F.lit(new)) for c in columns if c in df.columns})
    if "track" in df.columns:
        df = df.withColumn("model", F.when(F.col("track").endswith("_roms"), "Hybrid").otherwise("OC"))
    return df


def assert_no_suffix_columns(df: DataFrame) -> DataFrame:
    """Schema guard: joins must not have left `_dup`, `_x` or `_y` columns behind."""
    left_over = [c for c in df.columns if c.endswith(("_dup", "_x", "_y"))]
    if left_over:
        raise ValueError(f"ambiguous columns after a join: {left_over}")
    return df


def thresholds(spark: SparkSession, table=K.SPECIES_THRESHOLDS) -> DataFrame:
    rows = [(s, t, float(v)) for s, tiers in table.items() for t, v in tiers.items()]
    return spark.createDataFrame(rows, "species string, tier string, threshold double")


def label_long(df: DataFrame, limits: DataFrame, id_cols: list[str], species: list[str]) -> DataFrame:
    """Long labels per species and tier: 1 above the threshold, 0 otherwise, 0 when missing."""
    pairs = [F.struct(F.lit(s).alias("species"), F.col(f"`{s}`").cast("double").alias("value")) for s in species]
    long = df.select(*id_cols, F.explode(F.array(*pairs)).alias("_p")).select(*id_cols, "_p.*")
    # broadcast side: one row per species and tier
    return long.join(F.broadcast(limits), "species").withColumn(
        "y", F.coalesce((F.col("value") > F.col("threshold")).cast("int"), F.lit(0))
    )


def track_features(sources=K.SOURCE_PREFIXES, model_features=K.MODEL_FEATURES) -> dict[str, list[str]]:
    """Feature names per track: colour and season, then the same with the model variables."""
    suffixes = list(K.BAND_TO_WAVELENGTH.values()) + K.INDEX_NAMES
    out = {}
    for source, prefix in sources.items():
        colour = [f"{prefix}_{s}" for s in suffixes] + K.SEASON_FEATURES
        out[f"{source}_only"] = colour
        out[f"{source}_roms"] = colour + list(model_features)
    return out


def tracks(spark: SparkSession) -> DataFrame:
    rows = [(t, f, i) for t, fs in track_features().items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "track string, feature string, ordinal int")
