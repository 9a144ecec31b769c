"""In-situ count responses and bin metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_METRIC = T.StructType([T.StructField("metricId", T.StringType()), T.StructField("value", T.DoubleType())])
_SAMPLE = T.StructType(
    [
        T.StructField("binPid", T.StringType()),
        T.StructField("sampleTime", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("metrics", T.ArrayType(_METRIC)),
    ]
)
_SPECIES = T.StructType(
    [T.StructField("species", T.StringType()), T.StructField("data", T.ArrayType(_SAMPLE))]
)
COUNTS_SCHEMA = T.StructType(
    [T.StructField("properties", T.StructType([T.StructField("timeseriesData", T.ArrayType(_SPECIES))]))]
)
METADATA_COLUMNS = ["pid", "sample_time", "latitude", "longitude", "depth", "ml_analyzed", "cruise", "sample_type"]


def flatten_counts(responses: DataFrame, keys: list[str] = (), metric: str = "cell_concentration") -> DataFrame:
    """Nested count responses to long rows (keys, bin_pid, sample_time, latitude, longitude,
    species, concentration).

    Of several values for a bin and species the last in document order wins; bin attributes
    come from the first sample that names the bin; a bin with no concentration keeps one row
    with a null species. `responses` has `properties` in COUNTS_SCHEMA beside the keys.
    """
    keys = list(keys)
    samples = (
        responses.select(*keys, F.posexplode("properties.timeseriesData").alias("_s", "_entry"))
        .select(*keys, "_s", F.coalesce("_entry.species", F.lit("")).alias("species"), F.posexplode("_entry.data").alias("_d", "_sample"))
        .select(
            *keys,
            "_s",
            "_d",
            "species",
            F.coalesce("_sample.binPid", F.lit("")).alias("bin_pid"),
            "_sample.sampleTime",
            "_sample.latitude",
            "_sample.longitude",
            F.posexplode_outer("_sample.metrics").alias("_p", "_m"),
        )
    )
    named = F.when(F.col("_m.metricId") == metric, F.struct("_s", "_d", "_p"))
    attribute = F.struct("sampleTime", "latitude", "longitude")
    per_species = samples.groupBy(*keys, "bin_pid", "species").agg(
        F.min(F.struct("_s", "_d", attribute.alias("_a"))).alias("_first"),
        F.max_by(F.struct("species", F.col("_m.value").alias("concentration")), named).alias("_v"),
    )
    # at most one entry per species and bin
    bins = per_species.groupBy(*keys, "bin_pid").agg(F.min("_first").alias("_first"), F.collect_list("_v").alias("_vs"))
    return bins.select(
        *keys,
        "bin_pid",
        F.col("_first._a.sampleTime").alias("sample_time"),
        F.col("_first._a.latitude").alias("latitude"),
        F.col("_first._a.longitude").alias("longitude"),
        F.explode_outer("_vs").alias("_v"),
    ).select(*keys, "bin_pid", "sample_time", "latitude", "longitude", "_v.species", "_v.concentration")


def counts_wide(long: DataFrame, keys: list[str], species: list[str]) -> DataFrame:
    """One column per species at the edge of the engine."""
    attributes = ["sample_time", "latitude", "longitude"]
    return long.groupBy(*keys, "bin_pid", *attributes).pivot("species", species).agg(F.first("concentration"))


def clean_bin_metadata(df: DataFrame) -> DataFrame:
    """Lower-case trimmed headers, skipped bins out, known columns only, numbers or null."""
    df = df.toDF(*[c.lower().strip() for c in df.columns])
    if "skip" in df.columns:
        df = df.where(F.coalesce(F.expr("try_cast(skip as double)") != 1, F.lit(True)))
    numeric = {"depth", "ml_analyzed", "latitude", "longitude"}
    return df.select(
        *[F.expr(f"try_cast({c} as double)").alias(c) if c in numeric else c for c in METADATA_COLUMNS if c in df.columns]
    )


def scan_bin_metadata(spark: SparkSession, path: str) -> DataFrame:
    return clean_bin_metadata(spark.read.csv(path, header=True, inferSchema=False))


def flatten_datasets(features: DataFrame) -> DataFrame:
    """Dataset catalogue entries {id, properties {name, dashboardIdName}} as flat columns."""
    return features.select(
        F.col("id").cast("string").alias("dataset_id"),
        F.coalesce("properties.name", F.col("id").cast("string")).alias("dataset_name"),
        F.coalesce("properties.dashboardIdName", F.lit("")).alias("dashboardIdName"),
    )
