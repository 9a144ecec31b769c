"""Daily observations, lag reduction, reports, imputation, result-table summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redtide import constants as K
from redtide.functions.scalars import clip01, log_cells
from redtide.operators.joins import track_delta
from redtide.operators.ranking import HOT_ROWS, any_of, quantiles, quantiles_wide

# ---------------------------------------------------------------- observations


def first_known(column: str, order: list[str]) -> Column:
    """First non-null value in the given order; columns may come from different rows."""
    return F.min_by(F.col(f"`{column}`"), F.when(F.col(f"`{column}`").isNotNull(), F.struct(*order)))


def daily_p95(
    obs: DataFrame,
    species: list[str],
    first: list[str],
    q: float = 0.95,
    order: list[str] = ("sample_time", "bin_id"),
    keys: list[str] = ("location_id", "obs_date"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per location and day: interpolated quantile per species, nulls ignored, and the
    first known value of the other columns."""
    keys = list(keys)
    dated = obs.where(F.col("obs_date").isNotNull())
    attributes = [first_known(c, list(order)).alias(c) for c in first]
    return quantiles_wide(dated, keys, species, q, hot_rows, attributes)


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("location_id").alias("n_locations"),
        F.countDistinct("dataset_id").alias("n_datasets"),
        F.min("obs_date").alias("first_date"),
        F.max("obs_date").alias("last_date"),
        F.count("depth").alias("n_depth"),
    )


def dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order. A `min_by` combines before the shuffle, so many
    copies of one key do not travel."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def site_summary(df: DataFrame, columns: list[str], order: list[str], fixed_over: int = 100) -> DataFrame:
    return (
        df.groupBy("location_id")
        .agg(F.count(F.lit(1)).alias("n_obs"), *[first_known(c, order).alias(c) for c in columns])
        .withColumn("platform", F.when(F.col("n_obs") > fixed_over, "fixed").otherwise("ship"))
    )


# ---------------------------------------------------------------- lags


def lag_mean(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def lag_first(df: DataFrame, keys: list[str], columns: list[str], mode: str = "earliest") -> DataFrame:
    """First non-null per column by lag: the most negative lag (`earliest`), or the lag closest
    to zero (`nearest`, the earlier one on a tie)."""
    day = F.col("delta_days")
    order = F.struct(F.abs(day), day) if mode == "nearest" else F.struct(day)
    return df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    )


def lag_report(df: DataFrame, obs_keys: list[str]) -> DataFrame:
    return df.groupBy("delta_days").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*obs_keys).alias("n_obs")
    )


def lag_counts(placed: DataFrame, lagged: DataFrame, obs_keys: list[str], n_lags: int, first_year: int | None = None) -> DataFrame:
    """What became of the observations: outside the model's domain, before its first year, eligible, rows with a
    model day, observations with any, and lag rows dropped because the model day is missing."""
    late = (F.year("obs_date") >= first_year) if first_year else F.lit(True)
    inside = F.col("in_domain")
    counted = placed.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(~inside).alias("n_out_of_domain"),
        F.count_if(inside & ~late).alias("n_skipped_year"),
        F.count_if(inside & late).alias("n_eligible"),
    )
    found = lagged.where(late).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*obs_keys).alias("n_obs"))
    # one row on each side
    both = counted.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("n_dropped", F.col("n_eligible") * n_lags - F.col("n_rows"))


# ---------------------------------------------------------------- reports


def match_rate(df: DataFrame, by: str) -> DataFrame:
    return (
        df.groupBy(by)
        .agg(F.count("data_available").alias("total"), F.count_if("data_available").alias("matched"))
        .withColumn("pct", 100.0 * F.col("matched") / F.col("total"))
        .orderBy(F.desc("matched"), by)
    )


def composite_summary(df: DataFrame, prefixes: list[str], location: str = "location_id") -> DataFrame:
    """Rows, distinct dates and locations, and the number of columns under each source prefix (`n_columns_` and
    the prefix; `n_columns_base` for the rest)."""
    under = {p: [c for c in df.columns if c.startswith(f"{p}_")] for p in prefixes}
    base = len(df.columns) - sum(map(len, under.values()))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("obs_date").alias("n_dates"),
        F.countDistinct(location).alias("n_locations"),
        *[F.lit(len(columns)).alias(f"n_columns_{p}") for p, columns in under.items()],
        F.lit(base).alias("n_columns_base"),
    )


def availability(df: DataFrame, anchors: list[str], species: list[str]) -> DataFrame:
    """Filled share per source anchor; bloom presence among known values per species."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count(F.col(f"`{c}`")).alias(f"known_{c}") for c in [*anchors, *species]],
        *[F.count_if(F.col(f"`{s}`") > 0).alias(f"bloom_{s}") for s in species],
    )
    rows = [
        F.struct(F.lit("source").alias("kind"), F.lit(c).alias("name"), F.col(f"`known_{c}`").alias("n"), F.col("_all").alias("base"))
        for c in anchors
    ] + [
        F.struct(F.lit("species").alias("kind"), F.lit(s).alias("name"), F.col(f"`bloom_{s}`").alias("n"), F.col(f"`known_{s}`").alias("base"))
        for s in species
    ]
    return (
        counted.select(F.explode(F.array(*rows)).alias("_r"))
        .select("_r.*")
        .withColumn("pct", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("base")), F.lit(0.0)))
    )


def label_stats(labels: DataFrame, id_cols: list[str]) -> DataFrame:
    """Positives per tier and species, with the tier's rows that have one or more, and two or
    more labels."""
    per_row = labels.groupBy("tier", *id_cols).agg(F.sum("y").alias("_k"))
    rows = per_row.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_k") >= 1).alias("n_any"), F.count_if(F.col("_k") >= 2).alias("n_multi")
    )
    return labels.groupBy("tier", "species").agg(F.sum("y").alias("n_positive")).join(rows, "tier")


def feature_audit(df: DataFrame, track_map: dict[str, list[str]]) -> DataFrame:
    """Known values per feature, one column per track; null where a track lacks the feature."""
    features = sorted({f for fs in track_map.values() for f in fs if f in df.columns})
    counted = df.agg(*[F.count(F.col(f"`{f}`")).alias(f) for f in features])
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            *[
                (F.col(f"`{f}`") if f in fs else F.lit(None).cast("bigint")).alias(t)
                for t, fs in track_map.items()
            ],
        )
        for f in features
    ]
    return counted.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def distribution_report(df: DataFrame, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count, mean, median, min and max per column, as rows."""
    long = unpivot(df, [], columns)
    simple = long.groupBy("name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return simple.join(quantiles(long, ["name"], "value", {"median": 0.5}, hot_rows), "name", "left")


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value)) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*")


# ---------------------------------------------------------------- imputation and scaling


def column_quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float], hot_rows: int = HOT_ROWS):
    """Exact quantiles of whole columns: {column: {name: value}}; columns x quantiles numbers
    reach the driver, never rows."""
    found = quantiles(unpivot(df, [], columns), ["name"], "value", probabilities, hot_rows).collect()
    by_name = {row["name"]: row for row in found}
    return {c: {p: by_name[c][p] for p in probabilities} for c in columns if c in by_name}


def impute_median(df: DataFrame, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nulls become the exact median of their column; a column without values stays null."""
    medians = column_quantiles(df, columns, {"m": 0.5}, hot_rows)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v["m"])) for c, v in medians.items()})


def percentile_stretch(df: DataFrame, columns: list[str], low=0.02, high=0.98, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Scale each column between two of its percentiles and clip to [0, 1]."""
    limits = column_quantiles(df, columns, {"lo": low, "hi": high}, hot_rows)
    return df.withColumns(
        {c: clip01(F.try_divide(F.col(c) - v["lo"], F.lit(v["hi"] - v["lo"]))) for c, v in limits.items()}
    )


# ---------------------------------------------------------------- regression targets


def bloom_targets(df: DataFrame, species: list[str], warning: dict[str, float], min_n: int = 10) -> DataFrame:
    """Rows where any kept species exceeds its warning level; the target of a species is
    log10(cells + 1) where it blooms, else null. Species with fewer than `min_n` blooms go."""
    counts = df.agg(*[F.count_if(F.col(f"`{s}`") > warning[s]).alias(s) for s in species]).first()
    active = [s for s in species if counts[s] >= min_n]
    if not active:
        return df.limit(0)
    rows = df.where(any_of([F.coalesce(F.col(f"`{s}`") > warning[s], F.lit(False)) for s in active]))
    return rows.withColumns(
        {f"y_{s}": F.when(F.col(f"`{s}`") > warning[s], log_cells(F.col(f"`{s}`"))) for s in active}
    )


def target_stats(targets: DataFrame, species: list[str]) -> DataFrame:
    """Rows, least, largest and mean of each regression target."""
    pairs = [F.struct(F.lit(s).alias("species"), F.col(f"`y_{s}`").alias("y")) for s in species if f"y_{s}" in targets.columns]
    long = targets.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")
    return long.groupBy("species").agg(F.count("y").alias("n"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.avg("y").alias("y_mean"))


# ---------------------------------------------------------------- result tables


def fold_stats(df: DataFrame, keys: list[str], metrics: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, median and population standard deviation over folds, nulls skipped."""
    moments = [x for m in metrics for x in (F.avg(m).alias(f"cv_{m}_mean"), F.stddev_pop(m).alias(f"cv_{m}_std"))]
    return quantiles_wide(df.select(*keys, *metrics), keys, metrics, 0.5, hot_rows, moments).withColumnsRenamed(
        {m: f"cv_{m}_median" for m in metrics}
    )


def macro_stats(df: DataFrame, keys: list[str], metrics: list[str], species: str = "species") -> DataFrame:
    """Means over species of the per-species means, medians and standard deviations over folds."""
    inner = fold_stats(df, [*keys, species], metrics)
    kinds = {"mean": "", "median": "_median", "std": "_std"}
    return inner.groupBy(*keys).agg(*[F.avg(f"cv_{m}_{k}").alias(f"macro_{m}{end}") for m in metrics for k, end in kinds.items()])


def fold_macro(df: DataFrame, keys: list[str], metric: str = "f1") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(metric).alias(f"{metric}_macro"))


def pivot_first(df: DataFrame, index: list[str], column: str, value: str, values: list) -> DataFrame:
    """One column per listed value, so no extra job has to look the values up."""
    return df.groupBy(*index).pivot(column, values).agg(F.first(value, ignorenulls=True))


def delta_summary(df: DataFrame, keys=("ac", "tier", "species")) -> DataFrame:
    return track_delta(df, list(keys), ["f1", "prauc"]).orderBy("tier", "ac", F.desc("delta_f1"))


def recall_gain(df: DataFrame, keys=("ac", "tier", "species")) -> DataFrame:
    return (
        track_delta(df, list(keys), ["recall"])
        .withColumn("extra_blooms_per_100", F.round(100 * F.col("delta_recall"), 1))
        .orderBy("tier", "ac", F.desc("extra_blooms_per_100"))
    )


def significance_rollup(df: DataFrame, by: list[str], directions: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("p_value").alias("n_tests"),
        F.count_if("significant").alias("n_sig"),
        *[F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in directions],
        F.avg("delta").alias("mean_delta"),
        F.avg("rbc").alias("mean_rbc"),
    )


def leakage_gate(spatial: DataFrame, random: DataFrame, keys: list[str], min_ratio: float = 0.85) -> DataFrame:
    """Spatial over random macro F1 per cell, and whether it reaches the gate."""
    ratio = F.try_divide(F.col("spatial_f1"), F.col("random_f1"))
    return (
        spatial.select(*keys, F.col("f1").alias("spatial_f1"))
        .join(random.select(*keys, F.col("f1").alias("random_f1")), keys)
        .withColumn("leakage_ratio", ratio)
        .withColumn("leakage_gate_pass", F.col("leakage_ratio") >= min_ratio)
    )


def gate_failures(gated: DataFrame) -> DataFrame:
    """How many cells there are and how many fall below the gate."""
    return gated.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(~F.col("leakage_gate_pass")).alias("n_failing"))


def box_stats(df: DataFrame, keys: list[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Quartiles, and whiskers at the last value inside 1.5 interquartile ranges."""
    boxes = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, hot_rows)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return (
        df.where(v.isNotNull())
        .select(*keys, value)
        .join(boxes, keys)
        .groupBy(*keys)
        .agg(
            *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
            F.count_if((v < F.col("q1") - reach) | (v > F.col("q3") + reach)).alias("n_fliers"),
        )
    )


def top_features(df: DataFrame, n: int = 10, keys=("species",), value: str = "importance", name: str = "feature") -> DataFrame:
    """The n largest positive importances per species; a group has one row per feature."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), name)
    return df.where(F.col(value) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def importance_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by the mean of the listed columns, nulls skipped, largest first."""
    known = sum((F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns), F.lit(0.0))
    return df.withColumn("avg_importance", F.try_divide(total, known)).orderBy(F.desc_nulls_last("avg_importance"), "feature")
