"""Queries: models on features of the daily observations. Fits differ between libraries, so
these have no oracle SQL; the metrics they feed do."""

from __future__ import annotations

from pyspark.sql import functions as F

from redtide.functions.hashing import portable_hash
from redtide.operators import aggregates, blocking, clean, experiments, joins, metrics, models, splits
from redtide.plans.fixtures import SPECIES, view, with_views
from redtide.plans.queries_clean import THRESHOLDS
from redtide.plans.queries_composite import WARNING
from redtide.plans.queries_matchup import DAILY, OBS, daily, located
from redtide.plans.registry import query
from redtide.session import checkpointed, written

COLOUR = ["rrs_8", "latitude", "longitude", "doy_sin", "doy_cos"]
HYBRID = [*COLOUR, "depth"]
LABELS = {s: f"l_{s}" for s in SPECIES}
CLOSED = {s: f"c_{s}" for s in SPECIES}
TIERS = {"warning": LABELS, "closure": CLOSED}


#: Three atmospheric corrections stand for three bands; `rrs_8` is the band of source C.
SOURCES = {"A": ("b04", "a_rrs"), "B": ("b06", "b_rrs"), "C": ("b08", "rrs_8")}
PLACE = COLOUR[1:]
TRACKS = {f"{s}{kind}": [column, *PLACE, *model] for s, (_, column) in SOURCES.items() for kind, model in (("_only", []), ("_roms", ["depth"]))}


def with_sources(spark, sf):
    """Daily observations with the band of each source averaged over their own day."""
    keyed = located(spark, sf).select("loc", "location_id").distinct()
    pixels = view(spark, sf, "pixels").where("data_mask = 1").groupBy("loc", F.col("scene_date").alias("obs_date"))
    feats = pixels.agg(*[F.avg(band).alias(column) for band, column in SOURCES.values()]).join(keyed, "loc").drop("loc")
    return joins.attach_features(daily(spark, sf), feats, "rrs_8")


def matrix(spark, sf):
    """Labelled feature rows, nulls imputed, with an integer row id; written once, as several jobs read it."""
    ids = located(spark, sf).groupBy("location_id", "obs_date").agg(F.min("bin_id").alias("row_id"))
    rows = clean.with_season(with_sources(spark, sf)).join(ids, ["location_id", "obs_date"])
    colours = [column for _, column in SOURCES.values()]
    known = aggregates.impute_median(rows, [*colours, "depth"])
    levels = {c: F.coalesce((F.col(s) > THRESHOLDS[s][tier]).cast("int"), F.lit(0)) for tier, names in TIERS.items() for s, c in names.items()}
    kept = ["row_id", "station", *colours, *PLACE, "depth", *SPECIES, *LABELS.values(), *CLOSED.values()]
    return written(known.withColumns(levels).select(*kept))


def held_out():
    """One fifth by hash."""
    return portable_hash("row_id", 1) % 5 == 0


def halves(df):
    """Hold out one fifth by hash."""
    return df.where(~held_out()), df.where(held_out())


@query("v12_forest")
def v12(spark, sf):
    found = experiments.holdout(matrix(spark, sf), "row_id", held_out(), HYBRID, LABELS)
    return models.scores_table(found, ["species"])


@query("v13_mlp")
def v13(spark, sf):
    train, test = halves(matrix(spark, sf))
    model = models.fit_mlp(train, HYBRID, "l_view")
    pred = models.predict(model, test, HYBRID, ["row_id"], "l_view").withColumn("species", F.lit("view"))
    return models.scores_table(checkpointed(pred), ["species"])


def targets(spark, sf):
    return aggregates.bloom_targets(matrix(spark, sf), SPECIES, WARNING)


@query("v14_gbt_regressor")
def v14(spark, sf):
    train, test = halves(targets(spark, sf))
    model = models.fit_gbt(train, HYBRID, "y_view", max_iter=30)
    pred = models.predict(model, test, HYBRID, ["row_id"], "y_view").withColumn("species", F.lit("view"))
    return metrics.regression_metrics(checkpointed(pred), ["species"])


@query("v15_forest_regressor")
def v15(spark, sf):
    rows = written(targets(spark, sf))
    found = experiments.holdout(rows, "row_id", held_out(), HYBRID, {"view": "y_view"}, regression=True, trees=200)
    return metrics.regression_metrics(found, ["species"])


@query("v23_permutation_importance")
def v23(spark, sf):
    return experiments.importance(matrix(spark, sf), "row_id", held_out(), HYBRID, "l_view")


RANDOM_FOLDS, SPATIAL_FOLDS, REGRESSION_FOLDS = 50, 10, 50
CELL = ["track", "tier", "fold", "species"]


def random_matrix(spark, sf):
    rows = matrix(spark, sf)
    folds = experiments.random_folds(rows, "row_id", RANDOM_FOLDS)
    return experiments.run_experiments(rows, "row_id", folds, experiments.Matrix(TRACKS, TIERS), F.col("station") != "st0")


@query("v26_experiment_matrix_random")
def v26_random(spark, sf):
    """Three sources with and without the model variables, both tiers, all species, 50 random folds."""
    return models.scores_table(random_matrix(spark, sf)[0], CELL)


_DAY = f"{with_views('obs')}, {OBS}, {DAILY}, ids AS (SELECT location_id, obs_date, min(bin_id) AS row_id FROM obs GROUP BY ALL)"
_LEVELS = " UNION ALL ".join(
    f"SELECT '{tier}' AS tier, '{s}' AS species, row_id, station, CASE WHEN {s} > {THRESHOLDS[s][tier]} THEN 1 ELSE 0 END AS y FROM daily JOIN ids USING (location_id, obs_date)"
    for tier in TIERS
    for s in SPECIES
)


@query(
    "v26_cell_report",
    f"""{_DAY}, ranked AS (SELECT row_id, fold, row_number() OVER (PARTITION BY fold ORDER BY {splits.hash_sql('row_id', 'fold')}, row_id) AS rn FROM ids CROSS JOIN generate_series(0, {RANDOM_FOLDS - 1}) f(fold)),
    m AS (SELECT tier, species, fold, y, station <> 'st0' AS kept, rn <= (SELECT ceil(count(*) * 0.2e0) FROM ids) AS is_test FROM ({_LEVELS}) l JOIN ranked USING (row_id)),
    cells AS (SELECT tier, species, fold, count(*) FILTER (WHERE NOT is_test) AS n_train, coalesce(sum(y) FILTER (WHERE NOT is_test), 0)::BIGINT AS train_pos,
      count(*) FILTER (WHERE is_test AND kept) AS n_test, coalesce(sum(y) FILTER (WHERE is_test AND kept), 0)::BIGINT AS test_pos, sum(y) < 5 AS few_positives FROM m GROUP BY ALL),
    judged AS (SELECT *, train_pos > 0 AND train_pos < n_train AS both_classes FROM cells)
    SELECT tier, species, cast(fold AS int) AS fold, n_train, train_pos, n_test, test_pos, few_positives,
      CASE WHEN (SELECT count(*) FROM ids) < 50 THEN 'too_few_rows' WHEN NOT both_classes THEN 'train_excluded' WHEN n_test = 0 THEN 'no_test'
        WHEN NOT bool_and(both_classes) OVER (PARTITION BY tier, fold) THEN 'fold_skipped' ELSE 'fit' END AS status FROM judged""",
)
def v26_report(spark, sf):
    """What each cell of the random matrix is fitted and tested on, and the cells that are left out."""
    rows = matrix(spark, sf)
    folds = experiments.random_folds(rows, "row_id", RANDOM_FOLDS)
    return experiments.cell_report(rows, folds, experiments.Matrix(TRACKS, TIERS), F.col("station") != "st0")


def spatial_schemes(placed):
    """The rows with a block, for each of the four blocking schemes, sparse blocks merged."""
    sweep = blocking.moran_sweep(placed, "row_id", "view")
    size = 2 * blocking.correlation_range(sweep)
    grid = blocking.merge_sparse_blocks(blocking.grid_blocks(placed, size), 5, size)
    trees = {f"quadtree_{m}": blocking.merge_sparse_blocks(blocking.quadtree_blocks(placed, mode=m), 5, 5_000.0) for m in ("adaptive", "random")}
    return {"grid": grid, **trees, "clustering": blocking.cluster_blocks(placed)}


def spatial_matrix(spark, sf):
    """Predictions and report of all schemes; folds hold whole blocks and balanced label combinations."""
    placed = written(clean.project_utm(matrix(spark, sf)))
    predictions, reports = None, None
    for scheme, rows in spatial_schemes(placed).items():
        strata = splits.strat_label(rows, list(LABELS.values()), SPATIAL_FOLDS)
        home = written(splits.stratified_group_kfold(strata, "block_id", "strat", SPATIAL_FOLDS))
        folds = experiments.home_folds(SPATIAL_FOLDS)
        found = experiments.run_experiments(home, "row_id", folds, experiments.Matrix(TRACKS, TIERS, spatial=True))
        one, report = (d.withColumn("blocking", F.lit(scheme)) for d in found)
        predictions = one if predictions is None else predictions.unionByName(one)
        reports = report if reports is None else reports.unionByName(report)
    return predictions, reports


@query("v26_experiment_matrix_spatial")
def v26_spatial(spark, sf):
    """As the random matrix, with ten folds of whole blocks in each of four blocking schemes."""
    return models.scores_table(spatial_matrix(spark, sf)[0], ["blocking", *CELL], zero_pos_null=True)


@query("v26_regression")
def v26_regression(spark, sf):
    """All tracks, all active species, 50 random folds; R2, errors and bias of each cell."""
    rows = written(targets(spark, sf))
    labels = {s: f"y_{s}" for s in SPECIES if f"y_{s}" in rows.columns}
    folds = experiments.random_folds(rows, "row_id", REGRESSION_FOLDS)
    asked = experiments.Matrix(TRACKS, {"warning": labels}, regression=True, trees=200, min_rows=30)
    pred, _ = experiments.run_experiments(rows, "row_id", folds, asked)
    return metrics.regression_metrics(pred, CELL)
