"""Evaluation metrics over long predictions (keys, species, row_id, y_true, y_pred, score).

Every metric is one aggregate over all folds, tracks and species at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redtide.functions.scalars import cells_from_log
from redtide.operators.ranking import HOT_ROWS, running_totals


def _confusion() -> dict[str, Column]:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return {"tp": F.count_if(t & p), "fp": F.count_if(~t & p), "fn": F.count_if(t & ~p), "n": F.count(F.lit(1))}


def _or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def prf(pred: DataFrame, keys: list[str], zero_pos_null: bool = False) -> DataFrame:
    """Precision, recall and F1 per group, 0 on a zero division. With `zero_pos_null` (spatial
    folds) F1 is null where the test rows have no positive."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = _or_zero(2.0 * tp, 2.0 * tp + fp + fn)
    if zero_pos_null:
        f1 = F.when(tp + fn > 0, f1)
    return (
        pred.groupBy(*keys)
        .agg(*[c.alias(n) for n, c in _confusion().items()])
        .withColumns(
            {
                "n_positive": tp + fn,
                "precision": _or_zero(tp, tp + fp),
                "recall": _or_zero(tp, tp + fn),
                "f1": f1,
            }
        )
        .drop("tp", "fp", "fn")
    )


def hamming_subset(pred: DataFrame, keys: list[str], row_id: list[str] = ("row_id",)) -> DataFrame:
    """Share of wrong labels and share of rows with every label right."""
    wrong = F.count_if(F.col("y_true") != F.col("y_pred"))
    rows = pred.groupBy(*keys, *row_id).agg(wrong.alias("_wrong"), F.count(F.lit(1)).alias("_labels"))
    return rows.groupBy(*keys).agg(
        (F.sum("_wrong") / F.sum("_labels")).alias("hamming"),
        (F.count_if(F.col("_wrong") == 0) / F.count(F.lit(1))).alias("subset_acc"),
    )


def jaccard_macro(pred: DataFrame, keys: list[str], species: str = "species") -> DataFrame:
    """Mean over species of TP / (TP + FP + FN), 0 on a zero division."""
    inner = pred.groupBy(*keys, species).agg(*[c.alias(n) for n, c in _confusion().items()])
    score = _or_zero(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))
    return inner.groupBy(*keys).agg(F.avg(score).alias("jaccard"))


def pr_steps(pred: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct score, best first, with the true and false positives up to it and
    the recall before it. Ties are one step."""
    totals = running_totals(
        pred, keys, "score", {"pos": F.col("y_true").cast("bigint"), "cnt": F.lit(1)}, descending=True, hot_rows=hot_rows
    )
    # class totals per group: one row per group
    groups = pred.groupBy(*keys).agg(F.sum(F.col("y_true").cast("bigint")).alias("n_pos"), F.count(F.lit(1)).alias("n_all"))
    return totals.join(groups, keys).select(
        *keys,
        "score",
        "n_pos",
        "n_all",
        "pos",
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        (F.col("cnt_before") + F.col("cnt") - F.col("pos_before") - F.col("pos")).alias("fp"),
        F.try_divide(F.col("pos_before"), F.col("n_pos")).alias("recall_before"),
    )


def average_precision(pred: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sum of recall gained times precision over distinct scores; null where a group has one
    class only."""
    gained = F.try_divide(F.col("tp"), F.col("n_pos")) - F.col("recall_before")
    mixed = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_all"))
    return (
        pr_steps(pred, keys, hot_rows)
        .groupBy(*keys)
        .agg(F.sum(F.when(mixed, gained * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("prauc"))
    )


def fold_pr_curve(pred: DataFrame, keys: list[str], n: int = 100, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Precision at `n` even recall points per group with both classes, linearly interpolated.

    Recall tp / P meets grid point i / (n - 1) exactly when tp * (n - 1) = i * P, so all
    comparisons are between integers. At equal recall the lowest score counts on the way from
    below, the highest on the way to it; (recall 0, precision 1) starts the curve. Steps are
    reduced to one summary per grid interval before anything is put in order, so a group sends
    `n` rows on, not its scores.
    """
    last = n - 1
    tp, pos = F.col("tp"), F.col("n_pos")
    steps = pr_steps(pred, keys, hot_rows).where((pos > 0) & (pos < F.col("n_all")))
    # first grid point at or right of a step
    slot = F.expr(f"cast((tp * {last} + n_pos - 1) div n_pos as int)")
    slots = (
        steps.groupBy(*keys, slot.alias("slot"))
        .agg(
            F.max(pos).alias("n_pos"),
            F.max(F.struct(tp, F.col("fp"))).alias("_low"),  # last step at most at the grid point
            F.min(F.struct(tp, F.col("fp"))).alias("_high"),  # first step right of the one before
        )
    )
    grid = slots.groupBy(*keys).agg(F.max("n_pos").alias("_p")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(last))))
    # one window group is the n grid points of one curve
    behind = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.partitionBy(*keys).orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    placed = grid.join(slots.drop("n_pos"), [*keys, "slot"], "left").select(
        *keys,
        "slot",
        "_p",
        F.last("_low", ignorenulls=True).over(behind).alias("_a"),
        F.first("_high", ignorenulls=True).over(beyond).alias("_b"),
    )
    here = F.col("slot") * F.col("_p")
    a_tp = F.coalesce(F.col("_a.tp"), F.lit(0))
    a_prec = F.coalesce(F.col("_a.tp") / (F.col("_a.tp") + F.col("_a.fp")), F.lit(1.0))
    b_prec = F.col("_b.tp") / (F.col("_b.tp") + F.col("_b.fp"))
    share = (here - a_tp * last) / ((F.col("_b.tp") - a_tp) * last)
    exact = (a_tp * last == here) | F.col("_b").isNull()
    return placed.select(
        *keys,
        "slot",
        (F.col("slot") / last).alias("recall"),
        F.when(exact, a_prec).otherwise(a_prec + share * (b_prec - a_prec)).alias("precision"),
    )


def mean_pr_curve(pred: DataFrame, keys: list[str], fold: str = "fold", n: int = 100, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean and population deviation over folds of the interpolated precision."""
    return (
        fold_pr_curve(pred, [*keys, fold], n, hot_rows)
        .groupBy(*keys, "slot")
        .agg(F.max("recall").alias("recall"), F.avg("precision").alias("prec_mean"), F.stddev_pop("precision").alias("prec_std"))
    )


def pr_curve_table(pred: DataFrame, keys: list[str], fold: str = "fold", n: int = 100, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The mean curve with the mean and population deviation over folds of the average precision beside each point.
    Folds with one class only count in neither."""
    gained = (
        average_precision(pred, [*keys, fold], hot_rows)
        .groupBy(*keys)
        .agg(F.avg("prauc").alias("ap_mean"), F.stddev_pop("prauc").alias("ap_std"))
    )
    return mean_pr_curve(pred, keys, fold, n, hot_rows).join(gained, keys)



def regression_metrics(pred: DataFrame, keys: list[str], min_valid: int = 5) -> DataFrame:
    """R2 and bias of log10(cells + 1), RMSE and MAE in cells; groups with fewer than
    `min_valid` known targets have no row.

    R2 from deviations about the group mean: the variance aggregate merges partial results
    without losing digits, where raw sums of squares would.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    cells = cells_from_log(y) - cells_from_log(p)
    return (
        pred.where(y.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_valid"),
            F.sum((y - p) * (y - p)).alias("_res"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("_tot"),
            F.sqrt(F.avg(cells * cells)).alias("rmse"),
            F.avg(F.abs(cells)).alias("mae"),
            F.avg(p - y).alias("bias"),
        )
        .where(F.col("n_valid") >= min_valid)
        # a constant target scores 1 when hit exactly and 0 otherwise
        .withColumn("r2", F.coalesce(1 - F.try_divide("_res", "_tot"), F.when(F.col("_res") == 0, 1.0).otherwise(0.0)))
        .drop("_res", "_tot")
    )


def macro_by_fold(per_species: DataFrame, keys: list[str]) -> DataFrame:
    """Macro F1 and AP over the species that have a value, with the count of species without
    positives and of species left out of training (`train_excluded`, when that column exists)."""
    extra = []
    if "train_excluded" in per_species.columns:
        extra.append(F.count_if("train_excluded").alias("n_train_excluded"))
    return per_species.groupBy(*keys).agg(
        F.avg("f1").alias("f1_macro"),
        F.avg("prauc").alias("prauc_macro"),
        F.count_if(F.col("n_positive") == 0).alias("n_zero_positive"),
        *extra,
    )
