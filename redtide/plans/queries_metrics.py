"""Queries: evaluation metrics and significance tests on prediction and fold tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from redtide.operators import aggregates, metrics, ranking, significance
from redtide.plans import pipelines
from redtide.plans.fixtures import read, view, with_views
from redtide.plans.registry import query, rounded

PRED = with_views("predictions")
KEYS = ["fold", "species"]
CONF = """conf AS (SELECT fold, species, count(*) AS n, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn FROM fx_predictions GROUP BY ALL)"""


@query(
    "v16_prf",
    f"""{PRED}, {CONF} SELECT fold, species, n, tp + fn AS n_positive, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM conf""",
)
def v16(spark, sf):
    return rounded(metrics.prf(view(spark, sf, "predictions"), KEYS), ["precision", "recall", "f1"], 9)


@query(
    "v16_prf_spatial",
    """SELECT l_partkey AS fold, count(*) AS n, count(*) FILTER (WHERE l_quantity > 45) AS n_positive,
    round(CASE WHEN count(*) FILTER (WHERE l_quantity > 45) > 0 THEN 2e0 * count(*) FILTER (WHERE l_quantity > 45 AND l_tax > 0.04)
      / (count(*) FILTER (WHERE l_quantity > 45) + count(*) FILTER (WHERE l_tax > 0.04)) END, 9) AS f1 FROM lineitem GROUP BY 1""",
)
def v16_spatial(spark, sf):
    pred = read(spark, sf, "lineitem").selectExpr(
        "l_partkey AS fold", "CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS y_true", "CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS y_pred"
    )
    return rounded(metrics.prf(pred, ["fold"], zero_pos_null=True), ["f1"], 9).select("fold", "n", "n_positive", "f1")


@query(
    "v17_hamming_subset",
    f"""{PRED}, per AS (SELECT fold, row_id, count(*) FILTER (WHERE y_true <> y_pred) AS wrong, count(*) AS labels FROM fx_predictions GROUP BY ALL)
    SELECT fold, round(sum(wrong) / sum(labels), 9) AS hamming, round(count(*) FILTER (WHERE wrong = 0) / count(*), 9) AS subset_acc FROM per GROUP BY 1""",
)
def v17(spark, sf):
    return rounded(metrics.hamming_subset(view(spark, sf, "predictions"), ["fold"]), ["hamming", "subset_acc"], 9)


@query(
    "v18_jaccard_macro",
    f"{PRED}, {CONF} SELECT fold, round(avg(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END), 9) AS jaccard FROM conf GROUP BY 1",
)
def v18(spark, sf):
    return rounded(metrics.jaccard_macro(view(spark, sf, "predictions"), ["fold"]), ["jaccard"], 9)


STEPS = """per AS (SELECT fold, species, score, sum(y_true) AS pos, count(*) AS cnt FROM fx_predictions GROUP BY ALL),
    steps AS (SELECT *, sum(pos) OVER w AS tp, sum(cnt) OVER w - sum(pos) OVER w AS fp, sum(pos) OVER (PARTITION BY fold, species) AS n_pos,
      sum(cnt) OVER (PARTITION BY fold, species) AS n_all FROM per WINDOW w AS (PARTITION BY fold, species ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "w3_pr_steps",
    f"""{PRED}, {STEPS} SELECT fold, species, round(score, 9) AS score, cast(tp AS bigint) AS tp, cast(fp AS bigint) AS fp FROM steps""",
)
def w3(spark, sf):
    return rounded(metrics.pr_steps(view(spark, sf, "predictions"), KEYS).select(*KEYS, "score", "tp", "fp"), ["score"], 9)


@query(
    "w4_previous_recall",
    f"""{PRED}, {STEPS} SELECT fold, species, round(score, 9) AS score, round(tp / n_pos, 9) AS recall, round(lag(tp / n_pos, 1, 0) OVER (PARTITION BY fold, species ORDER BY score DESC), 9) AS recall_before
    FROM steps WHERE n_pos > 0""",
)
def w4(spark, sf):
    steps = metrics.pr_steps(view(spark, sf, "predictions"), KEYS).where("n_pos > 0")
    out = steps.select(*KEYS, "score", (F.col("tp") / F.col("n_pos")).alias("recall"), "recall_before")
    return rounded(out, ["score", "recall", "recall_before"], 9)


@query(
    "v19_average_precision",
    f"""{PRED}, {STEPS}, gains AS (SELECT fold, species, n_pos, n_all, tp / (tp + fp) AS prec, tp / n_pos - lag(tp / n_pos, 1, 0) OVER (PARTITION BY fold, species ORDER BY score DESC) AS gain FROM steps)
    SELECT fold, species, round(sum(CASE WHEN n_pos > 0 AND n_pos < n_all THEN gain * prec END), 9) AS prauc FROM gains GROUP BY ALL""",
)
def v19(spark, sf):
    return rounded(metrics.average_precision(view(spark, sf, "predictions"), KEYS), ["prauc"], 9)


CURVE = """mixed AS (SELECT * FROM steps WHERE n_pos > 0 AND n_pos < n_all),
    points AS (SELECT fold, species, n_pos, tp, fp FROM mixed UNION ALL SELECT fold, species, max(n_pos), 0, 0 FROM mixed GROUP BY fold, species),
    groups AS (SELECT DISTINCT fold, species, n_pos FROM mixed),
    bracket AS (SELECT g.fold, g.species, g.n_pos, i.slot, max((p.tp, p.fp)) FILTER (WHERE p.tp * 99 <= i.slot * g.n_pos) AS a, min((p.tp, p.fp)) FILTER (WHERE p.tp * 99 > i.slot * g.n_pos) AS b
      FROM groups g CROSS JOIN generate_series(0, 99) i(slot) JOIN points p ON p.fold = g.fold AND p.species = g.species GROUP BY ALL),
    parts AS (SELECT fold, species, n_pos, slot, a[1] AS atp, CASE WHEN a[1] + a[2] = 0 THEN 1 ELSE a[1] / (a[1] + a[2]) END AS aprec, b[1] AS btp, b[1] / (b[1] + b[2]) AS bprec FROM bracket),
    curve AS (SELECT fold, species, slot, CASE WHEN atp * 99 = slot * n_pos OR btp IS NULL THEN aprec ELSE aprec + (slot * n_pos - atp * 99) / ((btp - atp) * 99) * (bprec - aprec) END AS precision FROM parts)"""


@query(
    "v20_fold_pr_curve",
    f"{PRED}, {STEPS}, {CURVE} SELECT fold, species, cast(slot AS int) AS slot, round(precision, 9) AS precision FROM curve",
)
def v20_fold(spark, sf):
    out = metrics.fold_pr_curve(view(spark, sf, "predictions"), KEYS)
    return rounded(out.select(*KEYS, "slot", "precision"), ["precision"], 9)


@query(
    "v20_mean_pr_curve",
    f"""{PRED}, {STEPS}, {CURVE} SELECT species, cast(slot AS int) AS slot, round(slot / 99, 9) AS recall, round(avg(precision), 9) AS prec_mean, round(stddev_pop(precision), 9) AS prec_std FROM curve GROUP BY species, slot""",
)
def v20(spark, sf):
    return rounded(metrics.mean_pr_curve(view(spark, sf, "predictions"), ["species"]), ["recall", "prec_mean", "prec_std"], 9)


@query(
    "v20_pr_curve_table",
    f"""{PRED}, {STEPS}, {CURVE}, gains AS (SELECT fold, species, tp / (tp + fp) AS prec, tp / n_pos - lag(tp / n_pos, 1, 0) OVER (PARTITION BY fold, species ORDER BY score DESC) AS gain FROM mixed),
    ap AS (SELECT species, avg(prauc) AS ap_mean, stddev_pop(prauc) AS ap_std FROM (SELECT fold, species, sum(gain * prec) AS prauc FROM gains GROUP BY ALL) GROUP BY species)
    SELECT species, cast(slot AS int) AS slot, round(slot / 99, 9) AS recall, round(avg(precision), 9) AS prec_mean, round(stddev_pop(precision), 9) AS prec_std,
      round(max(ap_mean), 9) AS ap_mean, round(max(ap_std), 9) AS ap_std FROM curve JOIN ap USING (species) GROUP BY species, slot""",
)
def v20_table(spark, sf):
    out = metrics.pr_curve_table(view(spark, sf, "predictions"), ["species"])
    return rounded(out, ["recall", "prec_mean", "prec_std", "ap_mean", "ap_std"], 9)


@query(
    "v21_regression_metrics",
    """WITH p AS (SELECT l_partkey % 40 AS fold, concat('sp', l_suppkey % 5) AS species, CASE WHEN l_tax > 0.01 THEN log10(l_quantity * 100 + 1) END AS y, log10(l_quantity * 90 + l_linenumber * 40 + 1) AS q FROM lineitem),
    v AS (SELECT *, avg(y) OVER (PARTITION BY fold, species) AS m, power(10e0, y) - power(10e0, q) AS d FROM p WHERE y IS NOT NULL)
    SELECT fold, species, count(*) AS n_valid, round(1 - sum((y - q) * (y - q)) / sum((y - m) * (y - m)), 9) AS r2, round(sqrt(avg(d * d)), 9) AS rmse, round(avg(abs(d)), 9) AS mae, round(avg(q - y), 9) AS bias
    FROM v GROUP BY ALL HAVING count(*) >= 5""",
)
def v21(spark, sf):
    pred = read(spark, sf, "lineitem").selectExpr(
        "l_partkey % 40 AS fold",
        "concat('sp', l_suppkey % 5) AS species",
        "CASE WHEN l_tax > 0.01 THEN log10(l_quantity * 100 + 1) END AS y_true",
        "log10(l_quantity * 90 + l_linenumber * 40 + 1) AS y_pred",
    )
    out = metrics.regression_metrics(pred, KEYS)
    return rounded(out, ["r2", "bias", "rmse", "mae"], 9)


@query(
    "v22_macro_by_fold",
    f"""{PRED}, {CONF}, {STEPS}, gains AS (SELECT fold, species, n_pos, n_all, tp / (tp + fp) AS prec, tp / n_pos - lag(tp / n_pos, 1, 0) OVER (PARTITION BY fold, species ORDER BY score DESC) AS gain FROM steps),
    ap AS (SELECT fold, species, sum(CASE WHEN n_pos > 0 AND n_pos < n_all THEN gain * prec END) AS prauc FROM gains GROUP BY ALL),
    f AS (SELECT fold, species, tp + fn AS n_positive, CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM conf)
    SELECT fold, round(avg(f1), 9) AS f1_macro, round(avg(prauc), 9) AS prauc_macro, count(*) FILTER (WHERE n_positive = 0) AS n_zero_positive FROM f JOIN ap USING (fold, species) GROUP BY 1""",
)
def v22(spark, sf):
    pred = view(spark, sf, "predictions")
    per = metrics.prf(pred, KEYS, zero_pos_null=True).join(metrics.average_precision(pred, KEYS), KEYS)
    return rounded(metrics.macro_by_fold(per, ["fold"]), ["f1_macro", "prauc_macro"], 9)


PER_SPECIES = f"""{CONF}, {STEPS}, gains AS (SELECT fold, species, n_pos, n_all, tp / (tp + fp) AS prec, tp / n_pos - lag(tp / n_pos, 1, 0) OVER (PARTITION BY fold, species ORDER BY score DESC) AS gain FROM steps),
    ap AS (SELECT fold, species, sum(CASE WHEN n_pos > 0 AND n_pos < n_all THEN gain * prec END) AS prauc FROM gains GROUP BY ALL),
    scored AS (SELECT fold, species, tp + fn AS n_positive, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS jac, prauc FROM conf JOIN ap USING (fold, species))"""


def stats_sql(metrics_: list[str]) -> str:
    return ", ".join(
        f"round(avg({m}), 9) AS cv_{m}_mean, round(quantile_cont({m}, 0.5), 9) AS cv_{m}_median, round(stddev_pop({m}), 9) AS cv_{m}_std" for m in metrics_
    )


SPECIES_METRICS = ["f1", "prauc", "recall", "precision"]
GLOBAL_METRICS = ["f1_macro", "prauc_macro", "hamming", "subset_acc", "jaccard"]
stat_names = lambda ms: [f"cv_{m}_{s}" for m in ms for s in ("mean", "median", "std")]


@query("v26_species_comparison", f"{PRED}, {PER_SPECIES} SELECT species, {stats_sql(SPECIES_METRICS)} FROM scored GROUP BY species")
def v26_species(spark, sf):
    folds = pipelines.fold_results(view(spark, sf, "predictions"), [])
    return rounded(pipelines.species_comparison(folds, []), stat_names(SPECIES_METRICS), 9)


@query(
    "v26_global_comparison",
    f"""{PRED}, {PER_SPECIES}, macro AS (SELECT fold, fold % 2 AS tag, avg(f1) AS f1_macro, avg(prauc) AS prauc_macro, avg(jac) AS jaccard, count(*) FILTER (WHERE n_positive = 0) AS zero FROM scored GROUP BY fold),
    rowwise AS (SELECT fold, row_id, count(*) FILTER (WHERE y_true <> y_pred) AS wrong, count(*) AS labels FROM fx_predictions GROUP BY ALL),
    ham AS (SELECT fold, sum(wrong) / sum(labels) AS hamming, count(*) FILTER (WHERE wrong = 0) / count(*) AS subset_acc FROM rowwise GROUP BY fold)
    SELECT tag, {stats_sql(GLOBAL_METRICS)}, count(*) AS n_folds_used, round(avg(zero), 9) AS avg_zero_pos_species_per_fold FROM macro JOIN ham USING (fold) GROUP BY tag""",
)
def v26_global(spark, sf):
    pred = view(spark, sf, "predictions").withColumn("tag", F.col("fold") % 2)
    out = pipelines.global_comparison(pred, pipelines.fold_results(pred, ["tag"]), ["tag"])
    return rounded(out, [*stat_names(GLOBAL_METRICS), "avg_zero_pos_species_per_fold"], 9)


# ------------------------------------------------------------------ W2, V24, V25, E19


@query(
    "w2_midrank",
    f"""{with_views('folds')} SELECT ac, tier, species, fold, f1, rank() OVER (PARTITION BY ac, tier, species ORDER BY f1) + (count(*) OVER (PARTITION BY ac, tier, species, f1) - 1) / 2e0 AS midrank FROM fx_folds""",
)
def w2(spark, sf):
    folds = view(spark, sf, "folds").select("ac", "tier", "species", "fold", "f1")
    keys = ["ac", "tier", "species"]
    ranks = ranking.midrank_totals(folds, keys, "f1", {}).select(*keys, "f1", "midrank")
    return folds.join(ranks, [*keys, "f1"]).select(*keys, "fold", "f1", "midrank")


# erf by its power series, an independent formula for the oracle; good up to z = 4
def p_sql(z: str) -> str:
    x = f"(({z}) / {math.sqrt(2)!r})"
    terms = [f"{(-1) ** n / (math.factorial(n) * (2 * n + 1))!r} * power({x}, {2 * n + 1})" for n in range(45)]
    return f"(1 - {2 / math.sqrt(math.pi)!r} * ({' + '.join(terms)}))"


def tested_sql(source: str, keys: str, in_a: str) -> str:
    """Rank test with plain windows over `source`."""
    return f"""known AS (SELECT *, {in_a} AS in_a FROM {source} WHERE value IS NOT NULL),
    ranked AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2e0 AS midrank, count(*) OVER (PARTITION BY {keys}, value) AS t FROM known),
    sums AS (SELECT {keys}, count(*) FILTER (WHERE in_a) AS n_a, count(*) FILTER (WHERE NOT in_a) AS n_b, avg(value) FILTER (WHERE in_a) AS mean_a, avg(value) FILTER (WHERE NOT in_a) AS mean_b,
      sum(midrank) FILTER (WHERE in_a) - count(*) FILTER (WHERE in_a) * (count(*) FILTER (WHERE in_a) + 1) / 2e0 AS u, sum(t * t - 1e0) AS ties FROM ranked GROUP BY {keys}),
    zed AS (SELECT *, (greatest(u, n_a * n_b - u) - n_a * n_b / 2e0 - 0.5e0) / sqrt(n_a * n_b / 12e0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1e0)))) AS z FROM sums WHERE n_a >= 2 AND n_b >= 2),
    cnt AS (SELECT 0 AS m, 0 AS n, 0 AS v, 1e0 AS c UNION ALL SELECT m + d.x, n + 1 - d.x, v + d.x * n, sum(c) FROM cnt CROSS JOIN (VALUES (0), (1)) d(x)
      WHERE m + d.x <= 8 AND n + 1 - d.x <= (SELECT max(greatest(n_a, n_b)) FROM zed WHERE ties = 0 AND least(n_a, n_b) <= 8) GROUP BY ALL),
    exact AS (SELECT {keys}, least(1, 2 * sum(c) FILTER (WHERE v >= greatest(u, n_a * n_b - u)) / sum(c)) AS p_exact FROM zed JOIN cnt ON m = least(n_a, n_b) AND n = greatest(n_a, n_b)
      WHERE ties = 0 AND least(n_a, n_b) <= 8 GROUP BY {keys}),
    tested AS (SELECT *, coalesce(p_exact, CASE WHEN z <= 0 THEN 1 WHEN z > 4 THEN NULL ELSE {p_sql('z')} END) AS p, 1 - 2 * u / (n_a * n_b) AS rbc FROM zed LEFT JOIN exact USING ({keys}))"""


EFFECT = "CASE WHEN abs(rbc) < 0.1 THEN 'negligible' WHEN abs(rbc) < 0.3 THEN 'small' WHEN abs(rbc) < 0.5 THEN 'medium' ELSE 'large' END"
LONG = "long AS (SELECT ac, track_type, tier, species, 'f1' AS metric, f1 AS value FROM fx_folds UNION ALL SELECT ac, track_type, tier, species, 'prauc', prauc FROM fx_folds)"
RECURSIVE = with_views("folds").replace("WITH ", "WITH RECURSIVE ", 1)
MW = f"{RECURSIVE}, {LONG}, {tested_sql('long', 'ac, tier, species, metric', "track_type = '_only'")}"


@query(
    "v24_mann_whitney",
    f"""{MW} SELECT ac, tier, species, metric, concat(ac, '_only') AS only_track, concat(ac, '_roms') AS roms_track, n_a AS n_only, n_b AS n_roms, round(mean_a, 9) AS median_only, round(mean_b, 9) AS median_roms,
    round(mean_b - mean_a, 9) AS delta, u AS U_stat, round(p, 9) AS p_value, p < 0.05 AS significant, CASE WHEN mean_b > mean_a THEN 'roms_better' ELSE 'only_better' END AS direction, round(rbc, 9) AS rbc, {EFFECT} AS effect_size FROM tested""",
)
def v24(spark, sf):
    out = significance.mann_whitney(view(spark, sf, "folds"))
    return rounded(out, ["median_only", "median_roms", "delta", "p_value", "rbc"], 9)


PAIR_LONG = """pairs AS (SELECT DISTINCT a.track_type, a.tier, a.species, a.metric, a.ac AS ac_a, b.ac AS ac_b FROM long a JOIN long b ON a.track_type = b.track_type AND a.tier = b.tier AND a.species = b.species AND a.metric = b.metric AND a.ac < b.ac),
    sided AS (SELECT right(l.track_type, 4) AS track_type, tier, species, metric, p.ac_a, p.ac_b, l.ac, l.value FROM long l JOIN pairs p USING (track_type, tier, species, metric) WHERE l.ac IN (p.ac_a, p.ac_b))"""
MW_PAIRS = f"{RECURSIVE}, {LONG}, {PAIR_LONG}, {tested_sql('sided', 'track_type, tier, species, metric, ac_a, ac_b', 'ac = ac_a')}"


@query(
    "v25_mann_whitney_pairs",
    f"""{MW_PAIRS} SELECT track_type, tier, species, metric, ac_a, ac_b, n_a, n_b, round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b, round(mean_b - mean_a, 9) AS delta, u AS U_stat, round(p, 9) AS p_value,
    p < 0.05 AS significant, concat(CASE WHEN mean_b > mean_a THEN ac_b ELSE ac_a END, '_better') AS direction, round(rbc, 9) AS rbc, {EFFECT} AS effect_size FROM tested""",
)
def v25(spark, sf):
    out = significance.mann_whitney_pairs(view(spark, sf, "folds"))
    return rounded(out, ["mean_a", "mean_b", "delta", "p_value", "rbc"], 9)


@query(
    "e19_significance_rollup",
    f"""{MW} SELECT ac, metric, count(p) AS n_tests, count(*) FILTER (WHERE p < 0.05) AS n_sig, count(*) FILTER (WHERE mean_b > mean_a) AS n_roms_better, count(*) FILTER (WHERE NOT mean_b > mean_a) AS n_only_better,
    round(avg(mean_b - mean_a), 9) AS mean_delta, round(avg(rbc), 9) AS mean_rbc FROM tested GROUP BY ALL""",
)
def e19(spark, sf):
    tested = significance.mann_whitney(view(spark, sf, "folds"))
    out = aggregates.significance_rollup(tested, ["ac", "metric"], ["roms_better", "only_better"])
    return rounded(out, ["mean_delta", "mean_rbc"], 9)
