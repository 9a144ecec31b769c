"""Queries: blocking schemes, Moran's I, cross-validation splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from redtide import constants as K
from redtide.operators import blocking, joins, splits
from redtide.plans.fixtures import SPECIES, read, spread, view, with_views
from redtide.plans.queries_clean import THRESHOLDS
from redtide.plans.queries_matchup import DAILY, OBS, daily
from redtide.plans.registry import query, rounded
from redtide.session import written

# plane coordinates as simple multiples, so that both engines get the same doubles
XY = "points AS (SELECT bin_id, loc, (longitude + 72e0) * 80000e0 + bin_id % 7 * 311e0 AS x_m, (latitude - 38e0) * 111000e0 + bin_id % 5 * 427e0 AS y_m, view, concentration FROM fx_obs)"
PTS = f"{with_views('obs')}, {XY}"


def points(spark, sf):
    return view(spark, sf, "obs").selectExpr(
        "bin_id",
        "loc",
        "(longitude + 72e0) * 80000e0 + bin_id % 7 * 311e0 AS x_m",
        "(latitude - 38e0) * 111000e0 + bin_id % 5 * 427e0 AS y_m",
        "view",
        "concentration",
    )


GRID_ID = "concat(cast(cast(floor(x_m / 10000) AS bigint) AS varchar), '_', cast(cast(floor(y_m / 10000) AS bigint) AS varchar))"


@query("v7_grid_blocks", f"{PTS} SELECT bin_id, {GRID_ID} AS block_id FROM points")
def v7(spark, sf):
    return blocking.grid_blocks(points(spark, sf), 10_000).select("bin_id", "block_id")


BOX = "box AS (SELECT min(x_m) - 1 AS x0, max(x_m) + 1 AS x1, min(y_m) - 1 AS y0, max(y_m) + 1 AS y1 FROM points)"


def tree_sql(rule: str, names: str = "leaf") -> str:
    """The recursive definition as it stands: split a node until it stops."""
    return f"""nodes AS (
      SELECT bin_id, x_m, y_m, x0, x1, y0, y1, 0 AS depth, '' AS path, count(*) OVER () AS n FROM points CROSS JOIN box
      UNION ALL
      SELECT bin_id, x_m, y_m, nx0, nx1, ny0, ny1, depth, path, count(*) OVER (PARTITION BY path) AS n FROM (
        SELECT bin_id, x_m, y_m, CASE WHEN x_m < (x0 + x1) / 2 THEN x0 ELSE (x0 + x1) / 2 END AS nx0, CASE WHEN x_m < (x0 + x1) / 2 THEN (x0 + x1) / 2 ELSE x1 END AS nx1,
          CASE WHEN y_m < (y0 + y1) / 2 THEN y0 ELSE (y0 + y1) / 2 END AS ny0, CASE WHEN y_m < (y0 + y1) / 2 THEN (y0 + y1) / 2 ELSE y1 END AS ny1,
          depth + 1 AS depth, path || CASE WHEN x_m < (x0 + x1) / 2 THEN CASE WHEN y_m < (y0 + y1) / 2 THEN '0' ELSE '1' END ELSE CASE WHEN y_m < (y0 + y1) / 2 THEN '2' ELSE '3' END END AS path
        FROM nodes WHERE NOT (depth >= 2 AND (depth >= 8 OR least(x1 - x0, y1 - y0) <= 5000 OR {rule}))) t),
    {names} AS (SELECT bin_id, x_m, y_m, 'q' || arg_max(path, depth) AS block_id FROM nodes GROUP BY bin_id, x_m, y_m)"""


RECURSIVE = with_views("obs").replace("WITH ", "WITH RECURSIVE ", 1)


@query("v8_quadtree_adaptive", f"{RECURSIVE}, {XY}, {BOX}, {tree_sql('n <= 30')} SELECT bin_id, block_id FROM leaf")
def v8(spark, sf):
    return blocking.quadtree_blocks(points(spark, sf)).select("bin_id", "block_id")


_node = "1"
for _i in range(1, 9):
    _node = f"(CASE WHEN length(path) >= {_i} THEN {_node} * 4 + cast(substr(path || '0', {_i}, 1) AS bigint) ELSE {_node} END)"
COIN = f"{splits.hash_sql(_node, '42')} % 1000000 < 300000"


@query("v9_quadtree_random", f"{RECURSIVE}, {XY}, {BOX}, {tree_sql(COIN)} SELECT bin_id, block_id FROM leaf")
def v9(spark, sf):
    return blocking.quadtree_blocks(points(spark, sf), mode="random").select("bin_id", "block_id")


@query(
    "w7_prefix_counts",
    f"""{PTS}, {BOX}, cell AS (SELECT cast(floor((x_m - x0) / (x1 - x0) * 256) AS bigint) AS ix, cast(floor((y_m - y0) / (y1 - y0) * 256) AS bigint) AS iy FROM points CROSS JOIN box),
    node AS (SELECT d AS depth, ix >> (8 - d) AS nx, iy >> (8 - d) AS ny, count(*) AS n FROM cell CROSS JOIN generate_series(0, 8) g(d) GROUP BY ALL)
    SELECT cast(depth AS int) AS depth, count(*) AS n_nodes, max(n) AS largest, cast(sum(n * n) AS bigint) AS sum_sq FROM node GROUP BY 1""",
)
def w7(spark, sf):
    df = points(spark, sf)
    counts = blocking.prefix_counts(blocking.quadrant_path(df, blocking.extent(df)))
    return counts.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max("n").alias("largest"), F.sum(F.col("n") * F.col("n")).alias("sum_sq")
    )


@query(
    "e22_block_stats",
    f"""{PTS}, b AS (SELECT {GRID_ID} AS block_id, count(*) AS n, sqrt(power(max(x_m) - min(x_m), 2) + power(max(y_m) - min(y_m), 2)) AS d FROM points GROUP BY 1)
    SELECT count(*) AS n_blocks, round(min(d), 6) AS block_diag_min_m, round(quantile_cont(d, 0.5), 6) AS block_diag_median_m, round(max(d), 6) AS block_diag_max_m,
    min(n) AS obs_per_block_min, quantile_cont(n, 0.5) AS obs_per_block_median, max(n) AS obs_per_block_max FROM b""",
)
def e22(spark, sf):
    blocks = blocking.point_extent(blocking.grid_blocks(points(spark, sf), 10_000))
    return rounded(blocking.block_stats(blocks), ["block_diag_min_m", "block_diag_median_m", "block_diag_max_m"])


@query(
    "e22_quadtree_stats",
    f"""{RECURSIVE}, {XY}, {BOX}, {tree_sql('n <= 30')}, b AS (SELECT block_id, count(*) AS n FROM leaf GROUP BY 1), d AS (SELECT n, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) / power(2, length(block_id) - 1) AS d FROM b CROSS JOIN box)
    SELECT count(*) AS n_blocks, round(min(d), 6) AS block_diag_min_m, round(quantile_cont(d, 0.5), 6) AS block_diag_median_m, round(max(d), 6) AS block_diag_max_m,
    min(n) AS obs_per_block_min, quantile_cont(n, 0.5) AS obs_per_block_median, max(n) AS obs_per_block_max FROM d""",
)
def e22_tree(spark, sf):
    df = points(spark, sf)
    box = blocking.extent(df)
    blocks = blocking.leaf_extent(blocking.quadtree_blocks(df, box=box), box)
    return rounded(blocking.block_stats(blocks), ["block_diag_min_m", "block_diag_median_m", "block_diag_max_m"])


@query("v10_cluster_blocks")
def v10(spark, sf):
    df = points(spark, sf)
    return blocking.point_extent(blocking.cluster_blocks(df))


@query(
    "v10_cluster_sizes",
    f"{PTS}, places AS (SELECT x_m, y_m, count(*) AS n FROM points GROUP BY ALL) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_positions, true AS one_block_each, true AS all_in_range FROM places",
)
def v10_sizes(spark, sf):
    """Every row has a block, every position one, and every block 21 to 39 rows but for single positions with more."""
    blocks = blocking.cluster_blocks(points(spark, sf)).groupBy("x_m", "y_m").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block_id").alias("k"), F.min("block_id").alias("block_id"))
    per_block = blocks.groupBy("block_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("positions"), F.max("k").alias("k"))
    fits = F.col("n").between(21, 39) | ((F.col("positions") == 1) & (F.col("n") > 39))
    return per_block.agg(F.sum("n").alias("n_rows"), F.sum("positions").alias("n_positions"), (F.max("k") == 1).alias("one_block_each"), F.every(fits).alias("all_in_range"))


FINE_ID = GRID_ID.replace("10000", "2000")
MERGED = f"""blocked AS (SELECT *, {FINE_ID} AS block_id FROM points),
    b AS (SELECT block_id, count(*) AS n, avg(x_m) AS cx, avg(y_m) AS cy FROM blocked GROUP BY 1),
    offers AS (SELECT s.block_id, l.block_id AS new_id, row_number() OVER (PARTITION BY s.block_id ORDER BY sqrt(power(s.cx - l.cx, 2) + power(s.cy - l.cy, 2)), l.block_id) AS rn,
      sqrt(power(s.cx - l.cx, 2) + power(s.cy - l.cy, 2)) AS d FROM b s JOIN b l ON s.n < 7 AND l.n >= 7),
    moved AS (SELECT p.bin_id, coalesce(o.new_id, p.block_id) AS block_id FROM blocked p LEFT JOIN (SELECT * FROM offers WHERE rn = 1 AND d <= 6000) o USING (block_id)),
    merged AS (SELECT bin_id, block_id FROM moved WHERE block_id IN (SELECT block_id FROM moved GROUP BY 1 HAVING count(*) >= 7))"""


@query("d14_merge_sparse_blocks", f"{PTS}, {MERGED} SELECT bin_id, block_id FROM merged")
def d14(spark, sf):
    blocks = blocking.grid_blocks(points(spark, sf), 2_000)
    return blocking.merge_sparse_blocks(blocks, 7, 2_000).select("bin_id", "block_id")


PLACES = "places AS (SELECT x_m, y_m, count(*) AS n FROM points GROUP BY ALL)"


@query(
    "d13_distance_pairs",
    f"""{PTS}, {PLACES}, ids AS (SELECT concat(cast(cast(x_m AS bigint) AS varchar), ':', cast(cast(y_m AS bigint) AS varchar)) AS id, x_m, y_m FROM places)
    SELECT a.id AS i, b.id AS j, round(sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)), 6) AS dist_m FROM ids a JOIN ids b ON a.id <> b.id
    AND abs(a.x_m - b.x_m) <= 1500 AND abs(a.y_m - b.y_m) <= 1500 AND sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) <= 1500""",
)
def d13(spark, sf):
    places = points(spark, sf).select("x_m", "y_m").distinct()
    ident = F.concat_ws(":", F.round("x_m").cast("bigint").cast("string"), F.round("y_m").cast("bigint").cast("string"))
    return rounded(joins.distance_pairs(places.withColumn("id", ident), 1500.0), ["dist_m"])


@query(
    "v11_moran_sweep",
    f"""{PTS}, z AS (SELECT bin_id, x_m, y_m, concentration - m AS z FROM points CROSS JOIN (SELECT avg(concentration) AS m FROM points) c), r AS (SELECT unnest({K.MORAN_RADII_M}) AS radius),
    w AS (SELECT radius, a.bin_id, any_value(a.z) AS zi, sum(b.z) AS lag, count(*) AS deg FROM r JOIN z a ON true JOIN z b ON a.bin_id <> b.bin_id AND abs(a.x_m - b.x_m) <= radius AND abs(a.y_m - b.y_m) <= radius
      AND sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) <= radius GROUP BY radius, a.bin_id)
    SELECT cast(radius AS double) AS radius_m, (SELECT count(*) FROM z) AS n, count(*) AS s0, round((SELECT count(*) FROM z) / count(*) * sum(zi * lag / deg) / (SELECT sum(z * z) FROM z), 9) AS moran_i FROM w GROUP BY radius""",
)
def v11(spark, sf):
    return rounded(blocking.moran_sweep(points(spark, sf), "bin_id", "concentration"), ["moran_i"], 9)


@query("v11_moran_permutation_p")
def v11_p(spark, sf):
    return blocking.moran_sweep(points(spark, sf), "bin_id", "concentration", [5_000], permutations=999)


@query(
    "v11_permutation_sanity",
    f"""{PTS}, z AS (SELECT bin_id, x_m, y_m, concentration - m AS z FROM points CROSS JOIN (SELECT avg(concentration) AS m FROM points) c),
    w AS (SELECT a.bin_id, any_value(a.z) AS zi, sum(b.z) AS lag, count(*) AS deg FROM z a JOIN z b ON a.bin_id <> b.bin_id AND abs(a.x_m - b.x_m) <= 5000 AND abs(a.y_m - b.y_m) <= 5000
      AND sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) <= 5000 GROUP BY a.bin_id)
    SELECT 5000e0 AS radius_m, (SELECT count(*) FROM z) AS n, count(*) AS s0, round((SELECT count(*) FROM z) / count(*) * sum(zi * lag / deg) / (SELECT sum(z * z) FROM z), 9) AS moran_i,
      true AS p_in_range, true AS p_in_steps FROM w""",
)
def v11_p_sanity(spark, sf):
    """The observed index beside 999 draws: p is a whole number of thousandths above zero and at most a half and one step."""
    found = written(v11_p(spark, sf))
    steps = F.col("p_value") * 1000
    inside = (F.col("p_value") > 0) & (F.col("p_value") <= 0.501)
    return rounded(found.select("radius_m", "n", "s0", "moran_i", inside.alias("p_in_range"), (F.abs(steps - F.round(steps)) < 1e-9).alias("p_in_steps")), ["moran_i"], 9)


# ------------------------------------------------------------------ splits

FOLDS_SQL = f"""ranked AS (SELECT o_orderkey, fold, row_number() OVER (PARTITION BY fold ORDER BY {splits.hash_sql('o_orderkey', 'fold')}, o_orderkey) AS rn FROM orders CROSS JOIN generate_series(0, 49) f(fold))"""


@query(
    "v1_shuffle_split",
    f"WITH {FOLDS_SQL} SELECT o_orderkey, cast(fold AS int) AS fold, rn <= (SELECT ceil(count(*) * 0.2e0) FROM orders) AS is_test FROM ranked",
)
def v1(spark, sf):
    return splits.shuffle_split(spread(read(spark, sf, "orders").select("o_orderkey")), "o_orderkey", 50)


@query(
    "v1_usable_folds",
    f"""WITH {FOLDS_SQL}, m AS (SELECT r.fold, r.rn <= (SELECT ceil(count(*) * 0.2e0) FROM orders) AS is_test, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS a, CASE WHEN o_orderkey < fold THEN 1 ELSE 0 END AS b FROM ranked r JOIN orders USING (o_orderkey))
    SELECT cast(fold AS int) AS fold, count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test) AS n_test,
    count(*) FILTER (WHERE is_test) > 0 AND count(DISTINCT a) FILTER (WHERE NOT is_test) = 2 AND count(DISTINCT b) FILTER (WHERE NOT is_test) = 2 AS usable FROM m GROUP BY 1""",
)
def v1_usable(spark, sf):
    split = splits.shuffle_split(spread(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")), "o_orderkey", 50)
    labelled = split.withColumns(
        {"a": (F.col("o_orderstatus") == "P").cast("int"), "b": (F.col("o_orderkey") < F.col("fold")).cast("int")}
    )
    return splits.usable_folds(labelled, ["a", "b"])


@query(
    "v2_kfold",
    f"SELECT o_orderkey, cast((row_number() OVER (ORDER BY {splits.hash_sql('o_orderkey', '3')}, o_orderkey) - 1) % 10 AS int) AS fold FROM orders",
)
def v2(spark, sf):
    return splits.kfold(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10, 3)


@query(
    "w8_split_ordinal",
    f"WITH {FOLDS_SQL} SELECT o_orderkey, cast(fold AS int) AS fold, rn AS ordinal FROM ranked",
)
def w8(spark, sf):
    return splits.split_ordinal(spread(read(spark, sf, "orders").select("o_orderkey")), "o_orderkey", 50)


def grouped(spark, sf):
    return blocking.grid_blocks(points(spark, sf), 10_000).withColumn("stratum", (F.col("view") > 5000).cast("int"))


GROUP_HASH = "(('0x' || substr(md5(block_id), 1, 7))::BIGINT * 8)"
WALK = f"""{RECURSIVE}, {XY}, g AS (SELECT block_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {GROUP_HASH}, block_id) AS i FROM (SELECT {GRID_ID} AS block_id FROM points) t GROUP BY 1),
    walk AS (SELECT cast(0 AS bigint) AS i, cast([0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS bigint[]) AS loads, -1 AS fold
      UNION ALL SELECT g.i, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END), list_position(loads, list_min(loads)) - 1 FROM walk JOIN g ON g.i = walk.i + 1)"""


@query("v3_group_kfold", f"{WALK} SELECT block_id, cast(fold AS int) AS fold FROM walk JOIN g USING (i)")
def v3(spark, sf):
    folds = splits.group_kfold(grouped(spark, sf).select("bin_id", "block_id"), "block_id", 10)
    return folds.select("block_id", "fold").distinct()


_SPREAD = " + ".join(
    f"sqrt(10 * (list_sum(list_transform({c}, lambda x: x * x)) + 2 * n{c} * {c}[f + 1] + n{c} * n{c}) - power(list_sum({c}) + n{c}, 2)) / (10 * t{c})" for c in ("a", "b")
)
STRATIFIED_WALK = f"""{RECURSIVE}, {XY}, g AS (SELECT *, row_number() OVER (ORDER BY round(sqrt(greatest(2 * (na * na + nb * nb) - n * n, 0)) / 2, 9) DESC, na DESC, nb DESC, {GROUP_HASH}, block_id) AS i
      FROM (SELECT block_id, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(view > 5000, false)) AS na, count(*) FILTER (WHERE view > 5000) AS nb FROM (SELECT *, {GRID_ID} AS block_id FROM points) t GROUP BY 1) u),
    totals AS (SELECT sum(na)::BIGINT AS ta, sum(nb)::BIGINT AS tb FROM g), zero AS (SELECT cast([0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS bigint[]) AS z),
    walk AS (SELECT cast(0 AS bigint) AS i, z AS loads, z AS a, z AS b, cast(-1 AS bigint) AS fold FROM zero
      UNION ALL SELECT i, list_transform(loads, lambda x, k: CASE WHEN k = fold + 1 THEN x + n ELSE x END), list_transform(a, lambda x, k: CASE WHEN k = fold + 1 THEN x + na ELSE x END),
        list_transform(b, lambda x, k: CASE WHEN k = fold + 1 THEN x + nb ELSE x END), fold
      FROM (SELECT g.i, loads, a, b, n, na, nb, cast(list_sort(list_transform(range(10), lambda f: [round(({_SPREAD}) / 2, 12), loads[f + 1], f]))[1][3] AS bigint) AS fold
        FROM walk JOIN g ON g.i = walk.i + 1 CROSS JOIN totals) s)"""


@query("v4_stratified_group_kfold", f"{STRATIFIED_WALK} SELECT block_id, cast(fold AS int) AS fold FROM walk JOIN g USING (i)")
def v4(spark, sf):
    rows = grouped(spark, sf).select("bin_id", "block_id", F.coalesce("stratum", F.lit(0)).alias("stratum"))
    return splits.stratified_group_kfold(rows, "block_id", "stratum", 10).select("block_id", "fold").distinct()


LABEL_WIDE = ", ".join(f"CASE WHEN {s} > {THRESHOLDS[s]['warning']}e0 THEN 1 ELSE 0 END AS l_{s}" for s in SPECIES)
COMBO = " + ".join(f"l_{s} * {2 ** i}" for i, s in enumerate(SPECIES))


def labelled(spark, sf):
    levels = {f"l_{s}": F.coalesce((F.col(s) > THRESHOLDS[s]["warning"]).cast("int"), F.lit(0)) for s in SPECIES}
    return daily(spark, sf).withColumns(levels)


@query(
    "v5_strat_label",
    f"""{with_views('obs')}, {OBS}, {DAILY}, wide AS (SELECT location_id, obs_date, {LABEL_WIDE} FROM daily), packed AS (SELECT location_id, obs_date, {COMBO} AS combo FROM wide)
    SELECT location_id, obs_date, cast(combo AS int) AS combo, cast(CASE WHEN count(*) OVER (PARTITION BY combo) < 10 THEN -1 ELSE combo END AS int) AS strat FROM packed""",
)
def v5(spark, sf):
    out = splits.strat_label(labelled(spark, sf), [f"l_{s}" for s in SPECIES], 10)
    return out.select("location_id", "obs_date", "combo", "strat")


@query(
    "w6_collapse_rare",
    "SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) < 11 THEN -1 ELSE o_custkey END AS o_custkey FROM orders",
)
def w6(spark, sf):
    return splits.collapse_rare(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 11)


@query(
    "v6_split_groups",
    f"{PTS} SELECT block_id FROM (SELECT {GRID_ID} AS block_id, bin_id % 3 AS fold FROM points) t GROUP BY 1 HAVING count(DISTINCT fold) > 1",
)
def v6(spark, sf):
    blocks = blocking.grid_blocks(points(spark, sf), 10_000).withColumn("fold", F.col("bin_id") % 3)
    return splits.split_groups(blocks, "block_id")
