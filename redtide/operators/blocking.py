"""Spatial blocks: grid, quadtree, clusters; merging of sparse blocks; Moran's I."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redtide import constants as K
from redtide.functions.hashing import portable_hash
from redtide.operators.joins import cell_of, distance_pairs
from redtide.operators.ranking import running_totals
from redtide.operators.splits import hash_ordinal, portable_sample
from redtide.session import written


def grid_blocks(df: DataFrame, size_m: float) -> DataFrame:
    column = F.floor(F.col("x_m") / size_m).cast("bigint").cast("string")
    row = F.floor(F.col("y_m") / size_m).cast("bigint").cast("string")
    return df.withColumn("block_id", F.concat_ws("_", column, row))


def extent(df: DataFrame, pad: float = 1.0) -> tuple[float, float, float, float]:
    """Padded bounding box: four numbers, the only thing that reaches the driver."""
    b = df.agg(F.min("x_m"), F.max("x_m"), F.min("y_m"), F.max("y_m")).first()
    return b[0] - pad, b[1] + pad, b[2] - pad, b[3] + pad


def quadrant_path(df: DataFrame, box: tuple[float, float, float, float], max_depth: int = 8) -> DataFrame:
    """`_path`: `max_depth` quadrant digits of each row; digit = 2 * (east half) + (north half)."""
    x0, x1, y0, y1 = box
    parts = 2**max_depth
    inside = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / (hi - lo) * parts), F.lit(0)), F.lit(parts - 1)).cast("int")
    ix, iy = inside(F.col("x_m"), x0, x1), inside(F.col("y_m"), y0, y1)
    bit = lambda i, d: F.shiftright(i, max_depth - d).bitwiseAND(1)
    digits = [(2 * bit(F.col("_ix"), d) + bit(F.col("_iy"), d)).cast("string") for d in range(1, max_depth + 1)]
    return df.withColumns({"_ix": ix, "_iy": iy}).withColumn("_path", F.concat(*digits)).drop("_ix", "_iy")


def prefix_counts(df: DataFrame, max_depth: int = 8) -> DataFrame:
    """Rows under every prefix of `_path`: (depth, prefix, n). Rows are counted per finest cell
    first (at most 4 ** max_depth of them) and only those counts are added up per prefix."""
    finest = df.groupBy("_path").agg(F.count(F.lit(1)).alias("n"))
    depths = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    return (
        finest.select("_path", "n", depths)
        .groupBy("depth", F.substring(F.col("_path"), F.lit(1), F.col("depth")).alias("prefix"))
        .agg(F.sum("n").alias("n"))
    )


def quadtree_blocks(
    df: DataFrame,
    mode: str = "adaptive",
    target_obs: int = 30,
    stop_prob: float = 0.3,
    min_depth: int = 2,
    max_depth: int = 8,
    min_size_m: float = 5_000.0,
    seed: int = 42,
    box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Leaf of a quadtree over the padded box as `block_id` ("q" and its digits).

    A node stops when it is `min_depth` deep and at the depth limit, or its short side is at
    most `min_size_m`, or (adaptive) it has at most `target_obs` rows, or (random) its coin
    falls below `stop_prob`. A node exists only if none of its ancestors stopped, so a leaf is
    simply the shortest prefix that may stop; no recursion is needed.
    """
    x0, x1, y0, y1 = box = box or extent(df)
    pathed = quadrant_path(df, box, max_depth)
    nodes = prefix_counts(pathed, max_depth)
    short_side = min(x1 - x0, y1 - y0)
    limit = F.col("depth").isin([d for d in range(max_depth + 1) if d == max_depth or short_side / 2**d <= min_size_m])
    if mode == "adaptive":
        rule = F.col("n") <= target_obs
    elif mode == "random":
        rule = coin("prefix", seed) < int(stop_prob * 1_000_000)
    else:
        raise ValueError(f"mode must be adaptive or random, not {mode!r}")
    stops = nodes.where((F.col("depth") >= min_depth) & (limit | rule)).select("prefix")
    # at most 4 ** max_depth finest cells; each looks up its shortest stopping prefix
    leaves = (
        pathed.select("_path")
        .distinct()
        .withColumn("depth", F.explode(F.sequence(F.lit(min_depth), F.lit(max_depth))))
        .withColumn("prefix", F.substring(F.col("_path"), F.lit(1), F.col("depth")))
        .join(stops, "prefix")
        .groupBy("_path")
        .agg(F.min_by("prefix", "depth").alias("_leaf"))
    )
    # broadcast side: at most 4 ** max_depth rows
    return (
        pathed.join(F.broadcast(leaves), "_path")
        .withColumn("block_id", F.concat(F.lit("q"), "_leaf"))
        .drop("_path", "_leaf")
    )


def coin(prefix: Column | str, seed: int) -> Column:
    """Coin of a quadtree node in [0, 1000000), from its path read as a base-4 number with a
    leading 1 (so that paths of different lengths differ)."""
    node = F.conv(F.concat(F.lit("1"), F.col(prefix) if isinstance(prefix, str) else prefix), 4, 10).cast("bigint")
    return portable_hash(node, seed) % 1_000_000


def leaf_extent(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Blocks with their size on the ground: a leaf of depth d is 1 / 2 ** d of the box."""
    x0, x1, y0, y1 = box
    scale = F.pow(F.lit(2.0), F.length("block_id") - 1)
    diagonal = math.hypot(x1 - x0, y1 - y0)
    return df.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_obs")).withColumn("diag_m", diagonal / scale)


def point_extent(df: DataFrame) -> DataFrame:
    """Blocks with the diagonal of the box around their points."""
    width, height = F.max("x_m") - F.min("x_m"), F.max("y_m") - F.min("y_m")
    return df.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sqrt(width * width + height * height).alias("diag_m")
    )


def block_stats(blocks: DataFrame) -> DataFrame:
    """Number of blocks; least, median and largest diagonal and observation count. Works on
    one row per block."""
    return blocks.agg(
        F.count(F.lit(1)).alias("n_blocks"),
        *[f("diag_m").alias(f"block_diag_{n}_m") for n, f in _SPREAD.items()],
        *[f("n_obs").alias(f"obs_per_block_{n}") for n, f in _SPREAD.items()],
    )


_SPREAD = {"min": F.min, "median": lambda c: F.percentile(c, 0.5), "max": F.max}


#: Rows of a stretch of the curve that one task clusters, bits of a coordinate on the curve, rounds of moves.
STRETCH_ROWS, CURVE_BITS, MOST_ROUNDS = 1024, 20, 50


def curve_place(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Place on the Z-order curve over the box: the bits of both coordinates in turn."""
    x0, x1, y0, y1 = box
    parts = 1 << CURVE_BITS
    cell = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / (hi - lo) * parts), F.lit(0)), F.lit(parts - 1)).cast("bigint")
    spread = lambda i: reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(i, k).bitwiseAND(1), 2 * k) for k in range(CURVE_BITS)])
    return F.shiftleft(spread(cell(x, x0, x1)), 1) + spread(cell(y, y0, y1))


def bounded_clusters(xy: np.ndarray, weight: np.ndarray, target: int, low: int, high: int) -> np.ndarray:
    """Cluster of each position (given in curve order), about `target` rows each.

    Runs of even weight along the curve come first. Then positions move to a nearer centre, largest gain first,
    as long as the sizes of both clusters stay within `low` and `high`, until none moves.
    """
    k = max(1, round(float(weight.sum()) / target))
    ahead = np.cumsum(weight) - weight / 2
    own = np.minimum((ahead * k / weight.sum()).astype(int), k - 1)
    sizes = np.bincount(own, weight, k)
    for _ in range(MOST_ROUNDS):
        centres = np.column_stack([np.bincount(own, weight * c, k) for c in xy.T]) / np.maximum(sizes, 1)[:, None]
        gap = np.hypot(xy[:, None, 0] - centres[:, 0], xy[:, None, 1] - centres[:, 1])
        gap[:, sizes == 0] = np.inf
        best = gap.argmin(1)
        gain = gap[np.arange(len(xy)), own] - gap[np.arange(len(xy)), best]
        moved = False
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 1e-9:
                break
            if sizes[own[i]] - weight[i] >= low and sizes[best[i]] + weight[i] <= high:
                sizes[own[i]] -= weight[i]
                sizes[best[i]] += weight[i]
                own[i], moved = best[i], True
        if not moved:
            break
    return own


def cluster_blocks(df: DataFrame, target: int = 30, low: float = 0.7, high: float = 1.3) -> DataFrame:
    """Compact blocks of about `target` rows, from `low` to `high` times as many.

    Positions are put on a space-filling curve, whose stretches of some thousand rows are clustered task by task
    (`bounded_clusters`), so the cost grows with the rows and no centre meets all positions. All rows of a position
    are in one block: a position with more than the largest size is a block by itself, and with positions of
    many rows each, sizes can miss the range by the rows of one position. The range also can't hold below
    `low * target` rows in all.
    """
    least, most = math.ceil(low * target), math.floor(high * target)
    known = df.where(F.col("x_m").isNotNull() & F.col("y_m").isNotNull())
    places = known.groupBy("x_m", "y_m").agg(F.count(F.lit(1)).alias("_w"))
    places = written(places)
    alone = F.concat(F.lit("p"), F.col("x_m").cast("string"), F.lit(":"), F.col("y_m").cast("string"))
    few = places.where(F.col("_w") <= most)
    total, x0, x1, y0, y1 = few.agg(F.sum("_w"), F.min("x_m") - 1, F.max("x_m") + 1, F.min("y_m") - 1, F.max("y_m") + 1).first()
    rows = places.agg(F.sum("_w")).first()[0] or 0
    named = places.where(F.col("_w") > most).select("x_m", "y_m", alone.alias("block_id"))
    if total:
        curve = few.withColumns({"_at": curve_place(F.col("x_m"), F.col("y_m"), (x0, x1, y0, y1)), "_all": F.lit(1)})
        before = running_totals(curve, ["_all"], "_at", {"w": F.col("_w")}).select("_at", "w_before")
        stretches = max(1, total // STRETCH_ROWS)
        stretch = F.least(F.floor(F.col("w_before") * stretches / total), F.lit(stretches - 1)).cast("bigint")
        placed = curve.join(before, "_at").withColumn("_stretch", stretch)

        def cluster(key, table):
            table = table.sort_by([("_at", "ascending"), ("x_m", "ascending"), ("y_m", "ascending")])
            xy = np.column_stack([table["x_m"].to_numpy(), table["y_m"].to_numpy()])
            own = bounded_clusters(xy, table["_w"].to_numpy().astype(float), target, least, most)
            ids = pa.array([f"c{key[0].as_py()}_{c}" for c in own], pa.string())
            return pa.table({"x_m": table["x_m"], "y_m": table["y_m"], "block_id": ids})

        slim = placed.select("_stretch", "x_m", "y_m", "_w", "_at")
        named = named.unionByName(slim.groupBy("_stretch").applyInArrow(cluster, "x_m double, y_m double, block_id string"))
    # broadcast side: positions with over a thousandth of all rows, fewer than a thousand of them
    busy = places.where((F.col("_w") > most) & (F.col("_w") * 1000 > rows)).select("x_m", "y_m")
    at_busy = known.join(F.broadcast(busy), ["x_m", "y_m"], "left_semi").withColumn("block_id", alone)
    rest = known.join(F.broadcast(busy), ["x_m", "y_m"], "left_anti").join(named, ["x_m", "y_m"])
    return rest.unionByName(at_busy.select(*rest.columns))


def merge_sparse_blocks(
    df: DataFrame, min_obs: int = 5, size_m: float | None = None, factor: float = 3.0, id_col: str = "block_id"
) -> DataFrame:
    """Rows of blocks with fewer than `min_obs` move to the nearest large block by centroid
    within `factor` x `size_m`; blocks that stay small are dropped. Nothing changes when no
    block is sparse or none is large.

    The search runs between block centroids on a bucket join as wide as the search radius;
    without a size every distance counts and the blocks are compared directly.
    """
    blocks = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.avg("x_m").alias("_cx"), F.avg("y_m").alias("_cy"))
    seen = blocks.agg(F.count_if(F.col("_n") < min_obs), F.count_if(F.col("_n") >= min_obs)).first()
    if not seen[0] or not seen[1]:
        return df
    sparse = blocks.where(F.col("_n") < min_obs)
    large = blocks.where(F.col("_n") >= min_obs)
    anchors = large.select(F.col(id_col).alias("_to"), F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay"))
    dx, dy = F.col("_cx") - F.col("_ax"), F.col("_cy") - F.col("_ay")
    distance = F.sqrt(dx * dx + dy * dy)
    if size_m:
        reach = factor * size_m
        cell = lambda c: F.floor(c / reach).cast("bigint")
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        offers = (
            sparse.withColumn("_by", around(F.col("_cy")))
            .withColumn("_bx", around(F.col("_cx")))
            .join(anchors.withColumns({"_bx": cell(F.col("_ax")), "_by": cell(F.col("_ay"))}), ["_bx", "_by"])
            .where(distance <= reach)
        )
    else:
        offers = nearest_ring(sparse, anchors, id_col)
    moves = offers.withColumn("_d", distance).groupBy(id_col).agg(F.min_by("_to", F.struct("_d", "_to")).alias("_to"))
    # totals after the move come from the block table, rows are touched once
    renamed = blocks.join(moves, id_col, "left").select(id_col, "_n", F.coalesce("_to", F.col(id_col)).alias("_new"))
    kept = renamed.groupBy("_new").agg(F.sum("_n").alias("_total")).where(F.col("_total") >= min_obs).select("_new")
    target = renamed.join(kept, "_new").select(id_col, "_new")
    columns = df.columns
    return df.join(target, id_col).withColumn(id_col, F.col("_new")).select(*columns)


def nearest_ring(sparse: DataFrame, anchors: DataFrame, id_col: str) -> DataFrame:
    """Offers for a search without a radius: buckets double until every sparse block has one.

    A found anchor at distance d is only final if buckets are at least d wide, so each round
    keeps what is settled and widens the rest; rounds are few because the width doubles.
    """
    box = anchors.agg(F.min("_ax"), F.max("_ax"), F.min("_ay"), F.max("_ay"), F.count(F.lit(1))).first()
    far = sparse.agg(F.min("_cx"), F.max("_cx"), F.min("_cy"), F.max("_cy")).first()
    span = max(max(box[1], far[1]) - min(box[0], far[0]), max(box[3], far[3]) - min(box[2], far[2]), 1.0)
    width = span / max(1.0, math.sqrt(box[4]))
    found = None
    while True:
        cell = lambda c, w=width: F.floor(c / w).cast("bigint")
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        dx, dy = F.col("_cx") - F.col("_ax"), F.col("_cy") - F.col("_ay")
        offers = (
            sparse.withColumn("_by", around(F.col("_cy")))
            .withColumn("_bx", around(F.col("_cx")))
            .join(anchors.withColumns({"_bx": cell(F.col("_ax")), "_by": cell(F.col("_ay"))}), ["_bx", "_by"])
            .where(F.sqrt(dx * dx + dy * dy) <= width)
            .drop("_bx", "_by")
        )
        found = offers if found is None else found.unionByName(offers)
        if width > 2 * span:
            return found
        sparse = sparse.join(offers.select(id_col).distinct(), id_col, "left_anti")
        if sparse.isEmpty():
            return found
        width *= 2


# ---------------------------------------------------------------- Moran's I


def weighted_places(df: DataFrame, value: str) -> DataFrame:
    """Deviations from the mean summed per distinct position, with a position id."""
    known = df.where(F.col(value).isNotNull() & F.col("x_m").isNotNull() & F.col("y_m").isNotNull())
    mean = known.agg(F.avg(value)).first()[0]
    z = F.col(value) - mean
    return (
        known.groupBy("x_m", "y_m")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(z).alias("z"), F.sum(z * z).alias("zz"))
        .withColumn("id", F.concat_ws(":", F.col("x_m").cast("string"), F.col("y_m").cast("string")))
    )


#: Positions a tile of even density holds, and most positions in and around a tile that one task compares.
TILE_MEAN, TILE_MOST = 512, 8192
#: Sub-cells along a radius where tiles are fuller.
SUB_CELLS = 16


def reach_sums(places: DataFrame, radii_m: list[float], values: list[str], tile_most: int = TILE_MOST) -> DataFrame:
    """Sums of `values` over all positions within each radius of each position, itself included: (radius_m, id, values).

    Pairs of positions are never rows. Positions meet in tiles at least a radius wide, wider where there are few, with
    copies in the tiles within reach, and a tile is compared in arrays; all radii are one job. The tiles are counted
    first: around one with more than `tile_most` positions, sub-cells wholly within the radius add their sums,
    and only sub-cells on the border compare positions.
    """
    box = places.agg(F.min("x_m"), F.max("x_m"), F.min("y_m"), F.max("y_m"), F.count(F.lit(1))).first()
    slim = places.select("id", "x_m", "y_m", *[F.col(v).cast("double").alias(v) for v in values])
    if not box[4]:
        return slim.select(F.lit(0.0).alias("radius_m"), "id", *values)
    sides = {float(r): max(float(r), math.sqrt((box[1] - box[0] + r) * (box[3] - box[2] + r) * TILE_MEAN / box[4])) for r in radii_m}
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("radius_m"), F.lit(side).alias("side")) for r, side in sides.items()]))
    home = slim.withColumn("_r", each).select("*", "_r.*").drop("_r")
    home = home.withColumns({"_hx": cell_of(F.col("x_m"), F.col("side")), "_hy": cell_of(F.col("y_m"), F.col("side"))})
    around = lambda c: F.explode(F.sequence(cell_of(F.col(c) - F.col("radius_m"), F.col("side")), cell_of(F.col(c) + F.col("radius_m"), F.col("side"))))
    spread = home.withColumn("_tx", around("x_m")).withColumn("_ty", around("y_m"))
    tile = ["radius_m", "_tx", "_ty"]
    sizes = written(spread.groupBy(*tile).agg(F.count(F.lit(1)).alias("_size")))
    dense = sizes.where(F.col("_size") > tile_most).select("radius_m", F.col("_tx").alias("_hx"), F.col("_ty").alias("_hy"))
    crowded = sorted(r.radius_m for r in dense.select("radius_m").distinct().collect())  # at most one row a radius
    if crowded:
        spread = spread.join(sizes.where(F.col("_size") <= tile_most).drop("_size"), tile)
    schema = home.select("radius_m", "id", *values).schema
    found = spread.groupBy(*tile).applyInArrow(_tile_sums(values), schema)
    for radius in crowded:
        targets = home.where(F.col("radius_m") == radius).join(dense.where(F.col("radius_m") == radius), ["radius_m", "_hx", "_hy"], "left_semi")
        sums = _dense_sums(targets.select("id", "x_m", "y_m"), slim, radius, values)
        found = found.unionByName(sums.select(F.lit(radius).alias("radius_m"), "id", *values))
    return found


def _tile_sums(values: list[str], step: int = 256):
    """The positions at home in a tile against all within reach of it."""

    def run(key, table):
        radius, tx, ty = (k.as_py() for k in key)
        x, y = table["x_m"].to_numpy(), table["y_m"].to_numpy()
        own = np.flatnonzero((table["_hx"].to_numpy() == tx) & (table["_hy"].to_numpy() == ty))
        weights = np.column_stack([table[v].to_numpy() for v in values])
        out = np.zeros((len(own), len(values)))
        for first in range(0, len(own), step):
            some = own[first : first + step]
            dx, dy = x[some, None] - x, y[some, None] - y
            out[first : first + step] = (np.sqrt(dx * dx + dy * dy) <= radius) @ weights
        sums = {v: pa.array(out[:, k]) for k, v in enumerate(values)}
        return pa.table({"radius_m": pa.array([radius] * len(own), pa.float64()), "id": table["id"].take(pa.array(own)), **sums})

    return run


def _dense_sums(targets: DataFrame, sources: DataFrame, radius_m: float, values: list[str]) -> DataFrame:
    """`reach_sums` of the targets by sub-cells: whole ones by their sums, those on the border by their positions."""
    side = radius_m / SUB_CELLS
    near = lambda a: max(abs(a) - 1, 0)
    steps = range(-SUB_CELLS - 1, SUB_CELLS + 2)
    # a hair of slack on both sides: cells that rounding could misjudge count as border
    inside = [(a, b) for a in steps for b in steps if math.hypot(abs(a) + 1, abs(b) + 1) <= SUB_CELLS * (1 - 1e-9)]
    border = [(a, b) for a in steps for b in steps if (a, b) not in set(inside) and math.hypot(near(a), near(b)) <= SUB_CELLS * (1 + 1e-9)]
    offsets = lambda pairs: F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in pairs])).alias("_o")
    celled = lambda df: df.withColumns({"_cx": cell_of(F.col("x_m"), side), "_cy": cell_of(F.col("y_m"), side)})
    targets, sources = celled(targets), celled(sources)
    cells = sources.groupBy("_cx", "_cy").agg(*[F.sum(v).alias(v) for v in values])
    asked = targets.select("_cx", "_cy").distinct()

    def reached(pairs):
        return asked.select("_cx", "_cy", offsets(pairs)).select(
            F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay"), (F.col("_cx") + F.col("_o.a")).alias("_cx"), (F.col("_cy") + F.col("_o.b")).alias("_cy")
        )

    whole = reached(inside).join(cells, ["_cx", "_cy"]).groupBy("_ax", "_ay").agg(*[F.sum(v).alias(v) for v in values])
    whole = targets.select("id", F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay")).join(whole, ["_ax", "_ay"]).select("id", *values)
    renamed = sources.select("_cx", "_cy", F.col("x_m").alias("_x"), F.col("y_m").alias("_y"), *values)
    dx, dy = F.col("x_m") - F.col("_x"), F.col("y_m") - F.col("_y")
    here = targets.select("id", "x_m", "y_m", F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay"))
    edge = reached(border).join(cells.select("_cx", "_cy"), ["_cx", "_cy"], "left_semi").join(here, ["_ax", "_ay"]).join(renamed, ["_cx", "_cy"])
    edge = edge.where(F.sqrt(dx * dx + dy * dy) <= radius_m).groupBy("id").agg(*[F.sum(v).alias(v) for v in values])
    return whole.unionByName(edge).groupBy("id").agg(*[F.sum(v).alias(v) for v in values])


def moran_i(places: DataFrame, radii_m: list[float]) -> DataFrame:
    """Moran's I with row-standardised binary weights within each radius (one row a radius).

    Every row of a position has the same neighbours, all rows in reach but itself, so the sum
    over pairs of rows is a sum over positions: with N rows and Z summed deviation in
    reach of a position, its rows contribute (z Z - zz) / (N - 1). Neither rows nor positions pair up.
    """
    reach = reach_sums(places, radii_m, ["n", "z"]).select("radius_m", "id", F.col("n").alias("_n"), F.col("z").alias("_z"))
    neighbours = F.col("_n") - 1
    linked = neighbours > 0
    return reach.join(places, "id").groupBy("radius_m").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(linked, F.col("n")).otherwise(0)).alias("s0"),
        (
            F.sum("n")
            / F.sum(F.when(linked, F.col("n")))
            * F.sum(F.when(linked, (F.col("z") * F.col("_z") - F.col("zz")) / neighbours))
            / F.sum("zz")
        ).alias("moran_i"),
    )


#: Rows whose values fit in a broadcast of 384 MB, and rows of one position that one task draws for.
DRAWN_ROWS, SEATS = 48 << 20, 4096
#: Rows of one position that its tiles draw for themselves; for more, the sums of all draws are made once, in other tasks.
LIGHT_ROWS = 256
DRAWN_AT_ONCE = 1 << 15
ROUNDS = 16
MIX = 0x45D9F3B


def _mixed(v, both, odd, right):
    for _ in range(2):
        v = both(v, 0x7FFFFFFF) * MIX
        v = odd(v, right(v, 16))
    return v


def drawn_seat(ordinal, draw, n: int):
    """A keyed permutation of 0 .. n - 1 for every draw, on Columns or on integer arrays alike (arrays up to 2 ** 31).

    Each round pairs x with key - x (mod n) and a hash of the larger one decides whether the two change places, so any
    number of rounds is one-to-one for every n; no order, table or search is needed. The hash has 32 bits, which arrays
    take as they are.
    """
    if not isinstance(ordinal, Column):
        return _drawn_seats(ordinal, draw, n)
    both, odd, right = (lambda a, b: a.bitwiseAND(b)), (lambda a, b: a.bitwiseXOR(b)), F.shiftright
    keyed = lambda k: both(_mixed(draw * 64 + k, both, odd, right), 0x7FFFFFFF)

    def turn(x, k):
        partner = (keyed(k + 1) % n + n - x) % n
        larger = F.greatest(x, partner)
        coin = both(odd(odd(larger, right(larger, 31)), keyed(k + 32)), 0xFFFFFFFF)
        for _ in range(2):
            coin = both(odd(coin, right(coin, 16)) * MIX, 0xFFFFFFFF)
        return F.when(right(coin, 31) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(k).cast("bigint") for k in range(ROUNDS)]), ordinal, turn)


def _drawn_seats(ordinal: np.ndarray, draw: np.ndarray, n: int) -> np.ndarray:
    """`drawn_seat` in place on numbers of 32 bits: what falls below zero or above the top is at the far end of them."""
    steps = np.asarray(draw) * 64 + np.arange(ROUNDS).reshape(-1, *[1] * np.ndim(draw))
    keyed = lambda k: np.bitwise_and(_mixed(steps + k, np.bitwise_and, np.bitwise_xor, np.right_shift), 0x7FFFFFFF)
    keys, salts = (keyed(1) % n).astype(np.uint32), keyed(32).astype(np.uint32)
    x = np.array(np.broadcast_to(ordinal, np.broadcast_shapes(np.shape(ordinal), np.shape(draw))), np.uint32, order="C")
    partner, coin, spare = np.empty_like(x), np.empty_like(x), np.empty_like(x)
    half, top, mix = np.uint32(16), np.int32(31), np.uint32(MIX)
    for key, salt in zip(keys, salts):
        np.subtract(key, x, out=partner)
        np.minimum(partner, np.add(partner, np.uint32(n), out=spare), out=partner)
        np.bitwise_xor(np.maximum(x, partner, out=coin), salt, out=coin)
        for _ in range(2):
            np.bitwise_xor(coin, np.right_shift(coin, half, out=spare), out=coin)
            np.multiply(coin, mix, out=coin)
        taken = np.right_shift(coin.view(np.int32), top, out=coin.view(np.int32)).view(np.uint32)  # all bits or none
        np.bitwise_xor(x, partner, out=partner)
        np.bitwise_xor(x, np.bitwise_and(partner, taken, out=partner), out=x)
    return x.astype(np.int64)


def _numbered(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """(_id, seat from 0, x_m, y_m, _z): rows in hash order with their deviation from the mean; numbered once."""
    known = df.where(F.col(value).isNotNull() & F.col("x_m").isNotNull() & F.col("y_m").isNotNull())
    mean = known.agg(F.avg(value)).first()[0]
    rows = known.select(F.col(id_col).alias("_id"), "x_m", "y_m", (F.col(value) - F.lit(mean)).alias("_z"))
    ordered = hash_ordinal(rows.withColumns({"_h": portable_hash("_id"), "_all": F.lit(1)}), ["_all"], "_id").drop("_all")
    return written(ordered.withColumn("seat", F.col("ordinal") - 1).drop("ordinal"))


def moran_permutations(
    df: DataFrame, id_col: str, value: str, radius_m: float, permutations: int, drawn_rows: int = DRAWN_ROWS, tile_most: int = TILE_MOST
) -> DataFrame:
    """Moran's I of shuffled values, one row per permutation (`perm` from 1), over all rows.

    Rows are numbered once. In draw p a row of seat s gets the value of seat `drawn_seat(s, p)`, so nothing is put
    in order or moved for a draw. Values up to `drawn_rows` are broadcast (counted first), and a tile of positions
    draws for itself: one job for all permutations. Beyond, and where a tile is too full, values meet their seats
    in a join; the draws are the same.
    """
    numbered = _numbered(df, id_col, value)
    count, total = numbered.agg(F.count(F.lit(1)), F.sum(F.col("_z") * F.col("_z"))).first()
    places = numbered.groupBy("x_m", "y_m").agg(F.count(F.lit(1)).cast("double").alias("n"))
    places = written(places.withColumn("id", F.concat_ws(":", F.col("x_m").cast("string"), F.col("y_m").cast("string"))))
    reach = written(reach_sums(places, [radius_m], ["n"], tile_most).select("id", (F.col("n") - 1).alias("deg")))
    linked = places.join(reach, "id").where("deg > 0").agg(F.sum("n")).first()[0]
    if not linked or not total:
        return numbered.limit(0).select(F.lit(0).alias("perm"), F.lit(0.0).alias("moran_i"))
    box = places.agg(F.min("x_m"), F.max("x_m"), F.min("y_m"), F.max("y_m"), F.count(F.lit(1))).first()
    side = max(radius_m, math.sqrt((box[1] - box[0] + radius_m) * (box[3] - box[2] + radius_m) * TILE_MEAN / box[4]))
    around = lambda c: F.explode(F.sequence(cell_of(F.col(c) - radius_m, side), cell_of(F.col(c) + radius_m, side)))
    tiled = lambda d: d.withColumns({"_hx": cell_of(F.col("x_m"), side), "_hy": cell_of(F.col("y_m"), side)}).withColumn("_tx", around("x_m")).withColumn("_ty", around("y_m"))
    fullest = tiled(places).groupBy("_tx", "_ty").count().agg(F.max("count")).first()[0]
    if count <= drawn_rows and fullest <= tile_most:
        terms = _drawn_in_tiles(numbered, places, tiled, radius_m, permutations, count)
    else:
        terms = _drawn_by_joins(numbered, places, reach, radius_m, permutations, count)
    return terms.select("perm", (F.lit(count / linked) * F.col("term") / F.lit(total)).alias("moran_i"))


def _drawn_in_tiles(numbered: DataFrame, places: DataFrame, tiled, radius_m: float, permutations: int, n: int) -> DataFrame:
    """(perm, term): sums over the rows of z * (sum of z in reach) / neighbours, tile by tile."""
    spark = numbered.sparkSession
    # at most DRAWN_ROWS numbers
    values = spark.sparkContext.broadcast(numbered.select("seat", "_z").orderBy("seat").select("_z").toArrow()["_z"].to_numpy())
    pieces = F.ceil(F.col("n") / SEATS).cast("bigint")
    seats = numbered.join(places, ["x_m", "y_m"]).groupBy("id", "x_m", "y_m", F.pmod("seat", pieces).alias("piece"), pieces.alias("pieces"))
    seats = seats.agg(F.sort_array(F.collect_list("seat")).alias("seats"), F.first("n").alias("rows"))  # at most about SEATS in a list
    seats = written(seats.withColumn("heavy", (F.col("rows") > LIGHT_ROWS) | (F.col("pieces") > 1)))

    def sums(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the drawn values of each list and of their squares, [draw, list]; drawn in arrays that stay in the cache."""
        seats_of, starts = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(s) for s in lists])[:-1]])
        z, zz = np.zeros((permutations, len(lists))), np.zeros((permutations, len(lists)))
        step = max(1, DRAWN_AT_ONCE // len(seats_of))
        for first in range(0, permutations, step):
            draws = np.arange(first + 1, min(first + step, permutations) + 1)
            drawn = values.value.take(drawn_seat(seats_of[None, :], draws[:, None], n))
            z[draws - 1] = np.add.reduceat(drawn, starts, axis=1)
            zz[draws - 1] = np.add.reduceat(drawn * drawn, starts, axis=1)
        return z, zz

    def pre(batches):
        for batch in batches:
            lists, ids = [seat.values.to_numpy() for seat in batch.column(1)], batch.column(0)
            # lists are drawn for together, so that an array of one draw is full; fuller ones are alone
            ends, some = np.cumsum([len(seats) for seats in lists]), 0
            while some < len(lists):
                first, behind = some, (ends[some - 1] if some else 0) + DRAWN_AT_ONCE
                some = max(first + 1, int(np.searchsorted(ends, behind, side="right")))
                made = [pa.array([row.tobytes() for row in m.T]) for m in sums(lists[first:some])]
                yield pa.RecordBatch.from_arrays([ids.slice(first, some - first), *made], names=["id", "z", "zz"])

    def add(key, table):
        total = [sum(np.frombuffer(v) for v in table[c].to_pylist()) for c in ("z", "zz")]
        return pa.table({"id": pa.array([key[0].as_py()]), "z": pa.array([total[0].tobytes()]), "zz": pa.array([total[1].tobytes()])})

    # positions with many rows are drawn for in pieces beforehand, once and not in each tile, spread over all cores: a list
    # is small beside the work on it, so tasks aren't left to follow the size of the table
    dealt = seats.where("heavy").select("id", "seats").repartition(8 * spark.sparkContext.defaultParallelism)
    heavy = dealt.mapInArrow(pre, "id string, z binary, zz binary")
    heavy = heavy.groupBy("id").applyInArrow(add, "id string, z binary, zz binary")
    light = seats.where("not heavy").select("id", "seats")
    known = places.join(light, "id", "left").join(heavy, "id", "left")

    def run(key, table):
        x, y, rows = table["x_m"].to_numpy(), table["y_m"].to_numpy(), table["n"].to_numpy()
        own = np.flatnonzero((table["_hx"].to_numpy() == key[0].as_py()) & (table["_hy"].to_numpy() == key[1].as_py()))
        lists, ready, squares = table["seats"].to_pylist(), table["z"].to_pylist(), table["zz"].to_pylist()
        plain = [k for k, v in enumerate(lists) if v is not None]
        lists = [np.array(lists[k]) for k in plain]
        out = np.zeros(permutations)
        if len(own):
            z, zz = np.zeros((permutations, len(x))), np.zeros((permutations, len(x)))
            if plain:
                z[:, plain], zz[:, plain] = sums(lists)
            for k, v in enumerate(ready):
                if v is not None:
                    z[:, k], zz[:, k] = np.frombuffer(v), np.frombuffer(squares[k])
            for low in range(0, len(own), 256):
                some = own[low : low + 256]
                dx, dy = x[some, None] - x, y[some, None] - y
                near = (np.sqrt(dx * dx + dy * dy) <= radius_m).astype(float)
                degree = near @ rows - 1
                term = np.where(degree > 0, (z[:, some] * (z @ near.T) - zz[:, some]) / np.maximum(degree, 1), 0)
                out += term.sum(1)
        return pa.table({"perm": pa.array(range(1, permutations + 1), pa.int32()), "term": pa.array(out)})

    # as many tasks as cores can use: seats are few bytes, and Spark would join tiles by their bytes
    dealt = tiled(known).repartition(8 * spark.sparkContext.defaultParallelism, "_tx", "_ty")
    terms = dealt.groupBy("_tx", "_ty").applyInArrow(run, "perm int, term double")
    return terms.groupBy("perm").agg(F.sum("term").alias("term"))


def _drawn_by_joins(numbered: DataFrame, places: DataFrame, reach: DataFrame, radius_m: float, permutations: int, n: int) -> DataFrame:
    """As `_drawn_in_tiles`, with a row for each draw of a value, and pairs of positions within the radius."""
    drawn = numbered.join(places, ["x_m", "y_m"]).select("id", "seat", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    drawn = drawn.select("id", "perm", drawn_seat(F.col("seat").cast("bigint"), F.col("perm").cast("bigint"), n).alias("seat"))
    sums = written(drawn.join(numbered.select("seat", "_z"), "seat").groupBy("perm", "id").agg(F.sum("_z").alias("z"), F.sum(F.col("_z") * F.col("_z")).alias("zz")))
    pairs = distance_pairs(places.select("id", "x_m", "y_m"), radius_m).select("i", "j")
    near = pairs.join(sums.select("perm", F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy("perm", F.col("i").alias("id")).agg(F.sum("zj").alias("_zr"))
    both = sums.join(reach.where("deg > 0"), "id").join(near, ["perm", "id"], "left")
    return both.groupBy("perm").agg(F.sum((F.col("z") * (F.col("z") + F.coalesce("_zr", F.lit(0.0))) - F.col("zz")) / F.col("deg")).alias("term"))


def moran_sweep(
    df: DataFrame,
    id_col: str,
    value: str,
    radii: list[float] = K.MORAN_RADII_M,
    sample_n: int | None = None,
    permutations: int = 0,
    seed: int = 42,
) -> DataFrame:
    """Moran's I per radius, over all rows; `sample_n` draws a sample by hash first (T4)."""
    known = df.where(F.col(value).isNotNull())
    rows = portable_sample(known, id_col, sample_n, seed) if sample_n else known
    sweep = moran_i(written(weighted_places(rows, value)), [float(r) for r in radii])
    if not permutations:
        return sweep
    sweep, out = written(sweep), None
    for radius in radii:
        observed = sweep.where(F.col("radius_m") == float(radius))
        # one row on each side: all draws of a radius in a list
        draws = moran_permutations(rows, id_col, value, float(radius), permutations).agg(F.collect_list("moran_i").alias("_draws"))
        one = observed.withColumn("_one", F.lit(1)).join(draws.withColumn("_one", F.lit(1)), "_one").drop("_one")
        above = F.size(F.filter("_draws", lambda d: d >= F.col("moran_i")))
        extreme = F.least(above, F.lit(permutations) - above)
        one = one.withColumn("p_value", (extreme + 1) / F.lit(permutations + 1.0)).drop("_draws")
        out = one if out is None else out.unionByName(one)
    return out


def correlation_range(sweep: DataFrame, decay: float = 0.1) -> float:
    """Smallest radius where |I| falls below `decay`, else the largest; a block is twice that."""
    picked = sweep.agg(F.min(F.when(F.abs("moran_i") < decay, F.col("radius_m"))), F.max("radius_m")).first()
    return picked[0] if picked[0] is not None else picked[1]
