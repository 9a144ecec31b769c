"""Domain tables derived from the given TPC-H-like tables.

Each input is a base table plus select expressions that Spark and DuckDB read alike; Spark
applies them with `selectExpr` and the oracles inline them as CTEs. No rows are made up: every
table grows with its base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPECIES = ["click", "error", "purchase", "signup", "view"]
BANDS = ["b02", "b04", "b06", "b08", "b09", "b10", "b11", "b12", "b17"]
HALF = 0.0201  # half box off the pixel lattice, so no pixel sits on a rounding edge

_LAT = "38.5e0 + ({k} * 37 % 600) / 100e0"
_LON = "-72e0 + ({k} * 53 % 900) / 100e0"

VIEWS: dict[str, tuple[str, list[str]]] = {
    # one row per bin: a species and its concentration, five species columns beside it
    "obs": (
        "events",
        [
            "event_id AS bin_id",
            "ts AS sample_time",
            "cast(ts as date) AS obs_date",
            "user_id AS loc",
            "concat('st', cast(user_id % 13 AS string)) AS station",
            _LAT.format(k="user_id") + " AS latitude",
            _LON.format(k="user_id") + " AS longitude",
            "CASE WHEN event_id % 2 = 0 THEN value / 10e0 END AS depth",
            "event_type AS species",
            "value * 100e0 AS concentration",
            *[f"CASE WHEN event_type = '{s}' THEN value * 100e0 END AS {s}" for s in SPECIES],
        ],
    ),
    "pixels": (
        "lineitem",
        [
            "date '2024-01-01' + cast(l_orderkey % 30 AS int) AS scene_date",
            "cast(l_orderkey % 4 AS int) AS scene_no",
            "l_partkey % 150 AS loc",
            _LAT.format(k="(l_partkey % 150)") + " + ((l_suppkey % 13) - 6) * 0.003e0 AS lat",
            _LON.format(k="(l_partkey % 150)") + " + (l_linenumber - 4) * 0.003e0 AS lon",
            "l_suppkey % 13 AS px_row",
            "cast(l_linenumber AS int) AS px_col",
            "l_orderkey",
            "CASE WHEN l_tax = 0 THEN 0e0 ELSE (10 + l_quantity) / 10000e0 END AS b02",
            "(11 + l_quantity) / 10000e0 AS b04",
            "l_extendedprice / 20000000e0 + 0.001e0 AS b06",
            "(5 + l_partkey % 17) / 10000e0 AS b08",
            "(5 + l_suppkey % 19) / 10000e0 AS b09",
            "(4 + l_orderkey % 23) / 10000e0 AS b10",
            "(3 + l_quantity % 13) / 10000e0 AS b11",
            "(2 + l_partkey % 7) / 10000e0 AS b12",
            "(1 + l_suppkey % 5) / 10000e0 AS b17",
            "l_discount / 10e0 - 0.002e0 AS kd489",
            "(l_quantity - 10) / 1000e0 AS iop_apig",
            "cast(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 2 END AS bigint) AS quality_flags",
            "cast(CASE WHEN l_linestatus = 'O' THEN 2147483648 ELSE 1024 END AS bigint) AS ac_flags",
            "cast(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS int) AS data_mask",
            "cast(CASE WHEN l_returnflag = 'R' THEN 1024 WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 524288 + 2048 ELSE 2 END AS bigint) AS cloud_flags",
            "l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS acq_idx",
        ],
    ),
    "grid": (
        "part",
        [
            "p_partkey AS cell_id",
            "p_partkey % 150 AS eta",
            "cast(floor(p_partkey / 150e0) AS bigint) AS xi",
            _LAT.format(k="(p_partkey % 150)") + " + (floor(p_partkey / 150e0) % 7 - 3) * 0.008e0 AS lat",
            _LON.format(k="(p_partkey % 150)") + " + (floor(p_partkey / 150e0) % 5 - 2) * 0.008e0 AS lon",
            "cast(p_size - 5 AS double) AS h",
            "p_size",
            "p_retailprice",
        ],
    ),
    "predictions": (
        "lineitem",
        [
            "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS row_id",
            "l_partkey % 50 AS fold",
            "concat('sp', cast(l_suppkey % 5 AS string)) AS species",
            "CASE WHEN l_quantity > 35 THEN 1 ELSE 0 END AS y_true",
            "cast(l_quantity * 3 + l_partkey % 60 AS int) / 210e0 AS score",
            "CASE WHEN l_quantity * 3 + l_partkey % 60 > 120 THEN 1 ELSE 0 END AS y_pred",
        ],
    ),
    "folds": (
        "events",
        [
            "concat('ac', cast(user_id % 3 AS string)) AS ac",
            "CASE WHEN event_id % 2 = 0 THEN '_only' ELSE '_roms' END AS track_type",
            "concat('ac', cast(user_id % 3 AS string), CASE WHEN event_id % 2 = 0 THEN '_only' ELSE '_roms' END) AS track",
            "CASE WHEN event_id % 4 < 2 THEN 'warning' ELSE 'closure' END AS tier",
            "event_type AS species",
            "event_id % 50 AS fold",
            "value / 500e0 AS f1",
            "CASE WHEN event_id % 11 <> 0 THEN value / 450e0 END AS prauc",
            "value / 400e0 AS recall",
        ],
    ),
    # scene and model file names, one per order
    "files": (
        "orders",
        [
            "o_orderkey AS file_id",
            "cast(o_orderdate AS date) AS day",
            """CASE o_orderkey % 6
               WHEN 0 THEN concat('S3_OLCI_GOM_', replace(cast(cast(o_orderdate AS date) AS string), '-', ''), '_mosaic.nc')
               WHEN 1 THEN concat('S3A_OL_1_EFR____', replace(cast(cast(o_orderdate AS date) AS string), '-', ''), 'T1350', cast(10 + o_orderkey % 50 AS string), '_', replace(cast(cast(o_orderdate AS date) AS string), '-', ''), 'T1353', cast(10 + o_orderkey % 50 AS string), '_', cast(o_custkey AS string), '.SEN3.zip')
               WHEN 2 THEN concat('nos.gomofs.2ds.n00', cast(1 + o_orderkey % 6 AS string), '.', replace(cast(cast(o_orderdate AS date) AS string), '-', ''), '.t12z.nc')
               WHEN 3 THEN concat('gomofs.t12z.', replace(cast(cast(o_orderdate AS date) AS string), '-', ''), '.2ds.n00', cast(1 + o_orderkey % 6 AS string), '.nc')
               WHEN 4 THEN concat('nos.gomofs.stations.nowcast.', cast(o_custkey AS string), '.t00z.nc')
               ELSE concat('/data/in/S3B_OL_1_EFR____', replace(cast(cast(o_orderdate AS date) AS string), '-', ''), 'T1450', cast(10 + o_orderkey % 50 AS string), '_', cast(o_custkey AS string), '.SEN3 ') END AS name""",
        ],
    ),
    # scene catalogue entries with a footprint
    "catalog": (
        "orders",
        [
            "o_orderkey AS scene_id",
            "concat(CASE WHEN o_orderkey % 5 = 0 THEN 'S3A_SL_1_RBT____' ELSE 'S3A_OL_1_EFR____' END, cast(o_orderkey AS string)) AS name",
            "o_orderdate AS start_time",
            "-80e0 + o_custkey % 25 AS west",
            "-78e0 + o_custkey % 25 AS east",
            "34e0 + o_orderkey % 13 AS south",
            "36e0 + o_orderkey % 13 AS north",
        ],
    ),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores, such as a test file with a single
    row group. Inputs with enough splits, as on a cluster, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = VIEWS[name]
    base = read(spark, sf_dir, table)
    return (spread(base) if table == "lineitem" else base).selectExpr(*exprs)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ocean-model fields: every grid cell on the model days of January 2024."""
    days = "explode(sequence(date '2024-01-01', date '2024-01-30', interval 1 day))"
    return (
        view(spark, sf_dir, "grid")
        .selectExpr("*", f"{days} AS model_date")
        .where("day(model_date) % 7 <> 3")
        .selectExpr(*_FIELDS)
    )


_FIELDS = [
    "model_date",
    "eta",
    "xi",
    "5e0 + p_retailprice / 1000e0 - day(model_date) / 10e0 AS temp_sur",
    "(p_size % 11 - 5) / 10e0 AS u_sur",
    "((p_size + day(model_date)) % 13 - 6) / 10e0 AS v_sur",
]


def with_views(*names: str) -> str:
    """`WITH fx_a AS (...), ...` for the oracles."""
    parts = []
    for name in names:
        if name == "fields":
            parts.append(
                "fx_fields AS (SELECT " + ", ".join(_FIELDS) + " FROM (SELECT " + ", ".join(VIEWS["grid"][1]) + " FROM part) "
                "CROSS JOIN (SELECT cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) AS date) AS model_date) "
                "WHERE day(model_date) % 7 <> 3)"
            )
        else:
            table, exprs = VIEWS[name]
            parts.append(f"fx_{name} AS (SELECT {', '.join(exprs)} FROM {table})")
    return "WITH " + ",\n".join(parts)
