"""Registered queries against DuckDB, and the shape of their plans.

A representative part runs by default; REDTIDE_ALL_QUERIES=1 runs every query with an oracle.
"""

import importlib.util
import os
import pathlib

import pytest

import __spark_entry__ as entry
from redtide.operators import joins
from redtide.plans import queries_ocean
from redtide.plans.fixtures import fields, read, view
from redtide.plans.queries_matchup import candidates, daily

ROOT = pathlib.Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

SOME = """a1_flatten_counts a10_index_files a13_pending_work b2_polygon_filter b4_station_override b20_utm_projection
d3_composite d6_nearest_cell d14_merge_sparse_blocks e1_daily_p95 e5_grid_matchup e5_swath_matchup e8_patch_matchup
e9_scene_cloud_fraction e14_impute_median e25_box_stats v1_shuffle_split v3_group_kfold v5_strat_label
v8_quadtree_adaptive v9_quadtree_random v11_moran_sweep v19_average_precision v20_mean_pr_curve v20_pr_curve_table v24_mann_whitney
v25_mann_whitney_pairs x_spectral_indices a8_csv_sink a10_unrecognised_names b6_location_id b17_location_exclusion
d1_metadata_join e11_composite_summary e16_macro_stats e21_lag_counts e24_gate_failures e26_target_stats v1_usable_folds""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("REDTIDE_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_oracle(spark, sf, con, name):
    problem, rows = check.compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])
    assert problem is None
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_space_and_time_joins_are_equi_joins(spark, sf):
    obs = daily(spark, sf)
    points = read(spark, sf, "part").selectExpr("p_partkey AS id", "p_retailprice AS x_m", "cast(p_size AS double) AS y_m")
    built = [
        candidates(spark, sf),
        joins.window_join(obs, view(spark, sf, "pixels").select("scene_date").distinct()),
        queries_ocean.placed(spark, sf),
        joins.lag_join(queries_ocean.placed(spark, sf), fields(spark, sf)),
        joins.resample_nearest(
            obs.select("location_id", "latitude", "longitude"), queries_ocean.swath(spark, sf), ["scene_no"], ["b02"], on=()
        ),
        joins.distance_pairs(points, 10.0),
    ]
    for df in built:
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_pixels_are_shuffled_before_they_become_offers(spark, sf):
    sites = daily(spark, sf).select("location_id", "latitude", "longitude")
    df = joins.resample_nearest(sites, queries_ocean.swath(spark, sf), ["scene_date", "scene_no"], ["b02"], on=())
    shuffles = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any(" row#" in line or "(row#" in line for line in shuffles)


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(entry.queries()["a5_parquet_scan"](spark, sf))
    assert "GreaterThan(value,100.0)" in text and "props" not in text
    text = plan(entry.queries()["b5_year_filter"](spark, sf))
    assert "PushedFilters" in text and "GreaterThanOrEqual(o_orderdate" in text
