"""Preparation of the evaluation frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from redtide.plans import pipelines


@pytest.fixture(scope="module")
def composite(spark):
    day = dt.date(2024, 1, 10)
    rows = []
    for i in range(24):
        lat, lon = (41.0 + i * 1e-3, -70.0) if i < 18 else (43.5, -66.5)
        station = "elsewhere" if i == 0 else "mvco" if i < 18 else "gom"
        # C and A are always there, B is missing in two rows; one model value has a gap
        rows.append((i, station, lat, lon, day, i % 2, 0.1 * i, 0.2, None if i in (3, 4) else 0.3, None if i == 6 else float(i)))
    return spark.createDataFrame(
        rows,
        "id int, dashboardIdName string, latitude double, longitude double, obs_date date, delta_days int, C_rrs_2 double, "
        "A_rrs_412 double, B_rrs_412 double, roms_temp_sur double",
    ).withColumns({"location_id": F.lit("x"), "Karenia": F.col("id") * 100.0})


def test_random_frames(composite):
    only, hybrid, tracks = pipelines.evaluation_frames(composite)
    # same day, common rows only: even ids without 4
    assert sorted(r["id"] for r in only.collect()) == [i for i in range(0, 24, 2) if i != 4]
    assert tracks["C2RCC_only"] == ["C_rrs_412", "doy_sin", "doy_cos"]
    assert tracks["C2RCC_roms"] == ["C_rrs_412", "doy_sin", "doy_cos", "roms_temp_sur"]
    filled = {r["id"]: r["roms_temp_sur"] for r in hybrid.collect()}
    known = sorted(v for i, v in filled.items() if i != 6)
    assert filled[6] == (known[4] + known[5]) / 2


def test_spatial_frames_drop_sparse_blocks_before_common_rows(composite):
    block = lambda rows: pipelines.spatial_blocks(rows, ["mvco", "gom"], ["Karenia"], 10_000.0, min_obs=4)
    only, _, _ = pipelines.evaluation_frames(composite, spatial_block=block)
    got = {r["id"]: r for r in only.collect()}
    # the three far rows form a block of their own that is too small; id 0 is out of scope
    assert sorted(got) == [2, 6, 8, 10, 12, 14, 16]
    assert all(r["block_id"].count("_") == 1 for r in got.values())
    assert got[10]["bloom_index"] == pytest.approx(3.0004340774793186)
