"""Draws are made once a position, whether its tiles or other tasks make them, in arrays of any size."""

import pytest

from redtide.operators import blocking


def test_all_ways_of_drawing_in_tiles_agree(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "cast(id % 6 AS double) AS x_m", "cast(id % 5 AS double) AS y_m", "cast(id * 37 % 101 AS double) AS v")
    ways = []
    for light, at_once in ((256, 1 << 15), (2, 1 << 15), (256, 7)):
        monkeypatch.setattr(blocking, "LIGHT_ROWS", light)
        monkeypatch.setattr(blocking, "DRAWN_AT_ONCE", at_once)
        ways.append([r.moran_i for r in blocking.moran_permutations(df, "id", "v", 1.5, 9).orderBy("perm").collect()])
    assert len(ways[0]) == 9
    assert ways[1] == pytest.approx(ways[0]) and ways[2] == pytest.approx(ways[0])
