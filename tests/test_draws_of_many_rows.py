"""Draws of tables beyond eight million rows stay in tiles, and lists of seats are drawn for together."""

import numpy as np

from redtide.operators import blocking


def test_arrays_are_drawn_in_numbers_of_32_bits_up_to_their_top():
    for n in (36_000_000, (1 << 31) - 1, 1 << 31):
        seats = np.concatenate([np.arange(5), np.arange(n - 5, n)])
        drawn = blocking.drawn_seat(seats[None, :], np.arange(1, 401)[:, None], n)
        assert drawn.dtype == np.int64 and drawn.min() >= 0 and drawn.max() < n
        assert all(len(set(row)) == len(seats) for row in drawn.tolist())
        assert abs(drawn.mean() / n - 0.5) < 0.03
        assert (drawn[7] == blocking.drawn_seat(seats, np.int64(8), n)).all()


def test_tables_of_six_gigabytes_are_not_listed_draw_by_draw():
    """36 million rows a table of that size, 999 draws: a row for each would be 36 billion."""
    assert blocking.DRAWN_ROWS >= 36_000_000


def test_lists_drawn_for_together_give_the_sums_of_each(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "cast(id % 6 AS double) AS x_m", "cast(id % 5 AS double) AS y_m", "cast(id * 37 % 101 AS double) AS v")
    monkeypatch.setattr(blocking, "LIGHT_ROWS", 2)
    ways = []
    for seats, at_once in ((4096, 1 << 15), (4, 9), (4, 1)):
        monkeypatch.setattr(blocking, "SEATS", seats)
        monkeypatch.setattr(blocking, "DRAWN_AT_ONCE", at_once)
        ways.append([r.moran_i for r in blocking.moran_permutations(df, "id", "v", 1.5, 6).orderBy("perm").collect()])
    assert len(ways[0]) == 6 and np.allclose(ways[1], ways[0]) and np.allclose(ways[2], ways[0])
