"""Rows exploded into folds are never the side that is broadcast, however small the table looks."""

import re

from pyspark.sql import functions as F

from redtide.operators import splits
from redtide.session import written


def broadcast_sides(df) -> list[str]:
    """The plan below each broadcast."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:+-]*", line)[0])
    sides = []
    for i, line in enumerate(lines):
        if found := re.search(r"BroadcastHashJoin .*Build(Left|Right)", line):
            children = [j for j in range(i + 1, len(lines)) if depth(lines[j]) == depth(line) + 3][:2]
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            sides.append("\n".join(lines[children[0] : children[1]] if found[1] == "Left" else lines[children[1] : end]))
    return sides


def test_bounds_of_folds_are_looked_up_by_broadcasting_buckets(spark):
    rows = written(spark.range(500).select(F.col("id").alias("row_id")))
    sides = broadcast_sides(splits.shuffle_cuts(rows, "row_id", 50))
    assert len(sides) == 2
    assert all("Generate" not in side or "HashAggregate" in side for side in sides)


def test_offsets_of_folds_are_broadcast_and_rows_are_not(spark):
    rows = written(spark.range(500).select(F.col("id").alias("row_id")))
    found = splits.split_ordinal(rows, "row_id", 3)
    sides = broadcast_sides(found)
    assert len(sides) == 1 and "HashAggregate" in sides[0]
    assert sorted(r.ordinal for r in found.where("fold = 2").collect()) == list(range(1, 501))
    one = splits.kfold(rows, "row_id", 10)
    assert all("HashAggregate" in side for side in broadcast_sides(one))


def test_ids_are_ordered_in_arrays_as_rows_are(spark, monkeypatch):
    """Many small buckets and blocks, repeated ids, and null ones, which have no position; only packed ids are shuffled."""
    ids = [(i * 7919 % 4001,) for i in range(3000)] + [(5,), (5,), (None,)]
    rows = written(spark.createDataFrame(ids, "row_id bigint").repartition(3))
    want = splits.split_ordinal(rows.where("row_id is not null").withColumn("other", F.lit(1)), "row_id", 4).drop("other")
    monkeypatch.setattr(splits, "BUCKET_ROWS", 100)
    monkeypatch.setattr(splits, "DEALT_ROWS", 700)
    got = splits.split_ordinal(rows, "row_id", 4)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    text = got._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in text and "FlatMapGroupsInArrow" in text
