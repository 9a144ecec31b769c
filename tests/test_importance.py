"""Permutation importance: trees and scores in tasks on a bounded matrix, by a distributed fit beyond."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from redtide.functions.hashing import portable_hash, portable_hashes
from redtide.operators import experiments, models
from redtide.plans import catalog
from redtide.session import written


def test_arrays_hash_as_columns_do(spark):
    ids = [0, 7, 2**31, 10**12 + 3]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    for k in (0, 19):
        assert [r.h for r in rows.select(portable_hash("id", k).alias("h")).collect()] == portable_hashes(np.array(ids), k).tolist()


def test_both_ways_tell_the_features_that_count(spark):
    rows = written(spark.range(600).selectExpr("id AS row_id", "cast(id % 11 AS double) AS x", "cast(id % 7 AS double) AS noise", "cast(id % 11 < 4 AS int) AS y"))
    found = []
    for local_bytes in (experiments.LOCAL_BYTES, 0):
        out = experiments.importance(rows, "row_id", F.col("row_id") % 5 == 0, ["x", "noise"], "y", trees=12, repeats=4, local_bytes=local_bytes)
        found.append({r.feature: (r.perm_mean, r.perm_std) for r in out.collect()})
    # both forests are right on every row, so equal donors give equal losses
    assert found[0] == {f: pytest.approx(v) for f, v in found[1].items()}
    assert found[0]["x"][0] > 0.3 and found[0]["noise"] == (0, 0)


def test_the_query_needs_no_distributed_fit(spark, sf, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("distributed fit of a small matrix")

    monkeypatch.setattr(models, "fit_forest", refuse)
    assert catalog.QUERIES["v23_permutation_importance"](spark, sf).count() == 6
