"""Readers, writers and file lists."""

import pytest
from pyspark.sql import functions as F

from redtide.sources import counts, manifests, tables


def test_bin_metadata_csv(spark, tmp_path):
    path = tmp_path / "bins.csv"
    path.write_text("PID , Sample_Time,Latitude,longitude,depth,skip,Other\nb1,2020-01-01,41.5,-70,3,0,x\nb2,2020-01-02,n/a,-70,,1,y\nb3,2020-01-03,n/a,-70,,,z\n")
    out = counts.scan_bin_metadata(spark, str(path)).orderBy("pid")
    assert out.columns == ["pid", "sample_time", "latitude", "longitude", "depth"]
    assert [(r["pid"], r["latitude"], r["depth"]) for r in out.collect()] == [("b1", 41.5, 3.0), ("b3", None, None)]


def test_counts_from_json(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(
        '{"properties":{"timeseriesData":[{"species":"s","data":[{"binPid":"b1","sampleTime":"t","latitude":1.0,"longitude":2.0,'
        '"metrics":[{"metricId":"cell_concentration","value":5.0},{"metricId":"cell_concentration","value":6.0},{"metricId":"other","value":7.0}]},'
        '{"binPid":"b2","sampleTime":"t","latitude":9.0,"longitude":2.0,"metrics":[]}]}]}}'
    )
    long = counts.flatten_counts(spark.read.schema(counts.COUNTS_SCHEMA).json(str(path)))
    got = {r["bin_pid"]: (r["species"], r["concentration"], r["latitude"]) for r in long.collect()}
    assert got == {"b1": ("s", 6.0, 1.0), "b2": (None, None, 9.0)}
    wide = {r["bin_pid"]: r["s"] for r in counts.counts_wide(long, [], ["s"]).collect()}
    assert wide == {"b1": 6.0, "b2": None}


def test_partitions_are_written_once(spark, tmp_path):
    path = str(tmp_path / "years")
    df = spark.createDataFrame([(2020, 1), (2021, 2)], "year int, v int")
    tables.write_partition_once(df.where("year = 2020"), path, "year")
    tables.write_partition_once(df.withColumn("v", F.col("v") * 10), path, "year")
    assert sorted((r["year"], r["v"]) for r in spark.read.parquet(path).collect()) == [(2020, 1), (2021, 20)]
    tables.append_checkpoint(df.where("year = 2021"), path, "year")
    assert sorted((r["year"], r["v"]) for r in spark.read.parquet(path).collect()) == [(2020, 1), (2021, 2)]


def test_csv_is_sorted_and_rounded(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.1234567), ("a", 2.0)], "k string, v double")
    tables.write_csv_rounded(df, str(tmp_path / "out"), ["k"])
    lines = [ln for p in sorted((tmp_path / "out").glob("part-*")) for ln in p.read_text().splitlines()]
    assert [ln for ln in lines if ln != "k,v"] == ["a,2.0", "b,0.12346"]


def test_scene_ids(spark):
    full = "S3A_OL_1_EFR____20170101T150049_20170101T150349_20180612T1_0179"
    lines = spark.createDataFrame([(f" /in/{full}.SEN3.zip ",), (f"{full}.SEN3",), ("# note",), ("",), ("odd_name",)], "line string")
    got = {r["scene"]: r for r in manifests.normalize_scene_list(lines).collect()}
    assert set(got) == {full, "odd_name"}
    assert got[full]["short_id"] == "S3A_OL_1_EFR____20170101T150049"
    assert (got[full]["satellite"], got[full]["sensing_time"]) == ("S3A", "20170101T150049")
    assert got["odd_name"]["short_id"] == "odd_name"
    done = spark.createDataFrame([("S3A_OL_1_EFR____20170101T150049",)], "scene string")
    every = spark.createDataFrame([(full,), ("odd_name",)], "scene string")
    assert [r["scene"] for r in manifests.pending_work(every, every, done).collect()] == ["odd_name"]


def test_model_names_of_both_formats(spark):
    names = ["nos.gomofs.2ds.n001.20200620.t12z.nc", "gomofs.t12z.20240911.2ds.n001.nc", "gomofs.t12z.2024.2ds.n001.nc", "other.nc"]
    df = manifests.index_files(spark.createDataFrame([(n,) for n in names], "name string"), "model")
    got = {r["name"]: (r["date_str"], r["product"], r["fhour"], r["cycle"], r["format"]) for r in df.collect()}
    assert got[names[0]] == ("20200620", "2ds", "n001", "t12z", "A")
    assert got[names[1]] == ("20240911", "2ds", "n001", "t12z", "B")
    assert got[names[2]][0] is None and got[names[3]][0] is None


def test_a_cluster_without_a_shared_folder_is_refused():
    from redtide import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]")
