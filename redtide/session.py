"""Session builder with the settings the transforms rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "redtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings passed in `conf` win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session.

    Where the session names none, a temporary folder is made if all executors run in this process
    (tests); on a cluster that is an error. Tables in the folder belong to the session's run;
    `clear_shared_folder` empties it when their results have been written elsewhere.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="redtide-"))
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether executors run inside the driver (local-cluster has processes of its own)."""
    return master == "local" or master.startswith("local[")


def clear_shared_folder(spark: SparkSession) -> None:
    """Delete the tables this session has written to its shared folder. Nothing that still reads them may
    run afterwards."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df):
    """Cut lineage with a written copy in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df):
    """A parquet copy in the shared folder, read back: lineage is cut and later steps read only
    the columns they need. For an intermediate result that several steps use."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
