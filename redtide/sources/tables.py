"""Readers and writers of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def union_yearly(*frames: DataFrame) -> DataFrame:
    """All rows of all years; a column missing in a year is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_yearly(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def gathered(df: DataFrame, part_col: str) -> DataFrame:
    """Rows of a partition value together, for few output files; adaptive execution splits a
    value that has very many rows over several tasks."""
    return df.hint("rebalance", part_col)


def write_partition_once(df: DataFrame, path: str, part_col: str) -> None:
    """Append only partitions that are not there yet; finished ones are left alone.

    One reader of the existing partition values, then an anti join, so a rerun after a loss
    writes what is missing.
    """
    try:
        done = df.sparkSession.read.parquet(path).select(part_col).distinct()
    except AnalysisException:
        done = None
    todo = df if done is None else df.join(done, part_col, "left_anti")
    gathered(todo, part_col).write.mode("append").partitionBy(part_col).parquet(path)


def append_checkpoint(df: DataFrame, path: str, part_col: str) -> None:
    """Replace the partitions `df` has and leave the others: a rerun of a date does not double it."""
    out = gathered(df, part_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(part_col).parquet(path)


def rounded_floats(df: DataFrame, dp: int = 5) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), dp) for c in floats})


def write_csv_rounded(df: DataFrame, path: str, order: list = (), dp: int = 5) -> None:
    """Sorted result table with floats rounded. The sort is a range partitioning, so the part
    files follow each other in order; no single task writes the whole table."""
    out = df.orderBy(*order) if order else df
    rounded_floats(out, dp).write.mode("overwrite").csv(path, header=True)
