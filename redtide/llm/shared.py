"""Small helpers shared by the training-text operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, at_once: int = 1 << 30) -> DataFrame:
    """`fn` turns an iterator of column lists into column lists; a list has the rows of an Arrow batch, or of each `at_once`
    rows of it."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        parts = (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once))
        for columns in fn([c.to_pylist() for c in p.columns] for p in parts):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without the six ASCII space characters, as UTF-8."""
    return text.encode().split() if text else []


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, math.ceil(rows / per_partition))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri or ":" in uri.split("/")[0] else uri


def open_for_write(uri: str):
    """A binary stream into the shared folder, whatever store it is in. Call inside a task."""
    path = local_path(uri)
    if path is not None:
        import os

        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(inner)


def open_for_read(uri: str):
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)
