"""Whitening of embedding vectors by a weighted multiplicity covariance.

Entries become integers, x = floor(1024 * c) + 100000. Equal x vectors are grouped; the fit list weighs each distinct
vector by its count (`weights="counts"`) or by one (`"one"`). Sums are exact integers; the covariance is a product
of centred rows, weighted by the counts, summed over partitions; each distinct vector is whitened once and
joined back to its rows by its SHA-256.

Rows whose vector is null, empty, or holds null, NaN, infinite entries or ones of 2^52 and more are left out.
So are vectors that aren't of the usual length, which is the one most rows have (the greater one of a tie).
Repeated rows and rows with a null or repeated id each get their own result. A component without variance (its
eigenvalue below D * 1e-14 of the trace) has no unit covariance and is left out, so constant vectors, a
single row and an empty table give no row. Columns besides the id and the vector are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redtide.session import written

SCALE, SHIFT = 1024, 100000
MOST_ENTRY = 2.0**52
COMPONENTS = 8
#: A vector with more than this share of the rows is hot; there are fewer such vectors than its inverse.
HOT_SHARE = 1 / 1000
SALTS = 64


@dataclass
class Fit:
    """n vectors, their exact sums, eigenvectors as columns by falling eigenvalue, and the eigenvalues' shares."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, all lowest bytes first: the upper planes repeat, so blocks of rows compress well."""
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), -1, 8).transpose(0, 2, 1))
    return [row.tobytes() for row in planes]


def unpacked(keys: list[bytes], width: int) -> np.ndarray:
    planes = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 8, width)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(len(keys), width)


def whole_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v) of the rows with whole vectors."""
    entry = F.col("_v")
    whole = entry.isNotNull() & (F.size(entry) > 0)
    whole = whole & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST_ENTRY))
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    return df.select(F.col(f"`{id_col}`").alias("_id"), vector.alias("_v")).where(whole)


def usual_width(rows: DataFrame) -> int:
    """The vector length most rows have, 0 without rows."""
    top = rows.groupBy(F.size("_v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return top[0] if top else 0


def integer_rows(rows: DataFrame, width: int) -> DataFrame:
    """(_id, digest, key) of the vectors with `width` entries, as integers."""
    rows = rows.where(F.size("_v") == width)

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(-1, width)
            keys = packed(np.floor(SCALE * flat).astype(np.int64) + SHIFT)
            digests = [hashlib.sha256(k).digest() for k in keys]
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "digest", "key"])

    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "_id")
    return rows.mapInArrow(run, f"_id {kind}, digest binary, key binary")


def exact_sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Fit weight and per-dimension sums as whole numbers; one row a dimension and partition is shuffled."""

    def run(batches):
        n, sums = 0, [0] * width
        for batch in batches:
            x, weight = unpacked(batch.column(0).to_pylist(), width), batch.column(1).to_numpy()
            n += int(weight.sum())
            peak = int(np.abs(x).max(initial=0)) * int(weight.sum())
            part = x.T @ weight if peak < 2**62 else x.astype(object).T @ weight.astype(object)
            sums = [a + int(b) for a, b in zip(sums, part)]
        ks = pa.array(range(-1, width), pa.int32())
        values = pa.array([str(v) for v in (n, *sums)], pa.string())
        yield pa.RecordBatch.from_arrays([ks, values], names=["k", "v"])

    parts = distinct.select("key", "weight").mapInArrow(run, "k int, v string")
    found = {r.k: int(r.v) for r in parts.groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(width)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding: whole parts are taken away as integers."""
    low = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - low) - rest


def covariance(distinct: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """Weighted product of centred rows over n; partitions send one row a dimension, added up in two steps."""

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((width, width))
        for batch in batches:
            d = centred(unpacked(batch.column(0).to_pylist(), width), n, sums)
            total += (d * batch.column(1).to_numpy()[:, None]).T @ d
        salt = TaskContext.get().partitionId() % SALTS
        rows = pa.array([row.tobytes() for row in total], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([salt] * width, pa.int32()), rows], names=["i", "salt", "row"])

    def add(key, table):
        total = np.zeros(width)
        for row in table.column("row").to_pylist():
            total += np.frombuffer(row)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total.tobytes()], pa.binary())})

    parts = distinct.select("key", "weight").mapInArrow(run, "i int, salt int, row binary")
    some = parts.groupBy("i", "salt").applyInArrow(add, "i int, row binary")
    rows = some.groupBy("i").applyInArrow(add, "i int, row binary").collect()  # one row a dimension
    return np.array([np.frombuffer(r.row) for r in sorted(rows, key=lambda r: r.i)]) / n


def fit(distinct: DataFrame, width: int, components: int) -> Fit | None:
    n, sums = exact_sums(distinct, width) if width else (0, [])
    if not n:
        return None
    v = covariance(distinct, width, n, sums)
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(v))
    real = int((values > trace * width * 1e-14).sum()) if trace > 0 else 0
    k = min(components, real)
    return Fit(n, sums, vectors[:, :k], values[:k], values[:k] / trace) if k else None


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums of (n x - S)^2, exact: in 64 bits where a bound shows that they fit, else in Python's whole numbers."""
    low, rest = np.array([s // n for s in sums], object), np.array([s % n for s in sums], object)
    gap = x - low.astype(np.int64)
    peak = n * (int(np.abs(gap).max(initial=0)) + 1)
    if peak * peak * x.shape[1] < 2**62:
        d = gap * n - rest.astype(np.int64)
        return [int(v) for v in (d * d).sum(1)]
    d = gap.astype(object) * n - rest
    return [int(v) for v in (d * d).sum(1)]


def whitened_distinct(distinct: DataFrame, width: int, found: Fit) -> DataFrame:
    """(digest, count, weight, deviation, w): every distinct vector projected once."""
    n, sums, vectors, roots = found.n, found.sums, found.vectors, np.sqrt(found.values)

    def run(batches):
        for batch in batches:
            x = unpacked(batch.column("key").to_pylist(), width)
            w = centred(x, n, sums) @ vectors / roots
            offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            exact = pa.array([str(v) for v in deviations(x, n, sums)])
            columns = [batch.column("digest"), batch.column("count"), batch.column("weight"), exact, lists]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "count", "weight", "deviation", "w"])

    out = distinct.select("digest", "count", "weight", "key").mapInArrow(run, "digest binary, count bigint, weight bigint, deviation string, w array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, centred first."""
    w = [F.get("w", F.lit(i)) for i in range(k)]
    weight = F.col("weight")
    total, *means = whitened.agg(F.sum("weight"), *[F.sum(weight * c) for c in w]).first()
    means = [m / total for m in means]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [F.sum(weight * (w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) for i, j in pairs]
    found = whitened.agg(*products).first()
    return max(abs(v / total - (i == j)) for (i, j), v in zip(pairs, found))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) for every whole vector.

    Rows meet their distinct vector in an equi-join on its digest. Vectors with over a thousandth of all rows,
    fewer than a thousand by that definition, are joined by broadcast, so no task gets all copies of one.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"weights must be counts or one, not {weights!r}")
    rows = whole_rows(df, id_col, vector_col)
    width = usual_width(rows)
    rows = integer_rows(rows, width)
    grouped = rows.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("count"))
    weight = F.col("count") if weights == "counts" else F.lit(1).cast("bigint")
    distinct = written(grouped.withColumn("weight", weight))
    found = fit(distinct, width, components)
    if found is None:
        return _result(rows.limit(0).select("_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array(F.lit(0.0)).alias("w")), id_col, 0, [], 0.0)
    whitened = written(whitened_distinct(distinct, width, found))
    error = identity_error(whitened, len(found.values))
    total = whitened.agg(F.sum("count")).first()[0]
    hot = F.col("count") > F.lit(total) * HOT_SHARE
    sides = whitened.select("digest", "deviation", "w", hot.alias("hot"))
    slim = written(rows.select("_id", "digest"))
    # broadcast sides: fewer than 1 / HOT_SHARE vectors of `components` numbers
    often = sides.where("hot").drop("hot")
    near = slim.join(F.broadcast(often), "digest")
    rest = slim.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(sides.where("not hot").drop("hot").hint("shuffle_merge"), "digest")
    return _result(near.unionByName(rest), id_col, found.n, [float(e) for e in found.explained], error)


def _result(rows: DataFrame, id_col: str, n: int, explained: list[float], error: float) -> DataFrame:
    share: Column = F.get(F.array(*[F.lit(e) for e in explained or [0.0]]), F.col("component") - 1)
    numbered = rows.select("_id", "deviation", F.posexplode("w").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    return numbered.select(
        F.col("_id").alias(id_col),
        "component",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
