"""Where query modules leave their queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL an independent engine should agree with."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def r(c: Column | str, dp: int = 6) -> Column:
    """Rounded for comparison, at the very end of a query."""
    return F.round(F.col(c) if isinstance(c, str) else c, dp)


# ratios are of order one; everything else spectral is of order 1e-3
RATIOS = {"DINI", "KBBI", "NDNI", "NDCI", "NDWI", "RedEdge_Ratio", "CI", "BlueGreen_Ratio"} | {
    "Green_Red_Ratio",
    "Blue_Red_Ratio",
    "Red_NIR_Ratio",
}


def digits(column: str) -> int:
    return 4 if column == "DINI" else 11 if column == "GBI" else 17 if column == "EBI" else 7 if column in RATIOS else 12


def rounded(df: DataFrame, columns: list[str], dp: int | None = 6) -> DataFrame:
    """Round the columns. `dp=None` picks the digits that suit a spectral column and rounds by
    plain arithmetic, which is much cheaper for wide tables than decimal rounding."""
    if dp is not None:
        return df.withColumns({c: F.round(F.col(f"`{c}`"), dp) for c in columns})
    scale = lambda c: 10.0 ** digits(c)
    return df.withColumns({c: F.floor(F.col(f"`{c}`") * scale(c) + 0.5) / scale(c) for c in columns})


def sql_rounded(columns: list[str], dp: int | None = 6) -> str:
    if dp is not None:
        return ", ".join(f"round({c}, {dp}) AS {c}" for c in columns)
    return ", ".join(f"floor({c} * 1e{digits(c)} + 0.5e0) / 1e{digits(c)} AS {c}" for c in columns)
