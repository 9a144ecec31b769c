"""Small scalar expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN and infinities become NULL; aggregates would otherwise rank NaN highest."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def season(date: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of year; the period is 365 days in leap years too."""
    angle = 2 * math.pi * F.dayofyear(date) / 365
    return F.sin(angle), F.cos(angle)


def log_cells(c: Column) -> Column:
    return F.log10(c + 1)


def cells_from_log(c: Column) -> Column:
    return F.pow(F.lit(10.0), c) - 1


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def flow_vectors(df: DataFrame, prefix: str = "roms_") -> DataFrame:
    """Speed and direction of the surface current and the wind, for the pairs `df` has.

    Null unless both components are there (hypot and atan2 propagate nulls).
    """
    added = {}
    for name, u, v in (("current", "u_sur", "v_sur"), ("wind", "Uwind", "Vwind")):
        if {prefix + u, prefix + v} <= set(df.columns):
            pu, pv = nan_to_null(F.col(prefix + u)), nan_to_null(F.col(prefix + v))
            added[f"{prefix}{name}_speed"] = F.hypot(pu, pv)
            added[f"{prefix}{name}_dir"] = F.degrees(F.atan2(pv, pu))
    return df.withColumns(added)


def effect_label(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.1, "negligible").when(size < 0.3, "small").when(size < 0.5, "medium").otherwise("large")


def normal_two_sided_p(z: Column) -> Column:
    """2 * P(Z > z) for z >= 0, i.e. erfc(z / sqrt 2), to about 1e-15.

    Trapezoidal sum for erfc with its pole correction (Chiarella and Reichel, 1968); a short
    Taylor series below 0.01, where the two large terms of that sum would cancel.
    """
    x = z / math.sqrt(2)
    step = 0.5
    total = 1 / (x * x)
    for n in range(1, 14):
        total = total + 2 * math.exp(-((n * step) ** 2)) / (x * x + (n * step) ** 2)
    far = step * x * F.exp(-x * x) / math.pi * total
    pole = F.when(x < math.pi / step, 2 / (1 - F.exp(2 * math.pi * x / step))).otherwise(0.0)
    near = 1 - 2 / math.sqrt(math.pi) * (x - x * x * x / 3 + x * x * x * x * x / 10)
    return F.when(x < 0.01, near).otherwise(far + pole)
