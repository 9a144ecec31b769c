"""Spectral indices of one pixel, as Column arithmetic that stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redtide.constants import GRID_BANDS, INDEX_EPSILON

# band numbers in the order of the nine reflectance columns (fixed values)
BAND_NUMBERS = ["b02", "b04", "b06", "b08", "b09", "b10", "b11", "b12", "b17"]
# columns of each source that play the nine roles (fixed values)
SWATH_ROLES = dict(
    zip(
        BAND_NUMBERS,
        ["rrs_412", "rrs_490", "rrs_560", "rrs_665", "rrs_674", "rrs_682", "rrs_709", "rrs_754", "rrs_865"],
    )
)
GRID_ROLES = dict(zip(BAND_NUMBERS, GRID_BANDS))

# centre wavelengths in nm (fixed values)
NM = {"b02": 412.5, "b04": 490.0, "b06": 560.0, "b08": 665.0, "b09": 673.75, "b10": 681.25, "b11": 708.75, "b12": 753.75}


def _height(b: dict[str, Column], peak: str, left: str, right: str) -> Column:
    """Height of `peak` over the straight line from `left` to `right`."""
    fraction = (NM[peak] - NM[left]) / (NM[right] - NM[left])
    return b[peak] - (b[left] + (b[right] - b[left]) * fraction)


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den + INDEX_EPSILON)


def _normalized(b: dict[str, Column], p: str, q: str) -> Column:
    return F.try_divide(b[p] - b[q], b[p] + b[q] + INDEX_EPSILON)


def index_columns(b: dict[str, Column]) -> dict[str, Column]:
    """The 21 indices by name, from the nine reflectances keyed by band number."""
    flh_681 = _height(b, "b10", "b09", "b11")
    flh_665 = _height(b, "b08", "b09", "b11")
    flh_max = flh_681 - flh_665
    glh = _height(b, "b06", "b04", "b08")
    blh = _height(b, "b04", "b02", "b06")
    return {
        "FLH_681": flh_681,
        "FLH_665": flh_665,
        "FLHmax": flh_max,
        "GLH": glh,
        "BLH": blh,
        "MCI": _height(b, "b11", "b08", "b12"),
        "RBD": b["b10"] - b["b08"],
        "DINI": _ratio(flh_max, glh * b["b04"]),
        "EBI": flh_max * blh,
        "GBI": flh_681 * glh * 1e6,
        "KBBI": _normalized(b, "b10", "b08"),
        "NDNI": _normalized(b, "b11", "b04"),
        "NDCI": _normalized(b, "b11", "b08"),
        "NDWI": _normalized(b, "b06", "b17"),
        "RedEdge_Ratio": _ratio(b["b11"], b["b08"]),
        "CI": _ratio(b["b08"], b["b06"]),
        "BlueGreen_Ratio": _ratio(b["b04"], b["b06"]),
        "Green_Red_Ratio": _ratio(b["b06"], b["b08"]),
        "Blue_Red_Ratio": _ratio(b["b04"], b["b08"]),
        "Red_NIR_Ratio": _ratio(b["b08"], b["b12"]),
        "Fluorescence_Peak": b["b10"],
    }


def spectral_indices(df: DataFrame, roles: dict[str, str] = GRID_ROLES) -> DataFrame:
    """Append the 21 indices; `roles` maps band numbers to the columns of `df`."""
    return df.withColumns(index_columns({role: F.col(c) for role, c in roles.items()}))
