"""Spectral indices and pixel masks (X1 to X9); a missing or non-finite input gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_ratio(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a, b))


def normalized_diff(a: Column, b: Column) -> Column:
    return safe_ratio(a - b, a + b)


def bsi(b2: Column, b4: Column, b8: Column, b11: Column) -> Column:
    return normalized_diff(b11 + b4, b8 + b2)


def all_indices(pixels: DataFrame) -> DataFrame:
    """Every index whose bands are there."""
    c = {x: F.col(x) for x in pixels.columns}
    made = {
        "ndvi": normalized_diff(c["b8"], c["b4"]),
        "ndwi": normalized_diff(c["b3"], c["b8"]),
        "mndwi": normalized_diff(c["b3"], c["b11"]),
        "ndmi": normalized_diff(c["b8"], c["b11"]),
        "bsi": bsi(c["b2"], c["b4"], c["b8"], c["b11"]),
        "msi": safe_ratio(c["b11"], c["b8"]),
    }
    if {"b5", "b7", "b8a"} <= set(c):
        made |= {"ndre": normalized_diff(c["b8a"], c["b5"]), "cire": safe_ratio(c["b8a"], c["b5"]) - 1, "re_slope": normalized_diff(c["b7"], c["b5"])}
    return pixels.withColumns(made)


def valid_pixel(scl: Column) -> Column:
    return scl.isin(4, 5, 6)


def cloud_pixel(scl: Column) -> Column:
    return scl.isin(3, 8, 9, 10)


def radar_db(x: Column) -> Column:
    return 10 * F.log10(x + 1e-10)


def radar_ratio(vh: Column, vv: Column) -> Column:
    return vh / (vv + 1e-6)


def scene_score(cloud_percent: Column, ndvi: Column) -> Column:
    return (1 - cloud_percent / 100) * 0.7 + F.least(ndvi, F.lit(1.0)) * 0.3
