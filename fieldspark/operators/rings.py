"""Shapes as ring tables (S10, G1 to G3, G5): one row for each ring of each part, so that parts and holes count.

``keys, part, ring_no, hole, ring``: a part's ring 0 is its outer one, further
rings are holes; ``ring`` is an array of structs x, y, closed or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo

#: Radius of spherical mercator in metres.
RADIUS = 6378137.0


def parsed(rows: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """Rings of GeoJSON texts of type Polygon or MultiPolygon; other texts have none, nor do rings of under three corners."""
    shape = F.from_json(geometry, "type string, coordinates string")
    one = F.from_json(shape["coordinates"], "array<array<array<double>>>")
    parts = F.when(shape["type"] == "Polygon", F.array(one)).when(shape["type"] == "MultiPolygon", F.from_json(shape["coordinates"], "array<array<array<array<double>>>>"))
    by_part = rows.select(*keys, F.posexplode(parts).alias("part", "_rings"))
    by_ring = by_part.select(*keys, "part", F.posexplode("_rings").alias("ring_no", "_points"))
    points = F.transform("_points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return by_ring.select(*keys, "part", "ring_no", (F.col("ring_no") > 0).alias("hole"), _open(points).alias("ring")).where(F.size("ring") >= 3)


def _open(ring: Column) -> Column:
    """A ring without its first corner repeated at the end."""
    return F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def mercator(ring: Column) -> Column:
    """Degrees to metres."""
    return F.transform(ring, lambda p: F.struct((F.radians(p["x"]) * RADIUS).alias("x"), (F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(p["y"]) / 2)) * RADIUS).alias("y")))


def measures(rings: DataFrame, keys: list[str]) -> DataFrame:
    """G1: ``keys, parts, holes, area, perimeter, cx, cy``: holes are taken from the area and count in the perimeter."""
    ring = _open(F.col("ring"))
    sign = F.when(F.col("hole"), -1.0).otherwise(1.0)
    each = rings.select(*keys, "part", "hole", (sign * geo.ring_area(ring)).alias("_area"), geo.ring_perimeter(ring).alias("_length"), geo.ring_centroid(ring).alias("_c"))
    sums = each.groupBy(*keys).agg(
        F.count_distinct("part").alias("parts"), F.count_if("hole").alias("holes"), F.sum("_area").alias("area"), F.sum("_length").alias("perimeter"),
        *(F.sum(F.col(f"_c.{k}") * F.col("_area")).alias(f"_m{k}") for k in "xy"),
    )
    return sums.select(*keys, "parts", "holes", "area", "perimeter", *(F.try_divide(f"_m{k}", "area").alias(f"c{k}") for k in "xy"))


def bounds(rings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, minx, miny, maxx, maxy``; with no keys, of the whole set."""
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    each = rings.select(*keys, F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy"))
    return each.groupBy(*keys).agg(*(f(f"{n}{k}").alias(f"{n}{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xy"))


def without_slivers(rings: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Parts whose area, holes taken off, is under ``least`` go with their holes, and so do holes under it."""
    sized = rings.withColumn("_area", geo.ring_area(_open(F.col("ring"))))
    parts = sized.groupBy(*keys, "part").agg(F.sum(F.when(F.col("hole"), -F.col("_area")).otherwise(F.col("_area"))).alias("_net")).where(F.col("_net") >= least)
    return sized.join(parts.drop("_net"), [*keys, "part"], "left_semi").where(~F.col("hole") | (F.col("_area") >= least)).select(*rings.columns)


def containing(points: DataFrame, rings: DataFrame, keys: list[str], size: float = 0.01) -> DataFrame:
    """Points ``x, y`` with the keys of each shape that holds them: an odd number of its rings does.

    Points meet rings only in the grid square that they share.
    """
    boxed = bounds(rings, [*keys, "part", "ring_no"]).join(rings, [*keys, "part", "ring_no"])
    for k in "xy":
        boxed = boxed.withColumn(f"_g{k}", F.explode(F.sequence(F.floor(F.col(f"min{k}") / size), F.floor(F.col(f"max{k}") / size))))
    named = [F.col(k).alias(f"_{k}") for k in keys]
    dealt = boxed.select(*named, F.col("ring").alias("_ring"), "_gx", "_gy", *(F.col(f"{n}{k}").alias(f"_{n}{k}") for n in ("min", "max") for k in "xy"))
    asked = points.withColumn("_gx", F.floor(F.col("x") / size)).withColumn("_gy", F.floor(F.col("y") / size))
    met = asked.join(dealt, ["_gx", "_gy"]).where("x between _minx and _maxx and y between _miny and _maxy")
    inside = met.where(geo.in_ring(F.col("x"), F.col("y"), F.col("_ring")))
    return inside.groupBy(*points.columns, *(f"_{k}" for k in keys)).agg(F.count("*").alias("_n")).where("_n % 2 = 1").select(*points.columns, *(F.col(f"_{k}").alias(k) for k in keys))
