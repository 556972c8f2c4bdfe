"""Ring geometry as array expressions (G1, G2, G5): a ring is an array of structs x, y, not closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_ring(minx: str, miny: str, maxx: str, maxy: str) -> Column:
    corners = ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy))
    return F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners))


def _edges(ring: Column) -> Column:
    """Structs of each corner and the next one."""
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _origin(ring: Column) -> Column:
    """The ring moved to its first corner, which keeps the sums exact far from the origin."""
    return F.transform(ring, lambda p: F.struct((p["x"] - ring[0]["x"]).alias("x"), (p["y"] - ring[0]["y"]).alias("y")))


def ring_area(ring: Column) -> Column:
    return F.abs(_total(F.transform(_edges(_origin(ring)), _cross))) / 2


def ring_perimeter(ring: Column) -> Column:
    return _total(F.transform(_edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def ring_centroid(ring: Column) -> Column:
    near = _edges(_origin(ring))
    double = _total(F.transform(near, _cross))

    def moment(k: str) -> Column:
        return _total(F.transform(near, lambda e: (e["a"][k] + e["b"][k]) * _cross(e)))

    x, y = moment("x"), moment("y")
    return F.struct((ring[0]["x"] + F.try_divide(x, 3 * double)).alias("x"), (ring[0]["y"] + F.try_divide(y, 3 * double)).alias("y"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: an odd number of edges crossed to the right."""

    def crossed(e):
        spans = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = e["a"]["x"] + F.try_divide((y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]), e["b"]["y"] - e["a"]["y"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(_edges(ring), crossed), F.lit(0), lambda s, k: s + k) % 2 == 1
