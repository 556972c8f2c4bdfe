"""Neighbourhood operators on pixel tables (F); windows shrink at tile borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _rows():
    return Window.partitionBy("tile_id", "r").orderBy("c")


def _cols():
    return Window.partitionBy("tile_id", "c").orderBy("r")


def box_mean(df: DataFrame, value: str, name: str, radius: int = 2) -> DataFrame:
    """mean over a square, as sums along rows, then down columns; missing pixels don't count."""
    key = ["tile_id", "r", "c"]
    # sums along rows at every place near a pixel, so that no missing pixel hides its row from the sums down
    spread = df.select("tile_id", "r", F.explode(F.sequence(F.col("c") - radius, F.col("c") + radius)).alias("c"), F.col(value).alias("_v"))
    sums = spread.groupBy(*key).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    down = _cols().rangeBetween(-radius, radius)
    made = sums.select(*key, F.try_divide(F.sum("_s").over(down), F.sum("_n").over(down)).alias(name))
    return df.join(made, key, "left")


def class_fractions(df: DataFrame, label: str, classes: dict[str, list[int]], radius: int = 2) -> DataFrame:
    """F1 for each land-cover class."""
    for name, members in classes.items():
        df = box_mean(df.withColumn("_m", F.col(label).isin(members).cast("double")), "_m", name, radius).drop("_m")
    return df


def lee(df: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """speckle filter from local mean and variance; noise is the mean local variance of the tile."""
    both = box_mean(df, value, "_m", radius)
    both = box_mean(both.withColumn("_sq", F.col(value) * F.col(value)), "_sq", "_mm", radius)
    both = both.withColumn("_var", F.greatest(F.col("_mm") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    noise = both.groupBy("tile_id").agg(F.avg("_var").alias("_noise"))
    weight = F.coalesce(F.try_divide(F.col("_var"), F.col("_var") + F.col("_noise")), F.lit(0.0))
    return both.join(noise, "tile_id").withColumn("filtered", F.col("_m") + weight * (F.col(value) - F.col("_m"))).drop("_m", "_sq", "_mm", "_var", "_noise")


def shifted(value: str | Column, w, axis: str, step: int) -> Column:
    """The value step pixels on along an axis, null where that pixel is missing."""
    return F.when(F.lag(axis, -step).over(w) == F.col(axis) + step, F.lag(value, -step).over(w))


def gradient(df: DataFrame, value: str) -> DataFrame:
    """Scharr magnitude over the tile's maximum; a missing neighbour takes the pixel's own value."""
    own = F.col(value)

    def near(column, w, axis, step):
        return F.coalesce(shifted(column, w, axis, step), F.col(column))

    sides = df.withColumn("_dx", near(value, _rows(), "c", 1) - near(value, _rows(), "c", -1)).withColumn("_sx", 3 * near(value, _rows(), "c", 1) + 10 * own + 3 * near(value, _rows(), "c", -1))
    sides = sides.withColumn("_gx", 3 * near("_dx", _cols(), "r", 1) + 10 * F.col("_dx") + 3 * near("_dx", _cols(), "r", -1)).withColumn("_gy", near("_sx", _cols(), "r", 1) - near("_sx", _cols(), "r", -1))
    sides = sides.withColumn("_g", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))
    top = sides.groupBy("tile_id").agg(F.max("_g").alias("_top"))
    return sides.join(top, "tile_id").withColumn("edge", F.coalesce(F.try_divide("_g", "_top"), F.lit(0.0))).drop("_dx", "_sx", "_gx", "_gy", "_g", "_top")


def dilate(df: DataFrame, mask: str, steps: int = 1, erode: bool = False) -> DataFrame:
    """grow (or shrink) a boolean mask by cross steps; pixels outside the tile count as unset for erosion too."""
    for _ in range(steps):
        near = [F.coalesce(shifted(mask, w, axis, s), F.lit(False)) for w, axis in ((_rows(), "c"), (_cols(), "r")) for s in (1, -1)]
        whole = F.col(mask)
        for n in near:
            whole = (whole & n) if erode else (whole | n)
        df = df.withColumn(mask, whole)
    return df


def adjacency(df: DataFrame, label: str, strength: str) -> DataFrame:
    """pairs of labels that touch, their shared boundary and its mean strength."""
    pairs = None
    for w, axis in ((_rows(), "c"), (_cols(), "r")):
        side = df.withColumn("_o", shifted(label, w, axis, 1)).withColumn("_os", shifted(strength, w, axis, 1)).where((F.col("_o") != F.col(label)) & (F.col("_o") > 0) & (F.col(label) > 0))
        part = side.select("tile_id", F.least(label, "_o").alias("a"), F.greatest(label, "_o").alias("b"), ((F.col(strength) + F.col("_os")) / 2).alias("s"))
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs.groupBy("tile_id", "a", "b").agg(F.count("*").alias("shared"), F.avg("s").alias("strength"))


def weighted_composite(layers: DataFrame, coverage: DataFrame, value: str, least: float = 0.3) -> DataFrame:
    """mean of a per-date layer weighed by each date's coverage, clipped at its tile's 95th percentile."""
    both = layers.join(coverage.where(F.col("coverage") >= least), ["tile_id", "t"])
    made = both.groupBy("tile_id", "r", "c").agg((F.sum(F.col(value) * F.col("coverage")) / F.sum("coverage")).alias("v"))
    top = made.groupBy("tile_id").agg(F.percentile("v", F.lit(0.95)).alias("_p"))
    return made.join(top, "tile_id").select("tile_id", "r", "c", F.coalesce(F.least(F.try_divide("v", "_p"), F.lit(1.0)), F.lit(0.0)).alias("value"))


def stretch(df: DataFrame, value: str) -> DataFrame:
    """5th to 95th percentile of the tile onto 0..1; flat tiles give 0."""
    cut = df.groupBy("tile_id").agg(F.percentile(value, F.lit(0.05)).alias("_a"), F.percentile(value, F.lit(0.95)).alias("_b"))
    made = F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"))
    return df.join(cut, "tile_id").withColumn("stretched", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), made)), F.lit(0.0))).drop("_a", "_b")


def min_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Onto 0..1 per group; a constant group gives 0."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    made = F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"))
    return df.join(ends, keys).withColumn("scaled", F.coalesce(made, F.lit(0.0))).drop("_a", "_b")
