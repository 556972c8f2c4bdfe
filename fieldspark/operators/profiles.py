"""Entropy and temporal profiles (Z10, Z39): histograms that merge, bounds first and bins after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def entropy(df: DataFrame, keys: list[str], value: str, bins: int, least_span: float = 1e-6) -> DataFrame:
    """``keys, n, low, high, entropy`` in bits over ``bins`` equal bins between a group's bounds.

    Counts of bins are merged map-side, so no group's values are gathered;
    nulls and NaNs don't count, a group without values is left out.
    """
    x = F.col(value)
    some = df.where(x.isNotNull() & ~F.isnan(x.cast("double")))
    ends = some.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    scaled = (x - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(least_span))
    binned = some.join(ends, keys).groupBy(*keys, F.least(F.floor(scaled * bins), F.lit(bins - 1)).alias("_bin")).agg(F.count("*").alias("_c"), F.max("n").alias("_n"))
    share = F.col("_c") / F.col("_n")
    made = binned.groupBy(*keys).agg(F.sum(-share * F.log2(share)).alias("entropy"))
    return ends.join(made, keys)


def mask_profile(pixels: DataFrame, value: str, least_dates: int = 3) -> DataFrame:
    """``tile_id, valid_dates, amplitude, has_growth_peak, entropy`` of a mask's mean value by date.

    ``pixels`` has ``tile_id, t, value`` of the mask's valid pixels.  A peak has
    a rise over 0.02 before its first highest date, a fall below -0.02 after it,
    and an amplitude from 0.16.  With under three dates amplitude is 0, there
    is no peak and entropy is 4.
    """
    profile = pixels.where(F.col(value).isNotNull()).groupBy("tile_id", "t").agg(F.avg(value).alias("v"))
    top = profile.groupBy("tile_id").agg(F.min_by("t", F.struct(-F.col("v"), F.col("t"))).alias("_peak"))
    order = Window.partitionBy("tile_id").orderBy("t")
    steps = profile.withColumn("_d", F.col("v") - F.lag("v").over(order)).join(top, "tile_id")
    shape = steps.groupBy("tile_id").agg(F.max((F.col("t") <= F.col("_peak")) & (F.col("_d") > 0.02)).alias("_rise"), F.max((F.col("t") > F.col("_peak")) & (F.col("_d") < -0.02)).alias("_fall"))
    out = entropy(profile, ["tile_id"], "v", 6).join(shape, "tile_id")
    enough = F.col("n") >= least_dates
    amplitude = F.col("high") - F.col("low")
    peak = enough & F.coalesce(F.col("_rise"), F.lit(False)) & F.coalesce(F.col("_fall"), F.lit(False)) & (amplitude >= 0.16)
    return out.select("tile_id", F.col("n").alias("valid_dates"), F.when(enough, amplitude).otherwise(0.0).alias("amplitude"), peak.alias("has_growth_peak"), F.when(enough, F.col("entropy")).otherwise(4.0).alias("entropy"))


def is_strong(profile: DataFrame, latitude: str) -> DataFrame:
    """``strong``: a growth peak, or enough amplitude at low enough entropy, both milder north of 57 degrees."""
    north = F.col(latitude) > 57.0
    calm = (F.col("amplitude") >= F.when(north, 0.18).otherwise(0.22)) & (F.col("entropy") <= F.when(north, 2.4).otherwise(2.2))
    return profile.withColumn("strong", F.col("has_growth_peak") | calm)


def pixel_table(pixels: DataFrame, bands: list[str], entropy_of: str, bins: int = 10) -> DataFrame:
    """One row per pixel over dates: mean, median and maximum of each band over valid dates, valid share, entropy, median class."""
    keys = ["tile_id", "r", "c"]
    valid = F.col("valid")
    stats = [f(F.when(valid, F.col(b))).alias(f"{b}_{n}") for b in bands for n, f in (("mean", F.avg), ("median", F.median), ("max", F.max))]
    made = pixels.groupBy(*keys).agg(*stats, F.avg(valid.cast("int")).alias("valid_fraction"), F.median("scl").alias("scl_median"))
    spread = entropy(pixels.where(valid), keys, entropy_of, bins).select(*keys, F.col("entropy").alias(f"{entropy_of}_entropy"))
    return made.join(spread, keys, "left")
