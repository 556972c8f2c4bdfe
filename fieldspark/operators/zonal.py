"""Grouped and zonal statistics (Z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspark.operators import ranks


def summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, mean, extremes, median and quartiles (linear) of the non-null values."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.75)).alias("p75"),
    )


def histogram(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """min(8, max(4, n div 4)) equal bins per group, the last closed; groups under two values are skipped."""
    v = F.col(value)
    bounds = df.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).where("n >= 2")
    bounds = bounds.withColumn("bins", F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.lit(8), F.greatest(F.lit(4), F.floor(F.col("n") / 4)))).cast("int"))
    bounds = bounds.withColumn("flat", F.col("lo") == F.col("hi")).withColumn("lo", F.when(F.col("flat"), F.col("lo") - 0.01).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("flat"), F.col("hi") + 0.01).otherwise(F.col("hi"))).drop("flat")
    placed = df.where(v.isNotNull()).join(bounds, keys)
    bin_ = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1).cast("int")
    counted = placed.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("count"))
    frame = bounds.select(*keys, "lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    full = frame.join(counted, [*keys, "bin"], "left")
    return full.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric."""
    return df.unpivot(keys, metrics, "metric", "value")


def field_window_stats(pixels: DataFrame, membership: DataFrame, keys: list[str], metrics: list[str], least: int = 12) -> DataFrame:
    """Z3: statistics per field and window over valid pixels, and their coverage of the field.

    ``membership(tile_id, r, c, field)``; windows under ``least`` valid pixels are dropped.
    """
    joined = pixels.join(membership, ["tile_id", "r", "c"])
    cover = joined.groupBy(*keys).agg(F.count_if("valid").alias("valid_pixels"), F.count("*").alias("pixels")).where(F.col("valid_pixels") >= least)
    stats = summary(long_metrics(joined.where("valid"), keys, metrics), [*keys, "metric"])
    return stats.join(cover.select(*keys, (F.col("valid_pixels") / F.col("pixels")).alias("coverage")), keys)


def segment_properties(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """Area, boundary pixels, shape index and means of each label of each tile."""
    row, col = Window.partitionBy("tile_id", "r").orderBy("c"), Window.partitionBy("tile_id", "c").orderBy("r")

    def alike(w, axis, step):
        return (F.lag(axis, step).over(w) == F.col(axis) - step) & (F.lag("label", step).over(w) == F.col("label"))

    inner = F.coalesce(alike(row, "c", 1) & alike(row, "c", -1) & alike(col, "r", 1) & alike(col, "r", -1), F.lit(False))
    marked = labels.withColumn("edge", ~inner).where("label > 0").join(pixels, ["tile_id", "r", "c"], "left")
    return marked.groupBy("tile_id", "label").agg(
        F.count_distinct("r", "c").alias("area"), F.count_distinct(F.when(F.col("edge"), F.struct("r", "c"))).alias("perimeter"), F.avg("ndvi").alias("ndvi_mean"), F.avg("ndwi").alias("ndwi_mean")
    ).withColumn("shape_index", F.col("perimeter") / (4 * F.sqrt(F.greatest(F.col("area"), F.lit(1e-6)))))


def phenometrics(pixels: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, deviation and range of NDVI over time; -0.1 and 0 without data."""
    v = F.when(F.col("valid"), F.col("ndvi"))
    got = pixels.groupBy("tile_id", "r", "c").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    none, zero = F.lit(-0.1), F.lit(0.0)
    return got.select("tile_id", "r", "c", F.coalesce("lo", none).alias("ndvi_min"), F.coalesce("hi", none).alias("ndvi_max"), F.coalesce("mean", none).alias("ndvi_mean"), F.coalesce("std", zero).alias("ndvi_std"), F.coalesce(F.col("hi") - F.col("lo"), zero).alias("ndvi_delta"))


def median_composite(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Median of each band over the valid dates of a pixel."""
    return pixels.groupBy("tile_id", "r", "c").agg(*(F.percentile(F.when(F.col("valid"), F.col(b)), F.lit(0.5)).alias(b) for b in bands))


def temporal_coherence(pixels: DataFrame, bins: int = 10) -> DataFrame:
    """Amplitude, a growth peak inside the season, and the entropy of NDVI in equal bins over 0 to 1."""
    valid = pixels.where(F.col("valid") & F.col("ndvi").isNotNull())
    key = ["tile_id", "r", "c"]
    base = valid.groupBy(*key).agg(
        F.count("*").alias("n"), (F.max("ndvi") - F.min("ndvi")).alias("amplitude"), F.max("ndvi").alias("hi"), F.avg("ndvi").alias("mean"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max_by("t", F.struct("ndvi", -F.col("t"))).alias("peak_t"),
    ).where("n >= 3")
    bin_ = F.least(F.greatest(F.floor(F.col("ndvi") * bins), F.lit(0)), F.lit(bins - 1))
    shares = valid.groupBy(*key, bin_.alias("bin")).agg(F.count("*").alias("k"))
    total = shares.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(*key)))
    entropy = total.groupBy(*key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    peak = (F.col("peak_t") > F.col("first_t")) & (F.col("peak_t") < F.col("last_t")) & (F.col("hi") > F.col("mean") + 0.1)
    return base.join(entropy, key).select(*key, "amplitude", peak.alias("has_peak"), "entropy")


def scene_coverage(pixels: DataFrame) -> DataFrame:
    """Share of valid pixels per tile and date."""
    return pixels.groupBy("tile_id", "t").agg(F.avg(F.col("valid").cast("int")).alias("coverage"))


def tile_quality(pixels: DataFrame) -> DataFrame:
    """Coverage, usable scenes, cloud share and a processing mode with its reason, per tile."""
    scenes = pixels.groupBy("tile_id", "t").agg(F.avg(F.col("valid").cast("int")).alias("coverage"), F.avg(F.col("scl").isin(3, 8, 9, 10).cast("int")).alias("cloud"), F.avg(F.when(F.col("valid"), F.col("ndvi"))).alias("ndvi"))
    tiles = scenes.groupBy("tile_id").agg(F.avg("coverage").alias("coverage"), F.count_if(F.col("coverage") >= 0.3).alias("scenes"), F.avg("cloud").alias("cloud"), F.stddev_pop("ndvi").alias("ndvi_std"))
    mode = F.when(F.col("coverage") < 0.05, "skip").when(F.col("scenes") < 2, "degraded").when(F.col("cloud") > 0.5, "recovery").otherwise("normal")
    reason = F.when(F.col("coverage") < 0.05, "low_coverage").when(F.col("scenes") < 2, "few_scenes").when(F.col("cloud") > 0.5, "cloudy").otherwise("ok")
    return tiles.withColumn("mode", mode).withColumn("reason", reason)


def grid_cells(pixels: DataFrame, labels: DataFrame, base: int = 1) -> DataFrame:
    """Z13 with U9: cells of base * 4, * 2 and * 1 pixels, their field coverage and index means."""
    zooms = F.explode(F.array(*(F.struct(F.lit(z).alias("zoom"), F.lit(base * f).alias("k")) for z, f in enumerate((4, 2, 1))))).alias("z")
    flat = pixels.join(labels, ["tile_id", "r", "c"], "left").select("*", zooms)
    row, col = (F.floor(F.col(x) / F.col("z.k") + 1e-9).alias(n) for x, n in (("r", "row"), ("c", "col")))
    return flat.groupBy("tile_id", F.col("z.zoom").alias("zoom"), row, col).agg(F.avg((F.coalesce("label", F.lit(0)) > 0).cast("int")).alias("field_coverage"), F.avg("ndvi").alias("ndvi_mean"), F.avg("ndmi").alias("ndmi_mean"), F.avg("ndwi").alias("ndwi_mean"))


def group_series(obs: DataFrame) -> DataFrame:
    """Per metric and day over fields; a null counts as zero."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return obs.groupBy("metric", "observed_on").agg(F.avg(z("mean")).alias("mean"), F.min(z("min")).alias("min"), F.max(z("max")).alias("max"), F.avg(z("median")).alias("median"))


def conditional_rates(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Counts of each flag and of rows, per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def confusion(pred: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Precision, recall, IoU and F1 of ``pred`` against ``truth`` (booleans) per ``by``."""
    both = pred.join(truth, keys, "full")
    p, t = F.coalesce("pred", F.lit(False)), F.coalesce("truth", F.lit(False))
    got = both.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return got.select(*by, "tp", "fp", "fn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(tp, tp + fp + fn).alias("iou"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def lower_quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """The value at index int(q * (n - 1)) of the sorted values."""
    return ranks.quantiles(df, keys, value, {name: ranks.lower(q) for name, q in levels.items()}).drop("n")


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the median of each column, from one long table; a column without values is null."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).cast("double").alias("value")) for x in columns))))
    found = ranks.quantiles(long, ["name"], "value", {"m": ranks.linear(0.5)})
    return found.agg(*(F.max(F.when(F.col("name") == x, F.col("m"))).alias(x) for x in columns))


def nearest(pixels: DataFrame, marked: DataFrame, pixel_m: float, radius_m: float) -> DataFrame:
    """Metres from each pixel to the nearest marked one of its tile, radius_m if there is none so near.

    Marked pixels go to the blocks, as wide as the radius, around their own, so
    a pixel meets only those of its block and no pair is made twice.
    """
    block = max(1, int(radius_m // pixel_m))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = marked.select("tile_id", F.col("r").alias("mr"), F.col("c").alias("mc"), around.alias("o"))
    spread = spread.select("tile_id", "mr", "mc", (F.floor(F.col("mr") / block) + F.col("o.i")).alias("br"), (F.floor(F.col("mc") / block) + F.col("o.j")).alias("bc"))
    placed = pixels.withColumn("br", F.floor(F.col("r") / block)).withColumn("bc", F.floor(F.col("c") / block))
    metres = F.hypot(F.col("r") - F.col("mr"), F.col("c") - F.col("mc")) * pixel_m
    return placed.join(spread, ["tile_id", "br", "bc"], "left").groupBy("tile_id", "r", "c").agg(F.least(F.coalesce(F.min(metres), F.lit(radius_m)), F.lit(radius_m)).alias("distance"))
