"""Scenario response (M12) and crop tables of nutrients (A17): tables joined as dimensions, sweeps as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How an index answers to yield, irrigation, fertilizer, rain, temperature and radiation, and its limits.
EFFECTS = ("yield", "irrigation", "fertilizer", "rain", "temperature", "solar")
SENSITIVITY = {
    "ndvi": (0.62, 0.12, 0.18, 0.10, -0.025, 0.10, -0.2, 1.0),
    "ndmi": (0.28, 0.38, 0.04, 0.32, -0.018, 0.03, -0.5, 0.8),
    "ndwi": (0.18, 0.48, 0.00, 0.38, -0.010, 0.02, -0.5, 0.8),
    "mndwi": (0.18, 0.48, 0.00, 0.38, -0.010, 0.02, -0.5, 0.8),
    "soil_moisture": (0.20, 0.42, 0.04, 0.36, -0.018, 0.00, 0.02, 0.65),
    "bsi": (-0.38, -0.18, -0.08, -0.14, 0.010, -0.04, -0.5, 1.0),
    "evi": (0.55, 0.14, 0.20, 0.12, -0.022, 0.09, -1.0, 1.0),
    "savi": (0.55, 0.14, 0.20, 0.12, -0.022, 0.09, -1.0, 1.0),
}
OTHER_INDEX = (0.40, 0.18, 0.12, 0.16, -0.018, 0.05, -1.0, 1.0)
FIELD_CAPACITY, SATURATION, DRY_MOISTURE = 0.35, 0.55, 0.18

_LIMITS = ("lowest", "highest")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sensitivity(spark: SparkSession) -> DataFrame:
    """``metric`` and its row of SENSITIVITY: a dimension of eight rows."""
    return spark.createDataFrame([(m, *row) for m, row in SENSITIVITY.items()], "metric string, " + ", ".join(f"{x} double" for x in (*EFFECTS, *_LIMITS)))


def projected(series: DataFrame, scenarios: DataFrame, keys: list[str]) -> DataFrame:
    """``metric, value`` rows with ``projected`` for each of the scenarios of their keys.

    ``scenarios`` has ``keys, scenario, yield_ratio, irrigation_pct,
    fertilizer_pct, expected_rain_mm, temperature_delta_c, cloud_cover_factor``.
    The yield's change counts from -0.8 to 1.5, rain about 50 mm up to half the
    range of 300.  An index moves by that share of its own size and keeps to
    its limits; a null stays null.  Metrics without a row of their own take
    OTHER_INDEX.
    """
    table = sensitivity(series.sparkSession)
    known = series.join(F.broadcast(table), "metric", "left")  # eight rows
    for x, none in zip((*EFFECTS, *_LIMITS), OTHER_INDEX, strict=True):
        known = known.withColumn(x, F.coalesce(x, F.lit(none)))
    both = known.join(scenarios, keys)
    moves = {
        "yield": clip(F.col("yield_ratio") - 1, -0.8, 1.5),
        "irrigation": F.col("irrigation_pct") / 100,
        "fertilizer": F.col("fertilizer_pct") / 100,
        "rain": clip((F.col("expected_rain_mm") - 50) / 300, -0.5, 0.5),
        "temperature": F.col("temperature_delta_c"),
        "solar": F.col("cloud_cover_factor") - 1,
    }
    change = reduce(lambda a, b: a + b, (F.col(x) * m for x, m in moves.items()))
    made = F.when(F.col("value").isNotNull(), F.greatest("lowest", F.least("highest", F.col("value") + change * F.abs("value"))))
    return both.withColumn("projected", made).drop(*EFFECTS, *_LIMITS)


def adjusted(features: DataFrame) -> DataFrame:
    """A feature row under its scenario; columns as below, each may be null.

    ``management_total`` grows by 0.1 and 0.15 a percent of irrigation and
    fertilizer; nutrients scale with fertilizer within their limits; rain adds;
    soil moisture fills up towards field capacity and drains above it;
    radiation scales up to 245 a week; warmth adds to temperature, heat sum
    (by the observed days, 120 if unknown) and vapour pressure deficit.
    """
    irrigation, fertilizer, rain, factor, warmer = (F.coalesce(x, F.lit(none)) for x, none in (("irrigation_pct", 0.0), ("fertilizer_pct", 0.0), ("expected_rain_mm", 0.0), ("cloud_cover_factor", 1.0), ("temperature_delta_c", 0.0)))
    effort = F.abs(irrigation) * 0.1 + F.abs(fertilizer) * 0.15
    total = F.when(F.col("management_total").isNotNull(), F.greatest(F.lit(0.0), F.col("management_total") + effort)).when((irrigation != 0) | (fertilizer != 0), effort)
    nutrients = {x: clip(F.col(x) * (1 + fertilizer / 100), low, high) for x, low, high in (("soil_n_ppm", 2.0, 80.0), ("soil_p_ppm", 2.0, 65.0), ("soil_k_ppm", 4.0, 90.0))}
    nutrients = {x: F.when(F.col(x).isNotNull(), v) for x, v in nutrients.items()}
    precipitation = F.when(F.col("precipitation").isNotNull(), F.greatest(F.lit(0.0), F.col("precipitation") + rain)).when(rain > 0, rain)
    base = F.coalesce("soil_moisture", F.lit(DRY_MOISTURE))
    wet = base + rain * 0.002 * (1 - base / SATURATION) + F.greatest(FIELD_CAPACITY - base, F.lit(0.0)) * (1 - F.exp(-0.03 * F.greatest(irrigation, F.lit(0.0))))
    drained = F.when(wet > FIELD_CAPACITY, FIELD_CAPACITY + (wet - FIELD_CAPACITY) * 0.6).otherwise(wet)
    moisture = F.when(F.col("soil_moisture").isNotNull() | (irrigation != 0) | (rain != 0), clip(drained, 0.02, 0.6))
    sun = F.when((factor != 1) & (F.col("solar_radiation_mean") > 0), clip(F.col("solar_radiation_mean") * factor, 0.0, 245.0)).otherwise(F.col("solar_radiation_mean"))
    heat = F.when(warmer != 0, F.greatest(F.lit(0.0), F.col("gdd_sum") + warmer * F.coalesce("observed_days", F.lit(120.0)))).otherwise(F.col("gdd_sum"))
    heat = F.when(F.col("gdd_sum").isNotNull(), heat)
    vpd = F.when(F.col("vpd_mean").isNotNull(), F.when(warmer != 0, F.greatest(F.lit(0.0), F.col("vpd_mean") + warmer * 0.06)).otherwise(F.col("vpd_mean")))
    new = {"management_total": total, **nutrients, "precipitation": precipitation, "soil_moisture": moisture, "solar_radiation_mean": sun, "temperature_mean_c": F.col("temperature_mean_c") + warmer, "gdd_sum": heat, "vpd_mean": vpd}
    return features.select(*(new[x].alias(x) if x in new else F.col(x) for x in features.columns))


def nutrient_terms(rows: DataFrame, keys: list[str], levels: list[str], table: DataFrame, crop: str = "crop_code") -> DataFrame:
    """``keys, nutrient, term``: the response of each known level on its crop's curve.

    ``table`` has ``crop_code, nutrient`` and the corners ``zero, best, toxic,
    lethal, low, peak, bad, worst`` of each curve, and a default in rows whose
    crop_code is null.  Levels become rows, so a nutrient more is a table row
    more and no column.
    """
    long = rows.select(*keys, crop, F.explode(F.array(*(F.struct(F.lit(x).alias("nutrient"), F.col(x).cast("double").alias("x")) for x in levels))).alias("_l")).select(*keys, crop, "_l.*").where("x is not null")
    corners = ["zero", "best", "toxic", "lethal", "low", "peak", "bad", "worst"]
    own = table.where(F.col("crop_code").isNotNull()).select(F.col("crop_code").alias(crop), "nutrient", *corners)
    default = table.where(F.col("crop_code").isNull()).select("nutrient", *(F.col(k).alias(f"d_{k}") for k in corners))
    both = long.join(own, [crop, "nutrient"], "left").join(default, "nutrient", "left")
    p = {k: F.when(F.col("zero").isNotNull(), F.col(k)).otherwise(F.col(f"d_{k}")) for k in corners}
    x, tiny = F.col("x"), F.lit(1e-6)
    rise = p["low"] + (1 - F.exp(-3 * (x - p["zero"]) / F.greatest(p["best"] - p["zero"], tiny))) * (p["peak"] - p["low"])
    loss = p["peak"] - (x - p["toxic"]) / F.greatest(p["lethal"] - p["toxic"], tiny) * (p["peak"] - p["bad"])
    over = F.greatest(p["worst"], p["bad"] - F.least((x - p["lethal"]) / F.greatest(p["lethal"], tiny), F.lit(1.0)) * (p["bad"] - p["worst"]))
    term = F.when(x <= p["zero"], p["low"]).when(x <= p["best"], rise).when(x <= p["toxic"], p["peak"]).when(x <= p["lethal"], loss).otherwise(over)
    return both.select(*keys, "nutrient", term.alias("term")).where("term is not null")


def limiting_nutrient(terms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, factor, nutrient``: the least term, held from 0.35 to 1.1, and whose it is (ties: the first by name)."""
    return terms.groupBy(*keys).agg(clip(F.min("term"), 0.35, 1.1).alias("factor"), F.min_by("nutrient", F.struct(F.round("term", 9), "nutrient")).alias("nutrient"))
