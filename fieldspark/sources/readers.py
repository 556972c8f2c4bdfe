"""Readers and writers (S2, S11 to S16, S21): files of any store that Spark opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import weather


def read_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings; a byte-order mark is taken off the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


# The hourly metrics of a weather payload.
HOURLY = ("temperature", "precipitation", "vpd", "soil_moisture", "wind_speed", "cloud_cover")
HOURLY_SCHEMA = "hourly struct<time: array<string>, " + ", ".join(f"{m}: array<double>" for m in HOURLY) + ">"


def hourly_to_daily(payloads: DataFrame, key: str, column: str, base: float = 10.0) -> DataFrame:
    """Daily means of parallel hourly arrays (precipitation is summed) and heat over a base.

    Cloud cover over 1 is a percentage.  A malformed payload gives no rows.
    """
    parsed = payloads.select(key, F.from_json(column, HOURLY_SCHEMA)["hourly"].alias("h"))
    hours = parsed.select(key, F.explode(F.arrays_zip("h.time", *(f"h.{m}" for m in HOURLY))).alias("z"))
    flat = hours.select(key, F.to_date(F.substring("z.time", 1, 10)).alias("day"), *(F.col(f"z.{m}").alias(m) for m in HOURLY)).where("day is not null")
    flat = flat.withColumn("cloud_cover", F.when(F.col("cloud_cover") > 1, F.col("cloud_cover") / 100).otherwise(F.col("cloud_cover")))
    days = flat.groupBy(key, "day").agg(*((F.sum if m == "precipitation" else F.avg)(m).alias(m) for m in HOURLY), F.max("temperature").alias("_hi"), F.min("temperature").alias("_lo"))
    return days.withColumn("gdd", F.greatest(F.col("temperature") - base, F.lit(0.0))).drop("_hi", "_lo")


def merge_reanalysis(series: DataFrame, key: str) -> DataFrame:
    """Long series ``(key, day, variable, value)`` to one row per day, in usual units.

    Kelvin to degrees, metres to millimetres, wind speed from both components.
    """
    names = ["t2m", "d2m", "tp", "u10", "v10", "swvl1", "tcc"]
    wide = series.groupBy(key, "day").pivot("variable", names).agg(F.first("value", ignorenulls=True))
    t, dew = F.col("t2m") - 273.15, F.col("d2m") - 273.15
    return wide.select(key, "day", t.alias("temperature"), (F.col("tp") * 1000).alias("precipitation"), weather.wind_speed(F.col("u10"), F.col("v10")).alias("wind_speed"), weather.vpd_from_dew_point(t, dew).alias("vpd"), F.col("swvl1").alias("soil_moisture"), F.col("tcc").alias("cloud_cover"), F.greatest(t - 10, F.lit(0.0)).alias("gdd"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, dateFormat="yyyy-MM-dd")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, dateFormat="yyyy-MM-dd")


def read_scene_bands(pixels: DataFrame) -> DataFrame:
    """The band contract: NaN is null, a missing band is null, a missing scene class is 0."""
    bands = ("b2", "b3", "b4", "b5", "b7", "b8", "b8a", "b11")
    have = set(pixels.columns)
    made = [(F.when(~F.isnan(F.col(b).cast("double")), F.col(b).cast("double")) if b in have else F.lit(None).cast("double")).alias(b) for b in bands]
    scl = F.coalesce(F.col("scl").cast("int"), F.lit(0)) if "scl" in have else F.lit(0)
    return pixels.select("tile_id", "t", "r", "c", *made, scl.alias("scl"))


def to_feature(ring: Column, properties: list[str]) -> Column:
    """One GeoJSON feature per row; the ring is closed."""
    point = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(point, F.slice(point, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def registry_name(name: Column) -> Column:
    """Names in ``[a-z0-9_]``."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]+", "_")


def archive_snapshot(fields: DataFrame, metrics: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """One row per field with its state and metric means, and when it expires."""
    means = metrics.groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct("metric", "mean"))).alias("metrics"))
    state = F.struct("area_m2", "perimeter_m", "quality_score")
    day = F.lit(as_of).cast("date")
    return fields.join(means, "field_id", "left").select("field_id", F.to_json(state).alias("field_snapshot"), F.to_json("metrics").alias("metrics_snapshot"), day.alias("date_to"), F.date_add(day, days).alias("expires_at"))
