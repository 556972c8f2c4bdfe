"""Adaptive date selection (Q4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspark.functions.agronomy import latitude_band
from fieldspark.functions.weather import clip

# Weights of a date's score and shifts of the preferred season, in shares of the series.
COVERAGE, PHENOLOGY, SPREAD, WATER, CLOUD = 0.40, 0.30, 0.20, 0.10, 0.10
SHIFT = {"north": 14 / 60, "south": -14 / 60}


def date_scores(pixels: DataFrame, latitudes: DataFrame, least_valid: float = 0.5) -> DataFrame:
    """Q4's score of each date of a tile, before the spread over the season.

    ``pixels`` are indexed pixels, ``latitudes`` has (tile_id, lat).  A date's
    place in the season counts from 0 in the order of ``t``.  Percentiles are
    over the valid pixels of one scene.
    """

    def p90(x: str) -> Column:
        return F.coalesce(F.percentile(F.when(F.col("valid"), F.col(x)), F.lit(0.9)), F.lit(0.0))

    scenes = pixels.groupBy("tile_id", "t").agg(
        F.avg(F.col("valid").cast("int")).alias("coverage"), p90("ndvi").alias("_green"), F.coalesce(F.stddev_pop(F.when(F.col("valid"), F.col("ndvi"))), F.lit(0.0)).alias("_spread"),
        F.greatest(p90("ndwi"), F.lit(0.0)).alias("_ndwi"), F.greatest(p90("mndwi"), F.lit(0.0)).alias("_mndwi"),
    ).join(latitudes.select("tile_id", latitude_band(F.col("lat")).alias("_band")), "tile_id", "left")
    tile = Window.partitionBy("tile_id")
    place, last = F.row_number().over(tile.orderBy("t")) - 1, F.count("*").over(tile) - 1
    placed = scenes.withColumn("place", place).withColumn("last", last)

    def scaled(x: str) -> Column:
        lo, hi = F.min(x).over(tile), F.max(x).over(tile)
        return F.when(hi - lo <= 1e-9, 1.0).otherwise((F.col(x) - lo) / (hi - lo))

    shift = F.when(F.col("_band") == "north", SHIFT["north"]).when(F.col("_band") == "south", SHIFT["south"]).otherwise(0.0)
    span = F.greatest("last", F.lit(1))
    centre = F.greatest(F.lit(0.0), F.least(F.col("last") / 2 + shift * span, F.col("last").cast("double")))
    season = clip(1 - F.abs(F.col("place") - centre) / span, 0.0, 1.0)
    phenology = clip(0.55 * season + 0.45 * (0.7 * scaled("_green") + 0.3 * scaled("_spread")), 0.0, 1.0)
    water = clip(0.5 * scaled("_ndwi") + 0.5 * scaled("_mndwi"), 0.0, 1.0)
    clear = clip((F.col("coverage") - least_valid) / (1 - least_valid), 0.0, 1.0)
    cloudy = clip((least_valid - F.col("coverage")) / least_valid, 0.0, 1.0)
    edge = F.when(F.col("place").isin(0) | (F.col("place") == F.col("last")), 1.0).otherwise(F.least(F.lit(1.0), F.least(F.col("place"), F.col("last") - F.col("place")) / F.greatest(F.col("last") / 2, F.lit(1.0))))
    score = COVERAGE * clear + PHENOLOGY * phenology - WATER * water - CLOUD * cloudy
    return placed.select("tile_id", "t", "place", "coverage", score.alias("score"), edge.alias("edge"), (F.col("coverage") >= least_valid).alias("good"))


def pick_dates(scores: DataFrame, wanted: int = 7, least_good: int = 4) -> DataFrame:
    """Q4: up to ``wanted`` dates of each tile, one at a time by score and distance to those chosen.

    Scores are compared at nine decimals, as their last bits vary with row
    order.  Ties go to the higher coverage, then the earlier date.  Only good dates
    are candidates if there are any; with fewer than ``least_good`` chosen, the
    best covered others fill up.  A tile's dates are few; they are one group.
    """
    import pandas as pd

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        if rows["good"].any():
            pool = rows[rows["good"]]
        else:
            pool = rows
        most, gap = min(wanted, len(rows)), max(1, round(len(rows) / max(1, wanted)))
        left, taken = pool.to_dict("records"), []
        while left and len(taken) < most:
            def rank(d):
                spread = min(1.0, min(abs(d["place"] - x["place"]) for x in taken) / gap) if taken else d["edge"]
                return (d["score"] + SPREAD * spread, d["coverage"], -d["place"])

            best = max(left, key=rank)
            left.remove(best)
            taken.append({**best, "reason": "high_score"})
        if len(taken) < least_good:
            have = {x["place"] for x in taken}
            others = sorted((d for d in rows.to_dict("records") if d["place"] not in have), key=lambda d: (-d["coverage"], d["place"]))
            taken += [{**d, "reason": "fallback_low_quality"} for d in others[: most - len(taken)]]
        return pd.DataFrame(taken, columns=["tile_id", "t", "place", "reason"])

    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
    return scores.withColumn("score", F.round("score", 9)).groupBy("tile_id").applyInPandas(chosen, f"tile_id {kinds['tile_id']}, t {kinds['t']}, place {kinds['place']}, reason string")
