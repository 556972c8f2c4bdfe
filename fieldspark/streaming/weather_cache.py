"""Micro-batch variants (T1 and the weekly series) for append-only folders of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.agronomy import freshness
from fieldspark.operators.series import latest


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def first_per_place(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The first snapshot of each rounded place within the time to live; state is dropped by watermark."""
    placed = events.withColumn("lat", F.round("lat", 1)).withColumn("lon", F.round("lon", 1))
    return placed.withWatermark("observed_at", ttl).dropDuplicatesWithinWatermark(["lat", "lon"])


def newest_per_place(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The newest snapshot of each rounded place in each span of the time to live, final once the watermark has passed."""
    placed = events.withColumn("lat", F.round("lat", 1)).withColumn("lon", F.round("lon", 1))
    rest = [x for x in events.columns if x not in ("lat", "lon")]
    newest = F.max_by(F.struct(*rest), F.col("observed_at")).alias("row")
    return placed.withWatermark("observed_at", ttl).groupBy("lat", "lon", F.window("observed_at", ttl)).agg(newest).select("lat", "lon", "row.*")


def newest_at_once(events: DataFrame, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """T1 as a stream: ``lat, lon, event_id, observed_at, state`` whenever the cache entry of a rounded place changes.

    A newer row comes out as it arrives, fresh or, if the watermark has already
    passed its time to live, stale.  When a row outlives its time to live
    without a newer one, a timer sends it again as stale, the fallback that
    readers get.  Rows older than the newest one, and repeats, change nothing;
    of rows of one time the smallest event_id counts.  State is one row a
    place, in RocksDB, so the session must name that state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Newest(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.newest = handle.getValueState("newest", "event_id long, observed_at timestamp")

        def _row(self, key, event_id, observed_at, state):
            return pd.DataFrame({"lat": [key[0]], "lon": [key[1]], "event_id": [event_id], "observed_at": [observed_at], "state": [state]})

        def handleInputRows(self, key, rows, timerValues):
            held = self.newest.get() if self.newest.exists() else None
            best = None if held is None else (pd.Timestamp(held[1]), -held[0])
            before = best
            for part in rows:
                for event_id, at in zip(part["event_id"], part["observed_at"], strict=True):
                    if not pd.isna(at) and (best is None or (pd.Timestamp(at), -event_id) > best):
                        best = (pd.Timestamp(at), -event_id)
            if best == before:
                return
            at, event_id = best[0], -int(best[1])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            ends = int(at.tz_localize("UTC").timestamp() * 1000 if at.tzinfo is None else at.timestamp() * 1000) + ttl_seconds * 1000
            fresh = ends > timerValues.getCurrentWatermarkInMs()
            if fresh:
                self.handle.registerTimer(ends)
            self.newest.update((event_id, at.to_pydatetime()))
            yield self._row(key, event_id, at, "fresh" if fresh else "stale")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            event_id, at = self.newest.get()
            yield self._row(key, event_id, pd.Timestamp(at), "stale")

        def close(self):
            pass

    placed = events.select(F.round("lat", 1).alias("lat"), F.round("lon", 1).alias("lon"), F.col("event_id").cast("long").alias("event_id"), "observed_at").withWatermark("observed_at", late)
    shape = "lat double, lon double, event_id long, observed_at timestamp, state string"
    return placed.groupBy("lat", "lon").transformWithStateInPandas(Newest(), outputStructType=shape, outputMode="Update", timeMode="EventTime")


def cached(events: DataFrame, as_of: str, ttl_seconds: int, tie: str) -> DataFrame:
    """T1 on a table: the newest row of each rounded place up to a time, marked fresh or, as a fallback, stale.

    Of rows of one time the one with the smallest ``tie`` is taken.
    """
    now = F.lit(as_of).cast("timestamp")
    placed = events.where(F.col("observed_at") <= now).withColumn("lat", F.round("lat", 1)).withColumn("lon", F.round("lon", 1))
    found = latest(placed, ["lat", "lon"], [F.desc("observed_at"), F.asc(tie)])
    return found.withColumn("state", freshness(F.col("observed_at"), now, ttl_seconds))


def daily_means(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Mean value per field, metric and day, final once the watermark has passed."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy("field_id", "metric", w).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select("field_id", "metric", F.col("window.start").alias("day"), "mean", "n")
