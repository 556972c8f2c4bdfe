"""Readers, writers and streams on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.sources import readers
from fieldspark.streaming import weather_cache


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿field_external_id,season_year\nf1,2020\n,x\n".encode())
    df = readers.read_import_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["field_external_id", "season_year"]
    assert [tuple(r) for r in df.collect()] == [("f1", "2020"), (None, "x")]


def test_hourly_payload(spark):
    hourly = {"time": ["2024-05-01T00:00", "2024-05-01T12:00", "2024-05-02T00:00"], "temperature": [10.0, 14.0, 5.0], "precipitation": [0.5, 1.5, None], "vpd": [0.4, 0.6, 1.0], "soil_moisture": [0.2, 0.26, None], "wind_speed": [3.0, 5.0, 1.0], "cloud_cover": [40.0, 0.8, 1.0]}
    df = spark.createDataFrame([(1, json.dumps({"hourly": hourly})), (2, "{bad")], "k int, j string")
    got = {str(r["day"]): r for r in readers.hourly_to_daily(df, "k", "j").collect()}
    one = got["2024-05-01"]
    assert (one["temperature"], one["precipitation"], one["vpd"], one["wind_speed"], one["gdd"]) == (12.0, 2.0, 0.5, 4.0, 2.0)
    assert (one["soil_moisture"], one["cloud_cover"]) == (pytest.approx(0.23), pytest.approx(0.6))
    assert got["2024-05-02"]["precipitation"] is None and len(got) == 2


def test_reanalysis(spark):
    rows = [(1, "2024-05-01", v, x) for v, x in (("t2m", 293.15), ("d2m", 283.15), ("tp", 0.004), ("u10", 3.0), ("v10", 4.0))]
    got = readers.merge_reanalysis(spark.createDataFrame(rows, "k int, day string, variable string, value double"), "k").first()
    assert (got["temperature"], got["precipitation"], got["wind_speed"]) == (pytest.approx(20), pytest.approx(4), 5.0)


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-05-01"), (2, None)], "a long, d string").withColumn("d", F.col("d").cast("date"))
    readers.write_jsonl(df, str(tmp_path / "x"))
    assert sorted(map(tuple, readers.read_jsonl(spark, str(tmp_path / "x"), "a long, d date").collect())) == sorted(map(tuple, df.collect()))


def test_bands_and_features(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, float("nan"), 0.5)], "tile_id int, t int, r int, c int, b4 double, b8 double")
    got = readers.read_scene_bands(df).first()
    assert (got["b4"], got["b8"], got["b11"], got["scl"]) == (None, 0.5, None, 0)
    box = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0)], "id int, a double, b double, c double, d double")
    made = json.loads(box.select(readers.to_feature(geo.box_ring("a", "b", "c", "d"), ["id"])).first()[0])
    assert made["properties"] == {"id": 1} and made["geometry"]["coordinates"][0][0] == made["geometry"]["coordinates"][0][-1]


def test_streams(spark, tmp_path):
    rows = [(1, "ndvi", f"2024-05-0{d} 0{h}:00:00", float(d + h)) for d in (1, 2, 9) for h in (1, 3)]
    df = spark.createDataFrame(rows, "field_id int, metric string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = weather_cache.read_stream(spark, str(tmp_path / "in"), "field_id int, metric string, ts timestamp, value double")
    query = weather_cache.daily_means(stream).writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["mean"] for r in spark.table("daily").collect()) == [3.0, 4.0]
    points = spark.createDataFrame([(50.01, 30.0, "2024-05-01 00:00:00"), (50.02, 30.0, "2024-05-01 00:10:00"), (51.0, 30.0, "2024-05-01 00:20:00")], "lat double, lon double, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    points.write.parquet(str(tmp_path / "p"))
    stream = weather_cache.read_stream(spark, str(tmp_path / "p"), "lat double, lon double, observed_at timestamp")
    query = weather_cache.first_per_place(stream).writeStream.format("memory").queryName("places").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("places").count() == 2
    stream = weather_cache.read_stream(spark, str(tmp_path / "p"), "lat double, lon double, observed_at timestamp")
    query = weather_cache.newest_per_place(stream, "30 minutes").writeStream.outputMode("complete").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "c3")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["lat"], r["observed_at"].minute) for r in spark.table("newest").collect()) == [(50.0, 10), (51.0, 20)]
