"""Manifests, slices replaced in place, optional predicates, the streaming cache and profiles."""

from __future__ import annotations

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import manifests, predicates, profiles
from fieldspark.sources import slices
from fieldspark.streaming import weather_cache

ITEM = "queue int, task int, split string, area int, note string"


def test_digests_are_free_of_order_and_compose(spark):
    rng = random.Random(2)
    rows = [(i % 3, i, rng.choice(["train", "holdout"]), rng.randint(0, 50), rng.choice(["a", None, "é\n"])) for i in range(300)]
    given = spark.createDataFrame(rows, ITEM)
    rng.shuffle(rows)
    other = spark.createDataFrame(rows, ITEM).repartition(7)
    columns = ["task", "split", "area", "note"]
    whole = sorted(map(tuple, manifests.manifest(given, ["queue"], columns).collect()))
    assert whole == sorted(map(tuple, manifests.manifest(other, ["queue"], columns[::-1]).collect()))
    parts = [manifests.partial_digest(given.where(x), ["queue"], columns) for x in ("task < 100", "task >= 100")]
    assert whole == sorted(map(tuple, manifests.composed(parts[0].unionByName(parts[1]), ["queue"]).collect()))
    changed = given.withColumn("note", F.when(F.col("task") == 7, "b").otherwise(F.col("note")))
    assert len(set(whole) & set(map(tuple, manifests.manifest(changed, ["queue"], columns).collect()))) == 2
    twice = given.unionByName(given.where("task = 4"))
    assert len(set(whole) & set(map(tuple, manifests.manifest(twice, ["queue"], columns).collect()))) == 2


def test_planted_leaks_are_reported(spark):
    rows = [(1, 1, "train", 5, None), (1, 2, " Train", 5, None), (1, 3, "holdout", 6, None), (1, 4, "calibration", 7, None), (2, 1, "train", 5, None), (2, 2, "HOLDOUT", 5, None), (2, 3, "calibration", None, None), (2, 4, "other", 9, None), (3, 1, "train", 1, None)]
    got = {r["queue"]: r for r in manifests.checked(spark.createDataFrame(rows, ITEM), ["queue"], "area", "split").collect()}
    assert [got[q]["leaks"] for q in (1, 2, 3)] == [0, 1, 0]
    assert got[1]["error"] is None and got[2]["error"] == "an area is in several splits" and got[3]["missing"] == "calibration,holdout"


def test_registry_files(spark, tmp_path):
    texts = ['{"source": "Öko-Felder (EU) ", "year": 2020}', '[{"source": "b", "country": ["ee"]}, {"label_type": "x"}]', "{bad", "[]", ""]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(t)
    files = spark.read.text(str(tmp_path), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    got = sorted((r["source_id"], r["country"], r["year"]) for r in manifests.registry(files, "file", "text").collect())
    assert got == [("b", ["ee"], None), ("unknown", [], None), ("öko_felder__eu", [], 2020)]


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_slices_are_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(y, f, float(y * f)) for y in (2020, 2021, 2022) for f in range(40)]
    slices.write(spark.createDataFrame(rows, "year int, field int, v double"), path, ["year"])
    before = _files(path)
    new = spark.createDataFrame([(2021, 1, 7.0), (2021, 2, 8.0), (2023, 3, 9.0)], "year int, field int, v double")
    assert slices.replace(spark, new, path, ["year"]) == 2
    now = _files(path)
    assert {f: t for f, t in now.items() if "2020" in f or "2022" in f} == {f: t for f, t in before.items() if "2020" in f or "2022" in f}
    want = sorted([r for r in rows if r[0] != 2021] + [(2021, 1, 7.0), (2021, 2, 8.0), (2023, 3, 9.0)])
    assert sorted((r["year"], r["field"], r["v"]) for r in spark.read.parquet(path).collect()) == want
    assert slices.replace(spark, new, path, ["year"]) == 0  # again: nothing is written
    assert _files(path) == now
    one = spark.createDataFrame([(2023, 3, 10.0)], "year int, field int, v double")
    assert slices.replace(spark, one.unionByName(new.where("year = 2021")), path, ["year"]) == 1


def test_optional_predicates(spark, tmp_path):
    rows = [(i % 4, i, i % 3 == 0, None if i % 5 == 0 else f"b{i % 2}") for i in range(200)]
    made = spark.createDataFrame(rows, "org int, id int, kept boolean, branch string")
    made.write.partitionBy("org").parquet(str(tmp_path / "t"))

    def ids(**wanted):
        return {r["id"] for r in made.where(predicates.condition(**wanted)).collect()}

    assert ids() == set(range(200)) == ids(kept=None)
    assert ids(kept=True, branch=["b0"]) == {i for _, i, k, b in rows if k and b == "b0"}
    assert ids(branch__not="b0") == {i for _, i, _, b in rows if b == "b1"}
    assert ids(id={"from": 3, "to": 9}) == set(range(3, 10)) and ids(id={"from": 190}) == set(range(190, 200)) and ids(branch=[]) == set()
    assert ids(branch={"null": True}) == set(range(0, 200, 5))
    found = predicates.scan(spark, str(tmp_path / "t"), "org", 2, ["id"], kept=True, branch=None, id={"to": 50})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(org" in plan and "PushedFilters" in plan and "LessThanOrEqual(id,50)" in plan and "branch" not in plan
    assert {r["id"] for r in found.collect()} == {i for o, i, k, _ in rows if o == 2 and k and i <= 50}
    chosen = spark.createDataFrame([(1, "x"), (3, "y")], "org int, name string").where("name = 'x'")
    joined = predicates.scan(spark, str(tmp_path / "t"), "org", chosen)
    assert {r["org"] for r in joined.collect()} == {1}


def test_stream_of_newest_rows_agrees_with_the_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    batches = []
    for b in range(4):
        rows = [(b * 100 + i, 45.0 + rng.randint(0, 3) * 0.1, 30.0, base + dt.timedelta(minutes=b * 60 + rng.randint(-90, 55))) for i in range(25)]
        batches.append(rows + rows[:3])  # late ones by up to 90 minutes, and repeats
    batches.append([(900, 50.0, 30.0, base + dt.timedelta(hours=9))])  # moves the watermark on
    batches.append([(901, 50.0, 30.0, base + dt.timedelta(hours=9, minutes=1))])
    shape = "event_id long, lat double, lon double, observed_at timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    stream = weather_cache.newest_at_once(weather_cache.read_stream(spark, str(folder), shape), 2 * 3600, "3 hours")
    seen: list = []
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(folder))
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start()
        query.awaitTermination(120)
        assert query.exception() is None
    last = {(round(r[0], 1), r[1]): (r[2], r[4]) for r in seen}
    every = spark.createDataFrame([r for rows in batches for r in rows], shape)
    want = {(round(r["lat"], 1), r["lon"]): (r["event_id"], r["state"]) for r in weather_cache.cached(every, "2024-01-01 09:01:00", 2 * 3600, "event_id").collect()}
    assert last == want
    assert {s for _, s in want.values()} == {"fresh", "stale"}


def test_entropy_of_profiles(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for tile in range(6):
        dates = 2 if tile == 0 else 8
        means = np.round(rng.uniform(0.2, 0.8, dates), 3)
        rows += [(tile, t, float(m) + d) for t, m in enumerate(means) for d in (-0.01, 0.01)]
        low, high = means.min(), means.max()
        peak = int(means.argmax())
        steps = np.diff(means)
        grows = dates >= 3 and bool((steps[:peak] > 0.02).any() and (steps[peak:] < -0.02).any() and high - low >= 0.16)
        share = np.histogram((means - low) / max(high - low, 1e-6), bins=np.linspace(0, 1, 7))[0] / dates
        share = share[share > 0]
        want[tile] = (dates, high - low if dates >= 3 else 0, grows, -(share * np.log2(share)).sum() if dates >= 3 else 4)
    got = profiles.mask_profile(spark.createDataFrame(rows, "tile_id int, t int, v double"), "v").collect()
    for r in got:
        assert tuple(r)[1:4:2] == want[r["tile_id"]][0:3:2]
        assert (r["amplitude"], r["entropy"]) == pytest.approx((want[r["tile_id"]][1], want[r["tile_id"]][3]))


def test_imputed_matrix_and_errors(spark):
    from fieldspark.operators import models

    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        x, held = float(rng.normal()), i % 4 == 0
        crop = "flax" if i % 40 == 0 else ["wheat", "barley", "wheat"][i % 3]
        y = 10 * (crop == "wheat") + 5 * x + float(rng.normal()) * 0.1
        rows.append((i, held, None if i % 9 == 0 else float("nan") if i % 10 == 0 else x, None if i % 7 == 0 else crop, y))
    given = spark.createDataFrame(rows, "id int, held boolean, x double, crop string, y double")
    train = [r[2] for r in rows if not r[1] and r[2] is not None and not np.isnan(r[2])]
    got = {r["id"]: r for r in models.imputed(given, ["x"], ["crop"], "held").collect()}
    for i, _, x, crop, _ in rows:
        assert got[i]["x"] == pytest.approx(np.median(train) if x is None or np.isnan(x) else x)
        assert got[i]["crop"] == (crop or "wheat")
    model, errors = models.yield_pipeline(given, ["x"], ["crop"], "y", "held")
    e = errors.first()
    assert e["samples_test"] == 100 and e["mae"] < e["mean_mae"] * 0.6 and 0 < e["r2"] <= 1
    from pyspark.ml.functions import vector_to_array

    made = model.transform(models.imputed(given, ["x"], ["crop"], "held")).withColumn("hot", vector_to_array("crop_hot"))
    assert {(r["crop"], tuple(r["hot"])) for r in made.collect()} == {("barley", (1.0, 0.0)), ("wheat", (0.0, 1.0)), ("flax", (0.0, 0.0))}
