"""Unit tests on literal rows, with values worked out by hand or by NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import agronomy, geo, spectral, weather
from fieldspark.operators import focal, iterative, relational, scoring, series, zonal


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_indices_and_division_by_zero(spark):
    got = spectral.all_indices(one(spark, b2=0.1, b3=0.2, b4=0.1, b8=0.5, b11=0.0)).first()
    assert got["ndvi"] == pytest.approx(0.4 / 0.6)
    assert spectral.all_indices(one(spark, b2=0.0, b3=0.0, b4=0.0, b8=0.0, b11=0.0)).first()["ndvi"] is None
    scl = spark.createDataFrame([(x,) for x in (4, 5, 6, 3, 8, 0, 1, 10, 11, 2)], "s int")
    assert [r[0] for r in scl.select(spectral.valid_pixel(F.col("s"))).collect()] == [True] * 3 + [False] * 7


def test_weather(spark):
    df = one(spark, t=20.0, rh=50.0, cloud=2.0)
    got = df.select(weather.vpd_from_humidity(F.col("t"), F.col("rh")).alias("v"), weather.solar_from_cloud(F.lit(40.0), F.col("cloud")).alias("s"), weather.gdd(F.lit(30.0), F.lit(10.0)).alias("g"), weather.day_length(F.lit(0.0), F.lit(80.0)).alias("d")).first()
    assert got["v"] == pytest.approx(0.6108 * math.exp(17.27 * 20 / 257.3) * 0.5)
    assert (got["s"], got["g"]) == (10.0, 10.0)
    assert got["d"] == pytest.approx(12.0, abs=0.01)


def test_text_and_dates(spark):
    df = spark.createDataFrame([("Hello,  World!", "2024-02-29"), ("--", "2023-01-01")], "t string, d string").withColumn("d", F.col("d").cast("date"))
    got = df.select(agronomy.slug(F.col("t")), agronomy.years_back(F.col("d"), 1).cast("string"), agronomy.week_start(F.col("d")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("hello-world", "2023-02-28", "2024-02-26"), ("", "2022-01-01", "2022-12-26")]


def test_event_units(spark):
    df = spark.createDataFrame([("Полив", "cm", 2.0), ("urea", "g/m2", 500.0), ("urea", "kg/ha", 500.0)], "e string, u string, a double")
    got = df.select(agronomy.is_irrigation(F.col("e"), F.col("u")), agronomy.irrigation_mm(F.col("a"), F.col("u")), agronomy.nitrogen_kg(F.col("a"), F.col("u")), agronomy.nitrogen_kg(F.col("a"), F.col("u"), True)).collect()
    assert [tuple(r) for r in got] == [(True, 20.0, 2.0, 2.0), (False, 500.0, 0.5, 0.5), (False, 500.0, 500.0, 0.5)]


def test_holdout_digit_sum(spark):
    import hashlib

    df = spark.createDataFrame([(y, c) for y in range(2000, 2040) for c in ("wheat", "soy")], "y int, c string")
    for r in df.select("y", "c", agronomy.in_holdout(F.col("y"), F.col("c")).alias("h")).collect():
        assert r["h"] == (int(hashlib.sha1(f"{r['y']}:{r['c']}".encode()).hexdigest(), 16) % 5 == 0)


def test_ring_geometry(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0))))
    got = spark.range(1).select(geo.ring_area(ring), geo.ring_perimeter(ring), geo.ring_centroid(ring)["x"], geo.in_ring(F.lit(3.0), F.lit(1.0), ring), geo.in_ring(F.lit(1.0), F.lit(2.0), ring)).first()
    assert tuple(got) == (6.0, 12.0, pytest.approx(8 / 3), True, False)


def test_robust_z_fallbacks(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 5.0)] * 3 + [("c", x) for x in (1.0, 1.0, 1.0, 9.0)], "k string, v double")
    got = {}
    for r in series.robust_z(df, ["k"], "v", "z").collect():
        got.setdefault(r["k"], []).append((r["v"], r["z"]))
    assert dict(got["a"])[100.0] == pytest.approx(0.6745 * 97)
    assert {z for _, z in got["b"]} == {0.0}
    assert dict(got["c"])[9.0] == pytest.approx((9 - 3) / np.std([1, 1, 1, 9]))


def test_smoothing_keeps_short_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 3, 6.0)], "k string, d int, v double")
    got = sorted((r["k"], r["d"], r["smoothed"]) for r in series.smoothed(df, ["k"], "d", "v").collect())
    assert got == [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 1.5), ("b", 2, 3.0), ("b", 3, 4.0)]


def test_conformal_width_is_the_linear_quantile(spark):
    values = [3.0, -1.0, 4.0, 1.5, -5.0, 9.0, 2.0]
    got = scoring.interval_buckets(spark.createDataFrame([("x", v) for v in values], "k string, residual double"), ["k"]).first()
    level = min(0.9 * (1 + 1 / 7), 1)
    assert got["width"] == pytest.approx(np.quantile(np.abs(values), level))


def test_ridge_leave_one_out(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 2))
    y = 3 + x @ [2, -1] + rng.normal(scale=0.1, size=30)
    df = spark.createDataFrame([("g", float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)], "g string, a double, b double, y double")
    got = scoring.ridge(df, "g", ["a", "b"], "y", (1.0,)).first()
    errors = []
    for i in range(30):
        keep = np.arange(30) != i
        m = np.column_stack([np.ones(29), x[keep]])
        coef = np.linalg.solve(m.T @ m + np.diag([0, 1.0, 1.0]), m.T @ y[keep])
        errors.append(y[i] - coef @ [1, *x[i]])
    assert got["loo_rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))), rel=1e-6)


def test_suppression_equals_greedy(spark):
    rng = np.random.default_rng(3)
    score = rng.random(60).round(4)
    pairs = {tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(150)}
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(60)}
    kept: set = set()
    for i in sorted(range(60), key=lambda i: (-score[i], i)):
        if score[i] >= 0.25 and not near[i] & kept:
            kept.add(i)
    items = spark.createDataFrame([(i, float(score[i])) for i in range(60)], "id long, score double")
    got = iterative.suppress(items, spark.createDataFrame(list(pairs), "u long, v long")).where("state = 'kept'").collect()
    assert {r["id"] for r in got} == kept


def test_min_labels_on_a_long_chain(spark):
    nodes = spark.range(200).select("id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(150) if i != 70], "u long, v long")
    got = {r["id"]: r["component"] for r in iterative.min_labels(nodes, edges).collect()}
    assert got == {i: 0 if i <= 70 else 71 if i <= 150 else i for i in range(200)}


def test_box_mean_with_missing_pixels(spark):
    cells = {(r, c): float(r * 7 + c) for r in range(6) for c in range(6) if (r + c) % 4}
    df = spark.createDataFrame([(0, r, c, v) for (r, c), v in cells.items()], "tile_id int, r int, c int, x double")
    for row in focal.box_mean(df, "x", "m", 1).collect():
        near = [v for (r, c), v in cells.items() if abs(r - row["r"]) <= 1 and abs(c - row["c"]) <= 1]
        assert row["m"] == pytest.approx(np.mean(near))


def test_gradient_of_a_ramp(spark):
    df = spark.createDataFrame([(0, r, c, float(c)) for r in range(5) for c in range(5)], "tile_id int, r int, c int, x double")
    got = {(r["r"], r["c"]): r["edge"] for r in focal.gradient(df, "x").collect()}
    assert {got[r, c] for r in range(5) for c in (1, 2, 3)} == {1.0}
    assert got[2, 0] == pytest.approx(0.5)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(17)] + [("b", 2.0), ("b", 2.0), ("c", 1.0)], "k string, value double")
    got = sorted((r["k"], r["bin"], r["count"]) for r in zonal.histogram(df, ["k"]).collect())
    assert got == [("a", 0, 4), ("a", 1, 4), ("a", 2, 4), ("a", 3, 5), ("b", 0, 2)]


def test_validate_import_reports_the_first_rule(spark):
    rows = spark.createDataFrame([("f1", "2020", "wheat", "5.5"), (" ", "x", None, ""), ("f2", "x", "soy", "1"), ("f3", "2020", "soy", None), ("f4", "2020", " ", "2")], "field_external_id string, season_year string, crop_code string, yield_kg_ha string")
    got = [r["error_message"] for r in relational.validate_import(rows, "yield_history").collect()]
    assert got == [None, "field_external_id is required", "season_year is not a valid int", "yield_kg_ha is required", "crop_code is required"]


def test_water_balance_folds_weeks_in_order(spark):
    df = spark.createDataFrame([(1, f"2024-05-{d:02d}", 15.0, 1.0, 2.0, 0.0, r, 0.0, "clay", 1.0) for d, r in ((20, 0.0), (6, 200.0), (13, 10.0))], "f int, week_start string, tmean double, vpd double, wind double, gdd double, precip double, solar double, texture string, kc double")
    got = sorted(series.water_balance(df.withColumn("week_start", F.col("week_start").cast("date")), ["f"]).collect(), key=lambda r: r["week_start"])
    demand = (1.5 + 0.12 * 15 + 2.8 + 0.36) * 7
    storage = 155 * 0.62
    for r, rain in zip(got, (200.0, 10.0, 0.0), strict=True):
        storage = storage + rain * 0.82 - demand
        assert r["drainage"] == pytest.approx(max(0, storage - 155))
        storage = max(0.0, min(155.0, storage))
        assert r["storage"] == pytest.approx(storage)


def test_zones_shares_and_summary(spark):
    # of six cells in even steps two fall in each zone; a field of five cells has none
    rows = [(1, i, float(i), 0.5, 600.0) for i in range(6)] + [(2, i, float(i), 0.5, 600.0) for i in range(5)]
    cells = spark.createDataFrame(rows, "field_id int, cell_id int, x double, cover double, area double")
    shared = scoring.zone_shares(scoring.zones(cells, {"x": 1.0}), "cover", "area")
    got = {r["cell_id"]: r for r in shared.collect()}
    assert [got[i]["zone"] for i in range(6)] == ["low", "low", "medium", "medium", "high", "high"]
    raw = [min(1.25, max(0.75, 1 + 0.12 * 0.6745 * (i - 2.5) / 1.5)) for i in range(6)]
    assert [got[i]["multiplier"] for i in range(6)] == pytest.approx([x / (sum(raw) / 6) for x in raw])
    assert all(r["cell_area_m2"] == pytest.approx(100) for r in got.values())
    assert {(r["zone"], r["cells"], round(r["area_m2"]), round(r["area_share_pct"], 3)) for r in scoring.zone_summary(shared).collect()} == {(z, 2, 200, 33.333) for z in ("low", "medium", "high")}


def test_ranks_over_the_whole_table(spark):
    rows = [(i * 37 % 500 // 3, i) for i in range(500)]
    got = relational.ranked(spark.createDataFrame(rows, "size int, id int").repartition(7), [F.desc("size"), F.asc("id")]).collect()
    assert {r["id"]: r["rank"] for r in got} == {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)}


def test_suppression_of_a_long_chain(spark):
    """Each item overlaps the next, with falling scores: every other one stays."""
    from fieldspark.operators import iterative

    n = 40
    items = spark.createDataFrame([(i, 1 - i / 100) for i in range(n)], "id long, score double")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u long, v long")
    got = {r["id"]: r["state"] for r in iterative.suppress(items, links).collect()}
    assert got == {i: "kept" if i % 2 == 0 else "dropped" for i in range(n)}


def test_nearest_marked_across_blocks(spark):
    from fieldspark.operators import zonal

    cells = [(1, r, c) for r in range(-4, 9) for c in range(0, 12)] + [(2, 0, 0)]
    marked = [(1, -2, 3), (1, 7, 11)]
    shape = "tile_id long, r long, c long"
    got = zonal.nearest(spark.createDataFrame(cells, shape), spark.createDataFrame(marked, shape), pixel_m=10.0, radius_m=35.0)
    for x in got.collect():
        near = min((10 * ((x["r"] - r) ** 2 + (x["c"] - c) ** 2) ** 0.5 for t, r, c in marked if t == x["tile_id"]), default=35.0)
        assert abs(x["distance"] - min(near, 35.0)) < 1e-9


def test_suitability_by_hand(spark):
    from pyspark.sql import functions as F

    from fieldspark.functions import suitability as su

    rows = [("corn", 50.0, 2300.0, 500.0, 15.0, True), ("corn", 61.0, None, 100.0, 9.0, True), (None, 64.0, 1000.0, 800.0, 12.0, False), ("soy", None, None, None, None, True)]
    made = spark.createDataFrame(rows, "crop string, lat double, heat double, rain double, temp double, ok boolean")
    got = [r["s"] for r in made.select(su.crop_suitability(*(F.col(c) for c in made.columns)).alias("s")).collect()]
    assert (got[0]["score"], got[0]["status"], got[0]["reasons"]) == (1.0, "high", [])
    assert got[1]["reasons"] == ["latitude_out_of_range", "gdd_missing", "precipitation_deficit", "temperature_deficit"]
    assert abs(got[1]["score"] - round(0.18 * 0.8 * (0.92 - 120 / 220 * 0.4) * 0.75, 4)) < 1e-9
    assert got[2]["reasons"] == ["latitude_penalty", "seasonal_window_incomplete"] and got[2]["score"] == 0.625
    assert got[3]["reasons"] == ["gdd_missing"] and got[3]["status"] == "moderate"
    nothing = spark.range(1).select(su.vegetation_factor(*[F.lit(None).cast("double")] * 7).alias("v"), su.soil_factor(*[F.lit(None).cast("double")] * 3).alias("s"), su.wind_factor(F.lit(None).cast("double")).alias("w")).first()
    assert tuple(nothing) == (1.0, 1.0, 1.0)


def test_exact_quantiles_of_groups_and_of_a_whole_table(spark):
    import numpy as np

    from fieldspark.operators import ranks

    rng = np.random.default_rng(3)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True)] + [(None, 1.0), (None, 5.0), (0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double")
    places = {"p50": ranks.linear(0.5), "p90": ranks.linear(0.9), "low95": ranks.lower(0.95)}
    groups = {g: sorted(x for h, x in rows if h == g and x is not None and x == x) for g in (0, 1, 2, None)}
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "x", places).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert (got[g]["n"], got[g]["p50"], got[g]["low95"]) == (len(x), np.quantile(x, 0.5), x[int(0.95 * (len(x) - 1))])
        assert got[g]["p90"] == pytest.approx(np.quantile(x, 0.9))
    whole = ranks.quantiles(df, [], "x", places).collect()
    assert [r["p50"] for r in whole] == [np.quantile(sum(groups.values(), []), 0.5)]
    assert ranks.quantiles(df.where("false"), ["g"], "x", places).collect() == []


def test_running_sums_over_a_table_and_groups(spark):
    from fieldspark.operators import ranks

    df = spark.range(1000).selectExpr("id", "id % 3 as g", "id % 5 as n")
    whole, total = ranks.cumulated(df, [], ["id"], "n", "before").orderBy("id").collect(), 0
    for r in whole:
        assert r["before"] == total
        total += r["n"]
    sums = {0: 0, 1: 0, 2: 0}
    for r in ranks.cumulated(df, ["g"], ["id"], "n", "before").orderBy("id").collect():
        assert r["before"] == sums[r["g"]]
        sums[r["g"]] += r["n"]


def test_matches_in_order_equal_the_loop(spark):
    import random

    from fieldspark.operators import matching

    random.seed(5)
    pairs = [(t, p, random.choice([0.1, 0.3, 0.5, 0.5, 0.9])) for t in range(40) for p in range(30) if random.random() < 0.2]
    want, used = set(), set()
    for t in range(40):
        free = sorted((-x, p) for u, p, x in pairs if u == t and p not in used and x >= 0.2)
        if free:
            want.add((t, free[0][1]))
            used.add(free[0][1])
    got = matching.match_in_order(spark.createDataFrame(pairs, "t int, p int, x double"), "t", "p", "x", 0.2)
    assert {(r["t"], r["p"]) for r in got.collect()} == want
    assert matching.match_in_order(got.where("false"), "t", "p", "x").count() == 0


def test_dates_are_picked_as_by_a_loop(spark):
    import random

    from fieldspark.operators import dates

    random.seed(7)
    rows = [(tile, t, t, round(random.random(), 2), random.choice([0.1, 0.2, 0.3]), 0.5, None) for tile in range(12) for t in range(9)]
    rows = [(a, b, p, cov, s, e, cov >= 0.5) for a, b, p, cov, s, e, _ in rows]
    df = spark.createDataFrame(rows, "tile_id int, t int, place int, coverage double, score double, edge double, good boolean")
    got = {(r["tile_id"], r["place"]) for r in dates.pick_dates(df, 4, 2).collect()}
    want = set()
    for tile in range(12):
        mine = [r for r in rows if r[0] == tile]
        pool = [r for r in mine if r[6]] or mine
        taken = []
        while len(taken) < 4 and len(taken) < len(pool):
            best = None
            for r in pool:
                if r in taken:
                    continue
                spread = min(1.0, min(abs(r[2] - x[2]) for x in taken) / 2) if taken else r[5]
                key = (r[4] + 0.2 * spread, r[3], -r[2])
                if best is None or key > best[0]:
                    best = (key, r)
            taken.append(best[1])
        if len(taken) < 2:
            taken += sorted((r for r in mine if r not in taken), key=lambda r: (-r[3], r[2]))[: 4 - len(taken)]
        want |= {(tile, r[2]) for r in taken}
    assert got == want


def test_boundaries(spark):
    from fieldspark.operators import imports

    box = '{"type": "Polygon", "coordinates": [[[30, 0], [30.01, 0], [30.01, 0.01], [30, 0.01], [30, 0]]]}'
    rows = [(1, "a", box), (2, "a", box), (3, "", box), (4, "b", '{"type": "Point", "coordinates": [1, 2]}'), (5, "c", None), (6, "d", '{"type": "Polygon", "coordinates": []}')]
    read = imports.read_boundaries(spark.createDataFrame(rows, "row_number int, field_external_id string, geometry string"), "geometry")
    got = {r["row_number"]: r for r in read.collect()}
    assert [got[i]["error_message"] for i in range(1, 7)] == [None, None, "field_external_id is required", "Unsupported geometry type Point", "geometry is empty", "geometry is empty"]
    assert got[1]["area_m2"] == pytest.approx(1113.1949**2, rel=1e-5) and got[1]["perimeter_m"] == pytest.approx(4 * 1113.1949, rel=1e-5)
    old = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "field_external_id string, area_m2 double")
    assert {r["field_external_id"] for r in imports.commit_boundaries(old, read).collect()} == {"a", "z"}


def test_object_payloads_lose_what_is_not_finite(spark):
    from fieldspark.functions import agronomy as ag

    df = spark.sql("select named_struct('a', double('NaN'), 'b', array(double('Infinity'), 1d), 'm', map('k', named_struct('x', double('-Infinity')))) as p")
    r = df.select(ag.sanitized(F.col("p"), df.schema["p"].dataType).alias("p")).first()["p"]
    assert (r["a"], list(r["b"]), r["m"]["k"]["x"]) == (None, [None, 1.0], None)


def test_date_scores_are_not_rounded_before_the_query_rounds(spark):
    from fieldspark.operators import dates
    from fieldspark.plans import queries as plans

    pixels = spark.createDataFrame([(1, 1, x, 0.5, 0.2, 0.1) for x in (True, False, False)], "tile_id int, t int, valid boolean, ndvi double, ndwi double, mndwi double")
    scores = dates.date_scores(pixels, spark.createDataFrame([(1, 50.0)], "tile_id int, lat double"), 0.3)
    assert scores.first()["score"] == pytest.approx(0.4 * (1 / 3 - 0.3) / 0.7 + 0.3 - 0.1, abs=1e-14)
    # at nine decimals first, this one's score would be rounded up: it is 0.032777 in SQL
    found = plans.QUERIES["q4_date_scores"](spark, "/root/testdata/sf0.01").where("tile_id = 87 and place = 5")
    assert [r["score"] for r in found.collect()] == [0.032777]


def test_dates_alike_to_nine_decimals_are_ties(spark):
    from fieldspark.operators import dates

    df = spark.createDataFrame([(1, t, t, 0.5, 0.3 + t * 1e-12, 0.5, True) for t in range(3)], "tile_id int, t int, place int, coverage double, score double, edge double, good boolean")
    assert [r["place"] for r in dates.pick_dates(df, 1, 1).collect()] == [0]
