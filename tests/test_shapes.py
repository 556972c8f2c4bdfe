"""Overlay, ring tables and mosaics against hand-worked lists and plain counts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import focal, imports, iterative, mosaic, overlay, rings
from fieldspark.plans import queries as plans

EDGES = "grp int, shape int, ax double, ay double, bx double, by double, minus boolean"


def ring(*points):
    return [(*a, *b) for a, b in zip(points, (*points[1:], points[0]), strict=True)]


def square(x, y, w, h=None):
    h = w if h is None else h
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


CASES = {  # shapes of edges; area of union, of intersection, of the first without the others
    1: ([square(0, 0, 2), square(1, 1, 2)], 7, 1, 3),
    2: ([square(0, 0, 2), square(2, 0, 2)], 8, 0, 4),  # a shared side
    3: ([square(0, 0, 4), square(1, 1, 2)], 16, 4, 12),  # nested
    4: ([square(0, 0, 4) + square(1, 1, 2)[::-1], square(1, 1, 2)], 16, 0, 12),  # a hole, filled
    5: ([square(0, 0, 2), square(0, 0, 2)], 4, 4, 0),  # twice the same
    6: ([ring((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)), square(0.5, 0.5, 2)], 5.75, 1.25, 1.75),  # a notch
    7: ([ring((0, 0), (4, 0), (2, 4)), ring((0, 3), (2, -1), (4, 3))], None, None, None),  # slanted: counted below
    8: ([square(0, 0, 1), square(3, 0, 1)], 2, 0, 1),  # apart
    9: ([square(0, 0, 3), square(1, 0, 1, 3), square(0, 1, 3, 1)], 9, 1, 4),  # three, sides overlapping
    10: ([square(0, 0, 1) + square(2, 0, 1), square(0.5, 0, 2, 1)], 3, 1, 1),  # two parts
}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(g, s, *map(float, e), s > 0) for g, (shapes, *_) in CASES.items() for s, shape in enumerate(shapes) for e in shape]
    return spark.createDataFrame(rows, EDGES)


def counted(shapes, rule, n=400):
    """Area by the middles of small squares."""
    at = (np.arange(n * 6) + 0.5) / n - 1
    x, y = np.meshgrid(at, at)
    inside = []
    for shape in shapes:
        odd = np.zeros(x.shape, bool)
        for ax, ay, bx, by in shape:
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        inside.append(odd)
    made = {"union": np.any(inside, axis=0), "intersection": np.all(inside, axis=0), "difference": inside[0] & ~np.any(inside[1:], axis=0)}[rule]
    return made.sum() / n**2


@pytest.mark.parametrize("rule", ["union", "intersection", "difference"])
def test_areas(edges, rule):
    given = edges if rule == "difference" else edges.drop("minus")
    got = {r["grp"]: r["area"] for r in overlay.measures(overlay.overlay(given, rule, 0.7)).collect()}
    for g, (shapes, *areas) in CASES.items():
        want = areas[["union", "intersection", "difference"].index(rule)]
        assert got.get(g, 0) == pytest.approx(counted(shapes, rule), abs=0.03) if want is None else got.get(g, 0) == pytest.approx(want, abs=1e-9), g


def test_random_triangles_equal_a_count(spark):
    rng = random.Random(5)
    shapes = {g: [ring(*((round(rng.uniform(-0.9, 4.9), 3), round(rng.uniform(-0.9, 4.9), 3)) for _ in range(3))) for _ in range(3)] for g in range(6)}
    rows = [(g, s, *e, False) for g, many in shapes.items() for s, shape in enumerate(many) for e in shape]
    got = {r["grp"]: r["area"] for r in overlay.measures(overlay.overlay(spark.createDataFrame(rows, EDGES), "union", 0.5)).collect()}
    for g, many in shapes.items():
        assert got[g] == pytest.approx(counted(many, "union"), abs=0.05)


def test_outlines(edges):
    found = overlay.outlines(overlay.overlay(edges.where("grp in (1, 3, 4, 8)"), "difference", 0.7)).collect()
    by = {g: [r for r in found if r["grp"] == g] for g in (1, 3, 4, 8)}
    assert [(p["x"], p["y"]) for p in by[1][0]["ring"]] == [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    assert sorted((r["hole"], r["ring_area"]) for r in by[3]) == [(False, 16), (True, 4)]
    assert sorted((r["hole"], r["ring_area"]) for r in by[4]) == [(False, 16), (True, 4)]
    assert len(by[8]) == 1


def test_parts_and_holes_of_a_boundary_file(spark):
    many = '{"type": "MultiPolygon", "coordinates": [[[[0,0],[0.02,0],[0.02,0.02],[0,0.02],[0,0]],[[0.005,0.005],[0.015,0.005],[0.015,0.015],[0.005,0.015],[0.005,0.005]]],[[[0.03,0],[0.04,0],[0.04,0.01],[0.03,0.01],[0.03,0]]]]}'
    rows = spark.createDataFrame([(1, "a", many), (2, "b", '{"type": "Polygon", "coordinates": []}'), (3, "c", None), (4, "", many)], "row_number int, field_external_id string, geometry string")
    read = {r["row_number"]: r for r in imports.read_boundaries(rows, "geometry").collect()}
    side = 6378137 * np.radians(0.01)
    assert read[1]["area_m2"] == pytest.approx(4 * side**2, rel=1e-6)  # 4 - 1 + 1 squares
    assert read[1]["perimeter_m"] == pytest.approx(16 * side, rel=1e-6)
    assert (read[1]["parts"], read[1]["holes"]) == (2, 1)
    assert [read[i]["error_message"] for i in (1, 2, 3, 4)] == [None, "geometry is empty", "geometry is empty", "field_external_id is required"]
    box = imports.preview_boundaries(imports.read_boundaries(rows, "geometry")).first()
    assert (box["minx"], box["maxx"], box["valid_rows"]) == (0, 0.04, 1)
    table = rings.parsed(rows.where("row_number = 1"), ["row_number"], "geometry")
    assert rings.measures(table, ["row_number"]).first()["area"] == pytest.approx(4e-4)
    points = spark.createDataFrame([(1, 0.001, 0.001), (2, 0.01, 0.01), (3, 0.035, 0.005), (4, 0.025, 0.005)], "p int, x double, y double")
    assert sorted(r["p"] for r in rings.containing(points, table, ["row_number"]).collect()) == [1, 3]
    assert rings.without_slivers(table, ["row_number"], 2e-4).count() == 1  # the small part and the small hole go


SIZE, COLUMNS = 4, 3


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(3).random((3 * SIZE, COLUMNS * SIZE)) < 0.45


@pytest.fixture(scope="module")
def tiles(spark, picture):
    rows = [(int(y // SIZE * COLUMNS + x // SIZE), int(y % SIZE), int(x % SIZE), int(y * 100 + x), bool(picture[y, x])) for y in range(picture.shape[0]) for x in range(picture.shape[1])]
    return spark.createDataFrame(rows, "tile_id long, r long, c long, id long, m boolean")


def _grid(df, picture, value):
    out = np.zeros(picture.shape, object)
    for r in mosaic.placed(df, SIZE, COLUMNS).collect():
        out[r["gr"], r["gc"]] = r[value]
    return out


def test_cut_and_uncut_masks_agree(tiles, picture):
    def grown(mask, n):
        for _ in range(n):
            p = np.pad(mask, 1)
            mask = mask | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
        return mask

    for n in (1, 2, 3):
        got = _grid(mosaic.across(tiles, SIZE, COLUMNS, n, lambda x, n=n: focal.dilate(x, "m", n)), picture, "m").astype(bool)
        assert (got == grown(picture, n)).all()
    mean = _grid(mosaic.across(tiles.withColumn("v", F.col("m").cast("double")), SIZE, COLUMNS, 2, lambda x: focal.box_mean(x, "v", "mean", 2)), picture, "mean").astype(float)
    want = [[picture[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean() for x in range(picture.shape[1])] for y in range(picture.shape[0])]
    assert np.allclose(mean, want)
    sparse = tiles.where("id % 7 < 2")
    ring = _grid(mosaic.ring_around(tiles, "m", 2, SIZE, COLUMNS), picture, "ring").astype(bool)
    assert (ring == (grown(picture, 2) & ~picture)).all()
    assert mosaic.with_halo(sparse, SIZE, COLUMNS, 1).where("own").count() == sparse.count()


def test_distances_are_exact(tiles, picture):
    few = tiles.withColumn("m", F.col("id").isin(0, 511, 1107))
    got = _grid(mosaic.distance(mosaic.placed(few, SIZE, COLUMNS).drop("x"), "m", 9), picture, "distance")
    marks = [(0, 0), (5, 11), (11, 7)]
    for y in range(picture.shape[0]):
        for x in range(picture.shape[1]):
            want = min(np.hypot(y - a, x - b) for a, b in marks)
            assert got[y, x] == pytest.approx(want) if want <= 9 else got[y, x] is None


def test_labels_across_tiles(tiles, picture):
    got = {r["id"]: r["component"] for r in mosaic.components(tiles.where("m"), SIZE, COLUMNS).collect()}
    left, want = {(int(y), int(x)) for y, x in zip(*np.nonzero(picture), strict=True)}, {}
    while left:
        area, todo = [], [left.pop()]
        while todo:
            y, x = todo.pop()
            area.append(y * 100 + x)
            for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        want |= dict.fromkeys(area, min(area))
    assert got == want


def test_chains_settle(spark, monkeypatch):
    order = list(range(2000))
    random.Random(4).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "u long, v long")
    nodes = spark.range(2001).select("id")
    for most in (250_000, 700):  # in one task, and in rounds over several
        monkeypatch.setattr(iterative, "TASK_EDGES", most)
        got = {r["id"]: r["component"] for r in iterative.min_labels(nodes, chain).collect()}
        assert got == dict.fromkeys(range(2000), 0) | {2000: 2000}


def test_chains_of_refusals_and_suppression(spark, monkeypatch):
    from fieldspark.operators import matching

    rng = random.Random(6)
    pairs = [(t, p, 1 - 0.001 * p) for t in range(120) for p in range(t + 1)] + [(200 + rng.randint(0, 30), 300 + rng.randint(0, 30), round(rng.random(), 2)) for _ in range(200)]
    pairs = list({(t, p): (t, p, x) for t, p, x in pairs}.values())  # every truth wants what the earlier ones took
    want, used = {}, set()
    for t in sorted({t for t, *_ in pairs}):
        free = sorted((-x, p) for u, p, x in pairs if u == t and x >= 0.2 and p not in used)
        if free:
            want[t] = free[0][1]
            used.add(free[0][1])
    items = [(i, round(rng.random(), 3)) for i in range(150)]
    links = [(i, i + 1) for i in range(149)] + [(rng.randint(0, 149), rng.randint(0, 149)) for _ in range(40)]
    near: dict = {}
    for u, v in links:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    kept: set = set()
    for i, x in sorted(items, key=lambda r: (-r[1], r[0])):
        if x >= 0.25 and not (near.get(i, set()) - {i}) & kept:
            kept.add(i)
    for most in (250_000, 20):  # in one pass, and by rounds
        monkeypatch.setattr(iterative, "TASK_EDGES", most)
        monkeypatch.setattr(matching, "TASK_EDGES", 250_000 if most > 20 else 5_000)
        got = {r["t"]: r["p"] for r in matching.match_in_order(spark.createDataFrame(pairs, "t long, p long, x double"), "t", "p", "x").collect()}
        assert got == want
        states = iterative.suppress(spark.createDataFrame(items, "id long, score double"), spark.createDataFrame(links, "u long, v long"))
        assert {r["id"] for r in states.where("state = 'kept'").collect()} == kept


def test_overlays_write_little_beyond_their_edges(spark):
    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert plans.QUERIES["j19_difference"](spark, "/root/testdata/sf0.001").count()
    assert written() - before < 2_000_000


@pytest.mark.parametrize("rule", ["union", "intersection", "difference"])
def test_whole_groups_and_the_grid_give_the_same_outline(spark, monkeypatch, rule):
    rows = []
    for grp in range(6):
        for shape in range(3):
            x, y, w = 0.003 * shape, 0.002 * shape * (grp % 3), 0.006 + 0.001 * (grp % 2)
            corners = [(x, y), (x + w, y + 0.001 * grp), (x + w, y + w), (x + w / 3, y + w / 2), (x, y + w)]
            rows += [((grp, 7), f"s{shape}", *a, *b, shape == 1) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)]
    edges = spark.createDataFrame(rows, "grp struct<u:int,v:int>, shape string, ax double, ay double, bx double, by double, minus boolean")
    found = []
    for small, pairs in ((256, 1 << 20), (256, 40), (0, 1 << 20)):  # in tasks, in many blocks, on the grid
        monkeypatch.setattr(overlay, "SMALL", small)
        monkeypatch.setattr(overlay, "PAIRS", pairs)
        found.append(sorted((r["grp"]["u"], *(round(r[k], 9) for k in overlay.ENDS)) for r in overlay.overlay(edges, rule, 0.004).collect()))
    assert found[0] and found[0] == found[1] == found[2]
