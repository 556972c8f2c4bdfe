"""What only shows on larger tables: sums at a limit, places beyond the poles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldspark.functions import agronomy
from fieldspark.operators import generators, series
from fieldspark.plans import queries


def test_sums_do_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.createDataFrame([(i, 1, x) for i, x in enumerate((8.2, 1.6, 2.2))], "row_id int, k int, x double")
    for dealt in (rows, rows.orderBy(F.desc("row_id")), rows.repartition(3, "row_id")):
        assert [tuple(r) for r in series.in_order(dealt, ["k"], "row_id", x=F.sum("x"), n=F.count("*")).collect()] == [(1, 8.2 + 1.6 + 2.2, 3)]


def test_a_negative_area_has_no_shape_index(spark):
    got = spark.range(1).select(*(f(F.lit(a), F.lit(8.0)) for a in (-4.0, 4.0, 0.0) for f in (agronomy.shape_index, agronomy.pixel_shape_index))).first()
    assert math.isnan(got[0]) and math.isnan(got[1])
    assert got[2] == 8 / (2 * math.sqrt(math.pi * 4)) and got[3] == 1 and got[4] == 999 and got[5] == 2000


def test_tile_names_keep_their_length(spark):
    boxes = spark.createDataFrame([(1, 102.5, 102.7, 30.1, 30.2), (2, -7.0, -6.5, -1.0, -0.5)], "id int, miny double, maxy double, minx double, maxx double")
    assert {r["id"]: r["tile"] for r in generators.origin_tiles(boxes, "id").collect()} == {1: "N10E030", 2: "S09W003"}


def test_weeks_do_not_depend_on_the_order_of_rows(spark):
    rows = spark.createDataFrame([(i, 1, x) for i, x in enumerate((2.5, 1.6, 0.9))], "row_id int, field_id int, precip double")
    rows = rows.withColumns({"observed_on": F.date_add(F.lit("2024-05-06").cast("date"), F.col("row_id")), "tmean": F.lit(20.0), "vpd": F.lit(1.0)})
    for dealt in (rows, rows.orderBy(F.desc("row_id"))):
        week = queries._weeks_in_order(lambda name: dealt).first()  # noqa: B023
        assert (week["precip"], str(week["week_start"]), week["season_year"]) == (2.5 + 1.6 + 0.9, "2024-05-06", 2024)
