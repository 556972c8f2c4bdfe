"""Commits of validated imports (S9) and boundary files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.operators.relational import IMPORTS, missing_rows, upsert
from fieldspark.operators.rings import mercator
from fieldspark.operators.series import latest

# Further columns of each kind of import, and their types.
OPTIONAL = {
    "yield_history": {"observed_at": "date"},
    "crop_plan": {},
    "soil_samples": {"texture_class": "string", "organic_matter_pct": "double", "ph": "double", "n_ppm": "double", "p_ppm": "double", "k_ppm": "double"},
    "management_events": {"amount": "double", "unit": "string"},
    "weather_daily": {"temperature_mean_c": "double", "precipitation_mm": "double", "gdd": "double", "vpd": "double", "soil_moisture": "double"},
}
#: Keys by which an import replaces rows; the other kinds append.
REPLACES = {"crop_plan": ["field_id", "season_year"], "weather_daily": ["field_id", "season_year", "observed_on"]}


def import_facts(checked: DataFrame, kind: str, fields: DataFrame) -> DataFrame:
    """Typed facts of the valid rows, with ``error_message`` where the field isn't known.

    ``checked`` comes from ``validate_import`` and has ``row_number``;
    ``fields`` has (external_id, field_id).  Optional columns that are absent,
    blank or don't parse are null; a yield's day is 1 September unless given.
    """
    columns = {**IMPORTS[kind], **OPTIONAL[kind]}
    have = set(checked.columns)
    typed = []
    for name, dtype in columns.items():
        text = F.nullif(F.trim(F.col(name)), F.lit("")) if name in have else F.lit(None).cast("string")
        typed.append((text.try_cast(dtype) if dtype != "string" else text).alias(name))
    rows = checked.where("error_message is null").select("row_number", *typed)
    if "crop_code" in columns:
        rows = rows.withColumn("crop_code", F.lower("crop_code"))
    if kind == "yield_history":
        rows = rows.withColumn("observed_at", F.coalesce("observed_at", F.make_date("season_year", F.lit(9), F.lit(1))))
    known = fields.select(F.col("external_id").cast("string").alias("field_external_id"), "field_id")
    return rows.join(known, "field_external_id", "left").withColumn("error_message", F.when(F.col("field_id").isNull(), F.lit("unknown field")))


def commit_import(existing: DataFrame, facts: DataFrame, kind: str) -> DataFrame:
    """The target after the import; of repeated keys in one file the last row stays."""
    keys = REPLACES.get(kind)
    new = facts.where("error_message is null")
    if keys:
        return upsert(existing, latest(new, keys, [F.desc("row_number")]).select(*existing.columns), keys)
    return existing.unionByName(new.select(*existing.columns))


def new_seasons(facts: DataFrame, seasons: DataFrame) -> DataFrame:
    """S9 with S7: the seasons that the import must create."""
    return missing_rows(facts.where("error_message is null"), seasons, ["field_id", "season_year"])


GEOMETRY = "type string, coordinates string"


def read_boundaries(rows: DataFrame, geometry: str) -> DataFrame:
    """GeoJSON polygons with ``error_message``, ``rings``, ``parts``, ``holes`` and measures in spherical mercator.

    ``rings`` has each ring of each part: ``part``, ``hole`` and its points, not
    closed.  Area is in square metres, holes taken off, perimeter in metres,
    holes included; ``ring`` is the outer ring of the first part as it was
    given.  Null or malformed JSON is an empty geometry, and so is one without
    an outer ring of four points; shorter rings beside such are left out.
    """
    parsed = rows.withColumn("_g", F.from_json(geometry, GEOMETRY))
    kind = F.col("_g.type")
    single, many = F.from_json("_g.coordinates", "array<array<array<double>>>"), F.from_json("_g.coordinates", "array<array<array<array<double>>>>")
    parsed = parsed.withColumn("_parts", F.when(kind == "Polygon", F.array(single)).when(kind == "MultiPolygon", many))

    def points(ring):
        return F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    nested = F.transform("_parts", lambda part, i: F.transform(part, lambda ring, j: F.when(F.size(ring) >= 4, F.struct(i.alias("part"), (j > 0).alias("hole"), points(ring).alias("points")))))
    parsed = parsed.withColumn("rings", F.array_compact(F.flatten(nested)))
    error = (
        F.when(F.coalesce(F.trim("field_external_id"), F.lit("")) == "", "field_external_id is required")
        .when(kind.isNull(), "geometry is empty")
        .when(~kind.isin("Polygon", "MultiPolygon"), F.concat(F.lit("Unsupported geometry type "), kind))
        .when(~F.coalesce(F.exists("rings", lambda r: ~r["hole"]), F.lit(False)), "geometry is empty")
    )
    out = parsed.withColumn("geometry_type", kind).withColumn("ring", F.get(F.get("_parts", F.lit(0)), F.lit(0))).withColumn("error_message", error).drop("_g", "_parts")
    ok = F.col("error_message").isNull()
    out = out.withColumn("rings", F.when(ok, F.col("rings"))).withColumn("_m", F.transform("rings", lambda r: F.struct(r["hole"].alias("hole"), mercator(r["points"]).alias("points"))))

    def summed(value):
        return F.aggregate(F.transform("_m", value), F.lit(0.0), lambda t, x: t + x)

    area = summed(lambda r: F.when(r["hole"], -geo.ring_area(r["points"])).otherwise(geo.ring_area(r["points"])))
    out = out.withColumn("area_m2", area).withColumn("perimeter_m", summed(lambda r: geo.ring_perimeter(r["points"])))
    return out.withColumn("parts", F.size(F.array_distinct(F.transform("rings", lambda r: r["part"]))).cast("long")).withColumn("holes", F.size(F.filter("rings", lambda r: r["hole"])).cast("long")).drop("_m")


def preview_boundaries(read: DataFrame) -> DataFrame:
    """Counts, geometry types and the box of all valid rows."""
    ok = F.col("error_message").isNull()
    x = F.flatten(F.transform("rings", lambda r: F.transform(r["points"], lambda p: p["x"])))
    y = F.flatten(F.transform("rings", lambda r: F.transform(r["points"], lambda p: p["y"])))
    box = [F.min(F.when(ok, F.array_min(x))).alias("minx"), F.min(F.when(ok, F.array_min(y))).alias("miny"), F.max(F.when(ok, F.array_max(x))).alias("maxx"), F.max(F.when(ok, F.array_max(y))).alias("maxy")]
    types = F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("geometry_type")))), ",").alias("geometry_types")  # two at most
    return read.agg(F.count("*").alias("rows_total"), F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("invalid_rows"), F.count_distinct(F.when(ok, F.col("field_external_id"))).alias("fields"), types, *box)


def commit_boundaries(existing: DataFrame, read: DataFrame) -> DataFrame:
    """Fields by external id; a valid row replaces its field, the last of one file stays."""
    new = latest(read.where("error_message is null"), ["field_external_id"], [F.desc("row_number")])
    return upsert(existing, new.select(*existing.columns), ["field_external_id"])
