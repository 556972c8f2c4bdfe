"""Joins (J), filters (P), set operations (O), sorts and limits (L), imports and merges (S)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspark.operators.series import latest


def scan_tenant(table: DataFrame, org: int, *predicates: Column) -> DataFrame:
    """One tenant's rows without the hidden ones; all predicates reach the scan."""
    out = table.where((F.col("org") == org) & (F.col("source") != "merged_hidden"))
    for p in predicates:
        out = out.where(p)
    return out


def bbox_hits(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Rows whose box meets the given one."""
    return df.where((F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny))


def tiled(df: DataFrame, size: float, prefix: str = "") -> DataFrame:
    """Rows once for each grid square that their box touches, as ``_gx, _gy``."""
    out = df
    for axis, lo, hi in (("_gx", "minx", "maxx"), ("_gy", "miny", "maxy")):
        out = out.withColumn(axis, F.explode(F.sequence(F.floor(F.col(prefix + lo) / size), F.floor(F.col(prefix + hi) / size))))
    return out


def box_join(left: DataFrame, right: DataFrame, size: float = 0.02) -> DataFrame:
    """Pairs of boxes that overlap, by an equi-join on grid squares.

    A pair is reported only in the square of its overlap's lower corner, so no
    distinct is needed.  Columns of right get the prefix ``r_``.  Neither side is
    broadcast: a small file may have many rows.
    """
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    pairs = tiled(left, size).join(tiled(other, size, "r_").hint("merge"), ["_gx", "_gy"])
    hit = (F.col("minx") < F.col("r_maxx")) & (F.col("maxx") > F.col("r_minx")) & (F.col("miny") < F.col("r_maxy")) & (F.col("maxy") > F.col("r_miny"))
    home = (F.floor(F.greatest("minx", "r_minx") / size) == F.col("_gx")) & (F.floor(F.greatest("miny", "r_miny") / size) == F.col("_gy"))
    return pairs.where(hit & home).drop("_gx", "_gy")


def cells_of(cells: DataFrame, fields: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells whose box meets that of the one field that ``chosen(field_id)``, a single row, names."""
    box = fields.join(F.broadcast(chosen), "field_id").select("field_id", *(F.col(x).alias(f"r_{x}") for x in ("minx", "maxx", "miny", "maxy"))).limit(1)
    hit = (F.col("minx") < F.col("r_maxx")) & (F.col("maxx") > F.col("r_minx")) & (F.col("miny") < F.col("r_maxy")) & (F.col("maxy") > F.col("r_miny"))
    return cells.join(F.broadcast(box), hit).drop("r_minx", "r_maxx", "r_miny", "r_maxy")


def overlap_area() -> Column:
    """Overlap of the two boxes of a :func:`box_join` row, in square degrees."""
    return (F.least("maxx", "r_maxx") - F.greatest("minx", "r_minx")) * (F.least("maxy", "r_maxy") - F.greatest("miny", "r_miny"))


def box_iou() -> Column:
    both = overlap_area()
    own = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    other = (F.col("r_maxx") - F.col("r_minx")) * (F.col("r_maxy") - F.col("r_miny"))
    return both / (own + other - both)


def at_maximum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows at their group's maximum, by a grouped maximum joined back."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return df.join(top, keys).where(F.col(value) == F.col("_top")).drop("_top")


def precedence_merge(sources: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Per key and column, the value of the first source that has one."""
    out = None
    for i, df in enumerate(sources):
        part = df.select(*keys, *(F.col(c).alias(f"_{i}_{c}") for c in columns))
        out = part if out is None else out.join(part, keys, "full")
    return out.select(*keys, *(F.coalesce(*(F.col(f"_{i}_{c}") for i in range(len(sources)))).alias(c) for c in columns))


def smallest_tile(points: DataFrame, tiles: DataFrame, size: float = 0.02) -> DataFrame:
    """For each point the smallest tile that holds it; null without one."""
    keyed = points.withColumn("_gx", F.floor(F.col("x") / size)).withColumn("_gy", F.floor(F.col("y") / size))
    found = keyed.join(tiled(tiles, size), ["_gx", "_gy"]).where("x between minx and maxx and y between miny and maxy")
    best = found.groupBy("point_id").agg(F.min(F.struct(((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("a"), F.col("tile_id").alias("tile_id"))).alias("b"))
    return points.join(best.select("point_id", F.col("b.tile_id").alias("tile_id")), "point_id", "left")


def exists_flags(df: DataFrame, key: str, others: dict[str, DataFrame]) -> DataFrame:
    """A boolean per table that says whether it has the key."""
    for name, other in others.items():
        df = df.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def mutual_best(pairs: DataFrame, a: str, b: str, score: str, least: float) -> DataFrame:
    """Pairs that are each other's best, from a least score on."""
    best_b = F.row_number().over(Window.partitionBy(a).orderBy(F.desc(score), b))
    best_a = F.row_number().over(Window.partitionBy(b).orderBy(F.desc(score), a))
    return pairs.where(F.col(score) >= least).withColumn("_b", best_b).withColumn("_a", best_a).where("_a = 1 and _b = 1").drop("_a", "_b")


def key_delta(base: DataFrame, scenario: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Differences by key over either side, small ones dropped."""
    both = base.withColumnRenamed("value", "base").join(scenario.withColumnRenamed("value", "scenario"), keys, "full")
    both = both.select(*keys, F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("scenario", F.lit(0.0)).alias("scenario"))
    return both.withColumn("delta", F.col("scenario") - F.col("base")).where(F.abs("delta") >= least)


def yield_to_smaller_rank(cells: DataFrame, cell: str, owner: str, area: str) -> DataFrame:
    """Each cell goes to the larger of the owners that claim it."""
    return latest(cells, [cell], [F.desc(area), F.asc(owner)])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; the last of repeated new keys is the caller's to choose."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def missing_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that are not there yet."""
    return new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")


def replace_slice(target: DataFrame, new: DataFrame, keys: list[str], day: str, first: str, last: str) -> DataFrame:
    """The target without the keys' rows in a range of days, and the new rows."""
    gone = new.select(*keys).distinct().withColumn("_gone", F.lit(True))
    kept = target.join(gone, keys, "left").where(F.col("_gone").isNull() | ~F.col(day).between(first, last)).drop("_gone")
    return kept.unionByName(new)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """L3: a page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def ring_signature(minx: str, miny: str, maxx: str, maxy: str, digits: int = 6) -> Column:
    """O3: a digest that equal boxes share."""
    return F.sha2(F.concat_ws(",", *(F.format_string(f"%.{digits}f", F.col(c)) for c in (minx, miny, maxx, maxy))), 256)


def redirect(facts: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Facts of merged members go to their target."""
    return facts.join(mapping.select(F.col("member").alias(key), "target"), key, "left").withColumn(key, F.coalesce("target", key)).drop("target")


# Columns that each kind of import requires, and their types.
IMPORTS = {
    "yield_history": {"field_external_id": "string", "season_year": "int", "crop_code": "string", "yield_kg_ha": "double"},
    "crop_plan": {"field_external_id": "string", "season_year": "int", "crop_code": "string"},
    "soil_samples": {"field_external_id": "string", "sampled_at": "date"},
    "management_events": {"field_external_id": "string", "season_year": "int", "event_date": "date", "event_type": "string"},
    "weather_daily": {"field_external_id": "string", "season_year": "int", "observed_on": "date"},
}


def validate_import(rows: DataFrame, kind: str) -> DataFrame:
    """S3: string rows with ``error_message``, the first failing rule, null when valid.

    Required columns must be neither null nor blank and must parse.
    """
    checks = []
    for name, dtype in IMPORTS[kind].items():
        value = F.trim(F.col(name)) if name in rows.columns else F.lit(None).cast("string")
        checks.append(F.when(value.isNull() | (value == ""), F.lit(f"{name} is required")))
        if dtype != "string":
            checks.append(F.when(value.try_cast(dtype).isNull(), F.lit(f"{name} is not a valid {dtype}")))
    return rows.withColumn("error_message", F.coalesce(*checks))


def preview_import(checked: DataFrame) -> DataFrame:
    """Counts and the seasons of valid rows."""
    ok = F.col("error_message").isNull()
    return checked.agg(F.count("*").alias("rows_total"), F.count_if(ok).alias("rows_valid"), F.count_if(~ok).alias("rows_invalid"), F.count_distinct(F.when(ok, F.col("field_external_id"))).alias("fields"), F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("season_year")))), ",").alias("seasons"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their place, from 1, in an order over the whole table.

    Rows are dealt by ranges of the order; a count per partition makes the
    places global, so no task has all rows.  Rows alike in the order are
    interchangeable.
    """
    from fieldspark.operators.iterative import cut_lineage

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the checkpoint fixes partitions and their order
    fixed = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    fixed = fixed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return fixed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_id", "_part", "_at", "_start")
