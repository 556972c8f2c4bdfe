"""Neighbourhoods across tile borders (P7, F1, F4, Q2): halo exchange, exact distances, two-level labels.

Tiles are numbered row by row: tile ``ty * columns + tx`` holds the pixels
``r, c`` from 0 to ``size - 1``, and a pixel's place in the mosaic is
``ty * size + r, tx * size + c``.  Nothing is gathered beyond one tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.iterative import min_labels


def placed(df: DataFrame, size: int, columns: int) -> DataFrame:
    """df with the places ``gr, gc`` in the mosaic."""
    tile = F.col("tile_id")
    return df.withColumn("gr", F.floor(tile / columns) * size + F.col("r")).withColumn("gc", F.pmod(tile, F.lit(columns)) * size + F.col("c"))


def with_halo(df: DataFrame, size: int, columns: int, width: int) -> DataFrame:
    """Each tile with the pixels of others within ``width`` of it, which have ``r, c`` outside 0 to size - 1 and ``own`` false.

    Only pixels near a border are sent on; a tile gets 4 * width * (size + width) of them at most.
    """
    at = placed(df, size, columns)
    for axis, tile in (("gr", "_ty"), ("gc", "_tx")):
        at = at.withColumn(tile, F.explode(F.sequence(F.floor((F.col(axis) - width) / size), F.floor((F.col(axis) + width) / size))))
    at = at.where(F.col("_ty") >= 0).where(F.col("_tx").between(0, columns - 1))
    to = F.col("_ty") * columns + F.col("_tx")
    named = {"tile_id": to.cast(df.schema["tile_id"].dataType), "r": F.col("gr") - F.col("_ty") * size, "c": F.col("gc") - F.col("_tx") * size}
    return at.select(*(named[x].alias(x) if x in named else F.col(x) for x in df.columns), (to == F.col("tile_id")).alias("own"))


def across(df: DataFrame, size: int, columns: int, width: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A tile operator as if there were no borders: it runs on tiles with halos, and pixels of its own are kept."""
    return run(with_halo(df, size, columns, width)).where("own").drop("own")


def distance(df: DataFrame, mask: str, reach: int) -> DataFrame:
    """df, with places ``gr, gc``, and ``distance`` to the nearest pixel of mask, in pixels; null beyond ``reach``.

    Two passes, exact: set pixels mark their columns up and down, then the
    columns' least heights mark their rows.  Each pass spreads a pixel to
    2 * reach + 1 places, of which map-side minima are shuffled.
    """
    step = F.sequence(F.lit(-reach), F.lit(reach))
    down = df.where(F.col(mask)).select("gc", F.col("gr").alias("_r"), F.explode(step).alias("_d")).groupBy((F.col("_r") + F.col("_d")).alias("gr"), "gc").agg(F.min(F.abs("_d")).alias("_h"))
    along = down.select("gr", F.col("gc").alias("_c"), "_h", F.explode(step).alias("_d")).where(F.col("_h") * F.col("_h") + F.col("_d") * F.col("_d") <= reach * reach)
    near = along.groupBy("gr", (F.col("_c") + F.col("_d")).alias("gc")).agg(F.min(F.col("_h") * F.col("_h") + F.col("_d") * F.col("_d")).alias("_s"))
    return df.join(near, ["gr", "gc"], "left").withColumn("distance", F.sqrt("_s")).drop("_s")


def ring_around(df: DataFrame, mask: str, width: int, size: int, columns: int) -> DataFrame:
    """The unset pixels within ``width`` cross steps of a mask, across tiles, as the column ``ring``."""
    from fieldspark.operators.focal import dilate

    return across(df.withColumn("ring", F.col(mask)), size, columns, width, lambda x: dilate(x, "ring", width)).withColumn("ring", F.col("ring") & ~F.col(mask))


def hydro_masks(means: DataFrame, size: int, columns: int, water: float, buffer: int = 2, least: int = 1) -> DataFrame:
    """``open_water``, ``seasonal_wet`` and the riparian rings ``riparian_soft`` and ``riparian_hard`` of pixels.

    ``means`` has ``tile_id, r, c, ndwi_max, ndwi_mean, mndwi_max, scl_water, n``.
    Open water exceeds ``water`` at some date or is so classified; wet pixels
    exceed 0.7 of it on average or half of it in MNDWI.  Both need ``least``
    observations.  The soft ring is within ``buffer`` steps of either, the hard
    one next to open water.
    """
    enough = F.col("n") >= least
    open_water = F.coalesce((F.col("scl_water") | (F.col("ndwi_max") > water) | (F.col("mndwi_max") > water)) & enough, F.lit(False))
    wet = F.coalesce(((F.col("ndwi_mean") > 0.7 * water) | (F.col("mndwi_max") > 0.5 * water)) & enough, F.lit(False)) & ~open_water
    made = means.select("tile_id", "r", "c", open_water.alias("open_water"), wet.alias("seasonal_wet")).withColumn("_either", F.col("open_water") | F.col("seasonal_wet"))
    soft = ring_around(made, "_either", buffer, size, columns).withColumnRenamed("ring", "riparian_soft")
    return ring_around(soft, "open_water", 1, size, columns).withColumnRenamed("ring", "riparian_hard").drop("_either")


def _label(tile: pd.DataFrame) -> pd.DataFrame:
    """Labels of one tile's set pixels: least ids over side neighbours, by jumping to the label's label."""
    ids, r, c = (tile[k].to_numpy() for k in ("id", "r", "c"))
    order = np.lexsort((c, r))
    ids, r, c = ids[order], r[order], c[order]
    key = r * (int(c.max()) + 2) + c
    label = np.arange(len(ids))
    pairs = []
    for step in (1, int(c.max()) + 2):
        at = np.searchsorted(key, key + step)
        hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step)
        pairs.append((np.flatnonzero(hit), at[hit]))
    u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)  # the roots hook to lower ones
        np.minimum.at(label, label[v], low)
        label = label[label]
        if (label == before).all():
            break
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return pd.DataFrame({"tile_id": tile["tile_id"].iloc[0], "r": r, "c": c, "id": ids, "component": least[label]})


def tile_components(mask: DataFrame) -> DataFrame:
    """Q2 within tiles: ``tile_id, r, c, id, component`` of set pixels, in one pass; a task handles a tile at a time."""
    kinds = {k: mask.schema[k].dataType.simpleString() for k in ("tile_id", "r", "c")}
    return mask.select("tile_id", "r", "c", F.col("id").cast("long").alias("id")).groupBy("tile_id").applyInPandas(_label, f"tile_id {kinds['tile_id']}, r {kinds['r']}, c {kinds['c']}, id long, component long")


def components(mask: DataFrame, size: int, columns: int) -> DataFrame:
    """Q2 over a whole mosaic: ``tile_id, r, c, id, component``, the least id of each connected area.

    Tiles are labelled on their own; only labels that touch over a border are
    joined by rounds, whose number depends on tiles crossed and not on pixels.
    """
    from fieldspark.operators.iterative import cut_lineage

    local = cut_lineage(tile_components(mask))
    rim = placed(local, size, columns).where(f"r in (0, {size - 1}) or c in (0, {size - 1})").select("gr", "gc", "tile_id", "component")
    other = rim.select("gr", "gc", F.col("tile_id").alias("_tile"), F.col("component").alias("v"))
    meets = [rim.join(other.withColumn(k, F.col(k) - 1), ["gr", "gc"]).where("tile_id <> _tile").select(F.col("component").alias("u"), "v") for k in ("gr", "gc")]
    edges = cut_lineage(meets[0].unionByName(meets[1]).distinct())
    nodes = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()
    joined = min_labels(nodes, edges).select(F.col("id").alias("component"), F.col("component").alias("_root"))
    return local.join(joined, "component", "left").select("tile_id", "r", "c", "id", F.coalesce("_root", "component").alias("component"))
