"""Manifests (S19, S21, S22): canonical items, digests that don't depend on order, checks of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Splits that a dataset must have.
SPLITS = ("train", "calibration", "holdout")
_PARTS, _DIGITS = 4, 15
_WRAP = 16**_DIGITS


def canonical(columns: list[str]) -> Column:
    """An item as JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def partial_digest(items: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, n, d0 .. d3``: sums of the pieces of each item's sha256, wrapped.

    Sums of disjoint parts of a manifest add up to those of the whole, so
    digests of partitions, days or files compose; order plays no part, and
    repeated items count as often as they come.
    """
    sha = F.sha2(canonical(columns), 256)
    pieces = [F.conv(F.substring(sha, 1 + i * _DIGITS, _DIGITS), 16, 10).cast("decimal(20,0)") for i in range(_PARTS)]
    return items.groupBy(*keys).agg(F.count("*").alias("n"), *((F.sum(p) % _WRAP).cast("decimal(20,0)").alias(f"d{i}") for i, p in enumerate(pieces)))


def composed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, digest`` from partial digests of any parts."""
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *((F.sum(f"d{i}") % _WRAP).cast("decimal(20,0)").alias(f"d{i}") for i in range(_PARTS)))
    return sums.select(*keys, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"d{i}").cast("string") for i in range(_PARTS))), 256).alias("digest"))


def manifest(items: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Items of each manifest and its digest."""
    return composed(partial_digest(items, keys, columns), keys)


def leaks(items: DataFrame, keys: list[str], area: str, split: str) -> DataFrame:
    """Areas that are in more than one of the known splits, with how many."""
    name = F.lower(F.trim(split))
    known = items.where(F.col(area).isNotNull() & name.isin(*SPLITS)).select(*keys, area, name.alias("_split")).distinct()
    return known.groupBy(*keys, area).agg(F.count("*").alias("splits")).where("splits > 1")


def checked(items: DataFrame, keys: list[str], area: str, split: str) -> DataFrame:
    """Per manifest its items, the splits that it lacks, areas in several splits, and the first error or null."""
    name = F.lower(F.trim(split))
    has = [F.max((name == s).cast("int")) for s in SPLITS]
    sums = items.groupBy(*keys).agg(F.count("*").alias("items"), F.concat_ws(",", *(F.when(F.coalesce(h, F.lit(0)) == 0, F.lit(s)) for h, s in zip(has, SPLITS, strict=True))).alias("missing"))
    out = sums.join(leaks(items, keys, area, split).groupBy(*keys).agg(F.count("*").alias("leaks")), keys, "left").withColumn("leaks", F.coalesce("leaks", F.lit(0).cast("long")))
    error = F.when(F.col("missing") != "", "manifest must include train, calibration and holdout splits").when(F.col("leaks") > 0, "an area is in several splits")
    return out.withColumn("error", error)


def registry(texts: DataFrame, file: str, text: str) -> DataFrame:
    """One row per source of registry files, given as JSON texts of one object or an array of such.

    ``source_id`` has only ``a-z0-9_``; a missing source is unknown, a missing
    country list is empty.  Texts that aren't JSON have no rows.
    """
    shape = "array<struct<source:string,artifact_uri:string,license:string,country:array<string>,year:int,label_type:string>>"
    one = F.explode(F.from_json(F.when(F.trim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(F.col(text)), shape)).alias("_x")
    found = texts.select(F.col(file).alias("manifest_file"), one).where(F.coalesce(F.col("_x.source"), F.col("_x.artifact_uri"), F.col("_x.label_type")).isNotNull())
    source = F.coalesce("_x.source", F.lit("unknown"))
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(source)), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return found.select(source.alias("source"), name.alias("source_id"), "_x.artifact_uri", "_x.license", F.coalesce("_x.country", F.array().cast("array<string>")).alias("country"), "_x.year", "_x.label_type", "manifest_file")
