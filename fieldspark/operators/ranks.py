"""Ranks, quantiles and running totals whose groups may hold a whole table.

Rows are dealt by ranges of (keys, value), so no task holds a group; only one
row per group and partition is ordered in a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspark.operators.iterative import cut_lineage


def cumulated(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Rows with ``name``, the sum of ``amount`` over the rows before them in their group.

    ``keys`` and ``order`` together must tell rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # the checkpoint fixes which partition a row is in
    fixed = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    sums = fixed.groupBy(*keys, "_part").agg(F.sum(amount).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), start.alias("_start"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.sum(amount).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    return fixed.withColumn("_within", within).join(starts, same).withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_p", "_start", "_within", *(f"_k{i}" for i in range(len(keys))))


def linear(q: float) -> Callable[[Column], Column]:
    """The place of a quantile between the two values around it."""
    return lambda n: F.lit(q) * (n - 1)


def lower(q: float) -> Callable[[Column], Column]:
    """The place of the value at or below a quantile."""
    return lambda n: F.floor(F.lit(q) * (n - 1))


def quantiles(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact quantiles per group, from counts of its distinct values.

    ``places`` gives for each output the place, from 0, as a function of the
    group's size; between two places the value is interpolated.  Nulls and NaN
    don't count.  Output: keys, n and one column a place.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = clean.groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
    ranked = cumulated(counts, keys, ["_v"], "_k", "_before")
    sizes = counts.groupBy(*keys).agg(F.sum("_k").alias("n"))
    if keys:
        same = None
        renamed = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "n")
        for i, k in enumerate(keys):
            one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
            same = one if same is None else same & one
        sized = ranked.join(renamed, same).drop(*(f"_k{i}" for i in range(len(keys))))
    else:
        sized = ranked.crossJoin(F.broadcast(sizes))  # one row
    n = F.col("n")

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_k")), F.col("_v")))

    out = []
    for name, place in places.items():
        low = F.floor(place(n))
        share = F.max(place(n) - low)
        first, second = at(low), at(F.least(low + 1, n - 1))
        out.append((first + (second - first) * share).alias(name))
    return sized.groupBy(*keys, "n").agg(*out)
