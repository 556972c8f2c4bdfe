"""Tables whose slices are replaced in place (S18, O7, S7, S9): folders by key, overwritten one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, by: list[str]) -> None:
    """A new table, one folder for each slice; rows are dealt by slice and a hash, so a large slice is written by many tasks."""
    spread = F.pmod(F.xxhash64(*(c for c in df.columns if c not in by)), F.lit(8))
    df.repartition(*by, spread).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def digests(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, d``: rows of each slice and a digest that order doesn't change."""
    rest = sorted(c for c in df.columns if c not in by)
    text = F.to_json(F.struct(*(F.col(c) for c in rest)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.xxhash64(text).cast("decimal(20,0)")).cast("string").alias("d"))


def replace(spark: SparkSession, new: DataFrame, path: str, by: list[str]) -> int:
    """Each slice that new has takes the place of the table's; returns how many were written.

    Slices with the same rows as before are left alone, so running it again
    changes nothing, and a run that was cut off may simply be repeated.  Files
    of other slices aren't touched.
    """
    old = spark.read.parquet(path)
    new = new.select(*(F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns))
    near = old.join(new.select(*by).distinct(), by, "left_semi")  # prunes folders at run time
    was = digests(near, by).withColumnRenamed("n", "_n").withColumnRenamed("d", "_d")
    same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in by]
    both = digests(new, by).alias("new").join(was.alias("old"), same, "left")
    changed = both.where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("d").eqNullSafe(F.col("_d")))).select(*(F.col(f"new.{c}").alias(c) for c in by)).persist()
    count = changed.count()
    if count:
        rows = new.alias("new").join(changed.alias("changed"), [F.col(f"new.{c}").eqNullSafe(F.col(f"changed.{c}")) for c in by], "left_semi")
        spread = F.pmod(F.xxhash64(*(c for c in new.columns if c not in by)), F.lit(8))
        rows.repartition(*by, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    changed.unpersist()
    return count
