"""Scoring, calibration and reports (M and parts of Z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspark.functions.weather import clip
from fieldspark.operators import ranks


def interval_buckets(residuals: DataFrame, keys: list[str], coverage: float = 0.9) -> DataFrame:
    """M6: half-width of each bucket's conformal interval and its confidence.

    The level, min(c (1 + 1/n), 1), varies with n; ranks come from range
    partitions, as the bucket of all regions holds every row of a crop.
    """
    a = residuals.where(F.col("residual").isNotNull()).withColumn("a", F.abs("residual"))
    width = ranks.quantiles(a, keys, "a", {"width": lambda n: F.least(coverage * (1 + 1 / n), F.lit(1.0)) * (n - 1)})
    inside = a.join(width, keys).groupBy(*keys, "n", "width").agg(F.avg((F.col("a") <= F.col("width")).cast("int")).alias("empirical"))
    close = 1 - F.abs(F.col("empirical") - coverage) / coverage
    return inside.withColumn("confidence", clip(close * F.least(F.col("n") / 15, F.lit(1.0)), 0.2, 0.95))


def with_interval(points: DataFrame, buckets: DataFrame, estimate: str, least: int = 5, coverage: float = 0.9) -> DataFrame:
    """The interval of (crop, region), else of (crop, global) widened by 15 %, else a heuristic one."""
    enough = buckets.where(F.col("n") >= least)
    own = enough.select("crop_code", "region", F.col("width").alias("_own"))
    world = enough.where("region = 'global'").select("crop_code", F.col("width").alias("_all"))
    both = points.join(own, ["crop_code", "region"], "left").join(world, "crop_code", "left")
    plain = F.greatest(F.col(estimate) * 0.2 * (1.645 if coverage >= 0.9 else 1.28), F.lit(250.0))
    width = F.coalesce("_own", F.col("_all") * 1.15, plain)
    method = F.when(F.col("_own").isNotNull(), "conformal").when(F.col("_all").isNotNull(), "conformal_global_fallback").otherwise("heuristic")
    return both.withColumn("width", width).withColumn("method", method).withColumn("lower", F.greatest(F.col(estimate) - F.col("width"), F.lit(0.0))).withColumn("upper", F.col(estimate) + F.col("width")).drop("_own", "_all")


def ridge(rows: DataFrame, group: str, features: list[str], target: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0)) -> DataFrame:
    """M3: per group the alpha of least leave-one-out error, its RMSE and coefficients.

    Spark sums the Gram matrix; only those small sums reach a group's solve.
    Leave-one-out errors follow in closed form from the leverages, e / (1 - h),
    computed by joining the solved coefficients back to the rows.
    """
    import numpy as np
    import pandas as pd

    names = ["_one", *features]
    flat = rows.select(group, F.lit(1.0).alias("_one"), *(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias("_y")).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = flat.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(F.col(x) * F.col("_y")).alias(f"b{i}") for i, x in enumerate(names)))

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                g = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    g[i, j] = g[j, i] = r[f"g{i}_{j}"]
                for alpha in alphas:
                    penalty = np.diag([0.0] + [alpha] * len(features))
                    inverse = np.linalg.pinv(g + penalty)
                    out.append((r[group], alpha, (inverse @ [r[f"b{i}"] for i in range(len(names))]).tolist(), inverse.ravel().tolist()))
            yield pd.DataFrame(out, columns=[group, "alpha", "coef", "inverse"])

    kind = rows.schema[group].dataType.simpleString()
    solved = sums.mapInPandas(solve, f"{group} {kind}, alpha double, coef array<double>, inverse array<double>")
    x = F.array(*(F.col(n) for n in names))
    k = len(names)
    both = flat.withColumn("x", x).join(solved, group)
    fit = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    leverage = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: F.get("x", (i / k).cast("int")) * F.get("x", i % k) * F.get("inverse", i)), F.lit(0.0), lambda a, b: a + b)
    error = (F.col("_y") - fit) / F.greatest(1 - leverage, F.lit(1e-6))
    scored = both.groupBy(group, "alpha").agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("loo_rmse"), F.first("coef").alias("coef"))
    best = F.row_number().over(Window.partitionBy(group).orderBy("loo_rmse", "alpha"))
    return scored.withColumn("_rn", best).where("_rn = 1").drop("_rn")


def tier(n: Column, coverage: Column) -> Column:
    """M4: how a prediction may be made, by rows of history and feature coverage."""
    return F.when(n >= 5, "calibrated").when(n >= 1, "scaled").when(coverage >= 0.42, "baseline").otherwise("unsupported")


def feature_coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """M1: the share of features that are there, and the names of the missing ones."""
    have = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in features)))
    return df.withColumn("coverage", have / len(features)).withColumn("missing", F.array_join(missing, ","))


def combined_factor(factors: list[Column]) -> Column:
    """0.6 geometric mean + 0.4 minimum, clipped."""
    logs = sum((F.ln(F.greatest(f, F.lit(1e-9))) for f in factors), F.lit(0.0))
    return clip(0.6 * F.exp(logs / len(factors)) + 0.4 * F.least(*factors), 0.15, 1.45)


def label_priority(u: Column, d: Column, r: Column, q: Column) -> Column:
    return 0.45 * u + 0.25 * d + 0.15 * r + 0.15 * q


def promotion_gates(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Reasons against promotion; a missing metric is one."""
    reasons = [F.when(F.col(m).isNull(), F.lit(f"{m}_missing")).when(F.col(m) < x if op == ">=" else F.col(m) > x, F.lit(f"{m}_failed")) for m, op, x in rules]
    found = F.array_compact(F.array(*reasons))
    return metrics.withColumn("reasons", F.array_join(found, ",")).withColumn("passed", F.size(found) == 0)


def superseded(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of a key is promoted, the others are superseded."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("state", F.when(rank == 1, "promoted").otherwise("superseded"))


def residual_buckets(rows: DataFrame, least: int = 5) -> DataFrame:
    """M5: residuals by crop and region, and by crop overall; hold-out rows if there are enough, else all, else none."""
    both = rows.unionByName(rows.withColumn("region", F.lit("global")))
    keys = ["crop_code", "region"]
    counts = both.groupBy(*keys).agg(F.count_if("holdout").alias("held"), F.count("*").alias("n"))
    kept = both.join(counts, keys).where(F.when(F.col("held") >= least, F.col("holdout")).otherwise(F.col("n") >= least))
    return kept.drop("held", "n")


def zones(cells: DataFrame, scores: dict[str, float], least: int = 6) -> DataFrame:
    """Zones by tertiles of a weighted z-score over a field's cells, from six cells on.

    Scores have nine decimals, so that cells alike fall in one zone; the 1e-12
    before rounding lets sums that should tie fall the same way.
    """
    x = {n: F.col(n) for n in scores}
    # all metrics in one pass, as a join back for each would double the plan every time
    one = cells.groupBy("field_id").agg(F.count("*").alias("_n"), *(f(v).alias(f"_{k}_{n}") for n, v in x.items() for k, f in (("med", lambda v: F.percentile(v, F.lit(0.5))), ("avg", F.avg), ("std", F.stddev_pop)))).where(F.col("_n") >= least)
    near = cells.join(one.hint("merge"), "field_id")  # one row a field is too much for a broadcast
    mad = near.groupBy("field_id").agg(*(F.percentile(F.abs(v - F.col(f"_med_{n}")), F.lit(0.5)).alias(f"_mad_{n}") for n, v in x.items()))
    z = {n: F.when(F.col(f"_mad_{n}") > 1e-9, 0.6745 * (v - F.col(f"_med_{n}")) / F.col(f"_mad_{n}")).when(F.col(f"_std_{n}") > 1e-9, (v - F.col(f"_avg_{n}")) / F.col(f"_std_{n}")) for n, v in x.items()}
    total = sum((F.coalesce(z[n], F.lit(0.0)) * w for n, w in scores.items()), F.lit(0.0))
    out = near.join(mad.hint("merge"), "field_id").select(*cells.columns, F.round(total + 1e-12, 9).alias("score"))
    cuts = out.groupBy("field_id").agg(F.percentile("score", F.lit(0.33333)).alias("_a"), F.percentile("score", F.lit(0.66666)).alias("_b"))
    zone = F.when(F.col("score") <= F.col("_a"), "low").when(F.col("score") <= F.col("_b"), "medium").otherwise("high")
    return out.join(cuts.hint("merge"), "field_id").withColumn("zone", zone).drop("_a", "_b")


def zone_shares(zoned: DataFrame, coverage: str, area: str, baseline: str | None = None, confidence: str | None = None) -> DataFrame:
    """Each cell's share and part of its field's area, multiplier, predicted yield and confidence.

    Where a field has a positive ``baseline`` (a column), multipliers, clipped,
    are scaled to an area-weighted mean of 1 and the baseline times them is
    predicted; elsewhere they stay as clipped, nothing is predicted, and
    confidence is 0.58.
    """
    raw = clip(1 + 0.12 * F.col("score"), 0.75, 1.25)
    known = F.coalesce(F.col(baseline) > 0, F.lit(False)) if baseline else F.lit(True)
    rows = zoned.withColumn("weight", F.greatest(F.coalesce(F.col(coverage), F.lit(0.0)), F.lit(0.01))).withColumn("_raw", raw)
    totals = rows.groupBy("field_id").agg(F.sum("weight").alias("_total"), (F.sum(F.col("_raw") * F.col("weight")) / F.sum("weight")).alias("_mean"))
    out = rows.join(totals.hint("merge"), "field_id").withColumn("share", F.col("weight") / F.greatest("_total", F.lit(1e-6)))
    out = out.withColumn("multiplier", F.when(known, F.col("_raw") / F.greatest("_mean", F.lit(1e-6))).otherwise(F.col("_raw"))).withColumn("cell_area_m2", F.round(F.col(area) * F.col("share") + 1e-7, 4))
    predicted = F.when(known, F.round(F.col(baseline) * F.col("multiplier") + 1e-7, 4)) if baseline else F.lit(None).cast("double")
    sure = clip(F.when(known, F.col(confidence)).otherwise(F.lit(0.58)), 0.42, 0.92) if confidence else F.lit(0.58)
    return out.withColumn("predicted", predicted).withColumn("confidence", sure).drop("weight", "_raw", "_total", "_mean")


def zone_summary(shared: DataFrame) -> DataFrame:
    """Cells, area, mean score, mean predicted yield and confidence of each zone of a field."""
    means = [F.round(F.avg(x) + 1e-10, 7).alias(y) for x, y in (("score", "mean_score"), ("multiplier", "multiplier"), ("predicted", "predicted"))]
    return shared.groupBy("field_id", "zone").agg(F.count("*").alias("cells"), F.round(F.sum("cell_area_m2") + 1e-6, 3).alias("area_m2"), F.round(F.sum("share") * 100 + 1e-10, 7).alias("area_share_pct"), *means, F.max("confidence").alias("confidence"))
