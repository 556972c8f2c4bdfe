"""Hold-out metrics, run diagnosis and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspark.functions.agronomy import RANKING_REASONS, TERMINAL_REASONS, loss_stage
from fieldspark.operators import ranks

# Columns whose mean a mode's report has.
MEANS = (
    "iou", "iou_geo", "f1", "f1_geo", "precision", "recall", "boundary_iou", "boundary_iou_geo", "hausdorff_95_px", "hd95_m", "centroid_shift_m", "area_ratio_pred_gt",
    "missed_fields_count", "oversegmented_fields_count", "missed_fields_rate", "oversegmented_fields_rate",
)
# Fixed values: (output, column, rows it is the mean of).
SUBSET_MEANS = (
    ("boundary_iou_near_water", "boundary_iou", "water"), ("boundary_iou_near_road", "boundary_iou", "road"), ("missed_fields_near_water", "missed_fields_count", "water"), ("drifted_to_road_fields", "oversegmented_fields_count", "road"),
    ("field_recall_south", "recall", "south"), ("field_recall_north", "recall", "north"), ("oversegmented_fields_rate_south", "oversegmented_fields_rate", "south"), ("missed_fields_rate_south", "missed_fields_rate", "south"), ("centroid_shift_m_north", "centroid_shift_m", "north"),
)
# Fixed values: (output, column, rows, quantile).
SUBSET_QUANTILES = (
    ("hd95_m_p90", "hd95_m", "all", 0.9), ("area_ratio_geo_median", "area_ratio_geo_median", "all", 0.5), ("boundary_iou_north_median", "boundary_iou_geo", "north", 0.5), ("boundary_iou_south_median", "boundary_iou_geo", "south", 0.5),
    ("contour_shrink_ratio_north_median", "area_ratio_geo_median", "north", 0.5), ("centroid_shift_m_north_p90", "centroid_shift_m", "north", 0.9),
)
SKIP_MODES = ("skipped_budget", "skipped_error")
FALLBACK_MODES = ("fallback_non_sam", "skipped_budget", "skipped_error", "disabled")


def holdout_metrics(rows: DataFrame) -> DataFrame:
    """One row per ``mode`` with all means, medians, 90th percentiles, subset means, rates and latency quantiles.

    ``rows`` has the columns of MEANS, area_ratio_geo_median, latency_s,
    fallback_rate_tile (both may be null), water_adjacent_fields_present,
    road_complexity, region_band and sam_runtime_mode.  What has no rows is 0.
    """
    band = F.lower(F.coalesce("region_band", F.lit("")))
    subset = {"all": F.lit(True), "water": F.coalesce("water_adjacent_fields_present", F.lit(False)), "road": F.lower(F.coalesce("road_complexity", F.lit(""))).isin("medium", "high"), "south": band == "south", "north": band == "north"}
    kind = F.coalesce("sam_runtime_mode", F.lit(""))
    wide = rows.groupBy("mode").agg(
        F.count("*").alias("count"), *(F.avg(x).alias(x) for x in MEANS), F.avg("fallback_rate_tile").alias("fallback_rate_tile"),
        *(F.avg(F.when(subset[part], F.col(x))).alias(name) for name, x, part in SUBSET_MEANS),
        F.avg(kind.isin(*SKIP_MODES).cast("int")).alias("sam_skip_rate"), F.avg(kind.isin(*FALLBACK_MODES).cast("int")).alias("sam_fallback_rate"),
        F.avg(F.when(subset["south"], F.col("oversegmented_fields_count") + 1.0)).alias("mean_components_per_gt_field_south"),
    )
    # one long table, so that all quantiles take one pass
    parts = [F.struct(F.lit(name).alias("name"), F.when(subset[part], F.col(x).cast("double")).alias("value")) for name, x, part, _ in SUBSET_QUANTILES]
    long = rows.select("mode", F.inline(F.array(*parts, F.struct(F.lit("latency_s").alias("name"), F.col("latency_s").cast("double").alias("value")))))
    level = {name: q for name, _, _, q in SUBSET_QUANTILES}
    found = ranks.quantiles(long, ["mode", "name"], "value", {"p50": ranks.linear(0.5), "p90": ranks.linear(0.9), "low50": ranks.lower(0.5), "low95": ranks.lower(0.95)})
    picks = [F.max(F.when(F.col("name") == name, F.col("p50" if q == 0.5 else "p90"))).alias(name) for name, q in level.items()]
    late = [F.max(F.when(F.col("name") == "latency_s", F.col(x))).alias(y) for x, y in (("low50", "latency_p50"), ("low95", "latency_p95"))]
    return wide.join(found.groupBy("mode").agg(*picks, *late), "mode", "left").na.fill(0.0)


def mode_comparison(report: DataFrame, base: str, other: str) -> DataFrame:
    """Deltas of the second mode against the first, and go or no-go."""
    shown = ("iou", "f1", "boundary_iou", "hausdorff_95_px", "centroid_shift_m", "area_ratio_pred_gt")
    left = report.where(F.col("mode") == base).select(*(F.col(x).alias(f"_{x}") for x in shown))
    both = report.where(F.col("mode") == other).crossJoin(left)  # one row on each side
    deltas = {x: F.col(x) - F.col(f"_{x}") for x in shown}
    go = (F.col("fallback_rate_tile") <= 0.05) & (deltas["iou"] >= 0.04) & (deltas["f1"] >= 0.05) & (F.col("latency_p95") <= 120.0)
    return both.select(F.lit(base).alias("left_mode"), F.lit(other).alias("right_mode"), *(d.alias(f"delta_{x}") for x, d in deltas.items()), "latency_p95", "fallback_rate_tile", go.alias("go"))


def run_diagnosis(status: Column, total: Column, kept: Column, fields: Column, reasons: Column, has_tiles: Column) -> Column:
    """The stage at which a run lost its fields; ``reasons`` is the array of its reject reasons."""
    final = F.arrays_overlap(reasons, F.array(*(F.lit(x) for x in TERMINAL_REASONS)))
    outcomes = [
        (status.isin("failed", "stale", "cancelled"), "run_failed"), (F.coalesce(total, F.lit(0)) == 0, "candidate_generation"), (F.coalesce(kept, F.lit(0)) == 0, "rank_and_suppress"),
        (final, "obia_topology_cleanup"), (F.coalesce(fields, F.lit(0)) == 0, "rank_and_suppress"), (F.size(reasons) > 0, "partial_rank_and_suppress"), (~has_tiles, "unknown"),
    ]
    return F.coalesce(*(F.when(holds, F.lit(name)) for holds, name in outcomes), F.lit("no_major_recall_loss"))


def next_fix(diagnosis: Column, top_reasons: Column, recovery: Column, degraded: Column) -> Column:
    """What to mend next; ``recovery`` says that any tile had boundary recovery, ``degraded`` that a worst tile had degraded output."""
    ranked = F.arrays_overlap(top_reasons, F.array(*(F.lit(x) for x in RANKING_REASONS)))
    return (
        F.when(diagnosis == "candidate_generation", F.when(recovery, "generation_recovery_bias").otherwise("generation_harmonized_inputs"))
        .when(diagnosis.isin("rank_and_suppress", "partial_rank_and_suppress"), F.when(ranked, "ranking_thresholds").otherwise("ranking_object_features"))
        .when(diagnosis == "obia_topology_cleanup", "obia_topology_cleanup")
        .when(diagnosis == "run_failed", "runtime_failure")
        .when(diagnosis == "candidate_filtering", F.when(degraded, "degraded_output_thresholds").otherwise("candidate_filtering"))
        .otherwise("observe")
    )


def tile_losses(tiles: DataFrame) -> DataFrame:
    """``tiles`` (run, tile_id, total, kept, reasons) with the stage that lost each tile."""
    stages = F.transform(F.col("reasons"), loss_stage)
    has = lambda name: F.array_contains(stages, name)
    lost = F.when(has("rank_and_suppress"), "rank_and_suppress").when(has("obia_topology_cleanup"), "obia_topology_cleanup").otherwise("candidate_filtering")
    return tiles.withColumn("stage", F.when(F.coalesce("total", F.lit(0)) == 0, "candidate_generation").when(F.coalesce("kept", F.lit(0)) == 0, lost).otherwise("survived"))


def worst_tiles(losses: DataFrame, run: str, n: int = 8) -> DataFrame:
    """The n worst tiles of each run: lost ones first, then by candidates kept and found, ties by tile."""
    order = Window.partitionBy(run).orderBy(F.col("stage") == "survived", "kept", "total", "tile_id")
    return losses.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def top_reasons(rejects: DataFrame, run: str, n: int = 5) -> DataFrame:
    """A run's most frequent reject reasons in order, ties by name; ``rejects`` has one row per reject."""
    counts = rejects.where("reason is not null").groupBy(run, "reason").agg(F.count("*").alias("k"))
    first = counts.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("k"), "reason"))).where(F.col("place") <= n)
    return first.groupBy(run).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "reason"))), lambda x: x["reason"]).alias("reasons"))


# Regional targets of a promotion.
REGIONAL_TARGETS = (
    ("field_recall_south", ">=", 0.92), ("missed_fields_rate_south", "<=", 0.08), ("oversegmented_fields_rate_south", "<=", 0.12), ("mean_components_per_gt_field_south", "<=", 1.20),
    ("boundary_iou_south_median", ">=", 0.78), ("boundary_iou_north_median", ">=", 0.82), ("centroid_shift_m_north_p90", "<=", 5.0), ("north_inward_shrink_obvious_rate", "<=", 0.10),
)


def promotion_report(metrics: DataFrame) -> DataFrame:
    """All gates of a promotion per row; a missing metric is a reason, a missing baseline passes.

    Needs manual_holdout_size, iou_geo, baseline_iou_geo, hd95_m_p90,
    baseline_hd95_m_p90, contour_shrink_ratio_north_median and the regional
    targets; columns that aren't there count as missing.
    """
    have = set(metrics.columns)

    def value(name: str) -> Column:
        return F.col(name).cast("double") if name in have else F.lit(None).cast("double")

    def gate(name: str, fails: Column) -> Column:
        return F.when(value(name).isNull(), F.lit(f"{name}_missing")).when(fails, F.lit(f"{name}_failed"))

    shrink, base = value("contour_shrink_ratio_north_median"), value("baseline_hd95_m_p90")
    reasons = [
        F.when(F.coalesce(value("manual_holdout_size"), F.lit(0.0)) < 300, F.lit("manual_holdout_size_failed")),
        gate("iou_geo", value("iou_geo") < value("baseline_iou_geo") - 0.02),
        gate("hd95_m_p90", (base > 0) & (value("hd95_m_p90") > base * 1.10)),
        *(gate(name, value(name) < x if op == ">=" else value(name) > x) for name, op, x in REGIONAL_TARGETS),
        gate("contour_shrink_ratio_north_median", ~shrink.between(0.96, 1.04)),
    ]
    found = F.array_compact(F.array(*reasons))
    return metrics.withColumn("reasons", F.array_join(found, ",")).withColumn("passed", F.size(found) == 0)
