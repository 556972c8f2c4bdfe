"""Run rollup (Z40): one row per run from its tiles' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Means and what stands for one without values, decimals, categories and their defaults, limits of risk.
MEANS = {
    "ml_extent_threshold": None, "contour_shrink_ratio": None, "centroid_shift_m": None, "selected_date_confidence_mean": None, "edge_signal_p90": 0.0, "ml_quality_score": 0.0,
    "tta_consensus": None, "boundary_uncertainty": None, "geometry_confidence": None, "tta_extent_disagreement": None, "tta_boundary_disagreement": None,
}
DECIMALS = 4
CATEGORIES = {"geometry_refine_profile": "unknown", "uncertainty_source": None, "fusion_profile": "none", "sam_runtime_mode": "fallback_non_sam", "model_backend": "unknown"}
ANY = {"date_selection_low_confidence": "low_quality_input", "road_barrier_retry_used": "road_barrier_retry_used"}
RISKS = {"water_edge_risk_detected": ("water_edge_overlap_ratio", 0.05), "road_drift_risk_detected": ("road_edge_overlap_ratio", 0.08)}


def one_or_mixed(name: str, default: str | None) -> Column:
    """The single non-blank value of a group, mixed if there are several, else the default."""
    value = F.when(F.trim(name) != "", F.trim(name))
    return F.when(F.min(value).isNull(), F.lit(default)).when(F.min(value) == F.max(value), F.min(value)).otherwise("mixed")


def run_rollup(tiles: DataFrame, run: str) -> DataFrame:
    """Means, mean number of valid scenes, categories, flags, actions in order, and a signature of all scenes.

    Nulls don't count in means; a flag that is nowhere set is false.  The
    signature is the first half of the sha1 of the tiles' signatures, sorted
    and joined, or empty.
    """
    means = [F.coalesce(F.round(F.avg(x) + 1e-12, DECIMALS), F.lit(none).cast("double")).alias(x) for x, none in MEANS.items()]
    signature = F.when(F.trim("selected_scene_signature") != "", F.trim("selected_scene_signature"))
    joined = F.array_join(F.sort_array(F.collect_list(signature)), "|")
    return tiles.groupBy(run).agg(
        F.count("*").alias("tiles"),
        *means,
        F.coalesce(F.bround(F.avg("n_valid_scenes"), 0), F.lit(0)).cast("int").alias("n_valid_scenes"),
        *(one_or_mixed(x, none).alias(x) for x, none in CATEGORIES.items()),
        *(F.coalesce(F.bool_or(x), F.lit(False)).alias(name) for name, x in ANY.items()),
        *(F.coalesce(F.bool_or(F.col(x) > least), F.lit(False)).alias(name) for name, (x, least) in RISKS.items()),
        F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set("region_profile_actions")), lambda x: F.trim(x) != ""))), ",").alias("region_profile_actions"),
        F.when(joined == "", "").otherwise(F.substring(F.sha1(joined), 1, 16)).alias("selected_scene_signature"),
    )
