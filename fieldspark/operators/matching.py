"""Matches and merges of overlapping shapes (J16, J17, Q1, Z37) and change reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.iterative import TASK_EDGES, by_component, cut_lineage, min_labels, split_by_size
from fieldspark.operators.relational import box_iou, box_join, overlap_area

BOX = ("minx", "miny", "maxx", "maxy")


def match_in_order(pairs: DataFrame, truth: str, pred: str, score: str, least: float = 0.2) -> DataFrame:
    """One-to-one matches as truths choose in order of their id, each the best prediction still free.

    Of equal scores the smaller prediction id is chosen; ids are whole numbers.
    Truths and predictions that hang together by pairs are decided in one pass,
    however long a chain of refusals is, where they have up to TASK_EDGES
    pairs.  In larger components all truths propose at once and a prediction
    holds the earliest of them; refused pairs go and the refused propose again.
    As all predictions rank the truths alike, that gives the same matches.
    """
    import pandas as pd

    left = cut_lineage(pairs.where(F.col(score) >= least).select(truth, pred, score))
    side = left.select((F.col(truth) * 2).alias("u"), (F.col(pred) * 2 + 1).alias("v"))
    labels = min_labels(side.select(F.col("u").alias("id")), side)
    kinds = {x: left.schema[x].dataType.simpleString() for x in (truth, pred, score)}

    def decide(rows):
        used: set = set()
        out, done = [], object()
        for t, p, x in rows.sort_values([truth, score, pred], ascending=[True, False, True])[[truth, pred, score]].itertuples(index=False):
            if t != done and p not in used:
                used.add(p)
                out.append((t, p, x))
                done = t
        return pd.DataFrame(out, columns=[truth, pred, score])

    small, large = split_by_size(left.withColumn("_id", F.col(truth) * 2), labels, "_id", TASK_EDGES)
    made = by_component(small.drop("_id"), decide, ", ".join(f"{x} {kind}" for x, kind in kinds.items()))
    return made if large.isEmpty() else made.unionByName(_by_proposals(large.select(truth, pred, score), truth, pred, score))


def _by_proposals(left: DataFrame, truth: str, pred: str, score: str) -> DataFrame:
    left = cut_lineage(left)
    while True:
        best = left.groupBy(truth).agg(F.min_by(F.struct(pred, score), F.struct(-F.col(score), F.col(pred))).alias("_b")).select(truth, F.col(f"_b.{pred}").alias(pred), F.col(f"_b.{score}").alias(score))
        best = cut_lineage(best)
        held = best.groupBy(pred).agg(F.min(truth).alias("_first"))
        refused = best.join(held, pred).where(F.col(truth) != F.col("_first")).select(truth, pred)
        after = cut_lineage(left.join(refused, [truth, pred], "left_anti"))
        if refused.isEmpty():
            return best
        left = after


def mismatches(matches: DataFrame, truths: DataFrame, preds: DataFrame, truth: str, pred: str, by: str) -> DataFrame:
    """J17's counts and rates of missed truths and surplus predictions, per ``by``."""
    t = truths.join(matches.select(truth, F.lit(1).alias("_hit")), truth, "left").groupBy(by).agg(F.count("*").alias("truths"), F.count("_hit").alias("matched"))
    p = preds.join(matches.select(pred, F.lit(1).alias("_hit")), pred, "left").groupBy(by).agg(F.count("*").alias("preds"), F.count("_hit").alias("_used"))
    both = t.join(p, by, "full").na.fill(0, ["truths", "matched", "preds", "_used"])
    missed, surplus, size = F.col("truths") - F.col("matched"), F.col("preds") - F.col("_used"), F.greatest("truths", F.lit(1))
    return both.select(by, "truths", "preds", missed.alias("missed_fields_count"), surplus.alias("oversegmented_fields_count"), (missed / size).alias("missed_fields_rate"), (surplus / size).alias("oversegmented_fields_rate"))


def merge_supports(primary: DataFrame, support: DataFrame, least: float) -> DataFrame:
    """Primary boxes, each united with its best support from an overlap share on; supports that meet no result stay alone.

    Both have ``id`` and a box; equal shares go to the smaller support id.  A
    union is the box of both.  Output: id, origin, partner and the box.
    """
    pairs = box_join(primary.select("id", *BOX), support.select("id", *BOX)).withColumn("iou", box_iou())
    best = pairs.groupBy("id").agg(F.max_by(F.struct(F.col("r_id").alias("partner"), "iou", *(f"r_{x}" for x in BOX)), F.struct("iou", -F.col("r_id"))).alias("b")).where(F.col("b.iou") >= least)
    joined = primary.select("id", *BOX).join(best, "id", "left")
    wide = [(F.least if x.startswith("min") else F.greatest)(F.col(x), F.coalesce(F.col(f"b.r_{x}"), F.col(x))).alias(x) for x in BOX]
    merged = cut_lineage(joined.select("id", F.lit("primary").alias("origin"), F.col("b.partner").alias("partner"), *wide))
    met = box_join(support.select("id", *BOX), merged.select("id", *BOX)).select("id").distinct()
    alone = support.select("id", *BOX).join(met, "id", "left_anti").join(merged.select(F.col("partner").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    return merged.unionByName(alone.select("id", F.lit("support").alias("origin"), F.lit(None).cast(merged.schema["partner"].dataType).alias("partner"), *BOX))


def merge_overlapping(items: DataFrame, means: list[str], maxima: list[str], least_share: float = 0.0) -> DataFrame:
    """Q1 with Z37: one row per component of boxes that overlap by a share of the smaller one.

    ``items`` has id and a box.  ``means`` and ``maxima`` skip nulls and values
    that aren't finite; a group without any gets null.
    """
    boxes = items.select("id", *BOX)

    def size(prefix: str) -> Column:
        return (F.col(f"{prefix}maxx") - F.col(f"{prefix}minx")) * (F.col(f"{prefix}maxy") - F.col(f"{prefix}miny"))

    edges = box_join(boxes, boxes).where("id < r_id").where(overlap_area() >= least_share * F.least(size(""), size("r_"))).select(F.col("id").alias("u"), F.col("r_id").alias("v"))
    labelled = items.join(min_labels(boxes.select("id"), edges), "id")

    def finite(x: str) -> Column:
        v = F.col(x).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    corners = [(F.min if x.startswith("min") else F.max)(x).alias(x) for x in BOX]
    return labelled.groupBy("component").agg(F.count("*").alias("members"), *corners, *(F.avg(finite(x)).alias(x) for x in means), *(F.max(finite(x)).alias(x) for x in maxima))


def geometry_change(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Per ``by``, mean ratio of areas, mean and largest shift of centroids, and up to five reasons in order.

    Both have ``id``, a box and ``by``; ``before`` may have ``reason``.  Areas
    and shifts are in squared and plain degrees of the boxes.
    """
    other = after.select("id", *(F.col(x).alias(f"r_{x}") for x in BOX))
    ratio = (F.col("r_maxx") - F.col("r_minx")) * (F.col("r_maxy") - F.col("r_miny")) / F.nullif((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), F.lit(0.0))
    shift = F.hypot((F.col("r_minx") + F.col("r_maxx") - F.col("minx") - F.col("maxx")) / 2, (F.col("r_miny") + F.col("r_maxy") - F.col("miny") - F.col("maxy")) / 2)
    both = before.join(other, "id", "left").withColumn("ratio", ratio).withColumn("shift", shift)
    reasons = F.array_join(F.slice(F.sort_array(F.collect_set("reason")), 1, 5), ",")
    return both.groupBy(by).agg(F.count("*").alias("before"), F.count("r_minx").alias("after"), F.avg("ratio").alias("area_ratio_mean"), F.avg("shift").alias("centroid_shift_mean"), F.max("shift").alias("centroid_shift_max"), reasons.alias("reasons"))
