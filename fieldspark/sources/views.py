"""Domain views over the given tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

VIEWS = {
    "fields": """select *, (maxx - minx) * 111320e0 * cos(radians((miny + maxy) / 2e0)) * (maxy - miny) * 111320e0 as area_m2,
        2e0 * ((maxx - minx) * 111320e0 * cos(radians((miny + maxy) / 2e0)) + (maxy - miny) * 111320e0) as perimeter_m
      from (select c_custkey as field_id, 30e0 + (c_custkey % 40) * 1e-2 as minx, 45e0 + floor(c_custkey / 40e0) * 1e-2 as miny,
          30e0 + (c_custkey % 40) * 1e-2 + 6e-3 + (c_custkey % 5) * 2e-3 as maxx, 45e0 + floor(c_custkey / 40e0) * 1e-2 + 6e-3 + (c_custkey % 5) * 2e-3 as maxy,
          c_nationkey as org, (c_acctbal + 1000e0) / 11000e0 as quality_score,
          case c_mktsegment when 'HOUSEHOLD' then 'manual' when 'FURNITURE' then 'merged_hidden' else 'autodetect' end as source from customer) as f""",
    "parcel_rects": """select field_id, round(x1, 9) as x1, round(y1, 9) as y1, round(x2, 9) as x2, round(y2, 9) as y2 from (
        select field_id, minx as x1, miny as y1, maxx as x2, (miny + maxy) / 2e0 as y2 from fields where field_id % 3 = 0 union all
        select field_id, minx, (miny + maxy) / 2e0, (minx + maxx) / 2e0, maxy from fields where field_id % 3 = 0 union all
        select field_id, minx, miny, maxx, miny + (maxy - miny) / 3e0 from fields where field_id % 3 = 1 union all
        select field_id, minx, maxy - (maxy - miny) / 3e0, maxx, maxy from fields where field_id % 3 = 1 union all
        select field_id, minx, miny + (maxy - miny) / 3e0, minx + (maxx - minx) / 3e0, maxy - (maxy - miny) / 3e0 from fields where field_id % 3 = 1 union all
        select field_id, maxx - (maxx - minx) / 3e0, miny + (maxy - miny) / 3e0, maxx, maxy - (maxy - miny) / 3e0 from fields where field_id % 3 = 1 union all
        select field_id, minx, miny, minx + (maxx - minx) * 4e-1, maxy from fields where field_id % 3 = 2 union all
        select field_id, maxx - (maxx - minx) * 4e-1, miny, maxx, maxy from fields where field_id % 3 = 2) as p""",
    "grid_cells": """select p_partkey as cell_id, 30e0 + (p_partkey % 80) * 5e-3 as minx, 45e0 + floor(p_partkey / 80e0) * 5e-3 as miny,
        30e0 + (p_partkey % 80) * 5e-3 + 5e-3 as maxx, 45e0 + floor(p_partkey / 80e0) * 5e-3 + 5e-3 as maxy, p_partkey % 3 as zoom_level,
        p_size / 50e0 as ndvi_mean, (p_partkey % 21 - 10) / 20e0 as ndmi_mean, (p_partkey % 17 - 8) / 20e0 as bsi_mean,
        (p_partkey % 11) / 30e0 as soil_moist, (p_partkey % 10) / 10e0 as field_coverage, (p_partkey % 13) / 6e0 as vpd_mean, (p_partkey % 9) / 2e0 as wind_speed_m_s, p_partkey % 7 as run_id from part""",
    "pixels": """select l_suppkey as tile_id, l_linenumber as t, l_orderkey % 8 as r, l_partkey % 8 as c, 2e-2 + avg(l_discount) as b2, 3e-2 + avg(l_tax) as b3,
        3e-2 + avg(l_quantity) / 400e0 as b4, 1e-1 + avg(l_extendedprice) / 200000e0 as b8, 5e-2 + avg(l_quantity) / 250e0 as b11,
        (sum(l_partkey) + max(l_linenumber)) % 12 as scl from lineitem group by 1, 2, 3, 4""",
    "indexed": """select *, (b8 - b4) / nullif(b8 + b4, 0e0) as ndvi, (b3 - b8) / nullif(b3 + b8, 0e0) as ndwi, (b3 - b11) / nullif(b3 + b11, 0e0) as mndwi,
        (b8 - b11) / nullif(b8 + b11, 0e0) as ndmi, scl in (4, 5, 6) as valid from pixels""",
    "pixel_labels": """select distinct tile_id, r, c, case when (r + c) % 7 > 0 then 1 + cast(floor(r / 4e0) * 2 + floor(c / 4e0) as bigint) else 0 end as label from pixels""",
    "metric_obs": """select event_id, user_id as field_id, case event_type when 'view' then 'ndvi' when 'click' then 'ndmi' when 'purchase' then 'ndwi' when 'signup' then 'bsi' else 'ndre' end as metric,
        cast(date '2024-03-01' + 8 * (cast(day(ts) as int) - 1) as date) as observed_on, value / (value + 20e0) as value,
        case when event_id % 3 = 0 then 'run_snapshot' else 'historical_backfill' end as source, ts from events""",
    "field_seasons": """select o_orderkey as season_id, o_custkey as field_id, year(o_orderdate) as season_year, case substring(o_orderpriority, 1, 1) when '1' then 'wheat' when '2' then 'barley' when '3' then 'corn' when '4' then 'sunflower' else 'soy' end as crop_code,
        cast(o_orderdate as date) as assigned_at from orders""",
    "yield_obs": "select o_orderkey as obs_id, o_custkey as field_id, year(o_orderdate) as season_year, o_totalprice / 100e0 as yield_kg_ha, cast(o_orderdate as date) as observed_on from orders",
    "weather_daily": """select o_orderkey as row_id, o_custkey as field_id, cast(o_orderdate as date) as observed_on, case when o_orderkey % 17 = 0 then null else (o_orderkey % 300) / 10e0 end as tmean,
        (o_orderkey % 50) / 5e0 as precip, (o_orderkey % 40) / 10e0 as vpd, (o_orderkey % 11) / 30e0 as soil, greatest((o_orderkey % 300) / 10e0 - 10e0, 0e0) as gdd from orders""",
    "weather_fallback": """select o_orderkey as row_id, o_custkey as field_id, cast(o_orderdate as date) as observed_on, (o_orderkey % 280) / 10e0 as tmean, (o_orderkey % 45) / 5e0 as precip, (o_orderkey % 35) / 10e0 as vpd,
        (o_orderkey % 13) / 30e0 as soil from orders where o_orderkey % 7 < 5""",
    "soil_profiles": """select o_orderkey as profile_id, o_custkey as field_id, cast(o_orderdate as date) as sampled_at, 4e0 + (o_orderkey % 45) / 10e0 as ph, o_orderkey % 60 as n_ppm,
        case o_orderstatus when 'F' then 'sand' when 'O' then 'clay' else 'loam' end as texture from orders""",
    "management_events": """select l_orderkey as order_id, l_linenumber as line_id, o_custkey as field_id, cast(l_shipdate as date) as event_date, year(o_orderdate) as season_year, case l_returnflag when 'R' then 'irrigation' when 'A' then 'fertilizer' else 'pesticide' end as event_type,
        l_quantity as amount, case l_linestatus when 'O' then 'cm' else 'mm' end as unit from lineitem join orders on l_orderkey = o_orderkey""",
    "runs": "select o_orderkey as run_id, o_custkey % 25 as org, cast(o_orderdate as date) as created_at, case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'queued' end as status, o_totalprice / 1000e0 as progress from orders",
    "qa_results": "select event_id, user_id % 12 as region, value as queue_wall_s, case when event_type = 'error' then 'failed' else 'done' end as status, value < 1 as empty_output, event_id % 60 as field_count from events",
    "holdout_rows": """select event_id, case when event_id % 2 = 0 then 'rule_based' else 'ml_primary' end as mode, event_id % 61 / 60e0 as iou, event_id % 53 / 60e0 as iou_geo, event_id % 59 / 58e0 as f1, event_id % 47 / 50e0 as f1_geo, event_id % 43 / 42e0 as precision,
        event_id % 41 / 40e0 as recall, event_id % 37 / 36e0 as boundary_iou, event_id % 31 / 30e0 as boundary_iou_geo, event_id % 29 / 2e0 as hausdorff_95_px, value / 7e0 as hd95_m, value / 11e0 as centroid_shift_m, 9e-1 + event_id % 23 / 100e0 as area_ratio_pred_gt,
        94e-2 + event_id % 19 / 200e0 as area_ratio_geo_median, event_id % 7 as missed_fields_count, event_id % 5 as oversegmented_fields_count, event_id % 7 / 60e0 as missed_fields_rate, event_id % 5 / 60e0 as oversegmented_fields_rate,
        case when event_id % 13 > 0 then value end as latency_s, case when event_id % 17 > 0 then event_id % 10 / 100e0 end as fallback_rate_tile, event_id % 6 = 0 as water_adjacent_fields_present,
        case event_id % 4 when 0 then 'low' when 1 then 'Medium' when 2 then 'high' end as road_complexity, case user_id % 3 when 0 then 'south' when 1 then 'North' else 'central' end as region_band,
        case event_id % 9 when 0 then 'skipped_budget' when 1 then 'fallback_non_sam' when 2 then 'disabled' when 3 then null else 'full' end as sam_runtime_mode from events""",
    "tile_rows": """select event_id as tile_id, user_id as run, event_id % 5 as total, (event_id % 5) * (event_id % 3) as kept, case event_id % 6 when 0 then 'below_min_score' when 1 then 'dropped_after_merge' when 2 then 'area' when 3 then 'suppressed_by_8' end as reason,
        case when event_id % 50 = 7 then 'degraded_output' when event_id % 40 = 3 then 'boundary_recovery' else 'normal' end as profile, event_type from events""",
    "label_versions": "select conv_id as label_task_id, turn as version_no, case role when 'user' then 'pending' else 'approved' end as decision, length(coalesce(text, '')) as size from conversations",
    "point_weather": "select event_id, 45e0 + (user_id % 20) * 1e-1 as lat, 30e0 + (user_id % 30) * 1e-1 as lon, ts as observed_at, event_type as provider, value from events",
    "weekly_ndvi": """select field_id, cast(date_trunc('week', observed_on) as date) as week_start, avg(value) as v, max(value) as vmax, count(*) as n from metric_obs where metric = 'ndvi' group by 1, 2""",
    "weekly_weather": """select field_id, year(observed_on) as season_year, cast(date_trunc('week', observed_on) as date) as week_start, avg(tmean) as tmean, sum(precip) as precip, avg(vpd) as vpd, sum(gdd) as gdd, count(*) as n from weather_daily group by 1, 2, 3""",
}


def named_in(sql: str) -> list[str]:
    """Views that a statement refers to, what they need before themselves."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in [*named_in(VIEWS[name]), name] if x not in out] if name not in out else []
    return out


def with_views(sql: str) -> str:
    """A DuckDB statement with the views that it needs as common table expressions."""
    parts = ", ".join(f"{name} as ({VIEWS[name]})" for name in named_in(sql))
    if not parts:
        return sql
    text = sql.strip()
    if text[:15].lower() == "with recursive ":
        return f"with recursive {parts}, {text[15:]}"
    if text[:5].lower() == "with ":
        return f"with {parts}, {text[5:]}"
    return f"with {parts} {text}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over such, as a DataFrame; nothing is registered."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = [x for x in (*TABLES, *VIEWS) if x != name and re.search(rf"\b(?:from|join) {x}\b", sql)]
    for x in used:
        sql = re.sub(rf"\b(from|join) {x}\b", rf"\1 {{{x}}}", sql)
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in used})
