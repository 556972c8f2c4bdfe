"""Registered queries of matches, merges, hold-out reports, diagnoses, gates, imports, caches and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import agronomy as ag
from fieldspark.functions import suitability as su
from fieldspark.operators import dates, imports, matching, relational, reports, scoring
from fieldspark.plans.queries import _BOXES, _FLAT, ORACLE_SQL, _iou_pairs, register
from fieldspark.sources import readers
from fieldspark.sources.views import with_views
from fieldspark.streaming import weather_cache

c = F.col

# --- hold-out reports, diagnosis, gates -------------------------------------------------------------------------

_PART = {"all": "true", "water": "water_adjacent_fields_present", "road": "lower(road_complexity) in ('medium', 'high')", "south": "lower(region_band) = 'south'", "north": "lower(region_band) = 'north'"}
_Z27 = ", ".join(
    [f"avg({x}) as {x}" for x in reports.MEANS]
    + [f"coalesce(avg({x}) filter (where {_PART[p]}), 0) as {n}" for n, x, p in reports.SUBSET_MEANS]
    + [f"coalesce(quantile_cont({x}, {q}) filter (where {_PART[p]}), 0) as {n}" for n, x, p, q in reports.SUBSET_QUANTILES]
    + ["coalesce(avg(fallback_rate_tile), 0) as fallback_rate_tile", "avg(case when sam_runtime_mode in ('skipped_budget', 'skipped_error') then 1 else 0 end) as sam_skip_rate"]
    + ["avg(case when sam_runtime_mode in ('fallback_non_sam', 'skipped_budget', 'skipped_error', 'disabled') then 1 else 0 end) as sam_fallback_rate"]
    + ["coalesce(avg(oversegmented_fields_count + 1) filter (where lower(region_band) = 'south'), 0) as mean_components_per_gt_field_south"]
    + ["coalesce(list_sort(list(latency_s) filter (where latency_s is not null))[1 + floor(0.5e0 * (count(latency_s) - 1))::int], 0) as latency_p50"]
    + ["coalesce(list_sort(list(latency_s) filter (where latency_s is not null))[1 + floor(0.95e0 * (count(latency_s) - 1))::int], 0) as latency_p95"]
)
_Z27_NAMES = [*reports.MEANS, *(n for n, *_ in reports.SUBSET_MEANS), *(n for n, *_ in reports.SUBSET_QUANTILES), "fallback_rate_tile", "sam_skip_rate", "sam_fallback_rate", "mean_components_per_gt_field_south", "latency_p50", "latency_p95"]
register("z27_mode_report", lambda v: reports.holdout_metrics(v("holdout_rows")), f"select mode, count(*) as count, {_Z27} from holdout_rows group by 1", " ".join(_Z27_NAMES))
_DELTAS = ("iou", "f1", "boundary_iou", "hausdorff_95_px", "centroid_shift_m", "area_ratio_pred_gt")
register(
    "z29_go_no_go",
    lambda v: reports.mode_comparison(reports.holdout_metrics(v("holdout_rows")), "rule_based", "ml_primary"),
    f"""with m as (select mode, count(*) as count, {_Z27} from holdout_rows group by 1) select a.mode as left_mode, b.mode as right_mode, {", ".join(f"b.{x} - a.{x} as delta_{x}" for x in _DELTAS)}, b.latency_p95, b.fallback_rate_tile,
       b.fallback_rate_tile <= 0.05 and b.iou - a.iou >= 0.04 and b.f1 - a.f1 >= 0.05 and b.latency_p95 <= 120 as go from m a cross join m b where a.mode = 'rule_based' and b.mode = 'ml_primary'""",
    " ".join(f"delta_{x}" for x in _DELTAS) + " latency_p95 fallback_rate_tile",
)


def _tile_losses(v):
    return reports.tile_losses(v("tile_rows").withColumn("reasons", F.array_compact(F.array("reason", F.when(c("tile_id") % 4 == 0, "dropped_after_merge")))))


_STAGES = """st as (select *, case when total = 0 then 'candidate_generation' when kept = 0 then case when reason in ('below_min_score', 'suppressed_by_8') then 'rank_and_suppress' when reason = 'dropped_after_merge' or tile_id % 4 = 0 then 'obia_topology_cleanup' else 'candidate_filtering' end else 'survived' end as stage from tile_rows)"""
register("z25_stage_counts", lambda v: _tile_losses(v).groupBy("stage", "profile").agg(F.count("*").alias("n")), f"with {_STAGES} select stage, profile, count(*) as n from st group by 1, 2")
register(
    "z25_worst_tiles",
    lambda v: reports.worst_tiles(_tile_losses(v), "run").select("run", "tile_id", "stage", "place"),
    f"with {_STAGES} select run, tile_id, stage, row_number() over (partition by run order by stage = 'survived', kept, total, tile_id) as place from st qualify place <= 8",
)
_TOP = "tr as (select run, list(reason order by k desc, reason)[1:5] as top from (select run, reason, count(*) as k from tile_rows where reason is not null group by 1, 2) x group by 1)"
register("z25_top_reasons", lambda v: reports.top_reasons(v("tile_rows"), "run").select("run", F.array_join("reasons", ",").alias("reasons")), f"with {_TOP} select run, array_to_string(top, ',') as reasons from tr")


def _diagnoses(v):
    top = reports.top_reasons(v("tile_rows"), "run")
    worst = reports.worst_tiles(_tile_losses(v), "run").groupBy("run").agg(F.bool_or(c("profile") == "degraded_output").alias("degraded"))
    runs = v("tile_rows").groupBy("run").agg(F.sum(F.when(c("run") % 7 > 0, c("total")).otherwise(0)).alias("total"), F.sum(F.when(c("run") % 5 > 0, c("kept")).otherwise(0)).alias("kept"), F.sum("kept").alias("fields"), F.bool_or(c("profile") == "boundary_recovery").alias("recovery"))
    reasons = F.when(c("run") % 3 == 0, F.filter("reasons", lambda x: x != "dropped_after_merge")).when(c("run") % 11 == 0, F.array().cast("array<string>")).otherwise(c("reasons"))
    both = runs.join(top, "run", "left").join(worst, "run", "left").withColumn("reasons", F.coalesce(reasons, F.array().cast("array<string>")))
    status = F.when(c("run") % 13 == 0, "failed").otherwise("done")
    said = both.withColumn("diagnosis", reports.run_diagnosis(status, c("total"), c("kept"), c("fields"), c("reasons"), c("run") % 2 == 0))
    return said.select("run", "diagnosis", reports.next_fix(c("diagnosis"), c("reasons"), c("recovery"), c("degraded")).alias("target"))


register(
    "a28_run_diagnosis",
    _diagnoses,
    f"""with {_STAGES}, {_TOP}, w as (select run, bool_or(profile = 'degraded_output') as degraded from (select * from st qualify row_number() over (partition by run order by stage = 'survived', kept, total, tile_id) <= 8) x group by 1),
       r as (select run, sum(case when run % 7 > 0 then total else 0 end) as total, sum(case when run % 5 > 0 then kept else 0 end) as kept, sum(kept) as fields, bool_or(profile = 'boundary_recovery') as recovery from tile_rows group by 1),
       b as (select r.*, degraded, case when top is null then []::varchar[] when run % 3 = 0 then list_filter(top, lambda x: x <> 'dropped_after_merge') when run % 11 = 0 then []::varchar[] else top end as rs from r left join tr using (run) left join w using (run)),
       d as (select *, case when run % 13 = 0 then 'run_failed' when total = 0 then 'candidate_generation' when kept = 0 then 'rank_and_suppress' when list_contains(rs, 'dropped_after_merge') then 'obia_topology_cleanup' when fields = 0 then 'rank_and_suppress'
           when len(rs) > 0 then 'partial_rank_and_suppress' when run % 2 = 1 then 'unknown' else 'no_major_recall_loss' end as diagnosis from b)
       select run, diagnosis, case diagnosis when 'candidate_generation' then case when recovery then 'generation_recovery_bias' else 'generation_harmonized_inputs' end when 'rank_and_suppress' then case when list_contains(rs, 'below_min_score') then 'ranking_thresholds' else 'ranking_object_features' end
         when 'partial_rank_and_suppress' then case when list_contains(rs, 'below_min_score') then 'ranking_thresholds' else 'ranking_object_features' end when 'obia_topology_cleanup' then 'obia_topology_cleanup' when 'run_failed' then 'runtime_failure' else 'observe' end as target from d""",
)


def _gates(v):
    rows = v("holdout_rows").withColumn("mode", F.concat(c("mode"), (c("event_id") % 40).cast("string")))
    got = rows.groupBy("mode").agg(F.count("*").alias("manual_holdout_size"), F.avg("iou_geo").alias("iou_geo"), F.avg("hd95_m").alias("hd95_m_p90"), F.avg("recall").alias("field_recall_south"), F.avg("missed_fields_rate").alias("missed_fields_rate_south"), F.max("boundary_iou").alias("boundary_iou_south_median"), F.avg("area_ratio_geo_median").alias("contour_shrink_ratio_north_median"))
    return reports.promotion_report(got.withColumn("baseline_iou_geo", F.lit(0.45)).withColumn("baseline_hd95_m_p90", F.lit(1.0))).select("mode", "reasons", "passed")


register(
    "m13_promotion_report",
    _gates,
    """with m as (select mode || (event_id % 40) as mode, count(*) as n, avg(iou_geo) as g, avg(hd95_m) as h, avg(recall) as fr, avg(missed_fields_rate) as mr, max(boundary_iou) as bs, avg(area_ratio_geo_median) as s from holdout_rows group by 1)
       select mode, concat_ws(',', case when n < 300 then 'manual_holdout_size_failed' end, case when g < 0.45e0 - 0.02e0 then 'iou_geo_failed' end, case when h > 1.1e0 then 'hd95_m_p90_failed' end, case when fr < 0.92 then 'field_recall_south_failed' end, case when mr > 0.08 then 'missed_fields_rate_south_failed' end,
         'oversegmented_fields_rate_south_missing,mean_components_per_gt_field_south_missing', case when bs < 0.78 then 'boundary_iou_south_median_failed' end, 'boundary_iou_north_median_missing,centroid_shift_m_north_p90_missing,north_inward_shrink_obvious_rate_missing',
         case when s not between 0.96 and 1.04 then 'contour_shrink_ratio_north_median_failed' end) as reasons, false as passed from m""",
)

# --- matches and merges -----------------------------------------------------------------------------------------


def _truths(v):
    return v("grid_cells").where("zoom_level = 0").select(c("cell_id").alias("id"), *matching.BOX)


def _preds(v):
    return v("fields").select(c("field_id").alias("id"), *matching.BOX)


register(
    "j17_match_in_order",
    lambda v: matching.match_in_order(_iou_pairs(v), "cell_id", "field_id", "iou", 0.1).select("cell_id", "field_id", "iou"),
    f"""with recursive {_BOXES}, p as materialized (select cell_id, list(struct_pack(f := field_id, x := iou) order by iou desc, field_id) as choices, row_number() over (order by cell_id) as k from i where iou >= 0.1 group by 1),
       s as (select 0::bigint as k, []::bigint[] as used, null::bigint as cell_id, null::bigint as field_id, null::double as iou union all
         select k, case when z is null then used else list_append(used, z.f::bigint) end, cell_id, z.f::bigint, z.x from (select p.k, s.used, p.cell_id::bigint as cell_id, list_filter(p.choices, lambda y: not list_contains(s.used, y.f::bigint))[1] as z from s join p on p.k = s.k + 1) t)
       select cell_id, field_id, iou from s where field_id is not null""",
    "iou",
)
_MUTUAL = f"{_BOXES}, k as (select *, row_number() over (partition by cell_id order by iou desc, field_id) as x, row_number() over (partition by field_id order by iou desc, cell_id) as y from i where iou >= 0.1), m as (select cell_id, field_id from k where x = 1 and y = 1)"
register(
    "j17_mismatches",
    lambda v: matching.mismatches(relational.mutual_best(_iou_pairs(v), "cell_id", "field_id", "iou", 0.1), v("grid_cells").select("cell_id", (c("cell_id") % 7).alias("part")), v("fields").select("field_id", (c("field_id") % 7).alias("part")), "cell_id", "field_id", "part"),
    f"""with {_MUTUAL}, t as (select cell_id % 7 as part, count(*) as truths, count(m.cell_id) as hit from grid_cells left join m using (cell_id) group by 1), p as (select field_id % 7 as part, count(*) as preds, count(m.field_id) as used from fields left join m using (field_id) group by 1)
       select part, truths, preds, truths - hit as missed_fields_count, preds - used as oversegmented_fields_count, (truths - hit) / truths as missed_fields_rate, (preds - used) / truths as oversegmented_fields_rate from t join p using (part)""",
    "missed_fields_rate oversegmented_fields_rate",
)
register(
    "j16_merge_supports",
    lambda v: matching.merge_supports(_preds(v), _truths(v), 0.1),
    """with s as (select cell_id as id, minx, miny, maxx, maxy from grid_cells where zoom_level = 0),
       b as (select f.field_id as id, s.id as sid, (least(f.maxx, s.maxx) - greatest(f.minx, s.minx)) * (least(f.maxy, s.maxy) - greatest(f.miny, s.miny)) as i, (f.maxx - f.minx) * (f.maxy - f.miny) as a, (s.maxx - s.minx) * (s.maxy - s.miny) as o, s.minx as x1, s.miny as y1, s.maxx as x2, s.maxy as y2
         from fields f join s on f.minx < s.maxx and f.maxx > s.minx and f.miny < s.maxy and f.maxy > s.miny),
       k as (select * from (select * from b qualify row_number() over (partition by id order by i / (a + o - i) desc, sid) = 1) q where i / (a + o - i) >= 0.1e0),
       m as (select field_id as id, sid as partner, least(minx, coalesce(x1, minx)) as minx, least(miny, coalesce(y1, miny)) as miny, greatest(maxx, coalesce(x2, maxx)) as maxx, greatest(maxy, coalesce(y2, maxy)) as maxy from fields left join k on k.id = field_id)
       select id, 'primary' as origin, partner, minx, miny, maxx, maxy from m union all select id, 'support', null, minx, miny, maxx, maxy from s
       where id not in (select partner from m where partner is not null) and not exists (select 1 from m where s.minx < m.maxx and s.maxx > m.minx and s.miny < m.maxy and s.maxy > m.miny)""",
    "minx miny maxx maxy",
)
register(
    "q1_z37_merge_overlapping",
    lambda v: matching.merge_overlapping(v("fields").select(c("field_id").alias("id"), *matching.BOX, F.when(c("field_id") % 9 == 0, float("nan")).otherwise(c("quality_score")).alias("quality"), F.when(c("field_id") % 7 > 0, c("area_m2")).alias("edge_max")), ["quality"], ["edge_max"], 0.3),
    """with recursive e as (select a.field_id as u, b.field_id as v from fields a join fields b on a.field_id <> b.field_id and a.minx < b.maxx and a.maxx > b.minx and a.miny < b.maxy and a.maxy > b.miny
         and (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) >= 0.3e0 * least((a.maxx - a.minx) * (a.maxy - a.miny), (b.maxx - b.minx) * (b.maxy - b.miny))),
       reach as (select field_id as id, field_id as root from fields union select e.v as id, reach.root from reach join e on reach.id = e.u), comp as (select id, min(root) as component from reach group by 1)
       select component, count(*) as members, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy, avg(quality_score) filter (where id % 9 > 0) as quality, max(area_m2) filter (where id % 7 > 0) as edge_max from comp join fields on id = field_id group by 1""",
    "minx miny maxx maxy quality edge_max",
)
register(
    "z41_change_report",
    lambda v: matching.geometry_change(
        v("fields").select(c("field_id").alias("id"), *matching.BOX, "org", F.concat(c("source"), F.lit("_"), (c("field_id") % 4).cast("string")).alias("reason")),
        v("fields").where("source <> 'manual'").select(c("field_id").alias("id"), (c("minx") + c("field_id") % 3 / 1000).alias("minx"), "miny", "maxx", (c("maxy") - c("field_id") % 2 / 1000).alias("maxy")),
        "org",
    ),
    """with x as (select *, source <> 'manual' as k, (maxx - minx - field_id % 3 / 1000) * (maxy - field_id % 2 / 1000 - miny) / ((maxx - minx) * (maxy - miny)) as ratio, sqrt((field_id % 3 / 2000) * (field_id % 3 / 2000) + (field_id % 2 / 2000) * (field_id % 2 / 2000)) as shift from fields)
       select org, count(*) as before, count_if(k) as after, avg(ratio) filter (where k) as area_ratio_mean, avg(shift) filter (where k) as centroid_shift_mean, max(shift) filter (where k) as centroid_shift_max, array_to_string(list_sort(list(distinct source || '_' || field_id % 4))[1:5], ',') as reasons from x group by 1""",
    "area_ratio_mean centroid_shift_mean centroid_shift_max",
)
ORACLE_SQL["q3_suppression"] = with_views(
    """with recursive f as (select field_id as id, round(quality_score, 9) as score from fields),
       cf as (select a.field_id as u, b.field_id as v, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) as i, (a.maxx - a.minx) * (a.maxy - a.miny) as x, (b.maxx - b.minx) * (b.maxy - b.miny) as y from fields a join fields b on a.field_id <> b.field_id and a.minx < b.maxx and a.maxx > b.minx and a.miny < b.maxy and a.maxy > b.miny),
       nb as materialized (select u, list(v) as vs from cf where i / (x + y - i) > 0.02 group by 1),
       p as materialized (select id, coalesce(vs, []::bigint[]) as vs, row_number() over (order by score desc, id) as k from f left join nb on u = id where score >= 0.25),
       s as (select 0::bigint as k, []::bigint[] as kept union all select p.k, case when list_has_any(kept, vs) then kept else list_append(kept, id::bigint) end from s join p on p.k = s.k + 1),
       last as (select kept from s order by k desc limit 1)
       select id, case when score < 0.25 then 'low_score' when list_contains(kept, id) then 'kept' else 'dropped' end as state from f cross join last"""
)
ORACLE_SQL["q8_downsampling"] = with_views(
    """with n as (select count(*) filter (where status = 'failed') as p, count(*) filter (where status <> 'failed' and not empty_output) as e from qa_results)
       select event_id, status = 'failed' as positive, empty_output as hard from qa_results cross join n where status = 'failed' or empty_output or ('0x' || substring(md5(event_id::varchar), 1, 8))::bigint / 4294967296e0 < least(1, coalesce(p / nullif(e, 0), 1))"""
)
ORACLE_SQL["f3_gradient"] = with_views(
    f"""with f as {_FLAT}, a as (select f.*, coalesce(e.x, f.x) - coalesce(w.x, f.x) as dx, 3 * coalesce(e.x, f.x) + 10 * f.x + 3 * coalesce(w.x, f.x) as sx from f left join f e on e.tile_id = f.tile_id and e.r = f.r and e.c = f.c + 1 left join f w on w.tile_id = f.tile_id and w.r = f.r and w.c = f.c - 1),
       b as (select a.tile_id, a.r, a.c, 3 * coalesce(s.dx, a.dx) + 10 * a.dx + 3 * coalesce(n.dx, a.dx) as gx, coalesce(s.sx, a.sx) - coalesce(n.sx, a.sx) as gy from a left join a s on s.tile_id = a.tile_id and s.c = a.c and s.r = a.r + 1 left join a n on n.tile_id = a.tile_id and n.c = a.c and n.r = a.r - 1)
       select tile_id, r, c, round(coalesce(sqrt(gx * gx + gy * gy) / nullif(max(sqrt(gx * gx + gy * gy)) over (partition by tile_id), 0), 0) + 1e-9, 6) + 0 as edge from b"""
)

# --- imports ---------------------------------------------------------------------------------------------------

_PLAIN = {"row_number": "o_orderkey", "field_external_id": "case when o_orderkey % 13 = 0 then '' else cast(o_custkey as string) end", "season_year": "case when o_orderkey % 29 = 0 then 'x' else cast(year(o_orderdate) as string) end", "day": "case when o_orderkey % 31 = 0 then 'soon' else cast(cast(o_orderdate as date) as string) end"}
_ROWS = """i as (select o_orderkey as n, o_custkey as f, o_custkey % 19 > 0 as known, year(o_orderdate)::int as y, o_orderdate::date as d, o_orderkey % 13 > 0 as has_field, o_orderkey % 29 > 0 as has_year, o_orderkey % 31 > 0 as has_day, o_totalprice::double as price from orders)"""


def _facts(v, kind, day, **more):
    columns = {"row_number": _PLAIN["row_number"], "field_external_id": _PLAIN["field_external_id"], "season_year": _PLAIN["season_year"]} | ({day: _PLAIN["day"]} if day else {}) | more
    rows = v("orders").select(*(F.expr(e).alias(n) for n, e in columns.items()))
    known = v("customer").where("c_custkey % 19 > 0").select(c("c_custkey").alias("external_id"), c("c_custkey").alias("field_id"))
    return imports.import_facts(relational.validate_import(rows, kind), kind, known)


register(
    "s9_commit_yield",
    lambda v: imports.commit_import(v("yield_obs").select("field_id", "season_year", "yield_kg_ha", c("observed_on").alias("observed_at")), _facts(v, "yield_history", None, crop_code="'wheat'", yield_kg_ha="cast(o_totalprice as string)", observed_at="case when o_orderkey % 3 = 0 then cast(cast(o_orderdate as date) as string) end"), "yield_history"),
    f"with {_ROWS} select field_id, season_year::int as season_year, yield_kg_ha, observed_on as observed_at from yield_obs union all select f, y, price, case when n % 3 = 0 then d else make_date(y, 9, 1) end from i where has_field and has_year and known",
    "yield_kg_ha",
)
register(
    "s9_commit_crop_plan",
    lambda v: imports.commit_import(v("field_seasons").select("field_id", "season_year", "crop_code"), _facts(v, "crop_plan", None, crop_code="case o_orderkey % 3 when 0 then ' Corn' when 1 then 'SOY ' else 'wheat' end"), "crop_plan"),
    f"""with {_ROWS}, n as (select f, y, case n % 3 when 0 then 'corn' when 1 then 'soy' else 'wheat' end as k from i where has_field and has_year and known qualify row_number() over (partition by f, y order by n desc) = 1)
       select field_id, season_year::int as season_year, crop_code from field_seasons where (field_id, season_year) not in (select (f, y) from n) union all select * from n""",
)
register("s9_new_seasons", lambda v: imports.new_seasons(_facts(v, "crop_plan", None, crop_code="'rye'"), v("management_events").select("field_id", "season_year")), f"with {_ROWS} select distinct f as field_id, y as season_year from i where has_field and has_year and known and (f, y) not in (select (field_id, season_year) from management_events)")
register(
    "s9_commit_soil",
    lambda v: imports.commit_import(v("soil_profiles").select("field_id", "sampled_at", "ph", c("n_ppm").cast("double").alias("n_ppm")), _facts(v, "soil_samples", "sampled_at", ph="cast(4 + o_orderkey % 30 / 10 as string)", n_ppm="case when o_orderkey % 5 > 0 then cast(o_orderkey % 70 as string) else ' ' end"), "soil_samples"),
    f"with {_ROWS} select field_id, sampled_at, ph, n_ppm::double as n_ppm from soil_profiles union all select f, d, 4 + n % 30 / 10, case when n % 5 > 0 then n % 70 end from i where has_field and has_day and known",
    "ph",
)
register(
    "s9_commit_management",
    lambda v: imports.commit_import(v("management_events").select("field_id", "event_date", "event_type", c("amount").cast("double").alias("amount"), "unit"), _facts(v, "management_events", "event_date", event_type="'sowing '", amount="case when o_orderkey % 4 = 0 then 'much' else cast(o_orderkey % 90 as string) end", unit="''"), "management_events"),
    f"with {_ROWS} select field_id, event_date, event_type, amount::double as amount, unit from management_events union all select f, d, 'sowing', case when n % 4 > 0 then n % 90 end, null from i where has_field and has_year and has_day and known",
    "amount",
)
register(
    "s9_commit_weather",
    lambda v: imports.commit_import(v("weather_daily").select("field_id", F.year("observed_on").alias("season_year"), "observed_on", c("precip").alias("precipitation_mm"), c("vpd")), _facts(v, "weather_daily", "observed_on", precipitation_mm="cast(o_orderkey % 40 as string)", vpd="cast(o_orderkey % 9 as string)"), "weather_daily"),
    f"""with {_ROWS}, n as (select f, y, d, (n % 40)::double as p, (n % 9)::double as v from i where has_field and has_year and has_day and known qualify row_number() over (partition by f, d order by n desc) = 1)
       select field_id, year(observed_on)::int as season_year, observed_on, precip as precipitation_mm, vpd from weather_daily where (field_id, observed_on) not in (select (f, d) from n) union all select * from n""",
    "precipitation_mm vpd",
)


def _boundaries(v):
    def ring(*corners):
        return F.array(*(F.array(c(x), c(y)) for x, y in corners))

    box = ring(("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))
    plain, parts = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(box).alias("coordinates"))), F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(box)).alias("coordinates")))
    text = F.when(c("field_id") % 20 == 0, '{"type": "Point", "coordinates": [1.0, 2.0]}').when(c("field_id") % 21 == 0, "{bad").when(c("field_id") % 3 == 0, parts).otherwise(plain)
    rows = v("fields").select(c("field_id").alias("row_number"), F.when(c("field_id") % 17 > 0, (c("field_id") % 1000).cast("string")).alias("field_external_id"), text.alias("geometry"))
    return imports.read_boundaries(rows, "geometry")


_BOUNDARIES = """x as (select *, case when field_id % 17 = 0 then 'field_external_id is required' when field_id % 20 = 0 then 'Unsupported geometry type Point' when field_id % 21 = 0 then 'geometry is empty' end as error_message,
         6378137e0 * radians(maxx - minx) as w, 6378137e0 * (ln(tan(pi() / 4 + radians(maxy) / 2)) - ln(tan(pi() / 4 + radians(miny) / 2))) as h from fields)"""
register("s10_read_boundaries", lambda v: _boundaries(v).select(c("row_number").alias("field_id"), "error_message", "area_m2", "perimeter_m"), f"with {_BOUNDARIES} select field_id, error_message, case when error_message is null then w * h end as area_m2, case when error_message is null then 2 * (w + h) end as perimeter_m from x", "area_m2 perimeter_m", digits=1)
register(
    "s10_preview_boundaries",
    lambda v: imports.preview_boundaries(_boundaries(v)),
    f"""with {_BOUNDARIES} select count(*) as rows_total, count_if(error_message is null) as valid_rows, count_if(error_message is not null) as invalid_rows, count(distinct field_id % 1000) filter (where error_message is null) as fields,
       array_to_string(list_sort(list(distinct case when field_id % 3 = 0 then 'MultiPolygon' else 'Polygon' end) filter (where error_message is null)), ',') as geometry_types, min(minx) filter (where error_message is null) as minx, min(miny) filter (where error_message is null) as miny, max(maxx) filter (where error_message is null) as maxx, max(maxy) filter (where error_message is null) as maxy from x""",
    "minx miny maxx maxy",
)
register(
    "s10_commit_boundaries",
    lambda v: imports.commit_boundaries(v("customer").select(c("c_custkey").cast("string").alias("field_external_id"), F.lit(0.0).alias("area_m2")), _boundaries(v)),
    f"""with {_BOUNDARIES}, n as (select (field_id % 1000)::varchar as e, w * h as a from x where error_message is null qualify row_number() over (partition by field_id % 1000 order by field_id desc) = 1)
       select c_custkey::varchar as field_external_id, 0e0 as area_m2 from customer where c_custkey::varchar not in (select e from n) union all select * from n""",
    "area_m2",
    digits=1,
)

# --- caches, tiers, payloads, baselines, dates ------------------------------------------------------------------

register(
    "t1_weather_cache_state",
    lambda v: weather_cache.cached(v("point_weather"), "2024-01-25 00:00:00", 86400, "event_id").select("lat", "lon", "event_id", "state"),
    """with k as (select round(lat, 1) as lat, round(lon, 1) as lon, event_id, observed_at from point_weather where observed_at <= timestamp '2024-01-25 00:00:00' qualify row_number() over (partition by round(lat, 1), round(lon, 1) order by observed_at desc, event_id) = 1)
       select lat, lon, event_id, case when floor(epoch(timestamp '2024-01-25 00:00:00')) - floor(epoch(observed_at)) <= 86400 then 'fresh' else 'stale' end as state from k""",
    "lat lon",
)
register(
    "a22_tiers",
    lambda v: v("fields").select("field_id", ag.operational_tier(ag.quality_band(F.when(c("field_id") % 6 > 0, c("quality_score")), c("source")), F.when(c("field_id") % 8 == 0, "autodetect_preview").otherwise(c("source"))).alias("f"), ag.prediction_tier(c("field_id") % 9 > 0, F.element_at(F.array(*(F.lit(x) for x in ("tenant_calibrated", "global_baseline", "unsupported", "scaled"))), (c("field_id") % 4 + 1).cast("int")), F.element_at(F.array(*(F.lit(x) for x in ("high", "moderate", "low", "unsuitable", "unknown"))), (c("field_id") % 5 + 1).cast("int"))).alias("p")).select("field_id", c("f.tier").alias("tier"), c("f.review").alias("review"), c("f.reason_code").alias("reason"), c("p.tier").alias("prediction_tier"), c("p.reason_code").alias("prediction_reason")),
    """with x as (select *, case when source = 'manual' then 'manual' when field_id % 6 = 0 then 'unknown' when quality_score >= 0.82 then 'high' when quality_score >= 0.62 then 'medium' else 'low' end as band, ['tenant_calibrated', 'global_baseline', 'unsupported', 'scaled'][field_id % 4 + 1] as ct, ['high', 'moderate', 'low', 'unsuitable', 'unknown'][field_id % 5 + 1] as su from fields),
       y as (select field_id, case when field_id % 8 = 0 then 'preview_contour_requires_confirmation' when band = 'manual' or band = 'high' then null when band = 'medium' then 'field_medium_confidence_review' when band = 'low' then 'field_low_confidence_review' else 'field_confidence_unconfirmed' end as reason, band,
         case when su = 'unsuitable' then 'crop_unsuitable_for_region' when field_id % 9 = 0 or ct = 'unsupported' then 'unsupported' when ct = 'tenant_calibrated' and su in ('high', 'moderate') then null when su = 'low' then 'crop_borderline_suitability' when ct = 'global_baseline' then 'global_baseline_requires_review' else 'review_before_use' end as pr from x)
       select field_id, case when field_id % 8 = 0 or band = 'unknown' then 'experimental_rest' when band = 'manual' then 'validated_manual' when band = 'high' then 'validated_core' else 'review_needed' end as tier, reason is not null as review, reason,
         case when pr is null then 'validated_core' when pr in ('crop_unsuitable_for_region', 'unsupported') then 'unsupported' when pr = 'global_baseline_requires_review' then 'experimental_rest' else 'review_needed' end as prediction_tier, pr as prediction_reason from y""",
)


def _payloads(v):
    odd = F.when(c("event_id") % 3 == 0, float("nan")).when(c("event_id") % 5 == 0, float("-inf")).otherwise(c("value"))
    df = v("events").select("event_id", F.struct(odd.alias("a"), F.array(odd, c("value")).alias("b"), F.create_map(F.lit("k"), F.struct(odd.alias("x"))).alias("m"), c("event_type").alias("t")).alias("p"))
    return df.select("event_id", ag.sanitized(c("p"), df.schema["p"].dataType).alias("p")).select("event_id", c("p.a").alias("a"), c("p.b")[0].alias("b0"), c("p.b")[1].alias("b1"), c("p.m")["k"]["x"].alias("mx"), c("p.t").alias("t"))


register("a27_sanitized", _payloads, "select event_id, case when event_id % 3 > 0 and event_id % 5 > 0 then value end as a, case when event_id % 3 > 0 and event_id % 5 > 0 then value end as b0, value as b1, case when event_id % 3 > 0 and event_id % 5 > 0 then value end as mx, event_type as t from events", "a b0 b1 mx")


def _baselines(v):
    w = v("weather_daily")
    fert = (c("row_id") % 60).cast("double")
    water, rain, dry = F.when(c("row_id") % 6 > 0, c("soil") * 2), c("precip") * 15, c("vpd") * 2
    amounts = [F.when(c("row_id") % 2 == 0, (c("row_id") % k).cast("double")) for k in (37, 43, 29)]
    named = w.select("row_id", su.hydro_factor(water, dry, F.when(c("row_id") % 5 > 0, rain)).alias("hydro"), su.management_factor(F.when(c("row_id") % 7 > 0, (c("row_id") % 1200).cast("double")), *amounts).alias("management"), su.interaction_penalty(water, dry, F.when(c("row_id") % 4 > 0, (c("row_id") % 60).cast("double")), fert, fert / 2).alias("interaction"))
    history = F.when(c("row_id") % 3 > 0, (2000 + c("row_id") % 3000).cast("double"))
    return named.withColumn("estimate", su.baseline_estimate(F.lit(3200.0), scoring.combined_factor([c("hydro"), c("management"), c("interaction")]), history, c("row_id") % 5, F.when(c("row_id") % 11 > 0, c("row_id") % 6)))


_RESPONSE = "case when {x} is null then null when {x} <= 0 then {low} when {x} <= {best} then {low} + (1 - exp(-3 * {x} / {best})) * ({peak} - {low}) when {x} <= {toxic} then {peak} when {x} <= {lethal} then {peak} - ({x} - {toxic}) / ({lethal} - {toxic}) * ({peak} - {bad}) else greatest({worst}, {bad} - least(({x} - {lethal}) / {lethal}, 1) * ({bad} - {worst})) end"


def _response(x, best, toxic, lethal, low, peak, bad, worst):
    return _RESPONSE.format(x=x, **{k: f"{v}e0" for k, v in dict(best=best, toxic=toxic, lethal=lethal, low=low, peak=peak, bad=bad, worst=worst).items()})


register(
    "m2_baseline_estimate",
    _baselines,
    f"""with a as (select row_id, case when row_id % 6 > 0 then soil * 2 end as s, vpd * 2 as d, case when row_id % 5 > 0 then precip * 15 end as p, (row_id % 60)::double as fp, case when row_id % 4 > 0 then row_id % 60 end as n, case when row_id % 7 > 0 then (row_id % 1200) / 20e0 end as t,
         case when row_id % 2 = 0 then (row_id % 37)::double end as m1, case when row_id % 2 = 0 then (row_id % 43)::double end as m2, case when row_id % 2 = 0 then (row_id % 29)::double end as m3 from weather_daily),
       b as (select *, case when s < 0.05 then 0.2e0 when s < 0.1 then 0.2e0 + (s - 0.05e0) / 0.05e0 * 0.35e0 when s < 0.18 then 0.55e0 + (s - 0.1e0) / 0.08e0 * 0.4e0 when s <= 0.35 then 0.95e0 + (s - 0.18e0) / 0.17e0 * 0.1e0 when s <= 0.48 then 1.05e0 - (s - 0.35e0) / 0.13e0 * 0.45e0 when s is not null then greatest(0.15e0, 0.6e0 - (s - 0.48e0) * 2) end as hs,
         case when d < 0.3 then 0.85e0 when d < 0.5 then 0.85e0 + (d - 0.3e0) / 0.2e0 * 0.15e0 when d <= 2 then 1 when d <= 3.5 then 1 - (d - 2) * 0.12e0 else greatest(0.3e0, 0.82e0 - (d - 3.5e0) * 0.2e0) end as hd,
         case when p < 2 then 0.65e0 when p < 5 then 0.65e0 + (p - 2) / 3 * 0.25e0 when p <= 25 then 0.9e0 + (p - 5) / 20 * 0.12e0 when p <= 50 then 1.02e0 - (p - 25) / 25 * 0.22e0 when p <= 100 then 0.8e0 - (p - 50) / 50 * 0.3e0 when p is not null then greatest(0.15e0, 0.5e0 - (p - 100) / 100 * 0.25e0) end as hp,
         {_response("m1", 8, 20, 35, 0.8, 1.08, 0.85, 0.6)} as r1, {_response("m2", 10, 25, 40, 0.75, 1.12, 0.78, 0.5)} as r2, {_response("m3", 5, 15, 25, 0.85, 1.05, 0.82, 0.6)} as r3, {_response("t", 10, 30, 50, 0.7, 1.1, 0.8, 0.55)} as r4 from a),
       f as (select *, greatest(0.15e0, least(1.08e0, least(hs, hd, hp))) as hydro, case when r1 is not null then greatest(0.45e0, least(1.12e0, pow(r1 * r2 * r3, 1 / 3e0))) else coalesce(r4, 1) end as management,
         greatest(0.4e0, (case when s < 0.12 and (fp > 15 or coalesce(n > 35, false)) then greatest(0.55e0, least(1, 1 - least((35 - least(s, 0.12e0) * 100) / 35, 1) * fp / 50 * 0.3e0)) else 1 end)
           * (case when s > 0.4 then greatest(0.6e0, least(1, 1 - (s - 0.4e0) / 0.2e0 * (fp / 100 + coalesce(greatest(n - 30, 0) / 30, 0)) * 0.25e0)) else 1 end) * (case when d > 2 and s < 0.18 then greatest(0.55e0, least(1, 1 - (d - 2) / 2 * (0.18e0 - s) / 0.15e0 * 0.2e0)) else 1 end)
           * (case when s > 0.35 and fp / 2 > 20 then greatest(0.75e0, least(1, 1 - (fp / 2 - 20) / 80 * 0.18e0)) else 1 end)) as interaction from b),
       e as (select *, 3200 * greatest(0.15e0, least(1.45e0, 0.6e0 * pow(hydro * management * interaction, 1 / 3e0) + 0.4e0 * least(hydro, management, interaction))) as plain, 0.25e0 * exp(-0.3e0 * case when row_id % 11 > 0 then row_id % 6 else 3 end) * least(greatest(row_id % 5, 1) / 3e0, 1) as pull from f)
       select row_id, hydro, management, interaction, round(case when row_id % 3 = 0 then plain else plain * (1 - pull) + (2000 + row_id % 3000) * pull end, 2) as estimate from e""",
    "hydro management interaction estimate",
)


def _latitudes(v):
    return v("indexed").select("tile_id").distinct().withColumn("lat", 40 + c("tile_id") % 25 * 1.0)


register(
    "q4_date_scores",
    lambda v: dates.date_scores(v("indexed"), _latitudes(v), 0.3),
    """with s as (select tile_id, t, avg(case when valid then 1 else 0 end) as coverage, coalesce(quantile_cont(ndvi, 0.9) filter (where valid), 0) as g, coalesce(stddev_pop(ndvi) filter (where valid), 0) as sd, greatest(coalesce(quantile_cont(ndwi, 0.9) filter (where valid), 0), 0) as w, greatest(coalesce(quantile_cont(mndwi, 0.9) filter (where valid), 0), 0) as m from indexed group by 1, 2),
       p as (select *, (row_number() over (partition by tile_id order by t) - 1)::int as place, count(*) over (partition by tile_id) - 1 as last, 40 + tile_id % 25 as lat from s),
       q as (select *, case when max(g) over k - min(g) over k <= 1e-9 then 1 else (g - min(g) over k) / (max(g) over k - min(g) over k) end as ng, case when max(sd) over k - min(sd) over k <= 1e-9 then 1 else (sd - min(sd) over k) / (max(sd) over k - min(sd) over k) end as ns,
         case when max(w) over k - min(w) over k <= 1e-9 then 1 else (w - min(w) over k) / (max(w) over k - min(w) over k) end as nw, case when max(m) over k - min(m) over k <= 1e-9 then 1 else (m - min(m) over k) / (max(m) over k - min(m) over k) end as nm,
         greatest(0, least(last, last / 2e0 + case when lat < 48 then -14 when lat <= 57 then 0 else 14 end / 60e0 * greatest(last, 1))) as centre from p window k as (partition by tile_id))
       select tile_id, t, place, coverage, 0.4e0 * greatest(0, (coverage - 0.3e0) / 0.7e0) + 0.3e0 * (0.55e0 * greatest(0, 1 - abs(place - centre) / greatest(last, 1)) + 0.45e0 * (0.7e0 * ng + 0.3e0 * ns)) - 0.1e0 * (0.5e0 * nw + 0.5e0 * nm) - 0.1e0 * greatest(0, (0.3e0 - coverage) / 0.3e0) as score,
         case when place in (0, last) then 1 else least(1, least(place, last - place) / greatest(last / 2e0, 1)) end as edge, coverage >= 0.3 as good from q""",
    "coverage score edge",
)
register("q4_date_selection", lambda v: dates.pick_dates(dates.date_scores(v("indexed"), _latitudes(v), 0.3), 3, 2))


def _hourly(v):
    z = lambda x: F.collect_list(F.struct("row_id", F.coalesce(x, F.lit(0.0)).alias("x")))
    listed = v("weather_daily").groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct("row_id", F.concat(c("observed_on").cast("string"), F.lit("T06:00")).alias("x")))).alias("time"), *(F.sort_array(z(e)).alias(n) for n, e in (("temperature", c("tmean")), ("precipitation", c("precip")), ("vpd", c("vpd")), ("soil_moisture", c("soil")), ("wind_speed", c("vpd") * 2), ("cloud_cover", c("precip") * 10))))
    names = ("time", *readers.HOURLY)
    return listed.select("field_id", F.to_json(F.struct(F.struct(*(F.transform(n, lambda s: s["x"]).alias(n) for n in names)).alias("hourly"))).alias("payload"))


register(
    "s11_hourly_weather",
    lambda v: readers.hourly_to_daily(_hourly(v), "field_id", "payload"),
    """with d as (select field_id, observed_on as day, coalesce(tmean, 0) as t, precip as p, vpd as v, soil as s, case when precip * 10 > 1 then precip / 10 else precip * 10 end as cl from weather_daily)
       select field_id, day, avg(t) as temperature, sum(p) as precipitation, avg(v) as vpd, avg(s) as soil_moisture, avg(v * 2) as wind_speed, avg(cl) as cloud_cover, greatest(avg(t) - 10, 0) as gdd from d group by 1, 2""",
    "temperature precipitation vpd soil_moisture wind_speed cloud_cover gdd",
)
register(
    "s12_reanalysis",
    lambda v: readers.merge_reanalysis(v("weather_daily").where("tmean is not null").select("row_id", c("observed_on").alias("day"), F.inline(F.array(*(F.struct(F.lit(n).alias("variable"), e.alias("value")) for n, e in (("t2m", c("tmean") + 273.15), ("d2m", c("tmean") + 265.15), ("tp", c("precip") / 1000), ("u10", c("vpd")), ("v10", c("vpd") + 1), ("swvl1", c("soil")), ("tcc", c("soil") * 2))))).alias("variable", "value")), "row_id"),
    """select row_id, observed_on as day, tmean as temperature, precip as precipitation, sqrt(vpd * vpd + (vpd + 1) * (vpd + 1)) as wind_speed, 0.6108e0 * exp(17.27e0 * tmean / (tmean + 237.3e0)) - 0.6108e0 * exp(17.27e0 * (tmean - 8) / (tmean - 8 + 237.3e0)) as vpd, soil as soil_moisture, soil * 2 as cloud_cover, greatest(tmean - 10, 0) as gdd
       from weather_daily where tmean is not null""",
    "temperature precipitation wind_speed vpd soil_moisture cloud_cover gdd",
)
register(
    "s14_scene_bands",
    lambda v: readers.read_scene_bands(v("pixels").drop("b11").withColumn("b8", F.round("b8", 4)).withColumn("b4", F.when(c("r") == c("c"), float("nan")).otherwise(c("b4"))).withColumn("scl", F.when(c("r") != 3, c("scl")))),
    "select tile_id, t, r, c, b2, b3, case when r <> c then b4 end as b4, null::double as b5, null::double as b7, round(b8, 4) as b8, null::double as b8a, null::double as b11, case when r <> 3 then scl else 0 end::int as scl from pixels",
    "b2 b3 b4 b8",
)
register("s20_register_dataset", lambda v: relational.upsert(v("label_versions").select(c("label_task_id").alias("org"), c("version_no").alias("version"), "size"), v("runs").groupBy("org", (c("run_id") % 5).cast("bigint").alias("version")).agg(F.count("*").alias("size")), ["org", "version"]), "with n as (select org, run_id % 5 as version, count(*) as size from runs group by 1, 2) select label_task_id as org, version_no as version, size from label_versions where (label_task_id, version_no) not in (select (org, version) from n) union all select * from n")
