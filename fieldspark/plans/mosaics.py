"""Registered queries across tile borders, of manifests, profiles and optional predicates.

The tiles of the view pixels are laid out as a mosaic, ten in a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fieldspark.operators import focal, manifests, models, mosaic, predicates, profiles, series
from fieldspark.plans.queries import _FLAT, _flat, register

c = F.col
SIZE, COLUMNS = 8, 10
_AT = f"floor(tile_id / {COLUMNS}e0)::bigint * {SIZE} + r as gr, tile_id % {COLUMNS} * {SIZE} + c as gc"
_CROSS = "(values (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) as o(dr, dc)"


def _masked(v, least: float):
    return _flat(v).withColumn("m", F.coalesce(c("x") > least, F.lit(False))).select("tile_id", "r", "c", "m")


register(
    "f4_mosaic_dilation",
    lambda v: mosaic.across(_masked(v, 0.6), SIZE, COLUMNS, 1, lambda x: focal.dilate(x, "m")).select("tile_id", "r", "c", "m"),
    f"""with p as (select tile_id, r, c, coalesce(x > 0.6, false) as m, {_AT} from {_FLAT} f), q as (select p.gr + dr as gr, p.gc + dc as gc, bool_or(m) as m from p, {_CROSS} group by 1, 2)
       select tile_id, r, c, q.m from p join q using (gr, gc)""",
)
register(
    "f1_mosaic_share",
    lambda v: mosaic.across(_masked(v, 0.6).withColumn("v", c("m").cast("double")), SIZE, COLUMNS, 2, lambda x: focal.box_mean(x, "v", "share", 2)).select("tile_id", "r", "c", "share"),
    f"""with p as (select tile_id, r, c, coalesce(x > 0.6, false)::int as m, {_AT} from {_FLAT} f), q as (select gr + dr as gr, gc + dc as gc, avg(m) as share from p, range(-2, 3) as a(dr), range(-2, 3) as b(dc) group by 1, 2)
       select tile_id, r, c, share from p join q using (gr, gc)""",
    "share",
)
register(
    "j22_mosaic_distance",
    lambda v: mosaic.distance(mosaic.placed(_masked(v, 0.75), SIZE, COLUMNS), "m", 12).select("gr", "gc", "distance"),
    f"""with p as (select coalesce(x > 0.75, false) as m, {_AT} from {_FLAT} f), q as (select gr + dr as gr, gc + dc as gc, min(dr * dr + dc * dc) as s from p, range(-12, 13) as a(dr), range(-12, 13) as b(dc) where m and dr * dr + dc * dc <= 144 group by 1, 2)
       select gr, gc, sqrt(s) as distance from p left join q using (gr, gc)""",
    "distance",
)
register(
    "q2_mosaic_components",
    lambda v: mosaic.components(_masked(v, 0.62).where("m").withColumn("id", c("tile_id") * 64 + c("r") * 8 + c("c")), SIZE, COLUMNS).select("id", "component"),
    f"""with recursive p as materialized (select tile_id * 64 + r * 8 + c as id, {_AT} from {_FLAT} f where x > 0.62), e as materialized (select a.id as u, b.id as v from p a, {_CROSS}, p b where b.gr = a.gr + dr and b.gc = a.gc + dc),
       reach as (select id, id as root from p union select e.v, root from reach join e on id = e.u where e.v >= root) select id, min(root) as component from reach group by 1""",
)
_WATER = 0.2


def _hydro(v):
    means = v("indexed").where("valid").groupBy("tile_id", "r", "c").agg(F.max(c("ndwi") + 0.6).alias("ndwi_max"), F.avg(c("ndwi") + 0.6).alias("ndwi_mean"), F.max(c("mndwi") + 0.4).alias("mndwi_max"), F.max(c("scl") == 6).alias("scl_water"), F.count("*").alias("n"))
    return mosaic.hydro_masks(means, SIZE, COLUMNS, _WATER)


def _grown(of: str, steps: int, name: str) -> str:
    """SQL of masks grown by cross steps over the pixels that there are."""
    out, last = [], f"(select gr, gc, {of} as m from w)"
    for i in range(steps):
        out.append(f"{name}{i} as materialized (select w.gr, w.gc, g.m from w join (select s.gr + dr as gr, s.gc + dc as gc, bool_or(m) as m from {last} s, {_CROSS} group by 1, 2) g using (gr, gc))")
        last = f"{name}{i}"
    return ", ".join(out)


register(
    "p7_riparian_rings",
    lambda v: _hydro(v).select("tile_id", "r", "c", "open_water", "seasonal_wet", "riparian_soft", "riparian_hard"),
    f"""with s as (select tile_id, r, c, max(ndwi + 0.6e0) as a, avg(ndwi + 0.6e0) as b, max(mndwi + 0.4e0) as m, bool_or(scl = 6) as k, count(*) as n from indexed where valid group by 1, 2, 3),
       o as (select *, coalesce(k or a > {_WATER}e0 or m > {_WATER}e0, false) as open_water, coalesce(b > 0.7e0 * {_WATER}e0 or m > 0.5e0 * {_WATER}e0, false) as wet from s),
       w as materialized (select tile_id, r, c, open_water, wet and not open_water as seasonal_wet, open_water or wet as either, {_AT} from o), {_grown("either", 2, "x")}, {_grown("open_water", 1, "y")}
       select tile_id, r, c, open_water, seasonal_wet, x1.m and not either as riparian_soft, y0.m and not open_water as riparian_hard from w join x1 using (gr, gc) join y0 using (gr, gc)""",
)

# --- manifests ---------------------------------------------------------------------------------------------------

_ITEM = ["decision", "label_task_id", "size", "version_no"]
_SUMS = ", ".join(f"(sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint::hugeint) % 1152921504606846976)::varchar as d{i}" for i in range(4))
register(
    "s19_manifest_digest",
    lambda v: manifests.manifest(series.latest(v("label_versions"), ["label_task_id"], [F.desc("version_no")]).where("decision = 'approved'").withColumn("queue", c("label_task_id") % 10), ["queue"], _ITEM),
    f"""with i as (select label_task_id % 10 as queue, sha256('{{"decision":"approved","label_task_id":' || label_task_id || ',"size":' || size || ',"version_no":' || version_no || '}}') as h
         from (select * from label_versions qualify row_number() over (partition by label_task_id order by version_no desc) = 1) x where decision = 'approved'), s as (select queue, count(*) as n, {_SUMS} from i group by 1)
       select queue, n, sha256(concat_ws(':', n::varchar, d0, d1, d2, d3)) as digest from s""",
)
_SPLIT = {"done": "train", "running": "Calibration ", "queued": "holdout"}
register(
    "s22_manifest_check",
    lambda v: manifests.checked(v("runs").join(v("yield_obs").select(c("obs_id").alias("run_id"), c("field_id").alias("area")), "run_id").withColumn("split", reduce(lambda a, x: a.when(c("status") == x[0], x[1]), _SPLIT.items(), F.when(F.lit(False), ""))).where("org % 3 > 0 or status <> 'queued'"), ["org"], "area", "split"),
    """with i as (select org, field_id as area, case status when 'done' then 'train' when 'running' then 'calibration' else 'holdout' end as split from runs join yield_obs on run_id = obs_id where org % 3 > 0 or status <> 'queued'),
       l as (select org, count(*) as leaks from (select org, area from i group by 1, 2 having count(distinct split) > 1) a group by 1),
       s as (select org, count(*) as items, concat_ws(',', case when not bool_or(split = 'train') then 'train' end, case when not bool_or(split = 'calibration') then 'calibration' end, case when not bool_or(split = 'holdout') then 'holdout' end) as missing from i group by 1)
       select org, items, missing, coalesce(leaks, 0) as leaks, case when missing <> '' then 'manifest must include train, calibration and holdout splits' when leaks > 0 then 'an area is in several splits' end as error from s left join l using (org)""",
)


def _files(v):
    """Registry files: of every customer one, an object or an array, some without country or source."""
    one = F.to_json(F.struct(F.when(c("field_id") % 5 > 0, F.concat(F.lit("Open Fields "), c("source"), F.lit("-"), c("org"))).alias("source"), F.concat(F.lit("u"), c("field_id")).alias("artifact_uri"), F.when(c("field_id") % 3 > 0, F.array(F.lit("ee"), F.lit("lv"))).alias("country"), (c("field_id") % 9 + 2015).alias("year")))
    text = F.when(c("field_id") % 7 == 0, F.lit("{bad")).when(c("field_id") % 2 == 0, F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]"))).otherwise(one)
    return v("fields").select(c("field_id").cast("string").alias("file"), text.alias("text"))


register(
    "s21_registry_union",
    lambda v: manifests.registry(_files(v), "file", "text").groupBy("source_id", "year").agg(F.count("*").alias("n"), F.sum(F.size("country").cast("long")).alias("countries"), F.min("manifest_file").alias("first_file")),
    """with f as (select *, case when field_id % 5 > 0 then 'open_fields_' || source || '_' || org else 'unknown' end as source_id, (field_id % 9 + 2015)::int as year, case when field_id % 2 = 0 then 2 else 1 end as k from fields where field_id % 7 > 0)
       select source_id, year, sum(k)::bigint as n, sum(k * case when field_id % 3 > 0 then 2 else 0 end)::bigint as countries, min(field_id::varchar) as first_file from f group by 1, 2""",
)

# --- profiles, optional predicates -------------------------------------------------------------------------------

_ENTROPY = "-sum(share * log2(share))"
register(
    "z10_mask_profile",
    lambda v: profiles.is_strong(profiles.mask_profile(v("indexed").where("valid").join(v("pixel_labels").where("label > 0"), ["tile_id", "r", "c"]), "ndvi").withColumn("lat", 45.0 + c("tile_id") % 20), "lat").drop("lat"),
    f"""with p as (select tile_id, t, avg(ndvi) as v from indexed join pixel_labels using (tile_id, r, c) where valid and label > 0 and ndvi is not null group by 1, 2), e as (select tile_id, count(*) as n, min(v) as lo, max(v) as hi from p group by 1),
       b as (select tile_id, least(floor((v - lo) / greatest(hi - lo, 1e-6) * 6), 5) as bin, count(*) / any_value(n) as share from p join e using (tile_id) group by 1, 2), h as (select tile_id, {_ENTROPY} as entropy from b group by 1),
       k as (select tile_id, min(t) as peak from p join e using (tile_id) where v = hi group by 1), d as (select *, v - lag(v) over (partition by tile_id order by t) as d from p),
       s as (select tile_id, coalesce(bool_or(t <= peak and d > 0.02), false) and coalesce(bool_or(t > peak and d < -0.02), false) as shape from d join k using (tile_id) group by 1),
       o as (select tile_id, n as valid_dates, case when n >= 3 then hi - lo else 0 end as amplitude, n >= 3 and shape and hi - lo >= 0.16 as has_growth_peak, case when n >= 3 then entropy else 4 end as entropy from e join h using (tile_id) join s using (tile_id))
       select *, has_growth_peak or (amplitude >= case when tile_id % 20 > 12 then 0.18 else 0.22 end and entropy <= case when tile_id % 20 > 12 then 2.4 else 2.2 end) as strong from o""",
    "amplitude entropy",
)
_BANDS = ["b4", "b8", "b11", "ndvi", "ndmi"]
register(
    "z39_pixel_table",
    lambda v: profiles.pixel_table(v("indexed"), _BANDS, "ndvi"),
    f"""with g as (select tile_id, r, c, {", ".join(f"avg({b}) filter (where valid) as {b}_mean, median({b}) filter (where valid) as {b}_median, max({b}) filter (where valid) as {b}_max" for b in _BANDS)}, avg(valid::int) as valid_fraction, median(scl::double) as scl_median,
         min(ndvi) filter (where valid) as lo, max(ndvi) filter (where valid) as hi, count(ndvi) filter (where valid) as n from indexed group by 1, 2, 3),
       b as (select tile_id, r, c, least(floor((ndvi - lo) / greatest(hi - lo, 1e-6) * 10), 9) as bin, count(*) / any_value(n) as share from indexed join g using (tile_id, r, c) where valid and ndvi is not null group by 1, 2, 3, 4), h as (select tile_id, r, c, {_ENTROPY} as ndvi_entropy from b group by 1, 2, 3)
       select g.* exclude (lo, hi, n), ndvi_entropy from g left join h using (tile_id, r, c)""",
    " ".join([f"{b}_{n}" for b in _BANDS for n in ("mean", "median", "max")] + ["valid_fraction", "scl_median", "ndvi_entropy"]),
    digits=9,  # means and medians of few values tie at six
)
_ASKED = [
    {}, {"kept": True}, {"branch": [0, 2]}, {"kept": False, "branch": [1]}, {"reason": {"null": False}, "total": {"from": 2, "to": 3}}, {"reason__not": "area", "kept": None}, {"branch": []},
]


def _asked(v):
    rows = v("tile_rows").select("tile_id", (c("kept") > 0).alias("kept"), (c("tile_id") % 3).alias("branch"), "reason", "total")
    return reduce(lambda a, b: a.unionByName(b), (rows.where(predicates.condition(**w)).select(F.lit(i).alias("filter_no"), "tile_id") for i, w in enumerate(_ASKED)))


register(
    "p11_optional_filters",
    _asked,
    """with t as (select tile_id, kept > 0 as kept, tile_id % 3 as branch, reason, total from tile_rows)
       select 0 as filter_no, tile_id from t union all select 1, tile_id from t where kept union all select 2, tile_id from t where branch in (0, 2) union all select 3, tile_id from t where not kept and branch = 1
       union all select 4, tile_id from t where reason is not null and total between 2 and 3 union all select 5, tile_id from t where reason <> 'area'""",
)

# --- training rows of yields -------------------------------------------------------------------------------------

_NUMERIC, _CATEGORIES = ["gdd", "ph", "n_ppm"], ["crop_code", "texture"]


def _training(v):
    """One row per yield; some features are missing, and held-out rows have a crop that training doesn't."""
    rows = v("yield_obs").join(v("field_seasons").select(c("season_id").alias("obs_id"), "crop_code"), "obs_id").join(v("soil_profiles").select(c("profile_id").alias("obs_id"), "ph", "n_ppm", "texture"), "obs_id").join(v("weather_daily").select(c("row_id").alias("obs_id"), "gdd"), "obs_id")
    held = c("obs_id") % 5 == 0
    crop = F.when(c("obs_id") % 11 == 0, None).when(held & (c("obs_id") % 3 == 0), "flax").otherwise(c("crop_code"))
    return rows.select("obs_id", held.alias("held"), c("yield_kg_ha"), F.when(c("obs_id") % 7 > 0, c("gdd")).alias("gdd"), F.when(c("obs_id") % 6 > 0, c("ph")).alias("ph"), c("n_ppm").cast("double").alias("n_ppm"), crop.alias("crop_code"), F.when(c("obs_id") % 9 > 0, c("texture")).alias("texture"))


def _encoded(v):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    ready = models.imputed(_training(v), _NUMERIC, _CATEGORIES, "held")
    made = Pipeline(stages=models.one_hot(_CATEGORIES)).fit(ready.where("not held")).transform(ready)
    hot = [F.array_join(F.transform(vector_to_array(f"{x}_hot"), lambda y: y.cast("int").cast("string")), "").alias(f"{x}_hot") for x in _CATEGORIES]
    return made.select("obs_id", *_NUMERIC, *_CATEGORIES, *hot)


register(
    "m7_imputed_features",
    _encoded,
    """with t as (select obs_id, obs_id % 5 = 0 as held, case when obs_id % 7 > 0 then gdd end as gdd, case when obs_id % 6 > 0 then ph end as ph, n_ppm::double as n_ppm, case when obs_id % 11 = 0 then null when obs_id % 5 = 0 and obs_id % 3 = 0 then 'flax' else crop_code end as crop_code, case when obs_id % 9 > 0 then texture end as texture
         from yield_obs join (select season_id as obs_id, crop_code from field_seasons) s using (obs_id) join (select profile_id as obs_id, ph, n_ppm, texture from soil_profiles) p using (obs_id) join (select row_id as obs_id, gdd from weather_daily) w using (obs_id)),
       m as (select median(gdd) as gdd, median(ph) as ph, median(n_ppm) as n_ppm from t where not held), k as (select (select crop_code from t where not held and crop_code is not null group by 1 order by count(*) desc, 1 limit 1) as crop_code, (select texture from t where not held and texture is not null group by 1 order by count(*) desc, 1 limit 1) as texture),
       f as (select obs_id, held, coalesce(t.gdd, m.gdd) as gdd, coalesce(t.ph, m.ph) as ph, coalesce(t.n_ppm, m.n_ppm) as n_ppm, coalesce(t.crop_code, k.crop_code) as crop_code, coalesce(t.texture, k.texture) as texture from t, m, k),
       a as (select list(distinct crop_code order by crop_code) as crops, list(distinct texture order by texture) as textures from f where not held)
       select obs_id, gdd, ph, n_ppm, crop_code, texture, array_to_string(list_transform(crops, lambda x: if(x = crop_code, '1', '0')), '') as crop_code_hot, array_to_string(list_transform(textures, lambda x: if(x = texture, '1', '0')), '') as texture_hot from f, a""",
    "gdd ph n_ppm",
)
register("m7_yield_pipeline", lambda v: models.yield_pipeline(_training(v), _NUMERIC, _CATEGORIES, "yield_kg_ha", "held")[1])
