"""Registered queries of run rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import scenario
from fieldspark.operators import rollup
from fieldspark.plans.queries import register

c = F.col
_PRIMES = dict(zip(rollup.MEANS, (7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43), strict=True))
_WORDS = ["alpha", "beta", " "]


def _tiles(v):
    """Tiles of every run: values by the tile's number, some of them missing; of some runs all alike."""
    n = c("tile_id")
    few = F.when(c("run") % 4 == 0, c("run")).otherwise(n)
    return v("tile_rows").select(
        "run",
        *(F.when(n % p > 0, n % p / p).alias(x) for x, p in _PRIMES.items()),
        F.when(n % 5 > 0, n % 9).alias("n_valid_scenes"),
        *(F.element_at(F.array(*(F.lit(w) for w in _WORDS)), ((few + i) % 3 + 1).cast("int")).alias(x) for i, x in enumerate(rollup.CATEGORIES)),
        (n % 97 == 5).alias("low_quality_input"),
        (n % 89 == 5).alias("road_barrier_retry_used"),
        F.when(n % 3 > 0, n % 101 / 1900.0).alias("water_edge_overlap_ratio"),
        (n % 103 / 1270.0).alias("road_edge_overlap_ratio"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("act"), (n % 4).cast("string")), F.lit(" "))).alias("region_profile_actions"),
        F.when(n % 6 > 0, F.concat(F.lit("s"), (n % 50).cast("string"))).alias("selected_scene_signature"),
    )


def _category(i: int, name: str, none: str | None) -> str:
    x = f"nullif(trim(['alpha', 'beta', ' '][((case when run % 4 = 0 then run else n end) + {i}) % 3 + 1]), '')"
    default = "null" if none is None else f"'{none}'"
    return f"case when min({x}) is null then {default} when min({x}) = max({x}) then min({x}) else 'mixed' end as {name}"


register(
    "z40_run_tiles_rollup",
    lambda v: rollup.run_rollup(_tiles(v), "run"),
    f"""with t as (select run, tile_id as n from tile_rows)
       select run, count(*) as tiles, {", ".join(f"coalesce(round(avg(case when n % {p} > 0 then n % {p} / {p} end) + 1e-12, 4), {'null' if rollup.MEANS[x] is None else '0'})::double as {x}" for x, p in _PRIMES.items())},
         coalesce(round_even(avg(case when n % 5 > 0 then n % 9 end), 0), 0)::int as n_valid_scenes, {", ".join(_category(i, x, none) for i, (x, none) in enumerate(rollup.CATEGORIES.items()))},
         bool_or(n % 97 = 5) as date_selection_low_confidence, bool_or(n % 89 = 5) as road_barrier_retry_used, coalesce(bool_or(case when n % 3 > 0 then n % 101 / 1900e0 > 0.05e0 end), false) as water_edge_risk_detected, bool_or(n % 103 / 1270e0 > 0.08e0) as road_drift_risk_detected,
         coalesce(array_to_string(list_sort(list(distinct 'act' || n % 4) filter (where n % 2 = 0)), ','), '') as region_profile_actions,
         coalesce(substr(sha1(string_agg('s' || n % 50, '|' order by 's' || n % 50) filter (where n % 6 > 0)), 1, 16), '') as selected_scene_signature from t group by 1""",
    " ".join(rollup.MEANS),
)

# --- scenario response, crop tables ------------------------------------------------------------------------------

_SCENARIO = """(select field_id, s::int as scenario, 0.2e0 + (field_id + 7 * s) % 30 / 10e0 as yield_ratio, s * 10e0 - 50e0 as irrigation_pct, s * 20e0 - 100e0 as fertilizer_pct, s * 30e0 - 40e0 as expected_rain_mm, s * 1e0 - 5e0 as temperature_delta_c, 0.5e0 + s / 10e0 as cloud_cover_factor"""
_SERIES = "(select field_id, metric, observed_on, avg(case when event_id % 13 > 0 then value end) as value from metric_obs group by 1, 2, 3)"


def _sweep(v):
    s = c("scenario")
    return v("fields").select("field_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("scenario")).select(
        "field_id", "scenario", (0.2 + (c("field_id") + 7 * s) % 30 / 10).alias("yield_ratio"), (s * 10.0 - 50).alias("irrigation_pct"), (s * 20.0 - 100).alias("fertilizer_pct"), (s * 30.0 - 40).alias("expected_rain_mm"), (s * 1.0 - 5).alias("temperature_delta_c"), (0.5 + s / 10).alias("cloud_cover_factor"),
    )


_TABLE = ", ".join(f"('{m}', {', '.join(f'{x}e0' for x in row)})" for m, row in scenario.SENSITIVITY.items())
_NAMES = (*scenario.EFFECTS, "lowest", "highest")
register(
    "m12_projected_series",
    lambda v: scenario.projected(v("metric_obs").groupBy("field_id", "metric", "observed_on").agg(F.avg(F.when(c("event_id") % 13 > 0, c("value"))).alias("value")), _sweep(v), ["field_id"]).select("field_id", "metric", "observed_on", "scenario", "projected"),
    f"""with d as (from (values {_TABLE}) as d(metric, {", ".join(f'"{x}"' for x in _NAMES)})), a as (select x.*, {", ".join(f'coalesce(d."{x}", {none}e0) as k_{x}' for x, none in zip(_NAMES, scenario.OTHER_INDEX, strict=True))} from {_SERIES} x left join d using (metric)),
       w as {_SCENARIO} from fields, range(11) as r(s)),
       b as (select field_id, metric, observed_on, scenario, value, k_lowest, k_highest, greatest(-0.8e0, least(1.5e0, yield_ratio - 1)) * k_yield + irrigation_pct / 100 * k_irrigation + fertilizer_pct / 100 * k_fertilizer + greatest(-0.5e0, least(0.5e0, (expected_rain_mm - 50) / 300)) * k_rain + temperature_delta_c * k_temperature + (cloud_cover_factor - 1) * k_solar as ch from a join w using (field_id))
       select field_id, metric, observed_on, scenario, case when value is not null then greatest(k_lowest, least(k_highest, value + ch * abs(value))) end as projected from b""",
    "projected",
)


def _feature_rows(v):
    """Feature rows of field seasons under the eleven steps of a sweep."""
    soil = v("soil_profiles").select("field_id", "profile_id", c("n_ppm").cast("double").alias("soil_n_ppm"), F.when(c("profile_id") % 3 > 0, c("n_ppm") * 0.7).alias("soil_p_ppm"), F.lit(None).cast("double").alias("soil_k_ppm"))
    weather = v("weather_daily").select(c("row_id").alias("profile_id"), F.when(c("row_id") % 4 > 0, c("precip")).alias("precipitation"), F.when(c("row_id") % 5 > 0, c("soil")).alias("soil_moisture"), (c("vpd")).alias("vpd_mean"), c("tmean").alias("temperature_mean_c"), F.when(c("row_id") % 6 > 0, c("gdd") * 10).alias("gdd_sum"))
    made = soil.join(weather, "profile_id").withColumn("management_total", F.when(c("profile_id") % 2 == 0, c("profile_id") % 9 / 2)).withColumn("solar_radiation_mean", c("profile_id") % 200 + 60.0).withColumn("observed_days", F.when(c("profile_id") % 7 > 0, c("profile_id") % 90 * 1.0))
    return made.join(_sweep(v).where("scenario = field_id % 11").drop("yield_ratio"), "field_id")


_MOVED = ["management_total", "soil_n_ppm", "soil_p_ppm", "soil_k_ppm", "precipitation", "soil_moisture", "solar_radiation_mean", "temperature_mean_c", "gdd_sum", "vpd_mean"]
register(
    "m12_adjusted_features",
    lambda v: scenario.adjusted(_feature_rows(v)).select("profile_id", "scenario", *_MOVED),
    f"""with f as (select profile_id, field_id, n_ppm::double as n, case when profile_id % 3 > 0 then n_ppm * 0.7e0 end as p, case when profile_id % 4 > 0 then precip end as precipitation, case when profile_id % 5 > 0 then soil end as soil, vpd, tmean, case when profile_id % 6 > 0 then gdd * 10 end as gdd,
         case when profile_id % 2 = 0 then profile_id % 9 / 2 end as m, profile_id % 200 + 60e0 as sun, case when profile_id % 7 > 0 then profile_id % 90 * 1e0 end as days from (select profile_id, field_id, n_ppm from soil_profiles) s join (select row_id as profile_id, precip, soil, vpd, tmean, gdd from weather_daily) w using (profile_id)),
       w as {_SCENARIO} from fields, range(11) as r(s) where s = field_id % 11),
       x as (select *, coalesce(soil, {scenario.DRY_MOISTURE}e0) as b, abs(irrigation_pct) * 0.1e0 + abs(fertilizer_pct) * 0.15e0 as effort from f join w using (field_id)),
       y as (select *, b + expected_rain_mm * 0.002e0 * (1 - b / 0.55e0) + greatest(0.35e0 - b, 0) * (1 - exp(-0.03e0 * greatest(irrigation_pct, 0))) as wet from x)
       select profile_id, scenario, case when m is not null then greatest(0, m + effort) when irrigation_pct <> 0 or fertilizer_pct <> 0 then effort end as management_total, greatest(2, least(80, n * (1 + fertilizer_pct / 100))) as soil_n_ppm, case when p is not null then greatest(2, least(65, p * (1 + fertilizer_pct / 100))) end as soil_p_ppm, null::double as soil_k_ppm,
         case when precipitation is not null then greatest(0, precipitation + expected_rain_mm) when expected_rain_mm > 0 then expected_rain_mm end as precipitation, case when soil is not null or irrigation_pct <> 0 or expected_rain_mm <> 0 then greatest(0.02e0, least(0.6e0, case when wet > 0.35e0 then 0.35e0 + (wet - 0.35e0) * 0.6e0 else wet end)) end as soil_moisture,
         case when cloud_cover_factor <> 1 and sun > 0 then greatest(0, least(245, sun * cloud_cover_factor)) else sun end as solar_radiation_mean, tmean + temperature_delta_c as temperature_mean_c, case when gdd is not null then case when temperature_delta_c <> 0 then greatest(0, gdd + temperature_delta_c * coalesce(days, 120)) else gdd end end as gdd_sum,
         case when vpd is not null then case when temperature_delta_c <> 0 then greatest(0, vpd + temperature_delta_c * 0.06e0) else vpd end end as vpd_mean from y""",
    " ".join(_MOVED),
)
_CURVES = """(select crop_code, nutrient, 1e0 + k as zero, 15e0 + 4 * k + b as best, 30e0 + 5 * k + b as toxic, 45e0 + 5 * k + b as lethal, 0.4e0 + k / 50e0 as low, 1.08e0 as peak, 0.9e0 - b / 50e0 as bad, 0.5e0 as worst
     from (select crop_code, length(crop_code) as k from field_seasons where crop_code <> 'soy' group by 1 union all select null, 3) c, (select 'n_ppm' as nutrient, 0 as b union all select 'k_ppm', 4) n)"""


def _curves(v):
    """Curves of all crops but soy, which takes the default; corners by rule."""
    crops = v("field_seasons").where("crop_code <> 'soy'").select("crop_code").distinct().select("crop_code", F.length("crop_code").alias("k"))
    spark = crops.sparkSession
    crops = crops.unionByName(spark.createDataFrame([(None, 3)], "crop_code string, k int"))
    k, b = c("k"), c("b")
    both = crops.crossJoin(F.broadcast(spark.createDataFrame([("n_ppm", 0), ("k_ppm", 4)], "nutrient string, b int")))  # two rows
    return both.select("crop_code", "nutrient", (1.0 + k).alias("zero"), (15.0 + 4 * k + b).alias("best"), (30.0 + 5 * k + b).alias("toxic"), (45.0 + 5 * k + b).alias("lethal"), (0.4 + k / 50).alias("low"), F.lit(1.08).alias("peak"), (0.9 - b / 50).alias("bad"), F.lit(0.5).alias("worst"))


def _levels(v):
    return v("soil_profiles").join(v("field_seasons").select(c("season_id").alias("profile_id"), "crop_code"), "profile_id").select("profile_id", "crop_code", "n_ppm", F.when(c("profile_id") % 4 > 0, c("profile_id") % 83).alias("k_ppm"))


register(
    "a17_crop_nutrients",
    lambda v: scenario.limiting_nutrient(scenario.nutrient_terms(_levels(v), ["profile_id"], ["n_ppm", "k_ppm"], _curves(v)), ["profile_id"]),
    f"""with d as {_CURVES}, l as (select profile_id, crop_code, n_ppm, case when profile_id % 4 > 0 then profile_id % 83 end as k_ppm from soil_profiles join (select season_id as profile_id, crop_code from field_seasons) s using (profile_id)),
       x as (select profile_id, crop_code, 'n_ppm' as nutrient, n_ppm::double as x from l union all select profile_id, crop_code, 'k_ppm', k_ppm from l where k_ppm is not null),
       t as (select profile_id, x.nutrient, case when x <= zero then low when x <= best then low + (1 - exp(-3 * (x - zero) / (best - zero))) * (peak - low) when x <= toxic then peak when x <= lethal then peak - (x - toxic) / (lethal - toxic) * (peak - bad) else greatest(worst, bad - least((x - lethal) / lethal, 1) * (bad - worst)) end as term
         from x join d on d.nutrient = x.nutrient and d.crop_code is not distinct from case when x.crop_code = 'soy' then null else x.crop_code end)
       select profile_id, greatest(0.35e0, least(1.1e0, min(term))) as factor, arg_min(nutrient, {{'a': round(term, 9), 'b': nutrient}}) as nutrient from t group by 1""",
    "factor",
)
