"""Registered queries: each operator over the domain views, with the SQL that must give the same rows.

Doubles are rounded to six decimals on both sides, as sums may differ in their
last bits with the order of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import agronomy as ag
from fieldspark.functions import geo
from fieldspark.functions import spectral as sp
from fieldspark.functions import suitability as su
from fieldspark.functions import weather as we
from fieldspark.operators import focal, generators, iterative, models, mosaic, ranks, relational, scoring, series, zonal
from fieldspark.sources import readers
from fieldspark.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6
c = F.col


def nudge(digits: int) -> str:
    """Added before rounding, as text: exact ties, which differ in their last bits with row order, then all go up."""
    return f"1e-{digits + 3}"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to so many decimals; + 0 turns a negative zero into zero."""
    return df.select(*((F.round(F.col(x.name) + float(nudge(digits)), digits) + 0.0).alias(x.name) if isinstance(x.dataType, T.DoubleType) else F.col(x.name) for x in df.schema))


def register(name: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> None:
    """``build(v)`` makes the DataFrame, v(name) being a table or view; ``doubles`` are columns that SQL rounds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(lambda x: view(spark, sf_dir, x)), digits)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        inner = with_views(re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"count(*) filter (where \1)", sql))
        if doubles:
            fixed = ", ".join(f"round({x}::double + {nudge(digits)}, {digits}) + 0 as {x}" for x in doubles.split())
            ORACLE_SQL[name] = f"select * replace ({fixed}) from ({inner}) as q"
        else:
            ORACLE_SQL[name] = inner


# --- minimum slice: weekly series of every field -------------------------------------------------

register(
    "w1_weekly_smoothed",
    lambda v: series.smoothed(v("weekly_ndvi").select("field_id", "week_start", "v", "n"), ["field_id"], "week_start", "v"),
    "select field_id, week_start, v, n, case when count(*) over (partition by field_id) <= 2 then v else avg(v) over (partition by field_id order by week_start rows between 1 preceding and 1 following) end as smoothed from weekly_ndvi",
    "v smoothed",
)

# --- X: spectral -----------------------------------------------------------------------------------

register(
    "x2_x5_indices",
    lambda v: sp.all_indices(v("pixels")).select("tile_id", "t", "r", "c", "ndvi", "ndwi", "mndwi", "ndmi", "bsi", "msi"),
    """select tile_id, t, r, c, (b8 - b4) / nullif(b8 + b4, 0) as ndvi, (b3 - b8) / nullif(b3 + b8, 0) as ndwi, (b3 - b11) / nullif(b3 + b11, 0) as mndwi, (b8 - b11) / nullif(b8 + b11, 0) as ndmi,
       ((b11 + b4) - (b8 + b2)) / nullif((b11 + b4) + (b8 + b2), 0) as bsi, b11 / nullif(b8, 0) as msi from pixels""",
    "ndvi ndwi mndwi ndmi bsi msi",
    digits=9,
)
register(
    "x4_red_edge",
    lambda v: sp.all_indices(v("pixels").withColumns({"b5": c("b4") * 0.6 + c("b8") * 0.4, "b7": c("b4") * 0.2 + c("b8") * 0.8, "b8a": c("b8") * 0.95})).select("tile_id", "t", "r", "c", "ndre", "cire", "re_slope"),
    """select tile_id, t, r, c, (b8a - b5) / (b8a + b5) as ndre, b8a / b5 - 1 as cire, (b7 - b5) / (b7 + b5) as re_slope
       from (select *, b4 * 0.6e0 + b8 * 0.4e0 as b5, b4 * 0.2e0 + b8 * 0.8e0 as b7, b8 * 0.95e0 as b8a from pixels) as p""",
    "ndre cire re_slope",
)
register(
    "x6_x7_pixel_masks",
    lambda v: v("pixels").groupBy("tile_id", "t").agg(F.count_if(sp.valid_pixel(c("scl"))).alias("valid"), F.count_if(sp.cloud_pixel(c("scl"))).alias("cloudy"), F.count("*").alias("n")),
    "select tile_id, t, count_if(scl in (4, 5, 6)) as valid, count_if(scl in (3, 8, 9, 10)) as cloudy, count(*) as n from pixels group by 1, 2",
)
register(
    "x8_radar",
    lambda v: v("pixels").select("tile_id", "t", "r", "c", sp.radar_db(c("b4")).alias("vh_db"), sp.radar_ratio(c("b4"), c("b8")).alias("ratio")),
    "select tile_id, t, r, c, 10 * log10(b4 + 1e-10) as vh_db, b4 / (b8 + 1e-6) as ratio from pixels",
    "vh_db ratio",
)
register(
    "x9_scene_score",
    lambda v: v("indexed").groupBy("tile_id", "t").agg((100 * F.avg(sp.cloud_pixel(c("scl")).cast("int"))).alias("cloud"), F.avg("ndvi").alias("ndvi")).withColumn("score", sp.scene_score(c("cloud"), c("ndvi"))),
    "select *, (1 - cloud / 100) * 0.7e0 + least(ndvi, 1) * 0.3e0 as score from (select tile_id, t, 100 * avg(case when scl in (3, 8, 9, 10) then 1 else 0 end) as cloud, avg(ndvi) as ndvi from indexed group by 1, 2) as s",
    "cloud ndvi score",
)

# --- A: weather and agronomy ----------------------------------------------------------------------------

register("a1_gdd", lambda v: v("weather_daily").select("row_id", we.gdd(c("tmean") + 4, c("tmean") - 3).alias("gdd")), "select row_id, case when tmean is null then 0 else greatest((tmean + 4 + tmean - 3) / 2 - 10, 0) end as gdd from weather_daily", "gdd")
register(
    "a2_a3_vpd",
    lambda v: v("weather_daily").where("tmean is not null").select("row_id", we.vpd_from_dew_point(c("tmean"), c("tmean") - c("vpd") * 2).alias("by_dew"), we.vpd_from_humidity(c("tmean"), c("precip") * 12).alias("by_rh")),
    """select row_id, greatest(0.6108e0 * exp(17.27e0 * tmean / (tmean + 237.3e0)) - 0.6108e0 * exp(17.27e0 * (tmean - vpd * 2) / (tmean - vpd * 2 + 237.3e0)), 0) as by_dew,
       greatest(0.6108e0 * exp(17.27e0 * tmean / (tmean + 237.3e0)) * (1 - greatest(1, least(100, precip * 12)) / 100), 0) as by_rh from weather_daily where tmean is not null""",
    "by_dew by_rh",
)
register(
    "a4_wind",
    lambda v: v("weather_daily").select("row_id", we.wind_speed(c("vpd") - 2, c("precip") - 5).alias("speed"), we.wind_direction(c("vpd") - 2, c("precip") - 5).alias("direction"), we.wind_vector(c("vpd"), c("precip") * 36)[0].alias("u"), we.wind_vector(c("vpd"), c("precip") * 36)[1].alias("v")),
    """select row_id, sqrt((vpd - 2) * (vpd - 2) + (precip - 5) * (precip - 5)) as speed, (270 - degrees(atan2(precip - 5, vpd - 2)) + 720) - 360 * floor((270 - degrees(atan2(precip - 5, vpd - 2)) + 720) / 360) as direction,
       -vpd * sin(radians(precip * 36)) as u, -vpd * cos(radians(precip * 36)) as v from weather_daily""",
    "speed direction u v",
)
_RA = """greatest(0, 24 * 60 / pi() * 0.082e0 * (1 + 0.033e0 * cos(2 * pi() * doy / 365)) * (w * sin(phi) * sin(d) + cos(phi) * cos(d) * sin(w)))"""
_SUN = """(select *, acos(greatest(-1, least(1, -tan(phi) * tan(d)))) as w from (select row_id, soil, dayofyear(observed_on) as doy, radians(45 + row_id % 20) as phi, 0.409e0 * sin(2 * pi() * dayofyear(observed_on) / 365 - 1.39e0) as d from weather_daily) as x) as y"""
register(
    "a5_a6_solar",
    lambda v: v("weather_daily").withColumn("ra", we.extraterrestrial_radiation((45 + c("row_id") % 20).cast("double"), F.dayofyear("observed_on").cast("double"))).select("row_id", "ra", we.solar_from_cloud(c("ra"), c("soil") * 4).alias("solar")),
    f"select row_id, ra, greatest(0, ra * (0.25e0 + 0.5e0 * (1 - greatest(0, least(1, soil * 4))))) as solar from (select row_id, soil, {_RA} as ra from {_SUN}) as z",
    "ra solar",
)
register(
    "a7_day_length",
    lambda v: v("weather_daily").select("row_id", we.day_length(F.when(c("row_id") % 9 > 0, (45 + c("row_id") % 20).cast("double")), F.dayofyear("observed_on").cast("double")).alias("hours")),
    """select row_id, case when row_id % 9 = 0 then 12 else 24 / pi() * acos(greatest(-1, least(1, -tan(radians(45 + row_id % 20)) * tan(radians(23.45e0 * sin(radians(360e0 / 365 * (284 + dayofyear(observed_on))))))))) end as hours from weather_daily""",
    "hours",
)
register(
    "a8_reference_et",
    lambda v: v("weather_daily").where("tmean is not null").select("row_id", we.reference_et(c("tmean"), c("tmean") + 5, c("tmean") - 4, c("precip") * 2, (45 + c("row_id") % 20).cast("double"), c("soil") * 20, c("vpd")).alias("et0")),
    """select row_id, greatest(0.4e0, least(11.5e0, (0.408e0 * delta * rn + 0.066e0 * (900 / (tmean + 273)) * wind * least(dry, es)) / (delta + 0.066e0 * (1 + 0.34e0 * wind)))) as et0 from (
       select row_id, tmean, case when precip > 0 then precip * 2 else 14 end * 0.77e0 * greatest(0.75e0, least(1.05e0, 1.05e0 - (45 + row_id % 20) / 180e0)) as rn, case when vpd > 0 then vpd else 0.8e0 end as dry,
       greatest(0.1e0, least(12, case when soil = 0 then 2 else soil * 20 end)) as wind, (0.6108e0 * exp(17.27e0 * (tmean + 5) / (tmean + 5 + 237.3e0)) + 0.6108e0 * exp(17.27e0 * (tmean - 4) / (tmean - 4 + 237.3e0))) / 2 as es,
       4098 * 0.6108e0 * exp(17.27e0 * tmean / (tmean + 237.3e0)) / ((tmean + 237.3e0) * (tmean + 237.3e0)) as delta from weather_daily where tmean is not null) as x""",
    "et0",
)
register(
    "a9_weekly_et",
    lambda v: v("weekly_weather").where("tmean is not null").select("field_id", "season_year", "week_start", we.weekly_et(c("tmean"), c("vpd"), F.lit(2.0), c("gdd") / 7, F.when(c("n") > 1, c("precip") * 10).otherwise(0.0)).alias("et")),
    """select field_id, season_year, week_start, greatest(1, case when n > 1 and precip > 0 then 1.26e0 * (d / (d + 0.067e0)) * (precip * 10 * 0.77e0 / 7 / 2.45e0) else 1.5e0 + 0.12e0 * tmean + 2.8e0 * vpd + 0.36e0 + 0.003e0 * gdd / 7 end) as et
       from (select *, 4098 * 0.6108e0 * exp(17.27e0 * tmean / (tmean + 237.3e0)) / ((tmean + 237.3e0) * (tmean + 237.3e0)) as d from weekly_weather where tmean is not null) as x""",
    "et",
)
register(
    "a10_a33_soil",
    lambda v: v("soil_profiles").select("profile_id", ag.soil_capacity(c("texture"))[0].alias("taw"), ag.soil_capacity(c("texture"))[1].alias("raw_share"), ag.texture_code(c("texture")).alias("code"), ag.nutrient_availability(ag.texture_code(c("texture"))).alias("availability")),
    """select profile_id, case texture when 'sand' then 75e0 when 'clay' then 155e0 else 120e0 end as taw, case texture when 'sand' then 0.45e0 when 'clay' then 0.38e0 else 0.4e0 end as raw_share,
       case texture when 'sand' then 1e0 when 'clay' then 8e0 else 4e0 end as code, case texture when 'sand' then 0.82e0 when 'clay' then 0.85e0 else 1.05e0 end as availability from soil_profiles""",
    "taw raw_share code availability",
)
register(
    "a11_crop_profile",
    lambda v: v("field_seasons").select("season_id", "crop_code", ag.crop_profile(c("crop_code")).alias("p")).select("season_id", "crop_code", "p.peak_week", "p.reproductive"),
    "select season_id, crop_code, case crop_code when 'corn' then 10 when 'sunflower' then 8 else 9 end as peak_week, case crop_code when 'corn' then 1.12e0 when 'soy' then 1.02e0 when 'sunflower' then 1e0 else 1.08e0 end as reproductive from field_seasons",
    "reproductive",
)
register(
    "a12_a13_events",
    lambda v: v("management_events").select("order_id", "line_id", ag.is_irrigation(c("event_type"), c("unit")).alias("irrigation"), ag.is_nitrogen(c("event_type"), c("unit")).alias("nitrogen"), ag.irrigation_mm(c("amount"), c("unit")).alias("amount_mm"), ag.nitrogen_kg(c("amount"), F.lit("g/m2")).alias("amount_kg")),
    "select order_id, line_id, event_type = 'irrigation' as irrigation, event_type = 'fertilizer' as nitrogen, case when unit = 'cm' then amount * 10 else amount end as amount_mm, amount / 1000 as amount_kg from management_events",
    "amount_mm amount_kg",
)
register(
    "a12_text_class",
    lambda v: v("documents").select("doc_id", ag.is_irrigation(c("text"), c("source")).alias("irrigation"), ag.is_nitrogen(c("text"), c("source")).alias("nitrogen")),
    "select doc_id, regexp_matches(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'irrig|полив|water') as irrigation, regexp_matches(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'fert|nitrogen|азот|urea|ammon|селитр|карбамид') as nitrogen from documents",
)
register("a14_precedence", lambda v: v("weather_daily").select("row_id", F.coalesce("tmean", "vpd", "precip").alias("value")), "select row_id, coalesce(tmean, vpd, precip) as value from weather_daily", "value")
register(
    "a15_a16_responses",
    lambda v: v("soil_profiles").select("profile_id", ag.nutrient_response(c("n_ppm").cast("double"), 5, 25, 45, 55, 0.5, 1.1, 0.8, 0.4).alias("response"), ag.optimum_band(c("ph"), 4.5, 6.0, 7.0, 8.5, 0.6, 1.0, 0.7).alias("band")),
    """select profile_id, case when n_ppm <= 5 then 0.5e0 when n_ppm <= 25 then 0.5e0 + (1 - exp(-3 * (n_ppm - 5) / 20e0)) * 0.6e0 when n_ppm <= 45 then 1.1e0 when n_ppm <= 55 then 1.1e0 - (n_ppm - 45) / 10e0 * 0.3e0
         else greatest(0.4e0, 0.8e0 - least((n_ppm - 55) / 55e0, 1) * 0.4e0) end as response,
       case when x <= 6 then 0.6e0 + (x - 4.5e0) / 1.5e0 * 0.4e0 when x <= 7 then 1 else 1 - (x - 7) / 1.5e0 * 0.3e0 end as band from (select *, greatest(4.5e0, least(8.5e0, ph)) as x from soil_profiles) as s""",
    "response band",
)
register(
    "a19_combined_factor",
    lambda v: v("soil_profiles").select("profile_id", scoring.combined_factor([0.5 + c("n_ppm") / 100, c("ph") / 8, 0.9 + c("profile_id") % 3 / 10]).alias("factor")),
    "select profile_id, greatest(0.15e0, least(1.45e0, 0.6e0 * exp((ln(a) + ln(b) + ln(d)) / 3) + 0.4e0 * least(a, b, d))) as factor from (select profile_id, 0.5e0 + n_ppm / 100e0 as a, ph / 8 as b, 0.9e0 + profile_id % 3 / 10e0 as d from soil_profiles) as s",
    "factor",
)
register(
    "a20_a21_shape",
    lambda v: v("fields").select("field_id", ag.bounded_compactness(c("area_m2"), c("perimeter_m")).alias("compactness"), ag.utm_epsg(c("minx"), c("miny")).alias("epsg"), ag.latitude_band(c("miny")).alias("band"), ag.latitude_bucket(c("miny")).alias("bucket"), ag.shape_index(c("area_m2"), c("perimeter_m")).alias("shape_index"), ag.pixel_shape_index(c("area_m2"), c("perimeter_m")).alias("pixel_index")),
    """select field_id, greatest(0.1e0, least(1, 4 * pi() * area_m2 / (perimeter_m * perimeter_m))) as compactness, cast(32600 + floor((minx + 180) / 6) + 1 as bigint) as epsg, case when miny < 48 then 'south' when miny <= 57 then 'central' else 'north' end as band,
       case when miny < 40 then 'lat_lt_40' when miny < 48 then 'lat_40_48' when miny < 55 then 'lat_48_55' when miny < 62 then 'lat_55_62' else 'lat_gt_62' end as bucket, perimeter_m / (2 * sqrt(pi() * area_m2)) as shape_index, perimeter_m / (4 * sqrt(area_m2)) as pixel_index from fields""",
    "compactness shape_index pixel_index",
)
register(
    "a22_quality_band",
    lambda v: v("fields").select("field_id", ag.quality_band(c("quality_score"), c("source")).alias("band")),
    "select field_id, case when source = 'manual' then 'manual' when quality_score is null then 'unknown' when quality_score >= 0.82 then 'high' when quality_score >= 0.62 then 'medium' else 'low' end as band from fields",
)
register(
    "a23_freshness",
    lambda v: v("point_weather").select("event_id", ag.freshness(c("observed_at"), F.lit("2024-01-20 00:00:00").cast("timestamp"), 86400 * 3).alias("state")),
    "select event_id, case when epoch(timestamp '2024-01-20 00:00:00') - floor(epoch(observed_at)) <= 259200 then 'fresh' else 'stale' end as state from point_weather",
)
register(
    "a24_a31_a32_tiles",
    lambda v: v("qa_results").select("event_id", ag.tile_weight(c("empty_output"), c("status") == "failed", c("field_count") == 0).alias("weight"), ag.tile_quality_score(c("queue_wall_s") / 50, c("field_count") / 100, c("region") / 30).alias("quality"), ag.skip_low_observation(c("field_count") / 60).alias("skip"), ag.boosted(c("queue_wall_s") / 50, F.when(c("region") == 3, "boundary_first").otherwise("other"), 0.05, 0.1).alias("boosted")),
    """select event_id, case when field_count = 0 then 2e0 when status = 'failed' then 0.25e0 when empty_output then 0.5e0 else 1e0 end as weight,
       least(1, 0.45e0 * least(1, greatest(0, queue_wall_s / 50)) + 0.35e0 * least(1, field_count / 100e0 * 4) + 0.2e0 * least(1, region / 30e0 * 3)) as quality, field_count / 60e0 >= 0.85e0 as skip,
       case when region = 3 then least(1, queue_wall_s / 50 + 0.05e0) else queue_wall_s / 50 end as boosted from qa_results""",
    "weight quality boosted",
)
register(
    "a25_holdout",
    lambda v: v("field_seasons").select("season_id", ag.in_holdout(c("season_year"), c("crop_code")).alias("holdout")),
    """select season_id, list_sum(list_transform(string_split(sha1(season_year::varchar || ':' || crop_code), ''), lambda x: instr('0123456789abcdef', x) - 1)) % 5 = 0 as holdout from field_seasons""",
)
register("a29_slug", lambda v: v("pages").select("page_id", ag.slug(c("url")).alias("slug")), "select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as slug from pages")
register(
    "a30_dates",
    lambda v: v("yield_obs").select("obs_id", ag.week_start(c("observed_on")).alias("week_start"), ag.years_back(c("observed_on"), 2).alias("two_years_back")),
    "select obs_id, cast(date_trunc('week', observed_on) as date) as week_start, cast(observed_on - interval 2 year as date) as two_years_back from yield_obs",
)
register(
    "a34_weekly_defaults",
    lambda v: v("weekly_weather").select("field_id", "season_year", "week_start", *(x.alias(n) for n, x in we.weekly_defaults(c("tmean"), c("tmean") + 5, c("tmean") - 5, c("precip"), c("vpd"), c("gdd"), c("vpd")).items())),
    """select field_id, season_year, week_start, coalesce(nullif(tmean, 0), 15) as tmean, coalesce(nullif(tmean + 5, 0), nullif(tmean, 0), 22) as tmax, coalesce(nullif(tmean - 5, 0), nullif(tmean, 0), 8) as tmin,
       coalesce(nullif(precip, 0), 10) as precip, coalesce(nullif(vpd, 0), 1) as vpd, coalesce(nullif(gdd, 0), 15) as solar, coalesce(nullif(vpd, 0), 2) as wind from weekly_weather""",
    "tmean tmax tmin precip vpd solar wind",
)

# --- Z: grouped and zonal statistics ---------------------------------------------------------------------

_Z1 = "count(value) as n, avg(value) as mean, min(value) as min, max(value) as max, median(value) as median, quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.75) as p75"
_STATS = "mean min max median p25 p75"
register("z1_summary", lambda v: zonal.summary(v("metric_obs"), ["field_id", "metric"]), f"select field_id, metric, {_Z1} from metric_obs group by 1, 2", _STATS)
register(
    "z2_histogram",
    lambda v: zonal.histogram(v("metric_obs"), ["metric"]),
    """with b as (select metric, count(*) as n, min(value) as lo, max(value) as hi, least(8, greatest(4, floor(count(*) / 4)))::int as bins from metric_obs group by 1 having count(*) >= 2),
       k as (select m.metric, least(floor((value - lo) / (hi - lo) * bins), bins - 1)::int as bin, count(*) as count from metric_obs m join b using (metric) group by 1, 2),
       f as (select metric, lo, hi, bins, unnest(range(bins))::int as bin from b)
       select f.metric, f.bin, lo + f.bin * (hi - lo) / bins as lower, lo + (f.bin + 1) * (hi - lo) / bins as upper, coalesce(count, 0)::bigint as count from f left join k using (metric, bin)""",
    "lower upper",
)
register(
    "z3_field_windows",
    lambda v: zonal.field_window_stats(v("indexed"), v("pixel_labels").where("label > 0").select("tile_id", "r", "c", F.col("label").alias("field")), ["tile_id", "field", "t"], ["ndvi", "ndmi"], least=4),
    f"""with j as (select p.*, label as field from indexed p join pixel_labels l on p.tile_id = l.tile_id and p.r = l.r and p.c = l.c where label > 0),
       k as (select tile_id, field, t, count_if(valid) as valid_pixels, count(*) as pixels from j group by 1, 2, 3 having count_if(valid) >= 4),
       u as (select tile_id, field, t, 'ndvi' as metric, ndvi as value from j where valid union all select tile_id, field, t, 'ndmi', ndmi from j where valid)
       select tile_id, field, t, metric, {_Z1}, max(valid_pixels / pixels) as coverage from u join k using (tile_id, field, t) group by 1, 2, 3, 4""",
    _STATS + " coverage",
)
_PIX = "(select tile_id, r, c, avg(ndvi) as ndvi, avg(ndwi) as ndwi from indexed group by 1, 2, 3)"
register(
    "z4_segments",
    lambda v: zonal.segment_properties(v("pixel_labels"), v("indexed").groupBy("tile_id", "r", "c").agg(F.avg("ndvi").alias("ndvi"), F.avg("ndwi").alias("ndwi"))),
    f"""with n as (select a.tile_id, a.r, a.c, a.label, count(b.label) as alike from pixel_labels a left join pixel_labels b on a.tile_id = b.tile_id and abs(a.r - b.r) + abs(a.c - b.c) = 1 and a.label = b.label group by 1, 2, 3, 4)
       select tile_id, label, count(*) as area, count_if(alike < 4) as perimeter, avg(ndvi) as ndvi_mean, avg(ndwi) as ndwi_mean, count_if(alike < 4) / (4 * sqrt(count(*))) as shape_index
       from n left join {_PIX} p using (tile_id, r, c) where label > 0 group by 1, 2""",
    "ndvi_mean ndwi_mean shape_index",
)
register(
    "z6_phenometrics",
    lambda v: zonal.phenometrics(v("indexed")),
    """select tile_id, r, c, coalesce(min(ndvi) filter (where valid), -0.1) as ndvi_min, coalesce(max(ndvi) filter (where valid), -0.1) as ndvi_max, coalesce(avg(ndvi) filter (where valid), -0.1) as ndvi_mean,
       coalesce(stddev_pop(ndvi) filter (where valid), 0) as ndvi_std, coalesce(max(ndvi) filter (where valid) - min(ndvi) filter (where valid), 0) as ndvi_delta from indexed group by 1, 2, 3""",
    "ndvi_min ndvi_max ndvi_mean ndvi_std ndvi_delta",
)
register("z7_median_composite", lambda v: zonal.median_composite(v("indexed"), ["b4", "b8"]), "select tile_id, r, c, median(b4) filter (where valid) as b4, median(b8) filter (where valid) as b8 from indexed group by 1, 2, 3", "b4 b8", digits=9)
register(
    "z9_coherence",
    lambda v: zonal.temporal_coherence(v("indexed")),
    """with s as (select * from indexed where valid and ndvi is not null),
       b as (select tile_id, r, c, count(*) as n, max(ndvi) - min(ndvi) as amplitude, max(ndvi) as hi, avg(ndvi) as mean, min(t) as t0, max(t) as t1, arg_max(t, {'v': ndvi, 't': -t}) as tp from s group by 1, 2, 3 having count(*) >= 3),
       k as (select tile_id, r, c, least(greatest(floor(ndvi * 10), 0), 9) as bin, count(*) as k from s group by 1, 2, 3, 4),
       p as (select *, k / sum(k) over (partition by tile_id, r, c) as p from k),
       e as (select tile_id, r, c, -sum(p * log2(p)) as entropy from p group by 1, 2, 3)
       select tile_id, r, c, amplitude, tp > t0 and tp < t1 and hi > mean + 0.1 as has_peak, entropy from b join e using (tile_id, r, c)""",
    "amplitude entropy",
)
register("z11_scene_coverage", lambda v: zonal.scene_coverage(v("indexed")), "select tile_id, t, avg(case when valid then 1 else 0 end) as coverage from indexed group by 1, 2", "coverage")
register(
    "z12_tile_quality",
    lambda v: zonal.tile_quality(v("indexed")),
    """with s as (select tile_id, t, avg(case when valid then 1 else 0 end) as coverage, avg(case when scl in (3, 8, 9, 10) then 1 else 0 end) as cloud, avg(ndvi) filter (where valid) as ndvi from indexed group by 1, 2),
       k as (select tile_id, avg(coverage) as coverage, count_if(coverage >= 0.3) as scenes, avg(cloud) as cloud, stddev_pop(ndvi) as ndvi_std from s group by 1)
       select *, case when coverage < 0.05 then 'skip' when scenes < 2 then 'degraded' when cloud > 0.5 then 'recovery' else 'normal' end as mode, case when coverage < 0.05 then 'low_coverage' when scenes < 2 then 'few_scenes' when cloud > 0.5 then 'cloudy' else 'ok' end as reason from k""",
    "coverage cloud ndvi_std",
)
register(
    "z13_u9_grid",
    lambda v: zonal.grid_cells(v("indexed"), v("pixel_labels")),
    """select p.tile_id, zoom, floor(p.r / k + 1e-9)::bigint as row, floor(p.c / k + 1e-9)::bigint as col, avg(case when label > 0 then 1 else 0 end) as field_coverage, avg(ndvi) as ndvi_mean, avg(ndmi) as ndmi_mean, avg(ndwi) as ndwi_mean
       from indexed p left join pixel_labels l on p.tile_id = l.tile_id and p.r = l.r and p.c = l.c cross join (values (0, 4), (1, 2), (2, 1)) as z(zoom, k) group by 1, 2, 3, 4""",
    "field_coverage ndvi_mean ndmi_mean ndwi_mean",
)
register(
    "z14_cell_merge",
    lambda v: v("grid_cells").groupBy("zoom_level", F.floor(c("miny") * 50).alias("row"), F.floor(c("minx") * 50).alias("col")).agg(F.avg("ndvi_mean").alias("ndvi_mean"), F.avg("ndmi_mean").alias("ndmi_mean"), F.count("*").alias("n")),
    "select zoom_level, floor(miny * 50)::bigint as row, floor(minx * 50)::bigint as col, avg(ndvi_mean) as ndvi_mean, avg(ndmi_mean) as ndmi_mean, count(*) as n from grid_cells group by 1, 2, 3",
    "ndvi_mean ndmi_mean",
)
_SUM = "count(value) as n, avg(value) as mean, min(value) as min, max(value) as max"
register(
    "z16_dashboard",
    lambda v: v("metric_obs").groupingSets([["field_id", "metric"], ["metric"]], "field_id", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")),
    f"select field_id, metric, {_SUM} from metric_obs group by grouping sets ((field_id, metric), (metric))",
    "mean min max",
)
register(
    "z17_group_series",
    lambda v: zonal.group_series(zonal.summary(v("metric_obs"), ["field_id", "metric", "observed_on"]).withColumn("median", F.when(c("n") > 1, c("median")))),
    """with s as (select field_id, metric, observed_on, avg(value) as mean, min(value) as min, max(value) as max, case when count(*) > 1 then median(value) end as median from metric_obs group by 1, 2, 3)
       select metric, observed_on, avg(coalesce(mean, 0)) as mean, min(coalesce(min, 0)) as min, max(coalesce(max, 0)) as max, avg(coalesce(median, 0)) as median from s group by 1, 2""",
    "mean min max median",
)
register(
    "z18_weekly_rollup",
    lambda v: v("weather_daily").groupBy("field_id", F.year("observed_on").alias("season_year"), ag.week_start(c("observed_on")).alias("week_start")).agg(F.avg("tmean").alias("tmean"), F.max("tmean").alias("tmax"), F.min("tmean").alias("tmin"), F.sum("precip").alias("precip"), F.least(F.count("*") / 7, F.lit(1.0)).alias("coverage")),
    "select field_id, year(observed_on)::int as season_year, cast(date_trunc('week', observed_on) as date) as week_start, avg(tmean) as tmean, max(tmean) as tmax, min(tmean) as tmin, sum(precip) as precip, least(count(*) / 7, 1) as coverage from weather_daily group by 1, 2, 3",
    "tmean tmax tmin precip coverage",
)
register(
    "z19_weekly_management",
    lambda v: v("management_events").groupBy("field_id", ag.week_start(c("event_date")).alias("week_start")).agg(F.sum(F.when(ag.is_irrigation(c("event_type"), c("unit")), ag.irrigation_mm(c("amount"), c("unit")))).alias("irrigation_mm"), F.sum(F.when(ag.is_nitrogen(c("event_type"), c("unit")), c("amount"))).alias("nitrogen")),
    "select field_id, cast(date_trunc('week', event_date) as date) as week_start, sum(case when event_type = 'irrigation' then case when unit = 'cm' then amount * 10 else amount end end) as irrigation_mm, sum(case when event_type = 'fertilizer' then amount end) as nitrogen from management_events group by 1, 2",
    "irrigation_mm nitrogen",
)
register(
    "z20_weekly_series",
    lambda v: v("metric_obs").groupBy("field_id", "metric", ag.week_start(c("observed_on")).alias("week_start")).agg(F.avg("value").alias("value"), F.max_by("source", F.struct("ts", "event_id")).alias("source")),
    "select field_id, metric, cast(date_trunc('week', observed_on) as date) as week_start, avg(value) as value, arg_max(source, {'t': ts, 'e': event_id}) as source from metric_obs group by 1, 2, 3",
    "value",
)
register(
    "z21_management_totals",
    lambda v: v("management_events").rollup("field_id", "season_year", "event_type").agg(F.sum("amount").alias("total"), F.count("*").alias("n")),
    "select field_id, season_year, event_type, sum(amount) as total, count(*) as n from management_events group by rollup (field_id, season_year, event_type)",
    "total",
)
register("z22_yield_history", lambda v: v("yield_obs").groupBy("field_id").agg(F.avg("yield_kg_ha").alias("mean_yield"), F.count_distinct("season_year").alias("seasons"), F.max("season_year").alias("last_season")), "select field_id, avg(yield_kg_ha) as mean_yield, count(distinct season_year) as seasons, max(season_year)::int as last_season from yield_obs group by 1", "mean_yield")
register(
    "z23_season_weather",
    lambda v: relational.at_maximum(v("weather_daily").withColumn("season_year", F.year("observed_on")), ["field_id"], "season_year").groupBy("field_id", "season_year").agg(F.sum("gdd").alias("gdd"), F.sum("precip").alias("precip"), F.avg("tmean").alias("tmean"), F.avg("vpd").alias("vpd"), F.count("*").alias("days")),
    """with w as (select *, year(observed_on)::int as season_year from weather_daily), m as (select field_id, max(season_year) as season_year from w group by 1)
       select field_id, season_year, sum(gdd) as gdd, sum(precip) as precip, avg(tmean) as tmean, avg(vpd) as vpd, count(*) as days from w join m using (field_id, season_year) group by 1, 2""",
    "gdd precip tmean vpd",
)
register(
    "z26_qa_by_region",
    lambda v: zonal.conditional_rates(v("qa_results"), ["region"], {"failures": c("status") == "failed", "empty": c("empty_output")}).withColumn("success_rate", 1 - c("failures") / c("n")),
    "select region, count(*) as n, count_if(status = 'failed') as failures, count_if(empty_output) as empty, 1 - count_if(status = 'failed') / count(*) as success_rate from qa_results group by 1",
    "success_rate",
)
register(
    "z28_latency_quantiles",
    lambda v: zonal.lower_quantiles(v("qa_results"), ["region"], "queue_wall_s", {"p50": 0.5, "p95": 0.95}),
    """with s as (select region, queue_wall_s as x, row_number() over (partition by region order by queue_wall_s) - 1 as i, count(*) over (partition by region) as n from qa_results)
       select region, max(x) filter (where i = floor(0.5 * (n - 1))) as p50, max(x) filter (where i = floor(0.95 * (n - 1))) as p95 from s group by 1""",
    "p50 p95",
)
register(
    "z30_pixel_scores",
    lambda v: zonal.confusion(v("indexed").groupBy("tile_id", "r", "c").agg((F.avg("ndvi") > 0.45).alias("pred")), v("pixel_labels").select("tile_id", "r", "c", (c("label") > 1).alias("truth")), ["tile_id", "r", "c"], ["tile_id"]),
    """with p as (select tile_id, r, c, avg(ndvi) > 0.45 as pred from indexed group by 1, 2, 3), b as (select coalesce(p.tile_id, l.tile_id) as tile_id, coalesce(pred, false) as pred, coalesce(label > 1, false) as truth from p full join pixel_labels l on p.tile_id = l.tile_id and p.r = l.r and p.c = l.c),
       k as (select tile_id, count_if(pred and truth) as tp, count_if(pred and not truth) as fp, count_if(not pred and truth) as fn from b group by 1)
       select *, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, tp / nullif(tp + fp + fn, 0) as iou, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1 from k""",
    "precision recall iou f1",
)
register(
    "z32_channel_stats",
    lambda v: v("pixels").agg(*(f(x).alias(f"{x}_{n}") for x in ("b2", "b3", "b4", "b8", "b11") for n, f in (("mean", F.avg), ("std", F.stddev_pop)))),
    "select " + ", ".join(f"avg({x}) as {x}_mean, stddev_pop({x}) as {x}_std" for x in ("b2", "b3", "b4", "b8", "b11")) + " from pixels",
    " ".join(f"{x}_{n}" for x in ("b2", "b3", "b4", "b8", "b11") for n in ("mean", "std")),
)
register("z36_medians", lambda v: zonal.medians(v("weather_daily"), ["tmean", "precip", "vpd", "soil", "gdd"]), "select median(tmean) as tmean, median(precip) as precip, median(vpd) as vpd, median(soil) as soil, median(gdd) as gdd from weather_daily", "tmean precip vpd soil gdd")
register(
    "z40_run_rollup",
    lambda v: v("runs").groupBy("org").agg(F.count("*").alias("runs"), F.avg("progress").alias("progress"), F.bool_or(c("status") == "queued").alias("any_queued"), F.when(F.count_distinct("status") == 1, F.max("status")).otherwise("mixed").alias("state"), F.sha1(F.array_join(F.sort_array(F.collect_set("status")), ",")).alias("signature")),
    "select org, count(*) as runs, avg(progress) as progress, bool_or(status = 'queued') as any_queued, case when count(distinct status) = 1 then max(status) else 'mixed' end as state, sha1(array_to_string(list_sort(list(distinct status)), ',')) as signature from runs group by 1",
    "progress",
)
register(
    "z43_layer_stats",
    lambda v: v("indexed").where("ndvi is not null").groupBy("tile_id", F.least(F.greatest(F.floor(c("ndvi") * 10), F.lit(0)), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.min("ndvi").alias("lo"), F.max("ndvi").alias("hi")),
    "select tile_id, least(greatest(floor(ndvi * 10), 0), 9)::bigint as bin, count(*) as n, min(ndvi) as lo, max(ndvi) as hi from indexed where ndvi is not null group by 1, 2",
    "lo hi",
)

# --- W: windows and seasonal state -----------------------------------------------------------------------

register(
    "w2_cumulative_gdd",
    lambda v: series.cumulative(v("weather_daily").withColumn("season_year", F.year("observed_on")), ["field_id", "season_year"], ["observed_on", "row_id"], "gdd", "gdd_total").select("row_id", "gdd_total"),
    "select row_id, sum(coalesce(gdd, 0)) over (partition by field_id, year(observed_on) order by observed_on, row_id rows unbounded preceding) as gdd_total from weather_daily",
    "gdd_total",
)
register(
    "w3_auc",
    lambda v: series.area_under_curve(v("weekly_ndvi"), ["field_id"], "week_start", "v"),
    """with p as (select *, (v + lag(v) over w) / 2 * (week_start - lag(week_start) over w) / 7 as part from weekly_ndvi window w as (partition by field_id order by week_start))
       select field_id, sum(part) as auc, max(v) as peak, avg(v) as mean, count(v) as n from p group by 1""",
    "auc peak mean",
)
register(
    "w4_robust_z",
    lambda v: series.robust_z(v("weekly_ndvi").select("field_id", "week_start", "v"), ["field_id"], "v", "z"),
    """with m as (select field_id, median(v) as med, avg(v) as av, stddev_pop(v) as sd from weekly_ndvi group by 1), d as (select field_id, median(abs(v - med)) as mad from weekly_ndvi join m using (field_id) group by 1)
       select w.field_id, week_start, v, case when mad > 1e-9 then 0.6745e0 * (v - med) / mad when sd > 1e-9 then (v - av) / sd else 0 end as z from weekly_ndvi w join m using (field_id) join d using (field_id)""",
    "v z",
)
_PHENO = """p as (select field_id, week_start, v, row_number() over (partition by field_id order by week_start) - 1 as i from weekly_ndvi),
       b as (select field_id, count(*) as n, arg_max(i, {'v': v, 'i': -i}) as peak_i, max(v) as hi, greatest(max(v) - min(v), 1e-6) as amplitude, min(v) as lo from p group by 1 having count(*) >= 5),
       s as (select field_id, coalesce(min(i) filter (where v >= lo + amplitude * 0.2e0), 0) as sos_i, coalesce(max(i) filter (where v >= lo + amplitude * 0.25e0 and i >= peak_i), max(n) - 1) as eos_i, max(week_start) filter (where i = peak_i) as peak, max(n) as n, max(peak_i) as peak_i, max(amplitude) as amplitude, max(hi) as peak_value from p join b using (field_id) group by 1),
       ph as (select field_id, sos_i, peak_i, eos_i, peak, amplitude, peak_value, greatest(eos_i - sos_i + 1, 1) as season_weeks, (peak_i + 1 - 9)::double as lag_weeks,
         case when n - 1 <= sos_i + 1 then 'emergence' when n - 1 < peak_i - 1 then 'vegetative' when n - 1 <= peak_i + 1 then 'reproductive' when n - 1 < eos_i then 'grain_fill' else 'senescence' end as stage from s)"""
register("w5_phenology", lambda v: series.phenology(v("weekly_ndvi"), ["field_id"], "week_start", "v"), f"with {_PHENO} select * from ph", "amplitude peak_value lag_weeks")


def _anomalies(v):
    points = v("weekly_ndvi").select("field_id", "week_start", "v")
    ndmi = v("metric_obs").where("metric = 'ndmi'").groupBy("field_id", ag.week_start(c("observed_on")).alias("week_start")).agg((F.avg("value") - 0.35).alias("v"))
    return series.anomalies(points, ndmi, series.phenology(points, ["field_id"], "week_start", "v"), ["field_id"], "week_start", "v")


register(
    "w6_anomalies",
    _anomalies,
    f"""with {_PHENO}, q as (select *, v - lag(v) over (partition by field_id order by week_start) as d from p),
       vm as (select field_id, median(v) as med, avg(v) as av, stddev_pop(v) as sd from q group by 1), vd as (select field_id, median(abs(v - med)) as mad from q join vm using (field_id) group by 1),
       dm as (select field_id, median(d) as med2, avg(d) as av2, stddev_pop(d) as sd2 from q where d is not null group by 1), dd as (select field_id, median(abs(d - med2)) as mad2 from q join dm using (field_id) where d is not null group by 1),
       z as (select q.*, case when mad > 1e-9 then 0.6745e0 * (v - med) / mad when sd > 1e-9 then (v - av) / sd else 0 end as vz, case when mad2 > 1e-9 then 0.6745e0 * (d - med2) / mad2 when sd2 > 1e-9 then (d - av2) / sd2 else 0 end as dz
         from q join vm using (field_id) join vd using (field_id) join dm using (field_id) join dd using (field_id) where d is not null),
       dry as (select field_id, row_number() over (partition by field_id order by week_start) - 1 as i, v as ndmi from (select field_id, date_trunc('week', observed_on) as week_start, avg(value) - 0.35e0 as v from metric_obs where metric = 'ndmi' group by 1, 2) as x),
       k as (select field_id, z.week_start, vz, dz, case when dz <= -1.8 and vz <= -1.25 and coalesce(ndmi, 0) < -0.05 then 'possible_drought_stress' when dz <= -1.8 and vz <= -1.25 then 'rapid_canopy_loss' when dz >= 1.4 and stage = 'emergence' then 'delayed_development' end as kind,
         case when dz <= -2.4 and vz <= -1.25 then 'critical' when dz <= -1.8 and vz <= -1.25 then 'warning' else 'info' end as severity from z join ph using (field_id) left join dry using (field_id, i))
       select field_id, week_start, kind, severity, vz as z_score, dz as delta_z_score, coalesce(row_number() over (partition by field_id order by week_start desc) = 1 and lag(kind) over (partition by field_id order by week_start) = kind, false) as persistent from k where kind is not null""",
    "z_score delta_z_score",
)
register("w7_latest_soil", lambda v: series.latest(v("soil_profiles"), ["field_id"], [F.desc("sampled_at"), F.desc("profile_id")]), "select * from soil_profiles qualify row_number() over (partition by field_id order by sampled_at desc, profile_id desc) = 1", "ph")
register(
    "w9_yield_trend",
    lambda v: series.yield_trend(v("yield_obs").groupBy("field_id", "season_year").agg(F.avg("yield_kg_ha").alias("yield")), ["field_id"]),
    """with s as (select field_id, season_year, avg(yield_kg_ha) as y from yield_obs group by 1, 2), r as (select *, avg(y) over (partition by field_id order by season_year rows between 2 preceding and current row) as roll from s)
       select field_id, count(*) as seasons, regr_slope(y, season_year) as slope, stddev_pop(y) / nullif(avg(y), 0) as cv, arg_max(roll, season_year) as rolling_mean from r group by 1""",
    "slope cv rolling_mean",
)
register(
    "w10_next_version",
    lambda v: series.next_versions(v("label_versions").select("label_task_id", c("version_no").alias("item")), v("label_versions").where("version_no < 3"), "label_task_id", "item"),
    """select a.label_task_id, version_no as item, coalesce(top, 0) + row_number() over (partition by a.label_task_id order by version_no) as version_no from label_versions a left join (select label_task_id, max(version_no) as top from label_versions where version_no < 3 group by 1) b on a.label_task_id = b.label_task_id""",
)
register(
    "w11_forecast_curve",
    lambda v: series.forecast_curve(v("weather_daily").select("row_id", "field_id", "observed_on", "tmean", "precip"), ["field_id"], 5.0, 1.5, 20.0).select("row_id", "temp_c", "rain_mm", "gdd_day", "gdd_total"),
    """with s as (select row_id, field_id, observed_on, tmean + 1.5e0 as temp_c, greatest(coalesce(precip, 0) + 20e0 / count(*) over (partition by field_id), 0) as rain_mm, greatest(coalesce(tmean + 1.5e0 - 5, 0), 0) as gdd_day from weather_daily)
       select row_id, temp_c, rain_mm, gdd_day, sum(gdd_day) over (partition by field_id order by observed_on, row_id rows unbounded preceding) as gdd_total from s""",
    "temp_c rain_mm gdd_day gdd_total",
)
register(
    "w12_queue_position",
    lambda v: v("runs").where("status in ('queued', 'running')").select("run_id", F.expr("row_number() over (partition by org order by created_at, run_id)").cast("long").alias("position")),
    "select run_id, row_number() over (partition by org order by created_at, run_id) as position from runs where status in ('queued', 'running')",
)
register(
    "q5_water_balance",
    lambda v: series.water_balance(v("weekly_weather").where("tmean is not null").select("field_id", "season_year", "week_start", "tmean", "vpd", "gdd", "precip", F.lit(2.5).alias("wind"), F.lit(0.0).alias("solar"), F.when(c("field_id") % 2 == 0, "sand").otherwise("clay").alias("texture"), F.lit(0.8).alias("kc")), ["field_id", "season_year"]),
    """with recursive w as (select field_id, season_year::int as season_year, week_start, row_number() over (partition by field_id, season_year order by week_start) as i, count(*) over (partition by field_id, season_year) as n, case when field_id % 2 = 0 then 75e0 else 155e0 end as taw, coalesce(precip, 0) as rain,
         greatest(1, 1.5e0 + 0.12e0 * tmean + 2.8e0 * coalesce(vpd, 0) + 0.18e0 * 2.5e0 + 0.003e0 * coalesce(gdd, 0) / 7) * 0.8e0 * 7 as demand from weekly_weather where tmean is not null),
       s as (select field_id, season_year, week_start, i, taw, demand, taw * 0.62e0 + rain * 0.82e0 - demand as after from w where i = 1 and n >= 2
         union all select w.field_id, w.season_year, w.week_start, w.i, w.taw, w.demand, greatest(0, least(s.taw, s.after)) + w.rain * 0.82e0 - w.demand from s join w on s.field_id = w.field_id and s.season_year = w.season_year and w.i = s.i + 1),
       o as (select field_id, season_year, week_start, greatest(0, least(taw, after)) as storage, greatest(0, after - taw) as drainage, demand, greatest(taw - greatest(0, least(taw, after)), 0) as deficit, greatest(taw - greatest(0, least(taw, after)), 0) / greatest(taw, 1) as stress_ratio from s)
       select *, case when stress_ratio >= 0.6 then 'severe' when stress_ratio >= 0.35 then 'moderate' else 'normal' end as stress_class from o""",
    "storage drainage demand deficit stress_ratio",
)
register(
    "q6_stage_progress",
    lambda v: series.stage_progress(v("weekly_weather").select("field_id", "season_year", "week_start", "gdd"), ["field_id", "season_year"], F.lit(50.0), (5, 10, 20, 40, 60)).select("field_id", "season_year", "week_start", "heat_total", "stage"),
    """with h as (select field_id, season_year::int as season_year, week_start, coalesce(gdd, 0) * greatest(0.8e0, least(1.2e0, 24 / pi() * acos(greatest(-1, least(1, -tan(radians(50)) * tan(radians(23.45e0 * sin(radians(360e0 / 365 * (284 + dayofyear(week_start))))))))) / 14)) as heat from weekly_weather),
       r as (select field_id, season_year, week_start, sum(heat) over (partition by field_id, season_year order by week_start rows unbounded preceding) as heat_total from h)
       select *, (heat_total >= 5)::int + (heat_total >= 10)::int + (heat_total >= 20)::int + (heat_total >= 40)::int + (heat_total >= 60)::int as stage from r""",
    "heat_total",
)
def _weeks_in_order(v):
    """weekly_weather, added up in order of rows."""
    keys = {"season_year": F.year("observed_on"), "week_start": F.date_trunc("week", "observed_on").cast("date")}
    return series.in_order(v("weather_daily").withColumns(keys), ["field_id", *keys], "row_id", tmean=F.avg("tmean"), precip=F.sum("precip"), vpd=F.avg("vpd"))


register(
    "q9_risks",
    lambda v: series.risks(_weeks_in_order(v), ["field_id"]),
    """with r as (select *, row_number() over (partition by field_id order by week_start desc) as rn from weekly_weather)
       select field_id, least(count_if(vpd > 2) / 6, 1) as drought, least(count_if(precip > 5 and tmean > 12) / 6, 1) as wet_disease, count(*) as weeks from r where rn <= 10 group by 1""",
    "drought wet_disease",
)

# --- U: generators --------------------------------------------------------------------------------------------

register(
    "u1_season_weeks",
    lambda v: v("field_seasons").select("season_year").distinct().select("season_year", F.explode(F.sequence(F.date_trunc("week", F.make_date("season_year", F.lit(3), F.lit(1))).cast("date"), F.make_date("season_year", F.lit(10), F.lit(31)), F.expr("interval 7 days"))).alias("week_start")),
    "select season_year::int as season_year, unnest(generate_series(date_trunc('week', make_date(season_year, 3, 1)), make_date(season_year, 10, 31), interval 7 day))::date as week_start from (select distinct season_year from field_seasons) as s",
)
register(
    "u2_biweekly_windows",
    lambda v: v("field_seasons").select("season_year").distinct().select("season_year", F.explode(F.sequence(F.make_date("season_year", F.lit(3), F.lit(1)), F.make_date("season_year", F.lit(10), F.lit(31)), F.expr("interval 14 days"))).alias("first_day")).withColumn("last_day", F.least(F.date_add("first_day", 13), F.make_date("season_year", F.lit(10), F.lit(31)))).withColumn("middle", F.expr("date_add(first_day, cast(datediff(last_day, first_day) / 2 as int))")),
    """select *, first_day + ((last_day - first_day) // 2)::int as middle from (select season_year, first_day, least(first_day + 13, make_date(season_year, 10, 31)) as last_day from
       (select season_year::int as season_year, unnest(generate_series(make_date(season_year, 3, 1), make_date(season_year, 10, 31), interval 14 day))::date as first_day from (select distinct season_year from field_seasons) as s) as t) as u""",
)
register(
    "u4_multi_year",
    lambda v: v("yield_obs").select("obs_id", "observed_on", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("obs_id", "k", F.expr("add_months(observed_on, -12 * k)").alias("day")),
    "select obs_id, k::int as k, cast(observed_on - to_years(k::int) as date) as day from yield_obs cross join range(4) as r(k)",
)
register(
    "u5_tiles",
    lambda v: v("fields").select("field_id", F.explode(F.sequence(F.floor(c("minx") / 0.005), F.floor(c("maxx") / 0.005))).alias("col"), "miny", "maxy").select("field_id", "col", F.explode(F.sequence(F.floor(c("miny") / 0.005), F.floor(c("maxy") / 0.005))).alias("row")),
    "select field_id, col::bigint as col, unnest(range(floor(miny / 5e-3)::bigint, floor(maxy / 5e-3)::bigint + 1)) as row from (select *, unnest(range(floor(minx / 5e-3)::bigint, floor(maxx / 5e-3)::bigint + 1)) as col from fields) as f",
)
register(
    "u6_patch_windows",
    lambda v: v("pixels").groupBy("tile_id").agg((F.max("r") + 20).alias("h")).select("tile_id", F.explode(F.array_union(F.sequence(F.lit(0).cast("long"), c("h") - 8, F.lit(6).cast("long")), F.array(c("h") - 8))).alias("start")),
    "select distinct tile_id, start from (select tile_id, unnest(list_append(range(0, h - 7, 6), h - 8)) as start from (select tile_id, max(r) + 20 as h from pixels group by 1) as a) as b",
)
register("u8_sweep", lambda v: v("yield_obs").select("obs_id", "yield_kg_ha", F.explode(F.sequence(F.lit(-50), F.lit(50), F.lit(10))).alias("change")).withColumn("estimate", c("yield_kg_ha") * (1 + c("change") / 200)), "select obs_id, yield_kg_ha, change::int as change, yield_kg_ha * (1 + change / 200) as estimate from yield_obs cross join range(-50, 51, 10) as r(change)", "yield_kg_ha estimate")

# --- P: filters ---------------------------------------------------------------------------------------------------

register("s1_tenant_scan", lambda v: relational.scan_tenant(v("fields"), 7, c("area_m2") > 0).select("field_id", "source", "area_m2"), "select field_id, source, area_m2 from fields where org = 7 and source <> 'merged_hidden' and area_m2 > 0", "area_m2", digits=3)
register("p2_bbox", lambda v: relational.bbox_hits(v("fields"), 30.1, 45.0, 30.2, 45.2).select("field_id"), "select field_id from fields where minx <= 30.2e0 and maxx >= 30.1e0 and miny <= 45.2e0 and maxy >= 45e0")
register(
    "p3_cells_in_fields",
    lambda v: relational.box_join(v("grid_cells").select("cell_id", "minx", "miny", "maxx", "maxy"), v("fields").select("field_id", "minx", "miny", "maxx", "maxy")).select("cell_id").distinct(),
    "select cell_id from grid_cells g where exists (select 1 from fields f where g.minx < f.maxx and g.maxx > f.minx and g.miny < f.maxy and g.maxy > f.miny)",
)
_P4 = "list_filter([case when area < 4 then 'area' end, case when ndvi_delta < 0.05 then 'delta' end, case when ndwi_mean > 0.2 then 'water' end, case when shape_index > 1.2 then 'shape' end], lambda x: x is not null)[1]"


def _segments(v):
    return zonal.segment_properties(v("pixel_labels"), v("indexed").groupBy("tile_id", "r", "c").agg(F.avg("ndvi").alias("ndvi"), F.avg("ndwi").alias("ndwi"))).join(
        v("indexed").join(v("pixel_labels"), ["tile_id", "r", "c"]).groupBy("tile_id", "label").agg((F.max("ndvi") - F.min("ndvi")).alias("ndvi_delta")), ["tile_id", "label"])


register(
    "p4_segment_filter",
    lambda v: _segments(v).select("tile_id", "label", "area", su.segment_reject(c("area"), c("ndvi_delta"), c("ndwi_mean"), c("shape_index")).alias("reason")),
    f"""with n as (select a.tile_id, a.r, a.c, a.label, count(b.label) as alike from pixel_labels a left join pixel_labels b on a.tile_id = b.tile_id and abs(a.r - b.r) + abs(a.c - b.c) = 1 and a.label = b.label group by 1, 2, 3, 4),
       s as (select tile_id, label, count(*) as area, count_if(alike < 4) / (4 * sqrt(count(*))) as shape_index, avg(ndwi) as ndwi_mean from n left join {_PIX} p using (tile_id, r, c) where label > 0 group by 1, 2),
       d as (select i.tile_id, label, max(ndvi) - min(ndvi) as ndvi_delta from indexed i join pixel_labels l on i.tile_id = l.tile_id and i.r = l.r and i.c = l.c group by 1, 2)
       select tile_id, label, area, {_P4} as reason from s join d using (tile_id, label)""",
)
_P6 = "case when n >= 4 then least(if(ndwi_max > 0.1, 1, 9), if(ndvi_max < 0.2, 2, 9), if(ndvi_min > 0.5, 3, 9), if(ndvi_max - ndvi_min > 0.3, 4, 9), 5) else 0 end"
register(
    "p5_p6_phenology_class",
    lambda v: v("indexed").where("valid").groupBy("tile_id", "r", "c").agg(F.count("ndvi").alias("n"), F.max("ndvi").alias("ndvi_max"), F.min("ndvi").alias("ndvi_min"), F.max("ndwi").alias("ndwi_max")).select("tile_id", "r", "c", su.land_cover_class(c("n"), c("ndvi_min"), c("ndvi_max"), c("ndwi_max")).alias("class")),
    f"select tile_id, r, c, {_P6} as class from (select tile_id, r, c, count(ndvi) as n, max(ndvi) as ndvi_max, min(ndvi) as ndvi_min, max(ndwi) as ndwi_max from indexed where valid group by 1, 2, 3) as s",
)
register(
    "p8_cropland_mask",
    lambda v: v("pixels").groupBy("tile_id", "r", "c").agg(F.max("scl").alias("k")).select("tile_id", "r", "c", (c("k").isin(4, 5) | F.expr("max(k) over (partition by tile_id) = 0")).alias("crop")),
    "select tile_id, r, c, k in (4, 5) or max(k) over (partition by tile_id) = 0 as crop from (select tile_id, r, c, max(scl) as k from pixels group by 1, 2, 3) as s",
)
register("p9_has_signal", lambda v: v("weekly_weather").groupBy("field_id", "season_year").agg(F.bool_or((c("n") / 7 > 0.15) | c("tmean").isNotNull()).alias("signal")), "select field_id, season_year::int as season_year, bool_or(n / 7 > 0.15 or tmean is not null) as signal from weekly_weather group by 1, 2")
register(
    "p10_stuck_runs",
    lambda v: v("runs").where("status in ('running', 'queued') and created_at < date '2000-01-01'").join(v("events").select(c("event_id").alias("run_id")), "run_id", "left_anti").select("run_id", "org"),
    "select run_id, org from runs where status in ('running', 'queued') and created_at < date '2000-01-01' and run_id not in (select event_id from events)",
)

# --- J: joins ----------------------------------------------------------------------------------------------------------

register(
    "j1_observation_chain",
    lambda v: v("yield_obs").join(v("field_seasons").select(c("season_id").alias("obs_id"), "crop_code"), "obs_id").join(v("fields").select("field_id", "org", "area_m2"), "field_id").groupBy("org", "crop_code").agg(F.count("*").alias("n"), F.avg("yield_kg_ha").alias("yield"), F.sum("area_m2").alias("area")),
    "select org, crop_code, count(*) as n, avg(yield_kg_ha) as yield, sum(area_m2) as area from yield_obs o join field_seasons s on o.obs_id = s.season_id join fields f on o.field_id = f.field_id group by 1, 2",
    "yield area",
    digits=2,
)
register(
    "j2_events_of_season",
    lambda v: relational.page(v("management_events").join(v("yield_obs").where("season_year = 1998").select("field_id", "season_year").distinct(), ["field_id", "season_year"]), [F.desc("event_date"), F.asc("order_id"), F.asc("line_id")], 20, 50).select("order_id", "line_id", "event_date"),
    "select order_id, line_id, event_date from management_events e where season_year = 1998 and exists (select 1 from yield_obs y where y.field_id = e.field_id and y.season_year = 1998) order by event_date desc, order_id, line_id limit 50 offset 20",
)
register(
    "j3_j4_left_default",
    lambda v: v("runs").join(v("qa_results").select(c("event_id").alias("run_id"), "region", "queue_wall_s"), "run_id", "left").select("run_id", F.coalesce("region", F.lit(-1)).alias("region"), "queue_wall_s"),
    "select run_id, coalesce(region, -1) as region, queue_wall_s from runs left join qa_results on run_id = event_id",
    "queue_wall_s",
)
register(
    "j5_z15_field_metrics",
    lambda v: zonal.summary(zonal.long_metrics(relational.box_join(v("grid_cells").where("zoom_level = 2"), v("fields").where("source <> 'merged_hidden'").select("field_id", "minx", "miny", "maxx", "maxy")).select(c("r_field_id").alias("field_id"), "ndvi_mean", "ndmi_mean", "soil_moist"), ["field_id"], ["ndvi_mean", "ndmi_mean", "soil_moist"]), ["field_id", "metric"]),
    f"""with j as (select f.field_id, g.* from grid_cells g join fields f on g.minx < f.maxx and g.maxx > f.minx and g.miny < f.maxy and g.maxy > f.miny where zoom_level = 2 and source <> 'merged_hidden'),
       u as (select field_id, 'ndvi_mean' as metric, ndvi_mean as value from j union all select field_id, 'ndmi_mean', ndmi_mean from j union all select field_id, 'soil_moist', soil_moist from j)
       select field_id, metric, {_Z1} from u group by 1, 2""",
    _STATS,
)
register(
    "j7_newest_run",
    lambda v: v("grid_cells").join(v("runs").where("status = 'done'").groupBy((c("org") % 7).alias("run_id")).agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("newest")), "run_id").select("cell_id", "newest"),
    "select cell_id, newest from grid_cells join (select org % 7 as run_id, arg_max(run_id, {'c': created_at, 'r': run_id}) as newest from runs where status = 'done' group by 1) r using (run_id)",
)


def _previous(v):
    one = series.latest(v("field_seasons"), ["field_id", "season_year"], [F.desc("assigned_at"), F.desc("season_id")])
    return one.select("field_id", "season_year", "crop_code").join(one.select("field_id", (c("season_year") + 1).alias("season_year"), c("crop_code").alias("previous_crop")), ["field_id", "season_year"], "left")


register(
    "j8_previous_crop",
    _previous,
    """with s as (select * from field_seasons qualify row_number() over (partition by field_id, season_year order by assigned_at desc, season_id desc) = 1)
       select a.field_id, a.season_year::int as season_year, a.crop_code, b.crop_code as previous_crop from s a left join s b on a.field_id = b.field_id and a.season_year = b.season_year + 1""",
)
register(
    "j9_latest_soil_as_of",
    lambda v: v("soil_profiles").where("sampled_at <= date '1999-06-30'").groupBy("field_id").agg(F.max_by(F.struct("profile_id", "ph", "texture"), F.struct("sampled_at", "profile_id")).alias("s")).select("field_id", "s.profile_id", "s.ph", "s.texture"),
    "select field_id, profile_id, ph, texture from soil_profiles where sampled_at <= date '1999-06-30' qualify row_number() over (partition by field_id order by sampled_at desc, profile_id desc) = 1",
    "ph",
)
register(
    "j10_weather_merge",
    lambda v: relational.precedence_merge([x.groupBy("field_id", "observed_on").agg(*(F.max(m).alias(m) for m in ("tmean", "precip", "vpd", "soil"))) for x in (v("weather_daily").where("row_id % 3 > 0"), v("weather_fallback"))], ["field_id", "observed_on"], ["tmean", "precip", "vpd", "soil"]),
    """with a as (select field_id, observed_on, max(tmean) as tmean, max(precip) as precip, max(vpd) as vpd, max(soil) as soil from weather_daily where row_id % 3 > 0 group by 1, 2), b as (select field_id, observed_on, max(tmean) as tmean, max(precip) as precip, max(vpd) as vpd, max(soil) as soil from weather_fallback group by 1, 2)
       select field_id, observed_on, coalesce(a.tmean, b.tmean) as tmean, coalesce(a.precip, b.precip) as precip, coalesce(a.vpd, b.vpd) as vpd, coalesce(a.soil, b.soil) as soil from a full join b using (field_id, observed_on)""",
    "tmean precip vpd soil",
)
register(
    "j11_smallest_tile",
    lambda v: relational.smallest_tile(v("grid_cells").select(c("cell_id").alias("point_id"), (c("minx") + 0.0025).alias("x"), (c("miny") + 0.0025).alias("y")), v("fields").select(c("field_id").alias("tile_id"), "minx", "miny", "maxx", "maxy")).select("point_id", "tile_id"),
    """select cell_id as point_id, arg_min(field_id, {'a': (f.maxx - f.minx) * (f.maxy - f.miny), 'f': field_id}) as tile_id from grid_cells g left join fields f on g.minx + 25e-4 between f.minx and f.maxx and g.miny + 25e-4 between f.miny and f.maxy group by 1""",
)
register(
    "j12_exists_flags",
    lambda v: relational.exists_flags(v("fields").select("field_id"), "field_id", {"has_yield": v("yield_obs"), "has_metrics": v("metric_obs")}),
    "select field_id, field_id in (select field_id from yield_obs) as has_yield, field_id in (select field_id from metric_obs) as has_metrics from fields",
)
register("j13_max_zoom", lambda v: relational.at_maximum(v("grid_cells").select("run_id", "cell_id", "zoom_level"), ["run_id"], "zoom_level"), "select run_id, cell_id, zoom_level from grid_cells qualify zoom_level = max(zoom_level) over (partition by run_id)")
_NEAR = 0.0002


def _neighbours(v):
    f = v("fields").select("field_id", "minx", "miny", "maxx", "maxy")
    wide = f.select("field_id", (c("minx") - _NEAR).alias("minx"), (c("miny") - _NEAR).alias("miny"), (c("maxx") + _NEAR).alias("maxx"), (c("maxy") + _NEAR).alias("maxy"))
    near = relational.box_join(wide, f).where("field_id <> r_field_id").groupBy("field_id").agg(F.count_distinct("r_field_id").alias("k"))
    return f.join(near, "field_id", "left").select("field_id", F.least(F.coalesce("k", F.lit(0)) / 8, F.lit(1.0)).alias("crowding"))


register(
    "j14_neighbours",
    _neighbours,
    """select a.field_id, least(count(distinct b.field_id) / 8, 1) as crowding from fields a left join fields b on a.field_id <> b.field_id and a.minx - 2e-4 < b.maxx and a.maxx + 2e-4 > b.minx and a.miny - 2e-4 < b.maxy and a.maxy + 2e-4 > b.miny group by 1""",
    "crowding",
)
_BOXES = """b as (select cell_id, field_id, (least(g.maxx, f.maxx) - greatest(g.minx, f.minx)) * (least(g.maxy, f.maxy) - greatest(g.miny, f.miny)) as inter, (g.maxx - g.minx) * (g.maxy - g.miny) as ga, (f.maxx - f.minx) * (f.maxy - f.miny) as fa
       from grid_cells g join fields f on g.minx < f.maxx and g.maxx > f.minx and g.miny < f.maxy and g.maxy > f.miny), i as (select cell_id, field_id, round(inter / (ga + fa - inter), 9) as iou from b)"""


def _iou_pairs(v):
    return relational.box_join(v("grid_cells").select("cell_id", "minx", "miny", "maxx", "maxy"), v("fields").select("field_id", "minx", "miny", "maxx", "maxy")).select("cell_id", c("r_field_id").alias("field_id"), F.round(relational.box_iou(), 9).alias("iou"))


register("j15_best_overlap", lambda v: series.latest(_iou_pairs(v), ["cell_id"], [F.desc("iou"), F.asc("field_id")]), f"with {_BOXES} select * from i qualify row_number() over (partition by cell_id order by iou desc, field_id) = 1", "iou")
register(
    "j17_mutual_match",
    lambda v: relational.mutual_best(_iou_pairs(v), "cell_id", "field_id", "iou", 0.1),
    f"with {_BOXES}, k as (select *, row_number() over (partition by cell_id order by iou desc, field_id) as x, row_number() over (partition by field_id order by iou desc, cell_id) as y from i where iou >= 0.1) select cell_id, field_id, iou from k where x = 1 and y = 1",
    "iou",
)
register(
    "j18_key_delta",
    lambda v: relational.key_delta(v("weather_daily").groupBy("field_id").agg(F.sum("precip").alias("value")), v("weather_fallback").groupBy("field_id").agg(F.sum("precip").alias("value")), ["field_id"]),
    """select * from (select field_id, coalesce(a.v, 0) as base, coalesce(b.v, 0) as scenario, coalesce(b.v, 0) - coalesce(a.v, 0) as delta from (select field_id, sum(precip) as v from weather_daily group by 1) a full join (select field_id, sum(precip) as v from weather_fallback group by 1) b using (field_id)) x where abs(delta) >= 0.5""",
    "base scenario delta",
)
register(
    "j19_overlap_resolution",
    lambda v: relational.yield_to_smaller_rank(relational.box_join(v("grid_cells").select("cell_id", "minx", "miny", "maxx", "maxy"), v("fields").select("field_id", "minx", "miny", "maxx", "maxy", F.round("area_m2", 3).alias("area"))).select("cell_id", c("r_field_id").alias("field_id"), c("r_area").alias("area")), "cell_id", "field_id", "area").select("cell_id", "field_id"),
    "select cell_id, field_id from grid_cells g join fields f on g.minx < f.maxx and g.maxx > f.minx and g.miny < f.maxy and g.maxy > f.miny qualify row_number() over (partition by cell_id order by round(area_m2, 3) desc, field_id) = 1",
)

# --- L, O, S: order, sets, imports -----------------------------------------------------------------------------------------

register("l1_newest", lambda v: v("runs").orderBy(F.desc("created_at"), "run_id").limit(100).select("run_id", "created_at"), "select run_id, created_at from runs order by created_at desc, run_id limit 100")
register("l2_nulls_last", lambda v: v("weather_daily").orderBy(F.asc_nulls_last("tmean"), F.desc("precip"), "row_id").limit(500).select("row_id"), "select row_id from weather_daily order by tmean asc nulls last, precip desc, row_id limit 500")
register("l4_newest_fields", lambda v: v("yield_obs").join(v("yield_obs").agg(F.max(F.struct("observed_on", "obs_id"))["obs_id"].alias("obs_id")), "obs_id").select("obs_id", "field_id"), "select obs_id, field_id from yield_obs order by observed_on desc, obs_id desc limit 1")
register("l5_top_20", lambda v: relational.top_per_group(v("runs").where("progress >= 55"), ["org"], [F.desc("progress"), F.asc("run_id")], 20).select("org", "run_id"), "select org, run_id from runs where progress >= 55 qualify row_number() over (partition by org order by progress desc, run_id) <= 20")
register(
    "l7_crop_hint",
    lambda v: v("field_seasons").groupBy("field_id", "crop_code").agg(F.count("*").alias("n")).withColumn("p", c("n") / F.expr("sum(n) over (partition by field_id)")).groupBy("field_id").agg(F.max_by("crop_code", F.struct("p", "crop_code")).alias("top"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("crop_code", "n"))), lambda x: F.concat_ws(":", x["crop_code"], x["n"].cast("string"))), ",").alias("spread")),
    "with k as (select field_id, crop_code, count(*) as n from field_seasons group by 1, 2) select field_id, arg_max(crop_code, {'n': n, 'c': crop_code}) as top, string_agg(crop_code || ':' || n, ',' order by crop_code) as spread from k group by 1",
)
register("o1_o2_union_distinct", lambda v: v("weather_daily").select("field_id", "observed_on").unionByName(v("weather_fallback").select("observed_on", "field_id")).dropDuplicates(), "select field_id, observed_on from weather_daily union select field_id, observed_on from weather_fallback")
register(
    "o3_geometry_dedup",
    lambda v: series.latest(v("fields").withColumn("sig", relational.ring_signature("minx", "miny", "maxx", "maxy", 2)), ["sig"], [F.desc(F.round("area_m2", 3)), F.asc("field_id")]).select("field_id"),
    "select field_id from fields qualify row_number() over (partition by format('{:.2f},{:.2f},{:.2f},{:.2f}', minx, miny, maxx, maxy) order by round(area_m2, 3) desc, field_id) = 1",
)
register("o4_mask_sets", lambda v: v("indexed").where("ndvi > 0.5").select("tile_id", "r", "c").distinct().exceptAll(v("pixel_labels").where("label = 0").select("tile_id", "r", "c")), "select distinct tile_id, r, c from indexed where ndvi > 0.5 except select tile_id, r, c from pixel_labels where label = 0")
register(
    "o6_field_merge",
    lambda v: relational.redirect(v("yield_obs").select("obs_id", "field_id"), v("fields").where("source = 'merged_hidden'").select(c("field_id").alias("member"), (c("field_id") - c("field_id") % 10).alias("target")), "field_id"),
    "select obs_id, coalesce(case when f.field_id is not null then o.field_id - o.field_id % 10 end, o.field_id) as field_id from yield_obs o left join fields f on o.field_id = f.field_id and source = 'merged_hidden'",
)
register(
    "o7_s8_upsert",
    lambda v: relational.upsert(v("weather_daily").select("row_id", "precip"), v("weather_fallback").select("row_id", c("precip")), ["row_id"]),
    "select row_id, precip from weather_daily where row_id not in (select row_id from weather_fallback) union all select row_id, precip from weather_fallback",
    "precip",
)


def _imports(v):
    o = v("orders")
    rows = o.select(c("o_orderkey").alias("row_number"), F.when(c("o_orderkey") % 13 == 0, "").otherwise(c("o_custkey").cast("string")).alias("field_external_id"), F.when(c("o_orderkey") % 29 == 0, "x").otherwise(F.year("o_orderdate").cast("string")).alias("season_year"), F.lit("wheat").alias("crop_code"), c("o_totalprice").cast("string").alias("yield_kg_ha"))
    return relational.validate_import(rows, "yield_history")


_IMPORT = """i as (select o_orderkey as row_number, case when o_orderkey % 13 = 0 then '' else o_custkey::varchar end as field_external_id, case when o_orderkey % 29 = 0 then 'x' else year(o_orderdate)::varchar end as season_year,
       case when o_orderkey % 13 = 0 then 'field_external_id is required' when o_orderkey % 29 = 0 then 'season_year is not a valid int' end as error_message from orders)"""
register("s3_validate_import", lambda v: _imports(v).select("row_number", "error_message"), f"with {_IMPORT} select row_number, error_message from i")
register(
    "s4_preview_import",
    lambda v: relational.preview_import(_imports(v)),
    f"""with {_IMPORT} select count(*) as rows_total, count_if(error_message is null) as rows_valid, count_if(error_message is not null) as rows_invalid, count(distinct field_external_id) filter (where error_message is null) as fields,
       array_to_string(list_sort(list(distinct season_year) filter (where error_message is null)), ',') as seasons from i""",
)
register("s5_import_errors", lambda v: _imports(v).where("error_message is not null").orderBy("row_number").limit(200).select("row_number", "error_message"), f"with {_IMPORT} select row_number, error_message from i where error_message is not null order by row_number limit 200")
register("s7_missing_seasons", lambda v: relational.missing_rows(v("yield_obs"), v("yield_obs").where("obs_id % 5 = 0"), ["field_id", "season_year"]), "select distinct field_id, season_year::int as season_year from yield_obs where (field_id, season_year) not in (select (field_id, season_year) from yield_obs where obs_id % 5 = 0)")
register(
    "s17_retention",
    lambda v: v("runs").agg(F.count_if(F.date_add("created_at", 365) < F.lit("1999-01-01").cast("date")).alias("removed"), F.count_if(F.date_add("created_at", 365) >= F.lit("1999-01-01").cast("date")).alias("kept")),
    "select count_if(created_at + 365 < date '1999-01-01') as removed, count_if(created_at + 365 >= date '1999-01-01') as kept from runs",
)
register(
    "s22_manifest_splits",
    lambda v: v("runs").groupBy("org").agg(F.count_distinct("status").alias("splits"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("names")).where("splits > 1"),
    "select org, count(distinct status) as splits, array_to_string(list_sort(list(distinct status)), ',') as names from runs group by 1 having count(distinct status) > 1",
)
register(
    "s19_label_manifest",
    lambda v: series.latest(v("label_versions"), ["label_task_id"], [F.desc("version_no")]).where("decision = 'approved'").select("label_task_id", "version_no", F.sha2(F.concat_ws(":", c("label_task_id").cast("string"), c("version_no").cast("string")), 256).alias("digest")),
    "select label_task_id, version_no, sha256(label_task_id || ':' || version_no) as digest from (select * from label_versions qualify row_number() over (partition by label_task_id order by version_no desc) = 1) x where decision = 'approved'",
)

# --- G: geometry of boxes and rings ---------------------------------------------------------------------------

register(
    "g1_ring_measures",
    lambda v: v("fields").select("field_id", geo.box_ring("minx", "miny", "maxx", "maxy").alias("ring")).select("field_id", geo.ring_area(c("ring")).alias("area"), geo.ring_perimeter(c("ring")).alias("perimeter"), geo.ring_centroid(c("ring")).alias("p")).select("field_id", (c("area") * 1e6).alias("area"), "perimeter", c("p.x").alias("x"), c("p.y").alias("y")),
    "select field_id, (maxx - minx) * (maxy - miny) * 1e6 as area, 2 * (maxx - minx + maxy - miny) as perimeter, (minx + maxx) / 2 as x, (miny + maxy) / 2 as y from fields",
    "area perimeter x y",
)
register(
    "g2_bounds",
    lambda v: v("fields").groupBy("org").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")),
    "select org, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy from fields group by 1",
    "minx miny maxx maxy",
)
register("g3_sliver_removal", lambda v: v("fields").where("area_m2 >= 500000").select("field_id", "area_m2"), "select field_id, area_m2 from fields where area_m2 >= 500000", "area_m2", digits=2)
register("g4_area_quantiles", lambda v: ranks.quantiles(v("fields"), [], "area_m2", {n: ranks.linear(q) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))}).drop("n"), "select quantile_cont(area_m2, 0.5) as p50, quantile_cont(area_m2, 0.9) as p90, quantile_cont(area_m2, 0.99) as p99 from fields", "p50 p90 p99", digits=2)
register(
    "g5_point_in_ring",
    lambda v: relational.box_join(v("grid_cells").select("cell_id", "minx", "miny", "maxx", "maxy"), v("fields").select("field_id", "minx", "miny", "maxx", "maxy")).where(geo.in_ring(c("minx") + 0.0025, c("miny") + 0.0025, geo.box_ring("r_minx", "r_miny", "r_maxx", "r_maxy"))).select("cell_id", c("r_field_id").alias("field_id")),
    "select cell_id, field_id from grid_cells g join fields f on g.minx + 25e-4 > f.minx and g.minx + 25e-4 < f.maxx and g.miny + 25e-4 > f.miny and g.miny + 25e-4 < f.maxy",
)
register(
    "g6_mask_iou",
    lambda v: zonal.confusion(v("indexed").groupBy("tile_id", "r", "c").agg((F.avg("ndvi") > 0.45).alias("pred")), v("indexed").groupBy("tile_id", "r", "c").agg((F.avg("ndwi") < -0.45).alias("truth")), ["tile_id", "r", "c"], ["tile_id"]).select("tile_id", "iou"),
    """with p as (select tile_id, avg(ndvi) > 0.45 as a, avg(ndwi) < -0.45 as b from indexed group by tile_id, r, c) select tile_id, count_if(a and b) / nullif(count_if(a or b), 0) as iou from p group by 1""",
    "iou",
)

# --- F: neighbourhoods on pixels --------------------------------------------------------------------------------

_FLAT = "(select tile_id, r, c, avg(ndvi) as x, max(scl) as k from indexed group by 1, 2, 3)"


def _flat(v):
    return v("indexed").groupBy("tile_id", "r", "c").agg(F.avg("ndvi").alias("x"), F.max("scl").alias("k"))


register(
    "f1_class_fractions",
    lambda v: focal.class_fractions(_flat(v), "k", {"crop": [4, 5], "cloud": [8, 9, 10]}).select("tile_id", "r", "c", "crop", "cloud"),
    f"""select a.tile_id, a.r, a.c, avg(case when b.k in (4, 5) then 1 else 0 end) as crop, avg(case when b.k in (8, 9, 10) then 1 else 0 end) as cloud from {_FLAT} a join {_FLAT} b on a.tile_id = b.tile_id and b.r between a.r - 2 and a.r + 2 and b.c between a.c - 2 and a.c + 2 group by 1, 2, 3
       """,
    "crop cloud",
)
register(
    "f2_lee_filter",
    lambda v: focal.lee(_flat(v), "x").select("tile_id", "r", "c", "filtered"),
    f"""with n as (select a.tile_id, a.r, a.c, any_value(a.x) as x, avg(b.x) as m, greatest(avg(b.x * b.x) - avg(b.x) * avg(b.x), 0) as var from {_FLAT} a join {_FLAT} b on a.tile_id = b.tile_id and b.r between a.r - 1 and a.r + 1 and b.c between a.c - 1 and a.c + 1 group by 1, 2, 3)
       select tile_id, r, c, m + coalesce(var / nullif(var + avg(var) over (partition by tile_id), 0), 0) * (x - m) as filtered from n""",
    "filtered",
)
register("f3_gradient", lambda v: focal.gradient(_flat(v), "x").select("tile_id", "r", "c", "edge"))
register(
    "f4_dilation",
    lambda v: focal.dilate(_flat(v).withColumn("m", F.coalesce(c("x") > 0.55, F.lit(False))), "m").select("tile_id", "r", "c", "m"),
    f"select a.tile_id, a.r, a.c, bool_or(coalesce(b.x > 0.55, false)) as m from {_FLAT} a join {_FLAT} b on a.tile_id = b.tile_id and abs(a.r - b.r) + abs(a.c - b.c) <= 1 group by 1, 2, 3",
)
register(
    "f4_erosion",
    lambda v: focal.dilate(_flat(v).withColumn("m", F.coalesce(c("x") > 0.4, F.lit(False))), "m", erode=True).select("tile_id", "r", "c", "m"),
    f"select a.tile_id, a.r, a.c, count_if(coalesce(b.x > 0.4, false)) = 5 as m from {_FLAT} a join {_FLAT} b on a.tile_id = b.tile_id and abs(a.r - b.r) + abs(a.c - b.c) <= 1 group by 1, 2, 3",
)
register(
    "f5_adjacency",
    lambda v: focal.adjacency(v("pixel_labels").join(_flat(v), ["tile_id", "r", "c"]), "label", "x"),
    f"""with l as (select * from pixel_labels join {_FLAT} f using (tile_id, r, c))
       select a.tile_id, least(a.label, b.label) as a, greatest(a.label, b.label) as b, count(*) as shared, avg((a.x + b.x) / 2) as strength from l a join l b on a.tile_id = b.tile_id and ((a.r = b.r and b.c = a.c + 1) or (a.c = b.c and b.r = a.r + 1)) and a.label <> b.label and a.label > 0 and b.label > 0 group by 1, 2, 3""",
    "strength",
)
register(
    "f6_weighted_composite",
    lambda v: focal.weighted_composite(v("indexed").select("tile_id", "t", "r", "c", "ndvi"), zonal.scene_coverage(v("indexed")), "ndvi", 0.2),
    """with k as (select tile_id, t, avg(case when valid then 1 else 0 end) as coverage from indexed group by 1, 2 having avg(case when valid then 1 else 0 end) >= 0.2), m as (select tile_id, r, c, sum(ndvi * coverage) / sum(coverage) as v from indexed join k using (tile_id, t) group by 1, 2, 3),
       p as (select tile_id, quantile_cont(v, 0.95) as p from m group by 1) select tile_id, r, c, coalesce(least(v / nullif(p, 0), 1), 0) as value from m join p using (tile_id)""",
    "value",
)
register("w15_min_max", lambda v: focal.min_max(_flat(v), ["tile_id"], "x").select("tile_id", "r", "c", "scaled"), f"select tile_id, r, c, coalesce((x - min(x) over w) / nullif(max(x) over w - min(x) over w, 0), 0) as scaled from {_FLAT} window w as (partition by tile_id)", "scaled")
register(
    "w16_stretch",
    lambda v: focal.stretch(_flat(v), "x").select("tile_id", "r", "c", "stretched"),
    f"with q as (select tile_id, quantile_cont(x, 0.05) as a, quantile_cont(x, 0.95) as b from {_FLAT} f group by 1) select tile_id, r, c, coalesce(greatest(0, least(1, (x - a) / nullif(b - a, 0))), 0) as stretched from {_FLAT} f join q using (tile_id)",
    "stretched",
)
register(
    "w13_date_selection",
    lambda v: series.evenly_spaced(zonal.scene_coverage(v("indexed")).where("coverage >= 0.1"), ["tile_id"], "t", 3).select("tile_id", "t"),
    """with s as (select tile_id, t from indexed group by 1, 2 having avg(case when valid then 1 else 0 end) >= 0.1), k as (select *, row_number() over (partition by tile_id order by t) - 1 as i, count(*) over (partition by tile_id) as n from s)
       select distinct tile_id, t from k cross join range(3) as r(j) where n <= 3 or i = round(j * (n - 1) / 2)""",
)
register(
    "w8_best_scenes",
    lambda v: relational.top_per_group(v("indexed").groupBy("tile_id", "t").agg(F.round(F.avg("ndvi"), 9).alias("ndvi")), ["tile_id"], [F.desc_nulls_last("ndvi"), F.asc("t")], 2).select("tile_id", "t"),
    "select tile_id, t from (select tile_id, t, round(avg(ndvi), 9) as ndvi from indexed group by 1, 2) s qualify row_number() over (partition by tile_id order by ndvi desc nulls last, t) <= 2",
)
register(
    "w14_zones",
    lambda v: scoring.zones(relational.box_join(v("grid_cells"), v("fields").select("field_id", "minx", "miny", "maxx", "maxy")).select(c("r_field_id").alias("field_id"), "cell_id", "ndvi_mean", "ndmi_mean"), {"ndvi_mean": 0.7, "ndmi_mean": 0.3}).groupBy("field_id").agg(F.count("*").alias("cells"), F.max("score").alias("top"), F.min("score").alias("low")),
    """with j as (select field_id, cell_id, ndvi_mean as a, ndmi_mean as b from grid_cells g join fields f on g.minx < f.maxx and g.maxx > f.minx and g.miny < f.maxy and g.maxy > f.miny),
       m as (select field_id, median(a) as ma, avg(a) as aa, stddev_pop(a) as sa, median(b) as mb, avg(b) as ab, stddev_pop(b) as sb, count(*) as n from j group by 1), d as (select field_id, median(abs(a - ma)) as da, median(abs(b - mb)) as db from j join m using (field_id) group by 1),
       z as (select field_id, 0.7e0 * (case when da > 1e-9 then 0.6745e0 * (a - ma) / da when sa > 1e-9 then (a - aa) / sa else 0 end) + 0.3e0 * (case when db > 1e-9 then 0.6745e0 * (b - mb) / db when sb > 1e-9 then (b - ab) / sb else 0 end) as s, n from j join m using (field_id) join d using (field_id))
       select field_id, count(*) as cells, round(max(s) + 1e-12, 9) as top, round(min(s) + 1e-12, 9) as low from z where n >= 6 group by 1""",
    "top low",
    digits=9,  # as zones() rounds: a second rounding would make ties
)

# --- Q: iterative -----------------------------------------------------------------------------------------------------


def _mask(v):
    return _flat(v).where("x > 0.5").select("tile_id", "r", "c", (c("tile_id") * 64 + c("r") * 8 + c("c")).alias("id"))


_COMPONENTS = f"""m as (select tile_id, r, c, tile_id * 64 + r * 8 + c as id from {_FLAT} f where x > 0.5), e as (select a.id as u, b.id as v from m a join m b on a.tile_id = b.tile_id and abs(a.r - b.r) + abs(a.c - b.c) = 1),
       reach as (select id, id as root from m union select e.v as id, reach.root from reach join e on reach.id = e.u), comp as (select id, min(root) as component from reach group by 1)"""
register("q2_pixel_components", lambda v: mosaic.tile_components(_mask(v)).select("id", "component"), f"with recursive {_COMPONENTS} select id, component from comp")
register(
    "l9_largest_components",
    lambda v: relational.top_per_group(mosaic.tile_components(_mask(v)).groupBy("component").agg(F.count("*").alias("size")).withColumn("tile_id", F.floor(c("component") / 64)), ["tile_id"], [F.desc("size"), F.asc("component")], 2).select("component", "size"),
    f"with recursive {_COMPONENTS} select component, count(*) as size from comp group by 1 qualify row_number() over (partition by floor(component / 64) order by count(*) desc, component) <= 2",
)


def _overlaps(v):
    f = v("fields").select("field_id", "minx", "miny", "maxx", "maxy")
    return relational.box_join(f, f).where("field_id < r_field_id")


register(
    "q1_polygon_merge",
    lambda v: v("fields").join(iterative.min_labels(v("fields").select(c("field_id").alias("id")), _overlaps(v).select(c("field_id").alias("u"), c("r_field_id").alias("v"))).withColumnRenamed("id", "field_id"), "field_id").groupBy("component").agg(F.count("*").alias("members"), F.min("minx").alias("minx"), F.max("maxx").alias("maxx"), F.avg("quality_score").alias("quality")),
    """with recursive e as (select a.field_id as u, b.field_id as v from fields a join fields b on a.field_id <> b.field_id and a.minx < b.maxx and a.maxx > b.minx and a.miny < b.maxy and a.maxy > b.miny), reach as (select field_id as id, field_id as root from fields union select e.v as id, reach.root from reach join e on reach.id = e.u),
       comp as (select id, min(root) as component from reach group by 1) select component, count(*) as members, min(minx) as minx, max(maxx) as maxx, avg(quality_score) as quality from comp join fields on id = field_id group by 1""",
    "minx maxx quality",
)
register("q3_suppression", lambda v: iterative.suppress(v("fields").select(c("field_id").alias("id"), F.round("quality_score", 9).alias("score")), _overlaps(v).where(relational.box_iou() > 0.02).select(c("field_id").alias("u"), c("r_field_id").alias("v"))).select("id", "state"))
register("q7_group_split", lambda v: iterative.group_split(v("fields"), "org"), """with s as (select org, count(*) as n, md5(org::varchar) as h from fields group by 1), p as (select *, sum(n) over (order by h, org) - n as before, sum(n) over () as total from s)
       select org, n, case when before < 0.7 * total then 'train' when before < 0.85 * total then 'val' else 'test' end as part from p""")  # fmt: skip
register("q8_downsampling", lambda v: iterative.downsample(v("qa_results").select("event_id", (c("status") == "failed").alias("positive"), c("empty_output").alias("hard")), "event_id", "positive", "hard", 1.0))

# --- M: scoring and calibration -------------------------------------------------------------------------------------------


def _residuals(v):
    o = v("yield_obs").join(v("field_seasons").select(c("season_id").alias("obs_id"), "crop_code"), "obs_id")
    mean = o.groupBy("crop_code").agg(F.avg("yield_kg_ha").alias("m"))
    return o.join(mean, "crop_code").select("obs_id", "crop_code", ag.latitude_bucket((38 + c("field_id") % 30).cast("double")).alias("region"), (c("yield_kg_ha") - c("m")).alias("residual"), (c("obs_id") % 5 == 0).alias("holdout"))


_RESIDUALS = """o as (select obs_id, crop_code, 38 + o.field_id % 30 as lat, yield_kg_ha - avg(yield_kg_ha) over (partition by crop_code) as residual, obs_id % 5 = 0 as holdout from yield_obs o join field_seasons s on o.obs_id = s.season_id),
       rr as (select *, case when lat < 40 then 'lat_lt_40' when lat < 48 then 'lat_40_48' when lat < 55 then 'lat_48_55' when lat < 62 then 'lat_55_62' else 'lat_gt_62' end as region from o),
       al as (select obs_id, crop_code, region, residual, holdout from rr union all select obs_id, crop_code, 'global', residual, holdout from rr),
       kk as (select crop_code, region, count_if(holdout) as held, count(*) as n from al group by 1, 2), bb as (select al.* from al join kk using (crop_code, region) where case when held >= 5 then holdout else n >= 5 end)"""
register("m5_residual_buckets", lambda v: scoring.residual_buckets(_residuals(v)).groupBy("crop_code", "region").agg(F.count("*").alias("n"), F.avg("residual").alias("bias")), f"with {_RESIDUALS} select crop_code, region, count(*) as n, avg(residual) as bias from bb group by 1, 2", "bias", digits=4)
_M6 = f"""{_RESIDUALS}, ii as (select crop_code, region, abs(residual) as a, row_number() over (partition by crop_code, region order by abs(residual)) - 1 as i, count(*) over (partition by crop_code, region) as n from bb),
       pp as (select *, least(0.9e0 * (1 + 1 / n), 1) * (n - 1) as pos from ii), ww as (select crop_code, region, max(n) as n, max(a) filter (where i = floor(pos)) + (max(a) filter (where i = least(floor(pos) + 1, n - 1)) - max(a) filter (where i = floor(pos))) * max(pos - floor(pos)) as width from pp group by 1, 2),
       ee as (select crop_code, region, ww.n, width, avg(case when a <= width then 1 else 0 end) as empirical from ii join ww using (crop_code, region) group by 1, 2, 3, 4)"""
register("m6_intervals", lambda v: scoring.interval_buckets(scoring.residual_buckets(_residuals(v)), ["crop_code", "region"]), f"with {_M6} select *, greatest(0.2e0, least(0.95e0, (1 - abs(empirical - 0.9e0) / 0.9e0) * least(n / 15, 1))) as confidence from ee", "width empirical confidence", digits=4)
def _season_features(v):
    w = v("weather_daily").withColumn("season_year", F.year("observed_on")).groupBy("field_id", "season_year").agg(F.sum("gdd").alias("gdd"), F.sum("precip").alias("precip"), F.avg("vpd").alias("vpd"))
    y = v("yield_obs").groupBy("field_id", "season_year").agg(F.avg("yield_kg_ha").alias("yield"))
    s = series.latest(v("soil_profiles"), ["field_id"], [F.desc("sampled_at"), F.desc("profile_id")]).select("field_id", "ph", F.when(c("profile_id") % 4 > 0, c("n_ppm")).alias("n_ppm"))
    return y.join(w, ["field_id", "season_year"], "left").join(s, "field_id", "left")


_FEATURES = """sf as (select y.field_id, y.season_year::int as season_year, y.yield, gdd, precip, vpd, ph, case when profile_id % 4 > 0 then n_ppm end as n_ppm from (select field_id, season_year, avg(yield_kg_ha) as yield from yield_obs group by 1, 2) y
       left join (select field_id, year(observed_on) as season_year, sum(gdd) as gdd, sum(precip) as precip, avg(vpd) as vpd from weather_daily group by 1, 2) w using (field_id, season_year)
       left join (select * from soil_profiles qualify row_number() over (partition by field_id order by sampled_at desc, profile_id desc) = 1) s using (field_id))"""
register("z31_yield_corpus", _season_features, f"with {_FEATURES} select * from sf", "yield gdd precip vpd ph")
register(
    "m1_m4_feature_coverage",
    lambda v: scoring.feature_coverage(_season_features(v), ["gdd", "precip", "vpd", "ph", "n_ppm"]).withColumn("tier", scoring.tier(c("season_year") % 7, c("coverage"))).select("field_id", "season_year", "coverage", "missing", "tier"),
    f"""with {_FEATURES} select field_id, season_year, ((gdd is not null)::int + (precip is not null)::int + (vpd is not null)::int + (ph is not null)::int + (n_ppm is not null)::int) / 5 as coverage, case when n_ppm is null then 'n_ppm' else '' end as missing,
       case when season_year % 7 >= 5 then 'calibrated' when season_year % 7 >= 1 then 'scaled' else 'baseline' end as tier from sf""",
    "coverage",
)
register("m3_ridge", lambda v: scoring.ridge(_season_features(v).withColumn("crop", c("field_id") % 4), "crop", ["gdd", "precip", "vpd"], "yield").select("crop", "alpha", "n", F.round("loo_rmse", 2).alias("loo_rmse")))
register("m11_priority", lambda v: v("qa_results").select("event_id", scoring.label_priority(c("queue_wall_s") / 100, c("region") / 12, c("field_count") / 60, F.lit(0.5)).alias("priority")), "select event_id, 0.45e0 * queue_wall_s / 100 + 0.25e0 * region / 12 + 0.15e0 * field_count / 60 + 0.15e0 * 0.5e0 as priority from qa_results", "priority")
register(
    "m13_promotion_gates",
    lambda v: scoring.promotion_gates(v("qa_results").groupBy("region").agg(F.count("*").cast("double").alias("size"), F.avg("queue_wall_s").alias("wall"), F.max(F.when(c("region") % 3 > 0, 0.5)).alias("iou")), [("size", ">=", 300.0), ("wall", "<=", 10.0), ("iou", ">=", 0.4)]).select("region", "reasons", "passed"),
    """with m as (select region, count(*) as size, avg(queue_wall_s) as wall from qa_results group by 1) select region, concat_ws(',', case when size < 300 then 'size_failed' end, case when wall > 10 then 'wall_failed' end, case when region % 3 = 0 then 'iou_missing' end) as reasons, size >= 300 and wall <= 10 and region % 3 > 0 as passed from m""",
)
register("m14_superseded", lambda v: scoring.superseded(v("runs"), "org", [F.desc("created_at"), F.desc("run_id")]).select("run_id", "state"), "select run_id, case when row_number() over (partition by org order by created_at desc, run_id desc) = 1 then 'promoted' else 'superseded' end as state from runs")
register(
    "j20_model_precedence",
    lambda v: series.latest(v("runs").where("status <> 'queued'"), ["org"], [F.desc(c("status") == "done"), F.desc("created_at"), F.asc("run_id")]).select("org", "run_id"),
    "select org, run_id from runs where status <> 'queued' qualify row_number() over (partition by org order by status = 'done' desc, created_at desc, run_id) = 1",
)
register(
    "z24_z25_candidates",
    lambda v: v("embeddings").select((c("vec_id") % 3).alias("branch"), F.least(F.lit(1.0), F.abs(c("embedding")[0].cast("double")) * 4).alias("score")).withColumn("reason", F.when(c("score") < 0.25, "low_score").when(c("score") > 0.9, "suppressed_by_other")).cube("branch", "reason").agg(F.count("*").alias("n"), F.avg("score").alias("score")),
    "with k as (select vec_id % 3 as branch, least(1, abs(embedding[1]::double) * 4) as score from embeddings), r as (select *, case when score < 0.25 then 'low_score' when score > 0.9 then 'suppressed_by_other' end as reason from k) select branch, reason, count(*) as n, avg(score) as score from r group by cube (branch, reason)",
    "score",
)
register(
    "z29_mode_deltas",
    lambda v: v("qa_results").groupBy("region").pivot("status", ["done", "failed"]).agg(F.avg("queue_wall_s")).withColumn("delta", c("failed") - c("done")),
    "select region, avg(queue_wall_s) filter (where status = 'done') as done, avg(queue_wall_s) filter (where status = 'failed') as failed, avg(queue_wall_s) filter (where status = 'failed') - avg(queue_wall_s) filter (where status = 'done') as delta from qa_results group by 1",
    "done failed delta",
)
register(
    "z35_data_status",
    lambda v: v("metric_obs").groupBy("field_id").agg(F.count("*").alias("points"), F.min("observed_on").alias("first_day"), F.max("observed_on").alias("last_day"), F.count_if(c("source") == "historical_backfill").alias("backfill")).withColumn("status", F.when(c("points") < 10, "sparse").when(c("backfill") == c("points"), "backfill_only").otherwise("ready")),
    "select *, case when points < 10 then 'sparse' when backfill = points then 'backfill_only' else 'ready' end as status from (select field_id, count(*) as points, min(observed_on) as first_day, max(observed_on) as last_day, count_if(source = 'historical_backfill') as backfill from metric_obs group by 1) s",
)
register(
    "t1_weather_cache",
    lambda v: series.latest(v("point_weather").where("observed_at >= timestamp '2024-01-10 00:00:00'").withColumn("lat", F.round("lat", 1)).withColumn("lon", F.round("lon", 1)), ["lat", "lon"], [F.desc("observed_at"), F.asc("event_id")]).select("lat", "lon", "event_id", "provider"),
    "select round(lat, 1) as lat, round(lon, 1) as lon, event_id, provider from point_weather where observed_at >= timestamp '2024-01-10 00:00:00' qualify row_number() over (partition by round(lat, 1), round(lon, 1) order by observed_at desc, event_id) = 1",
    "lat lon",
)

# --- further filters, joins and reports --------------------------------------------------------------------------

register(
    "p7_hydro_masks",
    lambda v: v("indexed").where("valid").groupBy("tile_id", "r", "c").agg(F.avg((c("ndwi") > -0.4).cast("int")).alias("share"), F.count("*").alias("n")).select("tile_id", "r", "c", (c("share") >= 0.8).alias("open_water"), ((c("share") > 0.2) & (c("share") < 0.8)).alias("seasonal_wet")),
    "select tile_id, r, c, share >= 0.8 as open_water, share > 0.2 and share < 0.8 as seasonal_wet from (select tile_id, r, c, avg(case when ndwi > -0.4 then 1 else 0 end) as share from indexed where valid group by 1, 2, 3) s",
)
_P12 = "list_filter([case when area < 6 then 'area' end, case when water > 0.3 then 'water' end, case when ndvi_mean < 0.4 then 'ndvi' end, case when ndvi_std > 0.2 then 'std' end], lambda x: x is not null)[1]"
register(
    "p12_zonal_rejection",
    lambda v: v("pixel_labels").where("label > 0").join(_flat(v), ["tile_id", "r", "c"]).groupBy("tile_id", "label").agg(F.count("*").alias("area"), F.avg((c("k") == 6).cast("int")).alias("water"), F.round(F.avg("x"), 9).alias("ndvi_mean"), F.round(F.stddev_pop("x"), 9).alias("ndvi_std")).select(su.proposal_reject(c("area"), c("water"), c("ndvi_mean"), c("ndvi_std")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    f"select {_P12} as reason, count(*) as n from (select tile_id, label, count(*) as area, avg(case when k = 6 then 1 else 0 end) as water, round(avg(x), 9) as ndvi_mean, round(stddev_pop(x), 9) as ndvi_std from pixel_labels join {_FLAT} f using (tile_id, r, c) where label > 0 group by 1, 2) s group by 1",
)
register(
    "p14_quality_gate",
    lambda v: v("indexed").groupBy("tile_id").agg(F.avg(c("valid").cast("int")).alias("coverage"), F.avg("ndvi").alias("ndvi")).select("tile_id", (c("coverage").between(0.2, 0.95) & (c("ndvi") > 0.3)).alias("passed")),
    "select tile_id, avg(case when valid then 1 else 0 end) between 0.2 and 0.95 and avg(ndvi) > 0.3 as passed from indexed group by 1",
)
register(
    "p11_candidate_filter",
    lambda v: v("qa_results").where((c("status") == "done") & (c("region") == 3)).orderBy(F.desc("queue_wall_s"), "event_id").limit(100).select("event_id", "queue_wall_s"),
    "select event_id, queue_wall_s from qa_results where status = 'done' and region = 3 order by queue_wall_s desc, event_id limit 100",
    "queue_wall_s",
)
register(
    "z5_label_keep",
    lambda v: v("pixel_labels").join(v("pixel_labels").join(_flat(v), ["tile_id", "r", "c"]).groupBy("tile_id", "label").agg(F.round(F.avg("x"), 9).alias("m"), F.count("*").alias("n")).where("m > 0.5 and n >= 5 and label > 0").select("tile_id", "label"), ["tile_id", "label"], "left_semi").select("tile_id", "r", "c", "label"),
    f"select tile_id, r, c, label from pixel_labels where (tile_id, label) in (select (tile_id, label) from pixel_labels join {_FLAT} f using (tile_id, r, c) group by tile_id, label having round(avg(x), 9) > 0.5 and count(*) >= 5 and label > 0)",
)
register(
    "z8_best_scene_stack",
    lambda v: v("indexed").join(relational.top_per_group(v("indexed").groupBy("tile_id", "t").agg(F.round((1 - F.avg(sp.cloud_pixel(c("scl")).cast("int"))) * 0.7 + F.least(F.avg("ndvi"), F.lit(1.0)) * 0.3, 9).alias("s")), ["tile_id"], [F.desc_nulls_last("s"), F.asc("t")], 3).select("tile_id", "t"), ["tile_id", "t"]).where("valid").groupBy("tile_id", "r", "c").agg(F.max("ndvi").alias("hi"), F.avg("ndvi").alias("mean"), F.stddev_pop("ndvi").alias("std")),
    """with s as (select tile_id, t, round((1 - avg(case when scl in (3, 8, 9, 10) then 1 else 0 end)) * 0.7e0 + least(avg(ndvi), 1) * 0.3e0, 9) as s from indexed group by 1, 2), k as (select tile_id, t from s qualify row_number() over (partition by tile_id order by s desc nulls last, t) <= 3)
       select tile_id, r, c, max(ndvi) as hi, avg(ndvi) as mean, stddev_pop(ndvi) as std from indexed join k using (tile_id, t) where valid group by 1, 2, 3""",
    "hi mean std",
)
register(
    "z10_mask_profile",
    lambda v: v("indexed").where("valid").groupBy("tile_id", "t").agg(F.avg("ndvi").alias("m")).withColumn("d", F.expr("m - lag(m) over (partition by tile_id order by t)")).groupBy("tile_id").agg((F.max("m") - F.min("m")).alias("amplitude"), F.bool_or(c("d") > 0.02).alias("rise"), F.bool_or(c("d") < -0.02).alias("drop")),
    "with m as (select tile_id, t, avg(ndvi) as m from indexed where valid group by 1, 2), d as (select *, m - lag(m) over (partition by tile_id order by t) as d from m) select tile_id, max(m) - min(m) as amplitude, bool_or(d > 0.02) as rise, bool_or(d < -0.02) as drop from d group by 1",
    "amplitude",
)
register(
    "z27_holdout_metrics",
    lambda v: ranks.quantiles(v("qa_results"), [], "queue_wall_s", {"median_wall": ranks.linear(0.5), "p90_wall": ranks.linear(0.9)}).drop("n").crossJoin(v("qa_results").agg(F.avg("queue_wall_s").alias("mean_wall"), F.avg(F.when(c("region") < 4, c("queue_wall_s"))).alias("mean_south"), F.avg((c("status") == "failed").cast("int")).alias("failure_rate"), F.avg(c("empty_output").cast("int")).alias("empty_rate"))),
    "select avg(queue_wall_s) as mean_wall, median(queue_wall_s) as median_wall, quantile_cont(queue_wall_s, 0.9) as p90_wall, avg(queue_wall_s) filter (where region < 4) as mean_south, avg(case when status = 'failed' then 1 else 0 end) as failure_rate, avg(case when empty_output then 1 else 0 end) as empty_rate from qa_results",
    "mean_wall median_wall p90_wall mean_south failure_rate empty_rate",
)
register(
    "z33_geometry_quality",
    lambda v: v("field_seasons").join(v("fields").select("field_id", "quality_score"), "field_id").groupBy("season_year").agg(F.avg("quality_score").alias("quality"), F.count("*").alias("n")),
    "select season_year::int as season_year, avg(quality_score) as quality, count(*) as n from field_seasons join fields using (field_id) group by 1",
    "quality",
)
register(
    "z34_phase_features",
    lambda v: series.area_under_curve(v("weekly_ndvi"), ["field_id"], "week_start", "v").select("field_id", "auc", "peak").join(v("weekly_weather").groupBy("field_id").agg(F.count_if(c("vpd") > 2).alias("stress_weeks"), F.sum(F.greatest(c("vpd") - 2, F.lit(0.0))).alias("vpd_excess")), "field_id"),
    """with p as (select *, (v + lag(v) over w) / 2 * (week_start - lag(week_start) over w) / 7 as part from weekly_ndvi window w as (partition by field_id order by week_start)), a as (select field_id, sum(part) as auc, max(v) as peak from p group by 1), s as (select field_id, count_if(vpd > 2) as stress_weeks, sum(greatest(vpd - 2, 0)) as vpd_excess from weekly_weather group by 1)
       select field_id, auc, peak, stress_weeks, vpd_excess from a join s using (field_id)""",
    "auc peak vpd_excess",
)
register(
    "z38_truth_overlap",
    lambda v: v("pixel_labels").where("label > 0").join(_flat(v).select("tile_id", "r", "c", (c("x") > 0.5).alias("truth")), ["tile_id", "r", "c"]).groupBy("tile_id", "label").agg(F.avg(c("truth").cast("int")).alias("overlap"), F.var_pop("r").alias("vr"), F.var_pop("c").alias("vc"), F.covar_pop("r", "c").alias("cov")).withColumn("class", F.when(c("overlap") >= 0.2, 1).otherwise(0)),
    f"select *, case when overlap >= 0.2 then 1 else 0 end as class from (select tile_id, label, avg(case when x > 0.5 then 1 else 0 end) as overlap, var_pop(r) as vr, var_pop(c) as vc, covar_pop(r, c) as cov from pixel_labels join {_FLAT} f using (tile_id, r, c) where label > 0 and x is not null group by 1, 2) s",
    "overlap vr vc cov",
)
register(
    "z39_pixel_features",
    lambda v: v("indexed").groupBy("tile_id", "r", "c").agg(F.avg("b8").alias("b8_mean"), F.percentile("b8", F.lit(0.5)).alias("b8_median"), F.max("ndvi").alias("ndvi_max"), F.avg(c("valid").cast("int")).alias("valid_share"), F.percentile("scl", F.lit(0.5)).alias("scl_median")),
    "select tile_id, r, c, avg(b8) as b8_mean, median(b8) as b8_median, max(ndvi) as ndvi_max, avg(case when valid then 1 else 0 end) as valid_share, median(scl) as scl_median from indexed group by 1, 2, 3",
    "b8_mean b8_median ndvi_max valid_share scl_median",
    digits=8,
)
register(
    "z41_geometry_change",
    lambda v: v("fields").join(v("fields").select(c("field_id"), (c("area_m2") * (1 + c("field_id") % 5 / 50)).alias("after_m2")), "field_id").groupBy("org").agg(F.avg(c("after_m2") / c("area_m2")).alias("ratio"), F.array_join(F.slice(F.sort_array(F.collect_set("source")), 1, 5), ",").alias("sources")),
    "select org, avg(area_m2 * (1 + field_id % 5 / 50) / area_m2) as ratio, array_to_string(list_sort(list(distinct source))[1:5], ',') as sources from fields group by 1",
    "ratio",
)
register(
    "z42_ring_share",
    lambda v: focal.dilate(_flat(v).withColumn("m", F.coalesce(c("x") > 0.55, F.lit(False))).withColumn("own", c("m")), "m").where("m and not own").groupBy("tile_id").agg(F.avg((c("k") > 5).cast("int")).alias("share"), F.count("*").alias("ring")),
    f"""with d as (select a.tile_id, a.r, a.c, any_value(a.k) as k, any_value(coalesce(a.x > 0.55, false)) as own, bool_or(coalesce(b.x > 0.55, false)) as m from {_FLAT} a join {_FLAT} b on a.tile_id = b.tile_id and abs(a.r - b.r) + abs(a.c - b.c) <= 1 group by 1, 2, 3)
       select tile_id, avg(case when k > 5 then 1 else 0 end) as share, count(*) as ring from d where m and not own group by 1""",
    "share",
)
register(
    "j16_primary_support_merge",
    lambda v: v("grid_cells").select("cell_id").join(_iou_pairs(v).select("cell_id").distinct(), "cell_id", "left_anti").select(c("cell_id").alias("id"), F.lit("support").alias("origin")).unionByName(v("fields").select(c("field_id").alias("id"), F.lit("primary").alias("origin"))),
    "select cell_id as id, 'support' as origin from grid_cells g where not exists (select 1 from fields f where g.minx < f.maxx and g.maxx > f.minx and g.miny < f.maxy and g.maxy > f.miny) union all select field_id, 'primary' from fields",
)
register(
    "j22_nearest_masked",
    lambda v: zonal.nearest(_flat(v).select("tile_id", "r", "c"), _flat(v).where("k = 2").select("tile_id", "r", "c"), pixel_m=10.0, radius_m=1000.0),
    f"select a.tile_id, a.r, a.c, coalesce(min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) * 10), 1000) as distance from {_FLAT} a left join {_FLAT} b on a.tile_id = b.tile_id and b.k = 2 group by 1, 2, 3",
    "distance",
)
register("l3_paging", lambda v: relational.page(v("runs"), [F.desc("created_at"), F.asc("run_id")], 40, 20).select("run_id"), "select run_id from runs order by created_at desc, run_id limit 20 offset 40")
register(
    "l8_drivers",
    lambda v: v("weather_daily").select("row_id", F.inline(F.array(*(F.struct(F.lit(n).alias("driver"), F.when(F.abs(e) <= 1.5, e * 100).otherwise(e).alias("effect")) for n, e in (("vpd", c("vpd") - 2), ("precip", c("precip") - 5), ("soil", c("soil") - 0.2))))).alias("driver", "effect")).withColumn("rank", F.expr("row_number() over (partition by row_id order by round(abs(effect), 9) desc, driver)")),
    """with u as (select row_id, 'vpd' as driver, vpd - 2 as e from weather_daily union all select row_id, 'precip', precip - 5 from weather_daily union all select row_id, 'soil', soil - 0.2e0 from weather_daily), f as (select row_id, driver, case when abs(e) <= 1.5e0 then e * 100 else e end as effect from u)
       select *, row_number() over (partition by row_id order by round(abs(effect), 9) desc, driver)::int as rank from f""",
    "effect",
)
register("o8_rerun_ids", lambda v: v("qa_results").where("empty_output").select("region").distinct(), "select distinct region from qa_results where empty_output")
register(
    "s6_resolve_field",
    lambda v: v("yield_obs").select("obs_id", (c("field_id") + F.when(c("obs_id") % 11 == 0, 100000000).otherwise(0)).alias("external")).join(v("fields").select(c("field_id").alias("external"), c("field_id")), "external", "left").select("obs_id", "field_id", F.when(c("field_id").isNull(), "unknown field").alias("error")),
    "select obs_id, f.field_id, case when f.field_id is null then 'unknown field' end as error from yield_obs o left join fields f on f.field_id = o.field_id + case when obs_id % 11 = 0 then 100000000 else 0 end",
)
register(
    "s9_upsert_weather",
    lambda v: series.latest(v("weather_daily").select("field_id", "observed_on", "precip", F.lit(0).alias("p"), "row_id").unionByName(v("weather_fallback").select("field_id", "observed_on", "precip", F.lit(1).alias("p"), "row_id")), ["field_id", "observed_on"], [F.desc("p"), F.desc("row_id")]).select("field_id", "observed_on", "precip"),
    "select field_id, observed_on, precip from (select field_id, observed_on, precip, 0 as p, row_id from weather_daily union all select field_id, observed_on, precip, 1, row_id from weather_fallback) u qualify row_number() over (partition by field_id, observed_on order by p desc, row_id desc) = 1",
    "precip",
)
register("s21_registry_names", lambda v: v("pages").select("page_id", readers.registry_name(c("url")).alias("name")), "select page_id, regexp_replace(lower(trim(url)), '[^a-z0-9_]+', '_', 'g') as name from pages")
register("s8_json_props", lambda v: v("events").select("event_id", F.from_json("props", "k int")["k"].alias("k")), "select event_id, json_extract(props, '$.k')::int as k from events")
register(
    "m10_branch_agreement",
    lambda v: _overlaps(v).where(relational.box_iou() > 0.02).select("field_id", (c("r_field_id") % 3).alias("branch"), F.round(relational.box_iou(), 9).alias("iou")).groupBy("field_id").agg(F.count_distinct(F.when(c("branch") != c("field_id") % 3, c("branch"))).alias("agreement"), F.max("iou").alias("iou")),
    """with b as (select a.field_id, b.field_id % 3 as branch, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) as i, (a.maxx - a.minx) * (a.maxy - a.miny) as x, (b.maxx - b.minx) * (b.maxy - b.miny) as y from fields a join fields b on a.field_id < b.field_id and a.minx < b.maxx and a.maxx > b.minx and a.miny < b.maxy and a.maxy > b.miny)
       select field_id, count(distinct case when branch <> field_id % 3 then branch end) as agreement, max(round(i / (x + y - i), 9)) as iou from b where i / (x + y - i) > 0.02 group by 1""",
    "iou",
)
register(
    "m12_scenario",
    lambda v: v("weekly_ndvi").select("field_id", "week_start", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("v") * (1 + 0.15 * 0.4))).alias("v")),
    "select field_id, week_start, greatest(0, least(1, v * (1 + 0.15e0 * 0.4e0))) as v from weekly_ndvi",
    "v",
)
register("m7_yield_regressor", lambda v: models.yield_regressor(_season_features(v), ["gdd", "precip", "vpd", "ph", "n_ppm"], "yield"))
register("m8_object_classifier", lambda v: models.object_classifier(v("pixel_labels").where("label > 0").join(_flat(v), ["tile_id", "r", "c"]).groupBy("tile_id", "label").agg(F.avg("x").alias("x"), F.avg("k").alias("k"), F.count("*").cast("double").alias("n"), F.max((c("x") > 0.75).cast("double")).alias("target")), ["tile_id", "label"], ["x", "k", "n"], "target"))
register(
    "a26_land_cover_gate",
    lambda v: v("fields").select("field_id", ag.land_cover_gate(c("miny") + c("field_id") % 17, c("minx") + c("field_id") % 40).alias("gate")),
    """select field_id, case when (lon >= 44 and lat >= 50) or lon >= 60 then least(case when lat > 60 then 4e0 when lat > 57 then 5e0 else 10e0 end, case when lat > 57 then 2e0 when lat >= 52 then 3e0 else 4e0 end) else case when lat > 60 then 4e0 when lat > 57 then 5e0 else 10e0 end end as gate
       from (select field_id, miny + field_id % 17 as lat, minx + field_id % 40 as lon from fields) f""",
    "gate",
)
_REASON = "case event_id % 7 when 0 then 'below_min_score' when 1 then 'suppressed_by_3' when 2 then 'dropped_after_merge' when 3 then 'quality_gate_failed' when 4 then 'area' when 5 then '' end"
register(
    "a28_loss_stage",
    lambda v: v("qa_results").select("region", ag.loss_stage(F.expr(_REASON)).alias("stage")).groupBy("region", "stage").agg(F.count("*").alias("n")),
    "select region, case event_id % 7 when 0 then 'rank_and_suppress' when 1 then 'rank_and_suppress' when 2 then 'obia_topology_cleanup' when 3 then 'quality_gate' when 4 then 'candidate_filtering' else 'unknown' end as stage, count(*) as n from qa_results group by 1, 2",
)
register(
    "u7_origin_tiles",
    lambda v: generators.origin_tiles(v("fields").withColumn("maxx", c("maxx") + c("field_id") % 7), "field_id"),
    """select field_id, lat, lon, 'N' || lpad(lat::varchar, 2, '0') || 'E' || lpad(lon::varchar, 3, '0') as tile from (select *, unnest(range(floor(minx / 3)::bigint * 3, ceil((maxx + field_id % 7) / 3)::bigint * 3, 3)) as lon from (select *, unnest(range(floor(miny / 3)::bigint * 3, ceil(maxy / 3)::bigint * 3, 3)) as lat from fields) f) g""",
)
register(
    "p13_component_rescue",
    lambda v: mosaic.tile_components(_mask(v)).select("id", "component").join(_flat(v).select((c("tile_id") * 64 + c("r") * 8 + c("c")).alias("id"), "x"), "id").groupBy("component").agg(F.count("*").alias("size"), F.max("x").alias("top")).where("size between 3 and 30 and top > 0.6"),
    f"with recursive {_COMPONENTS} select component, count(*) as size, max(x) as top from comp join (select tile_id * 64 + r * 8 + c as id, x from {_FLAT} f) y using (id) group by 1 having count(*) between 3 and 30 and max(x) > 0.6",
    "top",
)

# --- zones over all metrics, and queries that are registered under two names ---

_ZONE_WEIGHTS = {"ndvi_mean": 0.45, "ndmi_mean": 0.18, "bsi_mean": -0.17, "soil_moist": 0.12, "vpd_mean": -0.05, "wind_speed_m_s": -0.03}


def _zone_cells(v):
    cells = relational.box_join(v("grid_cells"), v("fields").select("field_id", "minx", "miny", "maxx", "maxy", "area_m2")).select(c("r_field_id").alias("field_id"), "cell_id", *_ZONE_WEIGHTS, "field_coverage", c("r_area_m2").alias("area_m2"))
    known = v("yield_obs").groupBy("field_id").agg(F.round(F.avg("yield_kg_ha"), 3).alias("baseline"), (F.count("*") / 20.0).alias("confidence_0"))
    return scoring.zone_shares(scoring.zones(cells, _ZONE_WEIGHTS).join(known.hint("merge"), "field_id", "left"), "field_coverage", "area_m2", "baseline", "confidence_0")


_ZONES = f"""j as (select field_id, cell_id, {", ".join(_ZONE_WEIGHTS)}, area_m2, greatest(field_coverage, 0.01e0) as w from grid_cells g join fields f on g.minx < f.maxx and g.maxx > f.minx and g.miny < f.maxy and g.maxy > f.miny),
       x as (select field_id, cell_id, unnest({[*_ZONE_WEIGHTS]}) as k, unnest([{", ".join(f"{x}e0" for x in _ZONE_WEIGHTS.values())}]) as p, unnest([{", ".join(_ZONE_WEIGHTS)}]) as x from j),
       m as (select field_id, k, median(x) as mx, avg(x) as ax, stddev_pop(x) as sx from x group by 1, 2), d as (select field_id, k, median(abs(x - mx)) as dx from x join m using (field_id, k) group by 1, 2),
       z as (select field_id, cell_id, round(sum(p * case when dx > 1e-9 then 0.6745e0 * (x - mx) / dx when sx > 1e-9 then (x - ax) / sx else 0 end) + 1e-12, 9) as score from x join m using (field_id, k) join d using (field_id, k) group by 1, 2),
       t as (select field_id, quantile_cont(score, 0.33333) as a, quantile_cont(score, 0.66666) as b from z group by 1 having count(*) >= 6), r as (select field_id, cell_id, score, case when score <= a then 'low' when score <= b then 'medium' else 'high' end as zone, greatest(0.75e0, least(1.25e0, 1 + 0.12e0 * score)) as raw from z join t using (field_id)),
       y as (select field_id, round(avg(yield_kg_ha), 3) as baseline, count(*) / 20e0 as sure from yield_obs group by 1), s as (select field_id, sum(w) as total, sum(raw * w) / sum(w) as mean from r join j using (field_id, cell_id) group by 1),
       o as (select field_id, cell_id, score, zone, raw / case when baseline > 0 then greatest(mean, 1e-6) else 1 end as multiplier, w / total as share, round(area_m2 * (w / total) + 1e-7, 4) as cell_area_m2, case when baseline > 0 then round(baseline * (raw / greatest(mean, 1e-6)) + 1e-7, 4) end as predicted,
         greatest(0.42e0, least(0.92e0, case when baseline > 0 then sure else 0.58e0 end)) as confidence from r join j using (field_id, cell_id) join s using (field_id) left join y using (field_id))"""
register(
    "w14_zone_cells",
    lambda v: _zone_cells(v).select("field_id", "cell_id", "score", "zone", "multiplier", "cell_area_m2", "predicted", "confidence"),
    f"with {_ZONES} select field_id, cell_id, score, zone, multiplier, cell_area_m2, predicted, confidence from o",
    "score multiplier cell_area_m2 predicted confidence",
    digits=9,
)
register(
    "w14_zone_summary",
    lambda v: scoring.zone_summary(_zone_cells(v)),
    f"with {_ZONES} select field_id, zone, count(*) as cells, round(sum(cell_area_m2) + 1e-6, 3) as area_m2, round(sum(share) * 100 + 1e-10, 7) as area_share_pct, round(avg(score) + 1e-10, 7) as mean_score, round(avg(multiplier) + 1e-10, 7) as multiplier, round(avg(predicted) + 1e-10, 7) as predicted, max(confidence) as confidence from o group by 1, 2",
    "area_m2 area_share_pct mean_score multiplier predicted confidence",
    digits=9,
)
register(
    "l6_label_queue_all",
    lambda v: relational.ranked(v("label_versions").select("label_task_id", "version_no", "size"), [F.desc_nulls_last("size"), F.desc_nulls_last("version_no"), F.asc_nulls_last("label_task_id")]),
    "select label_task_id, version_no, size, row_number() over (order by size desc nulls last, version_no desc nulls last, label_task_id nulls last) as rank from label_versions",
)
register(
    "u3_time_windows_all",
    lambda v: generators.time_windows(v("yield_obs").groupBy("field_id").agg(F.min("observed_on").alias("first_day"), F.max("observed_on").alias("last_day")), "field_id", 7, (10, 15, 4, 20)).select("field_id", "slice", "first_day", "last_day"),
    """with g as (select field_id, min(observed_on) as a, max(observed_on) as b from yield_obs group by 1), d as (select field_id, unnest(generate_series(a, b, interval 1 day))::date as day from g),
       s as (select * from d where month(day) * 100 + day(day) >= 1015 or month(day) * 100 + day(day) <= 420), i as (select *, row_number() over (partition by field_id order by day) - 1 as i, count(*) over (partition by field_id) as n from s),
       k as (select field_id, day, max(x)::int as slice from i join range(7) as r(x) on x < least(7, n) and (x * n) // least(7, n) <= i group by 1, 2),
       p as (select *, day - row_number() over (partition by field_id, slice order by day)::int as island from k) select field_id, slice, min(day) as first_day, max(day) as last_day from p group by field_id, slice, island""",
)
register(
    "j21_interval_fallback_all",
    lambda v: scoring.with_interval(v("yield_obs").join(v("field_seasons").select(c("season_id").alias("obs_id"), "crop_code"), "obs_id").select("obs_id", "crop_code", F.when(c("obs_id") % 2 == 0, "lat_48_55").otherwise("none").alias("region"), c("yield_kg_ha").alias("estimate")), scoring.interval_buckets(scoring.residual_buckets(_residuals(v)), ["crop_code", "region"]), "estimate").select("obs_id", "width", "method", "lower", "upper"),
    f"""with {_M6}, x as (select obs_id, crop_code, case when obs_id % 2 = 0 then 'lat_48_55' else 'none' end as region, yield_kg_ha as e from yield_obs join field_seasons on obs_id = season_id),
       y as (select obs_id, e, coalesce(a.width, b.width * 1.15e0, greatest(e * 0.2e0 * 1.645e0, 250)) as width, case when a.width is not null then 'conformal' when b.width is not null then 'conformal_global_fallback' else 'heuristic' end as method from x left join ee a on x.crop_code = a.crop_code and x.region = a.region and a.n >= 5 left join ee b on x.crop_code = b.crop_code and b.region = 'global' and b.n >= 5)
       select obs_id, width, method, greatest(e - width, 0) as lower, e + width as upper from y""",
    "width lower upper",
    digits=4,
)
register(
    "s18_replace_slice_all",
    lambda v: relational.replace_slice(v("weather_daily").select("field_id", "observed_on", "precip"), v("weather_fallback").select("field_id", "observed_on", "precip"), ["field_id"], "observed_on", "1997-01-01", "1997-12-31"),
    "with n as (select field_id, observed_on, precip from weather_fallback) select field_id, observed_on, precip from weather_daily where not (field_id in (select field_id from n) and observed_on between date '1997-01-01' and date '1997-12-31') union all select * from n",
    "precip",
)
for _name in ("l6_label_queue", "u3_time_windows", "j21_interval_fallback", "s18_replace_slice"):
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"]

# --- one field's cells, yield factors, suitability, candidate scores ------------------------------

register(
    "j6_cells_of_one_field",
    lambda v: relational.cells_of(v("grid_cells"), v("fields"), v("fields").agg(F.max_by("field_id", F.struct("area_m2", "field_id")).alias("field_id"))).select("field_id", "cell_id", "zoom_level", "ndvi_mean"),
    """with f as (select * from fields order by area_m2 desc, field_id desc limit 1)
       select f.field_id, cell_id, zoom_level, ndvi_mean from grid_cells g cross join f where g.minx < f.maxx and g.maxx > f.minx and g.miny < f.maxy and g.maxy > f.miny""",
    "ndvi_mean",
)
register(
    "a17_soil_factor",
    lambda v: v("soil_profiles").select("profile_id", su.soil_factor(F.when(c("profile_id") % 5 > 0, c("profile_id") % 90 / 10.0), F.when(c("profile_id") % 3 > 0, c("ph")), F.when(c("profile_id") % 7 > 0, ag.texture_code(c("texture"))), F.when(c("profile_id") % 2 == 0, ag.nutrient_response(c("n_ppm").cast("double"), 5, 25, 45, 55, 0.5, 1.1, 0.8, 0.4))).alias("factor")),
    """with x as (select profile_id, case when profile_id % 5 > 0 then profile_id % 90 / 10e0 end as o, case when profile_id % 3 > 0 then ph end as ph, case when profile_id % 7 > 0 then texture end as texture, case when profile_id % 2 = 0 then n_ppm end as n from soil_profiles),
       t as (select profile_id, unnest([case when o is null then null when o <= 0.3 then 0.55e0 when o <= 2.5 then 0.55e0 + (1 - exp(-3 * (o - 0.3e0) / 2.2e0)) * 0.53e0 when o <= 5.5 then 1.08e0 when o <= 8 then 1.08e0 - (o - 5.5e0) / 2.5e0 * 0.06e0 else greatest(0.95e0, 1.02e0 - least((o - 8) / 8e0, 1) * 0.07e0) end,
           case when ph is null then null when ph < 5 then greatest(0.35e0, least(0.8e0, 0.35e0 + (ph - 4) * 0.45e0)) when ph < 6 then 0.8e0 + (ph - 5) * 0.25e0 when ph <= 7.2 then 1.05e0 when ph <= 8 then 1.05e0 - (ph - 7.2e0) * 0.19e0 else greatest(0.4e0, least(0.9e0, 0.9e0 - (ph - 8) * 0.35e0)) end,
           case when texture = 'sand' then 0.82e0 when texture = 'loam' then 1.05e0 when texture = 'clay' then 0.85e0 end,
           case when n is null then null when n <= 5 then 0.5e0 when n <= 25 then 0.5e0 + (1 - exp(-3 * (n - 5) / 20e0)) * 0.6e0 when n <= 45 then 1.1e0 when n <= 55 then 1.1e0 - (n - 45) / 10e0 * 0.3e0 else greatest(0.4e0, 0.8e0 - least((n - 55) / 55e0, 1) * 0.4e0) end]) as f from x where true)
       select profile_id, case when min(f) is null then 1 else greatest(0.35e0, least(1.1e0, min(f))) end as factor from t group by 1""",
    "factor",
    digits=9,
)
register(
    "a17_growth_factors",
    lambda v: v("grid_cells").select(
        "cell_id", su.radiation_factor(c("cell_id") % 300 / 10.0).alias("radiation"), su.wind_factor(F.when(c("cell_id") % 9 > 0, c("cell_id") % 400 / 10.0)).alias("wind"), su.nitrogen_status(c("bsi_mean") + 0.4).alias("nitrogen"),
        su.area_shape_factor(F.when(c("cell_id") % 8 > 0, c("cell_id") % 700 / 10.0), F.when(c("cell_id") % 6 > 0, c("field_coverage"))).alias("shape"),
        su.vegetation_factor(F.when(c("cell_id") % 3 > 0, c("ndvi_mean")), F.when(c("cell_id") % 4 > 0, c("ndmi_mean")), F.when(c("cell_id") % 5 > 0, c("bsi_mean") + 0.4), F.when(c("cell_id") % 2 > 0, c("cell_id") % 400 / 10.0), F.when(c("cell_id") % 7 > 0, c("field_coverage")), F.when(c("cell_id") % 11 > 5, c("soil_moist")), F.lit(0.72)).alias("vegetation"),
    ),
    """with x as (select *, cell_id % 300 / 10e0 as s, case when cell_id % 9 > 0 then cell_id % 400 / 10e0 end as w, bsi_mean + 0.4e0 as e, case when cell_id % 3 > 0 then ndvi_mean end as v, case when cell_id % 4 > 0 then ndmi_mean end as m,
           case when cell_id % 2 > 0 and cell_id % 400 > 0 then cell_id % 400 / 10e0 end as a, case when cell_id % 7 > 0 then field_coverage end as p, cell_id % 5 > 0 as has_e, coalesce(cell_id % 11 > 5 and soil_moist > 0, false) as has_n from grid_cells),
       y as (select *, case when e < 0.1 then 0.55e0 when e < 0.2 then 0.55e0 + (e - 0.1e0) * 2.3e0 when e < 0.35 then 0.78e0 + (e - 0.2e0) / 0.15e0 * 0.19e0 when e <= 0.5 then 0.97e0 + (e - 0.35e0) / 0.15e0 * 0.08e0 else greatest(0.9e0, 1.05e0 - (e - 0.5e0) * 0.25e0) end as nitrogen,
           case when v < 0.15 then 0.3e0 when v < 0.35 then 0.3e0 + (v - 0.15e0) / 0.2e0 * 0.4e0 when v <= 0.72 then 0.7e0 + (v - 0.35e0) / 0.37e0 * 0.38e0 when v <= 0.87 then 1.08e0 when v > 0.87 then greatest(0.85e0, 1.08e0 - (v - 0.87e0)) end as fv,
           case when m < -0.3 then 0.5e0 when m < 0 then 0.5e0 + (m + 0.3e0) / 0.3e0 * 0.4e0 when m <= 0.4 then 0.9e0 + m / 0.4e0 * 0.15e0 when m <= 0.55 then 1.05e0 when m > 0.55 then greatest(0.55e0, 1.05e0 - (m - 0.55e0) * 1.5e0) end as fm,
           case when a < 4 then 0.4e0 when a < 8 then 0.4e0 + (a - 4) / 4 * 0.35e0 when a < 14 then 0.75e0 + (a - 8) / 6 * 0.33e0 when a <= 20 then 1.08e0 when a > 20 then greatest(0.9e0, 1.08e0 - (a - 20) / 10 * 0.1e0) end as fa,
           case when p < 0.4 then 0.5e0 when p < 0.72 then 0.5e0 + (p - 0.4e0) / 0.32e0 * 0.55e0 when p >= 0.72 then 1.05e0 end as fp from x),
       z as (select *, case when fa is not null and fv is not null and fm is not null then fa * 0.4e0 + fv * 0.35e0 + fm * 0.2e0 + coalesce(fp, fa) * 0.05e0 when fa is not null and coalesce(fv, fm) is not null then fa * 0.45e0 + coalesce(fv, fm) * 0.45e0 + coalesce(fp, fa) * 0.1e0
           when fa is not null then fa * 0.85e0 + coalesce(fp, fa) * 0.15e0 when fv is not null and fm is not null then fv * 0.7e0 + fm * 0.3e0 else coalesce(fv, fm, 1) end as g, case when not has_e then 0 when has_n then 0.09e0 else 0.17e0 end as k from y)
       select cell_id, case when s <= 0 then 0.8e0 when s < 5 then 0.5e0 + s / 5 * 0.3e0 when s < 10 then 0.8e0 + (s - 5) / 5 * 0.15e0 when s < 16 then 0.95e0 + (s - 10) / 6 * 0.07e0 when s <= 22 then 1.02e0 else greatest(0.9e0, 1.02e0 - (s - 22) * 0.02e0) end as radiation,
         case when w is null or w <= 5 then 1 when w <= 10 then 1 - (w - 5) / 5 * 0.08e0 when w <= 15 then 0.92e0 - (w - 10) / 5 * 0.18e0 else greatest(0.35e0, 0.74e0 - (w - 15) / 10 * 0.24e0) end as wind, nitrogen,
         greatest(0.76e0, least(1, (0.85e0 + least(case when cell_id % 8 > 0 then cell_id % 700 / 10e0 else 1 end, 50) / 50 * 0.15e0) * least(1, 0.88e0 + case when cell_id % 6 > 0 then field_coverage else 0.65e0 end * 0.12e0))) as shape,
         greatest(0.25e0, least(1.15e0, g * (1 - k) + nitrogen * k)) as vegetation from z""",
    "radiation wind nitrogen shape vegetation",
    digits=12,
)


def _suitability(v):
    # added up in order of rows: limits are compared with sums of doubles, whose last bits vary with the order
    season = series.in_order(v("weather_daily").withColumn("season_year", F.year("observed_on")), ["field_id", "season_year"], "row_id", heat=F.sum("gdd"), rain=F.sum("precip"), temperature=F.avg("tmean"), days=F.count("*"))
    season = season.withColumns({"heat": c("heat") * 30, "rain": c("rain") * 20})
    crops = series.latest(v("field_seasons"), ["field_id", "season_year"], [F.desc("assigned_at"), F.desc("season_id")]).select("field_id", "season_year", "crop_code")
    both = crops.join(season, ["field_id", "season_year"]).join(v("fields").select("field_id", "miny"), "field_id")
    found = both.select("field_id", "season_year", "crop_code", su.crop_suitability(c("crop_code"), c("miny") + c("field_id") % 20 + 1 / 13, F.when(c("field_id") % 6 > 0, c("heat")), c("rain"), c("temperature"), c("days") >= 2).alias("s"))
    return found.select("field_id", "season_year", "crop_code", "s.score", "s.status", "s.yield_factor", F.array_join("s.reasons", ",").alias("reasons"))


register(
    "a18_crop_suitability",
    _suitability,
    """with w as (select field_id, year(observed_on) as season_year, sum(gdd) * 30 as heat, sum(precip) * 20 as r, avg(tmean) as t, count(*) >= 2 as ok from weather_daily group by 1, 2),
       k as (select * from field_seasons qualify row_number() over (partition by field_id, season_year order by assigned_at desc, season_id desc) = 1),
       p(crop, warm, ls, lh, g1, g2, p1, p2, p3) as (values ('corn', true, 55e0, 60e0, 1500e0, 2200e0, 220e0, 420e0, 780e0), ('soy', true, 54e0, 58e0, 1650e0, 2300e0, 240e0, 430e0, 760e0), ('barley', false, 65e0, 69e0, 850e0, 1350e0, 160e0, 320e0, 700e0), ('wheat', false, 61e0, 67e0, 950e0, 1600e0, 170e0, 340e0, 720e0), ('sunflower', false, 61e0, 67e0, 950e0, 1600e0, 170e0, 340e0, 720e0)),
       x as (select k.field_id, k.season_year::int as season_year, crop_code, abs(miny + k.field_id % 20 + 1 / 13e0) as lat, case when k.field_id % 6 > 0 then heat end as g, r, t, ok, p.* from k join w using (field_id, season_year) join fields f on f.field_id = k.field_id join p on crop = crop_code),
       y as (select *, case when lat > lh then 0.18e0 when lat > ls then greatest(0.4e0, 0.85e0 - (lat - ls) / (lh - ls) * 0.45e0) else 1 end as a,
           case when not ok then 1 when g > 0 and g < g1 then greatest(0.2e0, least(0.8e0, 0.25e0 + g / g1 * 0.55e0)) when g > 0 and g < g2 then 0.88e0 + (g - g1) / (g2 - g1) * 0.12e0 when g > g2 * 1.35e0 then 0.92e0 when g > 0 or not warm then 1 else 0.8e0 end as b,
           case when not ok or coalesce(r, 0) <= 0 then 1 when r < p1 then greatest(0.45e0, 0.92e0 - (p1 - r) / p1 * 0.4e0) when r > p3 then greatest(0.5e0, 0.95e0 - (r - p3) / p3 * 0.3e0) when r < p2 then 0.92e0 + (r - p1) / (p2 - p1) * 0.08e0 else 1 end as d, case when ok and warm and t < 11 then 0.75e0 else 1 end as e from x)
       select field_id, season_year, crop_code, round(a * b * d * e + 1e-9, 4) as score, case when a * b * d * e >= 0.82 then 'high' when a * b * d * e >= 0.62 then 'moderate' when a * b * d * e >= 0.35 then 'low' else 'unsuitable' end as status, round(greatest(0.2e0, least(1.05e0, 0.35e0 + a * b * d * e * 0.7e0)) + 1e-9, 4) as yield_factor,
         concat_ws(',', case when lat > lh then 'latitude_out_of_range' when lat > ls then 'latitude_penalty' end, case when not ok then null when g > 0 and g < g1 then 'gdd_deficit' when g > g2 * 1.35e0 then 'gdd_excess' when coalesce(g, 0) <= 0 and warm then 'gdd_missing' end,
           case when not ok or coalesce(r, 0) <= 0 then null when r < p1 then 'precipitation_deficit' when r > p3 then 'precipitation_excess' end, case when ok and warm and t < 11 then 'temperature_deficit' end, case when not ok and coalesce(g, r, t) is not null then 'seasonal_window_incomplete' end) as reasons from y""",
    "score yield_factor",
    digits=4,
)
register(
    "m9_candidate_score",
    lambda v: v("grid_cells").select("cell_id", su.candidate_score({"area_px": c("cell_id") % 13, "boundary_closure_ratio": c("field_coverage"), "edge_p90": c("soil_moist"), "ndvi_delta_mean": c("ndmi_mean"), "worldcover_cropland_frac": F.when(c("cell_id") % 4 > 0, c("ndvi_mean")), "compactness": c("ndvi_mean") * 1.3, "agreement_branch_count": c("zoom_level"), "road_overlap_ratio": c("soil_moist"), "hole_ratio": F.abs("bsi_mean")}).alias("score")),
    """select cell_id, case when cell_id % 13 = 0 then 0 else greatest(0, least(1, (25 * field_coverage + least(100 * soil_moist, 20) + greatest(0, 50 * ndmi_mean + 5) + 15 * case when cell_id % 4 > 0 then ndvi_mean else 0.5e0 end + least(13 * ndvi_mean, 10) + least(5 * zoom_level, 10)
         - 15 * soil_moist - 8 * abs(bsi_mean)) / 100e0)) end as score from grid_cells""",
    "score",
)

# further queries register themselves in the same tables
from fieldspark.plans import mosaics, reports, rollups, shapes  # noqa: E402, F401
