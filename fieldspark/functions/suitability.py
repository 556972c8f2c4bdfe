"""Yield factors and crop suitability (A17, A18), candidate scores (M9) and reject rules.

Most factors are broken lines: a table of (x, factor) corners, flat outside.
A null input gives a null term, and factors without any term are 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.agronomy import nutrient_availability, nutrient_response
from fieldspark.functions.weather import clip

# Corners of the response lines.
RADIATION = ((0.0, 0.5), (5.0, 0.8), (10.0, 0.95), (16.0, 1.02), (22.0, 1.02), (28.0, 0.9))
NITROGEN = ((0.1, 0.55), (0.2, 0.78), (0.35, 0.97), (0.5, 1.05), (1.1, 0.9))
WIND = ((5.0, 1.0), (10.0, 0.92), (15.0, 0.74), (31.25, 0.35))
AUC = ((4.0, 0.4), (8.0, 0.75), (14.0, 1.08), (20.0, 1.08), (38.0, 0.9))
NDMI = ((-0.3, 0.5), (0.0, 0.9), (0.4, 1.05), (0.55, 1.05), (0.55 + 0.5 / 1.5, 0.55))
PH = ((4.0, 0.35), (5.0, 0.8), (6.0, 1.05), (7.2, 1.05), (8.0, 1.05 - 0.8 * 0.19))
# Fixed values by crop group: family, latitude (soft, hard), heat (least, best), rain (least, best, high).
SUITABILITY = {
    ("corn", "maize", "кукуруза"): ("warm_season", 55.0, 60.0, 1500.0, 2200.0, 220.0, 420.0, 780.0),
    ("soy", "soybean", "соя"): ("warm_season", 54.0, 58.0, 1650.0, 2300.0, 240.0, 430.0, 760.0),
    ("barley", "ячмень", "oats", "овес"): ("cool_season", 65.0, 69.0, 850.0, 1350.0, 160.0, 320.0, 700.0),
    ("rapeseed", "canola", "рапс"): ("temperate_oilseed", 61.0, 66.0, 1050.0, 1650.0, 200.0, 360.0, 720.0),
}
OTHER_GRAIN = ("temperate_grain", 61.0, 67.0, 950.0, 1600.0, 170.0, 340.0, 720.0)
_PROFILE = ("family", "lat_soft", "lat_hard", "heat_least", "heat_best", "rain_least", "rain_best", "rain_high")


def broken_line(x: Column, corners) -> Column:
    """Linear between the corners' values, flat before the first and after the last."""
    out = F.when(x.isNull(), None).when(x <= corners[0][0], F.lit(float(corners[0][1])))
    for (a, y), (b, z) in zip(corners, corners[1:], strict=False):
        out = out.when(x <= b, y + (x - a) * ((z - y) / (b - a)))
    return out.otherwise(F.lit(float(corners[-1][1])))


def area_shape_factor(area_ha: Column, compactness: Column) -> Column:
    area = F.coalesce(area_ha, F.lit(1.0))
    shape = F.coalesce(compactness, F.lit(0.65))
    return clip(clip(0.85 + F.least(area, F.lit(50.0)) * 0.003, 0.85, 1.0) * clip(0.88 + shape * 0.12, 0.88, 1.0), 0.76, 1.0)


def radiation_factor(solar: Column) -> Column:
    return F.when(solar <= 0, 0.8).otherwise(broken_line(solar, RADIATION))


def nitrogen_status(ndre: Column) -> Column:
    return broken_line(ndre, NITROGEN)


def wind_factor(speed: Column) -> Column:
    return F.coalesce(broken_line(speed, WIND), F.lit(1.0))


def soil_factor(organic: Column, ph: Column, texture_code: Column, *nutrients: Column) -> Column:
    """The least of the terms that are known, as the scarcest input limits; ``nutrients`` are responses."""
    acid = F.when(ph > 8, clip(0.9 - (ph - 8) * 0.35, 0.4, 0.9)).otherwise(broken_line(ph, PH))
    available = nutrient_availability(texture_code)
    terms = [F.when(organic.isNotNull(), nutrient_response(organic, 0.3, 2.5, 5.5, 8.0, 0.55, 1.08, 1.02, 0.95)), acid, *nutrients, F.when(available != 1.0, available)]
    return F.coalesce(clip(F.array_min(F.array(*terms)), 0.35, 1.1), F.lit(1.0))


def vegetation_factor(ndvi: Column, ndmi: Column, ndre: Column, auc: Column, peak: Column, soil_n: Column, target: Column) -> Column:
    """A weighted mean of what is known of NDVI, NDMI, season area and peak, then of nitrogen status."""
    goal = F.greatest(F.coalesce(target, F.lit(0.68)), F.lit(0.3))
    now = (
        F.when(ndvi < 0.15, 0.3)
        .when(ndvi < 0.35, 0.3 + (ndvi - 0.15) * 2)
        .when(ndvi <= goal, 0.7 + (ndvi - 0.35) / F.greatest(goal - 0.35, F.lit(0.01)) * 0.38)
        .when(ndvi.isNotNull(), clip(1.08 - F.greatest(ndvi - goal - 0.15, F.lit(0.0)), 0.85, 1.08))
    )
    water = broken_line(ndmi, NDMI)
    season = F.when(auc > 0, F.when(auc < 4, 0.4).otherwise(broken_line(auc, AUC)))
    top = F.when(peak < 0.4, 0.5).when(peak < goal, 0.5 + (peak - 0.4) / F.greatest(goal - 0.4, F.lit(0.01)) * 0.55).when(peak.isNotNull(), 1.05)
    named = {"now": now, "water": water, "season": season, "top": F.coalesce(top, season), "nitrogen": nitrogen_status(ndre), "share": F.when(ndre.isNull(), 0.0).when(soil_n > 0, 0.09).otherwise(0.17)}
    # bound once, as the mix refers to each term several times
    return F.element_at(F.transform(F.array(F.struct(*(x.alias(k) for k, x in named.items()))), _mixed), 1)


def _mixed(term: Column) -> Column:
    now, water, season, top, share = (term[k] for k in ("now", "water", "season", "top", "share"))
    one = F.coalesce(now, water)
    mixed = (
        F.when(season.isNotNull() & now.isNotNull() & water.isNotNull(), season * 0.4 + now * 0.35 + water * 0.2 + top * 0.05)
        .when(season.isNotNull() & one.isNotNull(), season * 0.45 + one * 0.45 + top * 0.1)
        .when(season.isNotNull(), season * 0.85 + top * 0.15)
        .otherwise(F.coalesce(now * 0.7 + water * 0.3, one, F.lit(1.0)))
    )
    return clip(mixed * (1 - share) + F.coalesce(term["nitrogen"], F.lit(0.0)) * share, 0.25, 1.15)


def suitability_profile(crop: Column) -> Column:
    """A18's struct of thresholds for a crop code."""

    def made(values):
        return F.struct(*(F.lit(v).alias(k) for k, v in zip(_PROFILE, values, strict=True)))

    name, out = F.lower(F.trim(F.coalesce(crop, F.lit("")))), None
    for names, values in SUITABILITY.items():
        out = (out.when if out is not None else F.when)(name.isin(*names), made(values))
    return out.otherwise(made(OTHER_GRAIN))


def crop_suitability(crop: Column, latitude: Column, heat: Column, rain: Column, temperature: Column, settled: Column) -> Column:
    """struct(score, status, yield_factor, reasons).

    ``settled`` says that the season's sums can be relied on; else only the
    latitude counts, and the reason is named if there are any sums.
    """
    p = suitability_profile(crop)
    lat, warm = F.abs(latitude), p["family"] == "warm_season"
    beyond = (lat - p["lat_soft"]) / (p["lat_hard"] - p["lat_soft"])
    # each rule: (condition, factor, reason or None); of a group, the first that holds
    groups = [
        [(lat > p["lat_hard"], F.lit(0.18), "latitude_out_of_range"), (lat > p["lat_soft"], clip(0.85 - beyond * 0.45, 0.4, 0.85), "latitude_penalty")],
        [
            (settled & (heat > 0) & (heat < p["heat_least"]), clip(0.25 + heat / p["heat_least"] * 0.55, 0.2, 0.8), "gdd_deficit"),
            (settled & (heat > 0) & (heat < p["heat_best"]), clip(0.88 + (heat - p["heat_least"]) / (p["heat_best"] - p["heat_least"]) * 0.12, 0.88, 1.0), None),
            (settled & (heat > p["heat_best"] * 1.35), F.lit(0.92), "gdd_excess"),
            (settled & ~F.coalesce(heat > 0, F.lit(False)) & warm, F.lit(0.8), "gdd_missing"),
        ],
        [
            (settled & (rain > 0) & (rain < p["rain_least"]), clip(0.92 - (p["rain_least"] - rain) / p["rain_least"] * 0.4, 0.45, 0.92), "precipitation_deficit"),
            (settled & (rain > p["rain_high"]), clip(0.95 - (rain - p["rain_high"]) / p["rain_high"] * 0.3, 0.5, 0.95), "precipitation_excess"),
            (settled & (rain > 0) & (rain < p["rain_best"]), clip(0.92 + (rain - p["rain_least"]) / (p["rain_best"] - p["rain_least"]) * 0.08, 0.92, 1.0), None),
        ],
        [(settled & warm & (temperature < 11), F.lit(0.75), "temperature_deficit")],
        [(~settled & F.coalesce(heat, rain, temperature).isNotNull(), F.lit(1.0), "seasonal_window_incomplete")],
    ]
    factors, reasons = [], []
    for rules in groups:
        factor, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], F.lit(rules[0][2]))
        for holds, value, name in rules[1:]:
            factor, reason = factor.when(holds, value), reason.when(holds, F.lit(name))
        factors.append(factor.otherwise(1.0))
        reasons.append(reason)
    score = factors[0] * factors[1] * factors[2] * factors[3]
    status = F.when(score >= 0.82, "high").when(score >= 0.62, "moderate").when(score >= 0.35, "low").otherwise("unsuitable")
    return F.struct(F.round(score + 1e-9, 4).alias("score"), status.alias("status"), F.round(clip(0.35 + score * 0.7, 0.2, 1.05) + 1e-9, 4).alias("yield_factor"), F.array_compact(F.array(*reasons)).alias("reasons"))


# Weight, cap and default of each feature of a candidate's score.
CANDIDATE_POINTS = (("boundary_closure_ratio", 25.0, None, 0.0), ("edge_p90", 100.0, 20.0, 0.0), ("worldcover_cropland_frac", 15.0, None, 0.5), ("compactness", 10.0, 10.0, 0.0), ("agreement_branch_count", 5.0, 10.0, 0.0))
CANDIDATE_PENALTIES = (("road_overlap_ratio", 15.0), ("worldcover_noncrop_frac", 12.0), ("hole_ratio", 8.0))


def candidate_score(feature: dict[str, Column]) -> Column:
    """M9: points of a candidate's features out of 100, 0 for an empty one; absent or null features have defaults."""

    def value(name, other):
        return F.coalesce(feature[name].cast("double"), F.lit(other)) if name in feature else F.lit(other)

    points = F.greatest(F.lit(0.0), value("ndvi_delta_mean", 0.0) * 50 + 5)
    for name, weight, cap, other in CANDIDATE_POINTS:
        part = value(name, other) * weight
        points = points + (F.least(part, F.lit(cap)) if cap else part)
    for name, weight in CANDIDATE_PENALTIES:
        points = points - value(name, 0.0) * weight
    return F.when(value("area_px", 0.0) == 0, 0.0).otherwise(clip(points / 100, 0.0, 1.0))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, or null."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for holds, name in rules[1:]:
        out = out.when(holds, F.lit(name))
    return out


def segment_reject(area: Column, delta: Column, ndwi: Column, shape: Column, least_area: float = 4, least_delta: float = 0.05, most_ndwi: float = 0.2, most_shape: float = 1.2) -> Column:
    """Why a segment goes, or null."""
    return first_reason((area < least_area, "area"), (delta < least_delta, "delta"), (ndwi > most_ndwi, "water"), (shape > most_shape, "shape"))


def land_cover_class(n: Column, ndvi_min: Column, ndvi_max: Column, ndwi_max: Column, least: int = 4) -> Column:
    """1 water, 2 bare, 3 evergreen, 4 field, 5 other, in this order; 0 with too few valid dates."""
    return F.when(n < least, 0).when(ndwi_max > 0.1, 1).when(ndvi_max < 0.2, 2).when(ndvi_min > 0.5, 3).when(ndvi_max - ndvi_min > 0.3, 4).otherwise(5)


def proposal_reject(area: Column, water: Column, ndvi_mean: Column, ndvi_std: Column) -> Column:
    """Why a proposal goes, or null."""
    return first_reason((area < 6, "area"), (water > 0.3, "water"), (ndvi_mean < 0.4, "ndvi"), (ndvi_std > 0.2, "std"))


# Corners of water and weather stress.
SOIL_WATER = ((0.05, 0.2), (0.1, 0.55), (0.18, 0.95), (0.35, 1.05), (0.48, 0.6), (0.705, 0.15))
VPD_STRESS = ((0.3, 0.85), (0.5, 1.0), (2.0, 1.0), (3.5, 0.82), (6.1, 0.3))
RAIN_STRESS = ((2.0, 0.65), (5.0, 0.9), (25.0, 1.02), (50.0, 0.8), (100.0, 0.5), (240.0, 0.15))
# Zero, best, toxic, lethal amount; factors at none, best, toxic, lethal.
IRRIGATION = (0.0, 8.0, 20.0, 35.0, 0.80, 1.08, 0.85, 0.60)
FERTILIZER = (0.0, 10.0, 25.0, 40.0, 0.75, 1.12, 0.78, 0.50)
PESTICIDE = (0.0, 5.0, 15.0, 25.0, 0.85, 1.05, 0.82, 0.60)
ALL_EVENTS = (0.0, 10.0, 30.0, 50.0, 0.70, 1.10, 0.80, 0.55)


def hydro_factor(soil_water: Column, vpd: Column, rain: Column) -> Column:
    """The worst of the water terms that are known."""
    terms = F.array(broken_line(soil_water, SOIL_WATER), broken_line(vpd, VPD_STRESS), broken_line(rain, RAIN_STRESS))
    return F.coalesce(clip(F.array_min(terms), 0.15, 1.08), F.lit(1.0))


def management_factor(total: Column, irrigation: Column, fertilizer: Column, pesticide: Column) -> Column:
    """Geometric mean of the responses to the amounts by type; without any of those, the response to the total over 20."""
    typed = [F.when(x.isNotNull(), nutrient_response(x, *k)) for x, k in ((irrigation, IRRIGATION), (fertilizer, FERTILIZER), (pesticide, PESTICIDE))]
    known = sum((t.isNotNull().cast("int") for t in typed), F.lit(0))
    logs = sum((F.coalesce(F.ln(t), F.lit(0.0)) for t in typed), F.lit(0.0))
    return F.when(known > 0, clip(F.exp(logs / known), 0.45, 1.12)).when(total.isNotNull(), nutrient_response(total / 20, *ALL_EVENTS)).otherwise(1.0)


def interaction_penalty(soil_water: Column, vpd: Column, soil_n: Column, fertilizer_pct: Column, irrigation_pct: Column) -> Column:
    """Stresses that make each other worse: salt on dry soil, nitrogen washed out of wet soil, dry air over dry soil, water on wet soil."""
    more = F.greatest(fertilizer_pct, F.lit(0.0))
    salt = clip(1 - F.least((35 - F.least(soil_water, F.lit(0.12)) * 100) / 35, F.lit(1.0)) * (more / 50) * 0.3, 0.55, 1.0)
    surplus = more / 100 + F.coalesce(F.greatest(soil_n - 30, F.lit(0.0)) / 30, F.lit(0.0))
    washed = clip(1 - (soil_water - 0.4) / 0.2 * surplus * 0.25, 0.6, 1.0)
    air = clip(1 - (vpd - 2) / 2 * ((0.18 - soil_water) / 0.15) * 0.2, 0.55, 1.0)
    flooded = clip(1 - (irrigation_pct - 20) / 80 * 0.18, 0.75, 1.0)
    rules = [
        ((soil_water < 0.12) & ((fertilizer_pct > 15) | F.coalesce(soil_n > 35, F.lit(False))), salt),
        (soil_water > 0.4, washed),
        ((vpd > 2) & (soil_water < 0.18), air),
        ((soil_water > 0.35) & (irrigation_pct > 20), flooded),
    ]
    out = F.lit(1.0)
    for holds, factor in rules:
        out = out * F.when(holds, factor).otherwise(1.0)
    return clip(out, 0.4, 1.0)


def baseline_estimate(baseline: Column, combined: Column, history: Column, seasons: Column, years_ago: Column) -> Column:
    """M2: the crop's baseline times the combined factor (A19), drawn to the field's own mean yield.

    The pull is at most a quarter, less with few seasons and old ones; unknown
    counts are one season and three years.  Null without a baseline.
    """
    plain = baseline * combined
    known = F.when(seasons > 0, seasons).otherwise(1)
    pull = 0.25 * F.exp(-0.3 * F.greatest(F.coalesce(years_ago, F.lit(3)), F.lit(0))) * F.least(known / 3, F.lit(1.0))
    return F.round(F.greatest(F.lit(0.0), F.when(history.isNull(), plain).otherwise(plain * (1 - pull) + history * pull)), 2)
