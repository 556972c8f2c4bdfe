"""Time-series operators over window functions (W) and seasonal state (Q5, Q6, Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspark.functions import agronomy, weather


def smoothed(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Centred mean of three, shrinking at the ends; series up to two points stay."""
    w = Window.partitionBy(*keys)
    mean = F.avg(value).over(w.orderBy(order).rowsBetween(-1, 1))
    return df.withColumn("smoothed", F.when(F.count("*").over(w) <= 2, F.col(value)).otherwise(mean))


def cumulative(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum; null adds nothing."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w))


def area_under_curve(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Trapezoid area in weeks, peak, mean and count; the area of one point is null."""
    w = Window.partitionBy(*keys).orderBy(day)
    part = (F.col(value) + F.lag(value).over(w)) / 2 * F.datediff(F.col(day), F.lag(day).over(w)) / 7
    return df.withColumn("_part", part).groupBy(*keys).agg(F.sum("_part").alias("auc"), F.max(value).alias("peak"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def robust_z(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """.6745 (x - median) / MAD; with no MAD the plain z-score, with no spread 0.

    Medians are grouped and joined back, so no partition is held for a window.
    """
    v = F.col(value)
    one = df.groupBy(*keys).agg(F.percentile(v, F.lit(0.5)).alias("_med"), F.avg(v).alias("_avg"), F.stddev_pop(v).alias("_std"))
    near = df.join(one, keys)
    mad = near.groupBy(*keys).agg(F.percentile(F.abs(v - F.col("_med")), F.lit(0.5)).alias("_mad"))
    z = F.when(F.col("_mad") > 1e-9, 0.6745 * (v - F.col("_med")) / F.col("_mad")).when(F.col("_std") > 1e-9, (v - F.col("_avg")) / F.col("_std")).otherwise(0.0)
    return near.join(mad, keys).withColumn(name, z).drop("_med", "_avg", "_std", "_mad")


def phenology(df: DataFrame, keys: list[str], day: str, value: str, norm_peak: Column | None = None) -> DataFrame:
    """Start, peak and end of season, stage and lag, from five points on."""
    w = Window.partitionBy(*keys)
    i = (F.row_number().over(w.orderBy(day)) - 1).alias("i")
    rows = df.select(*keys, day, F.col(value).alias("v"), i)
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("i", F.struct("v", -F.col("i"))).alias("peak_i"), F.max("v").alias("hi"), F.min("v").alias("lo")).where("n >= 5")
    base = base.withColumn("amplitude", F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)))
    both = rows.join(base, keys)
    start = F.min(F.when(F.col("v") >= F.col("lo") + F.col("amplitude") * 0.2, F.col("i")))
    end = F.max(F.when((F.col("v") >= F.col("lo") + F.col("amplitude") * 0.25) & (F.col("i") >= F.col("peak_i")), F.col("i")))
    found = both.groupBy(*keys).agg(start.alias("sos_i"), end.alias("eos_i"), F.max(F.when(F.col("i") == F.col("peak_i"), F.col(day))).alias("peak"), *(F.first(c).alias(c) for c in ("n", "peak_i", "amplitude", "hi")))
    found = found.withColumn("sos_i", F.coalesce("sos_i", F.lit(0))).withColumn("eos_i", F.coalesce("eos_i", F.col("n") - 1))
    now = F.col("n") - 1
    stage = F.when(now <= F.col("sos_i") + 1, "emergence").when(now < F.col("peak_i") - 1, "vegetative").when(now <= F.col("peak_i") + 1, "reproductive").when(now < F.col("eos_i"), "grain_fill").otherwise("senescence")
    norm = norm_peak if norm_peak is not None else F.lit(agronomy.OTHER_CROP[0])
    return found.select(*keys, "sos_i", "peak_i", "eos_i", "peak", "amplitude", F.col("hi").alias("peak_value"), F.greatest(F.col("eos_i") - F.col("sos_i") + 1, F.lit(1)).alias("season_weeks"), (F.col("peak_i") + 1 - norm).cast("double").alias("lag_weeks"), stage.alias("stage"))


def anomalies(ndvi: DataFrame, ndmi: DataFrame, stages: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Sharp falls of NDVI, with drought where NDMI is low, and delays in emergence.

    ``ndmi`` is matched by position in its series, as NDVI's points are counted.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    rows = ndvi.withColumn("i", F.row_number().over(w) - 1).withColumn("d", F.col(value) - F.lag(value).over(w))
    rows = robust_z(rows, keys, value, "vz")
    diffs = robust_z(rows.where("d is not null"), keys, "d", "dz").join(stages.select(*keys, "stage"), keys)
    dry = ndmi.withColumn("i", F.row_number().over(w) - 1).select(*keys, "i", F.col(value).alias("ndmi"))
    both = diffs.join(dry, [*keys, "i"], "left").withColumn("ndmi", F.coalesce("ndmi", F.lit(0.0)))
    fall = (F.col("dz") <= -1.8) & (F.col("vz") <= -1.25)
    kind = F.when(fall & (F.col("ndmi") < -0.05), "possible_drought_stress").when(fall, "rapid_canopy_loss").when((F.col("dz") >= 1.4) & (F.col("stage") == "emergence"), "delayed_development")
    severity = F.when(fall & (F.col("dz") <= -2.4), "critical").when(fall, "warning").otherwise("info")
    found = both.withColumn("kind", kind).withColumn("severity", severity).where("kind is not null")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(day)))
    before = F.lag("kind").over(Window.partitionBy(*keys).orderBy(day))
    return found.select(*keys, F.col(day), "kind", "severity", F.col("vz").alias("z_score"), F.col("dz").alias("delta_z_score"), F.coalesce((last == 1) & (before == F.col("kind")), F.lit(False)).alias("persistent"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def yield_trend(seasons: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and variation over seasons, and the mean of the last three."""
    w = Window.partitionBy(*keys).orderBy("season_year").rowsBetween(-2, 0)
    rolled = seasons.withColumn("_roll", F.avg("yield").over(w))
    return rolled.groupBy(*keys).agg(F.count("*").alias("seasons"), F.regr_slope("yield", F.col("season_year").cast("double")).alias("slope"), F.try_divide(F.stddev_pop("yield"), F.avg("yield")).alias("cv"), F.max_by("_roll", "season_year").alias("rolling_mean"))


def next_versions(items: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Version numbers that go on from the greatest there is."""
    top = existing.groupBy(key).agg(F.max("version_no").alias("_top"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return items.join(top, key, "left").withColumn("version_no", F.coalesce("_top", F.lit(0)) + rank).drop("_top")


def forecast_curve(days: DataFrame, keys: list[str], base: float, warmer: float = 0.0, extra_rain: float = 0.0) -> DataFrame:
    """Adjusted temperature and rain, daily and cumulative heat."""
    w = Window.partitionBy(*keys)
    made = days.withColumn("temp_c", F.col("tmean") + warmer).withColumn("rain_mm", F.greatest(F.coalesce("precip", F.lit(0.0)) + F.lit(extra_rain) / F.count("*").over(w), F.lit(0.0)))
    made = made.withColumn("gdd_day", F.greatest(F.coalesce(F.col("temp_c") - base, F.lit(0.0)), F.lit(0.0)))
    return made.withColumn("gdd_total", F.sum("gdd_day").over(w.orderBy("observed_on", "row_id").rowsBetween(Window.unboundedPreceding, 0)))


def water_balance(weeks: DataFrame, keys: list[str]) -> DataFrame:
    """Q5: a root-zone bucket by week, as a fold over each season's weeks in order.

    ``weeks(keys, week_start, tmean, vpd, wind, gdd, precip, solar, texture, kc)``;
    a season has at most some fifty weeks, so the folded array is small.
    """
    c = F.col
    taw, _ = agronomy.soil_capacity(c("texture"))
    temp, zero = F.coalesce("tmean", F.lit(0.0)), F.lit(0.0)
    et = weather.weekly_et(temp, F.coalesce("vpd", zero), F.coalesce(F.nullif(c("wind"), zero), F.lit(2.0)), F.coalesce("gdd", zero) / 7, F.coalesce("solar", zero))
    rows = weeks.select(*keys, "week_start", taw.alias("taw"), F.coalesce("precip", zero).alias("rain"), (et * c("kc") * 7).alias("demand"))
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("week_start", "taw", "rain", "demand"))).alias("w")).where(F.size("w") >= 2)
    point = "struct<week_start:date,taw:double,storage:double,drainage:double,demand:double>"

    def step(acc, x):
        before = F.when(F.size(acc) > 0, F.element_at(acc, -1)["storage"]).otherwise(x["taw"] * 0.62)
        after = before + x["rain"] * 0.82 - x["demand"]
        held = F.greatest(F.least(after, x["taw"]), F.lit(0.0))
        return F.concat(acc, F.array(F.struct(x["week_start"].alias("week_start"), x["taw"].alias("taw"), held.alias("storage"), F.greatest(after - x["taw"], F.lit(0.0)).alias("drainage"), x["demand"].alias("demand"))))

    folded = packed.select(*keys, F.inline(F.aggregate("w", F.array().cast(f"array<{point}>"), step)))
    deficit = F.greatest(c("taw") - c("storage"), F.lit(0.0))
    ratio = deficit / F.greatest(c("taw"), F.lit(1.0))
    klass = F.when(ratio >= 0.6, "severe").when(ratio >= 0.35, "moderate").otherwise("normal")
    return folded.select(*keys, "week_start", "storage", "drainage", "demand", deficit.alias("deficit"), ratio.alias("stress_ratio"), klass.alias("stress_class"))


def stage_progress(weeks: DataFrame, keys: list[str], lat: Column, thresholds: tuple[float, ...] = (100, 300, 600, 900, 1200)) -> DataFrame:
    """Q6: cumulative heat, lengthened by long days, and the stage that it has reached."""
    hours = weather.day_length(lat, F.dayofyear("week_start").cast("double"))
    heat = F.coalesce("gdd", F.lit(0.0)) * F.greatest(F.lit(0.8), F.least(F.lit(1.2), hours / 14))
    w = Window.partitionBy(*keys).orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
    made = weeks.withColumn("heat_total", F.sum(heat).over(w))
    stage = sum(((F.col("heat_total") >= float(x)).cast("int") for x in thresholds), F.lit(0))
    return made.withColumn("stage", stage)


def in_order(rows: DataFrame, keys: list[str], order: str, **totals: Column) -> DataFrame:
    """A row for each key with the totals, taken in ``order``, a column without ties, however rows are dealt."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = rows.select(*keys, *(x.over(whole).alias(n) for n, x in totals.items()), F.row_number().over(w).alias("_rn"))
    return made.where("_rn = 1").drop("_rn")


def risks(weeks: DataFrame, keys: list[str]) -> DataFrame:
    """Q9: shares of the last ten weeks with drought, vegetation and wet-disease signs, counts capped at six."""
    w = Window.partitionBy(*keys).orderBy(F.desc("week_start"))
    last = weeks.withColumn("_rn", F.row_number().over(w)).where("_rn <= 10")
    capped = lambda c: F.least(F.count_if(c) / 6, F.lit(1.0))
    return last.groupBy(*keys).agg(capped(F.col("vpd") > 2).alias("drought"), capped((F.col("precip") > 5) & (F.col("tmean") > 12)).alias("wet_disease"), F.count("*").alias("weeks"))


def evenly_spaced(dates: DataFrame, keys: list[str], day: str, n: int) -> DataFrame:
    """N dates at evenly spaced ranks; all of them where there are no more than n."""
    w = Window.partitionBy(*keys)
    ranked = dates.withColumn("_i", F.row_number().over(w.orderBy(day)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.round(j * (F.col("_n") - 1) / max(n - 1, 1)).cast("int"))
    return ranked.where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")
