"""Weather expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def saturation(t: Column) -> Column:
    """Saturation vapour pressure in kPa at t degrees C."""
    return 0.6108 * F.exp(17.27 * t / F.greatest(t + 237.3, F.lit(1.0)))


def gdd(tmax: Column, tmin: Column, base: float = 10.0) -> Column:
    return F.greatest((tmax + tmin) / 2 - base, F.lit(0.0))


def vpd_from_dew_point(t: Column, dew: Column) -> Column:
    return F.greatest(saturation(t) - saturation(dew), F.lit(0.0))


def vpd_from_humidity(t: Column, rh: Column) -> Column:
    return F.greatest(saturation(t) * (1 - clip(rh, 1.0, 100.0) / 100), F.lit(0.0))


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(u: Column, v: Column) -> Column:
    return F.pmod(270 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def wind_vector(speed: Column, direction: Column) -> tuple[Column, Column]:
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def extraterrestrial_radiation(lat: Column, doy: Column) -> Column:
    """MJ per square metre and day, by the FAO-56 equation 21."""
    angle = 2 * math.pi * doy / 365
    phi, delta = F.radians(lat), 0.409 * F.sin(angle - 1.39)
    sunset = F.acos(clip(-F.tan(phi) * F.tan(delta), -1.0, 1.0))
    made = 1440 / math.pi * 0.082 * (1 + 0.033 * F.cos(angle)) * (sunset * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(sunset))
    return F.greatest(made, F.lit(0.0))


def solar_from_cloud(ra: Column, cloud: Column) -> Column:
    return F.greatest(ra * (0.25 + 0.5 * (1 - clip(cloud, 0.0, 1.0))), F.lit(0.0))


def day_length(lat: Column, doy: Column) -> Column:
    decl = F.radians(23.45 * F.sin(F.radians(360.0 / 365.0 * (284 + doy))))
    return F.when(lat.isNull(), F.lit(12.0)).otherwise(24 / math.pi * F.acos(clip(-F.tan(F.radians(lat)) * F.tan(decl), -1.0, 1.0)))


def reference_et(tmean: Column, tmax: Column, tmin: Column, solar: Column, lat: Column, wind: Column, vpd: Column) -> Column:
    """Daily reference evapotranspiration of the Penman-Monteith form, 0.4 to 11.5 mm."""
    sun = F.when(solar > 0, solar).otherwise(14.0)
    dry = F.when(vpd > 0, vpd).otherwise(0.8)
    speed = clip(F.coalesce(F.nullif(wind, F.lit(0.0)), F.lit(2.0)), 0.1, 12.0)
    es = (saturation(F.greatest(tmax, tmean)) + saturation(F.least(tmin, tmean))) / 2
    delta = 4098 * saturation(tmean) / F.greatest((tmean + 237.3) * (tmean + 237.3), F.lit(1.0))
    rn = sun * 0.77 * F.coalesce(clip(1.05 - F.abs(lat) / 180, 0.75, 1.05), F.lit(1.0))
    above = 0.408 * delta * rn + 0.066 * (900 / F.greatest(tmean + 273, F.lit(1.0))) * speed * F.least(dry, es)
    return clip(above / F.greatest(delta + 0.066 * (1 + 0.34 * speed), F.lit(0.05)), 0.4, 11.5)


def weekly_et(temp: Column, vpd: Column, wind: Column, gdd_day: Column, solar_week: Column) -> Column:
    """Priestley-Taylor where there is solar radiation, else an empirical proxy; 1 mm at least."""
    es = 0.6108 * F.exp(17.27 * temp / F.greatest(temp + 237.3, F.lit(1e-6)))
    delta = 4098 * es / F.greatest((temp + 237.3) * (temp + 237.3), F.lit(1e-6))
    taylor = 1.26 * (delta / (delta + 0.067)) * (solar_week * 0.77 / 7 / 2.45)
    plain = 1.5 + 0.12 * temp + 2.8 * vpd + 0.18 * wind + 0.003 * gdd_day
    return F.greatest(F.lit(1.0), F.when(solar_week > 0, taylor).otherwise(plain))


def weekly_defaults(tmean: Column, tmax: Column, tmin: Column, precip: Column, vpd: Column, solar: Column, wind: Column) -> dict[str, Column]:
    """A missing or zero weekly input takes a default."""

    def some(x: Column, *then: Column | float) -> Column:
        return F.coalesce(F.nullif(x, F.lit(0.0)), *(F.nullif(y, F.lit(0.0)) if isinstance(y, Column) else F.lit(y) for y in then))

    return {"tmean": some(tmean, 15.0), "tmax": some(tmax, tmean, 22.0), "tmin": some(tmin, tmean, 8.0), "precip": some(precip, 10.0), "vpd": some(vpd, 1.0), "solar": some(solar, 15.0), "wind": some(wind, 2.0)}
