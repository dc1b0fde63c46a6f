"""Evaporation and radiation formulas of FAO-56 as column arithmetic on a weather table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Physical constants (MJ m-2 min-1, MJ K-4 m-2 day-1).
SOLAR_CONSTANT = 0.0820
STEFAN_BOLTZMANN = 0.000000004903
PSYCHROMETER = {1: 0.000662, 2: 0.000800, 3: 0.001200}


def actual_et(pet: Column, deficit: Column, capacity: float = 150.0, a: float = 0.0073, p: float = 1.0) -> Column:
    """min(pet, readily available water); deficit is 0 or negative."""
    return F.least(pet, a * pet * (capacity + deficit) * p)


def penman_pet(rad: Column, temp: Column, rh: Column, wind_10: Column | None = None, wind_2: Column | None = None,
               psurf: Column | None = None, mslp: Column | None = None, elevation: Column | None = None) -> Column:
    """Daily Penman-Monteith evaporation (mm). One wind and one pressure column must be given."""
    if (wind_10 is None) == (wind_2 is None):
        raise ValueError("give exactly one of wind_10 and wind_2")
    if (psurf is None) == (mslp is None):
        raise ValueError("give exactly one of psurf and mslp")
    if psurf is None:
        if elevation is None:
            raise ValueError("elevation is needed with mslp")
        lift = 0.0065 * elevation
        psurf = mslp * F.pow(1 - lift / (temp + 273 + lift), F.lit(5.257))
    wind = wind_2 if wind_2 is not None else wind_at_2m(wind_10, F.lit(10.0))
    latent = 2.501 - 0.00236 * temp
    slope = svp_slope(temp)
    gamma = (1.1013 * psurf) / (0.622 * latent * 1000)
    es = 0.61094 * F.exp(17.625 * temp / (243.04 + temp))
    ed = rh * es / 100
    return (slope * rad / latent + gamma * (900 / (temp + 273)) * wind * (es - ed)) / (slope + gamma * (1 + 0.34 * wind))


def saturation_vp(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def svp_slope(t: Column) -> Column:
    return 4098 * saturation_vp(t) / F.pow(t + 237.3, F.lit(2.0))


def air_pressure(altitude: Column) -> Column:
    return 101.3 * F.pow((293.0 - 0.0065 * altitude) / 293.0, F.lit(5.26))


def wind_at_2m(speed: Column, height: Column) -> Column:
    return speed * 4.87 / F.log(67.8 * height - 5.42)


def solar_declination(doy: Column) -> Column:
    return 0.409 * F.sin(2 * math.pi / 365 * doy - 1.39)


def sunset_angle(latitude: Column, declination: Column) -> Column:
    cosine = -F.tan(latitude) * F.tan(declination)
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def inverse_sun_distance(doy: Column) -> Column:
    return 1 + 0.033 * F.cos(2 * math.pi / 365 * doy)


def extraterrestrial_radiation(latitude: Column, declination: Column, angle: Column, distance: Column) -> Column:
    inner = (angle * F.sin(latitude) * F.sin(declination)
             + F.cos(latitude) * F.cos(declination) * F.sin(angle))
    return 24 * 60 / math.pi * SOLAR_CONSTANT * distance * inner


def hargreaves_et(tmin: Column, tmax: Column, tmean: Column, et_rad: Column) -> Column:
    return 0.0023 * (tmean + 17.8) * F.sqrt(tmax - tmin) * 0.408 * et_rad


def fao56_et(net_rad: Column, kelvin: Column, wind: Column, svp: Column, avp: Column, slope: Column,
             gamma: Column, heat_flux: Column | float = 0.0) -> Column:
    base = slope + gamma * (1 + 0.34 * wind)
    return (0.408 * (net_rad - heat_flux) * slope + 900 * wind / kelvin * (svp - avp) * gamma) / base


def psychrometer_constant(kind: int, pressure: Column) -> Column:
    if kind not in PSYCHROMETER:
        raise ValueError("psychrometer kind must be 1, 2 or 3")
    return PSYCHROMETER[kind] * pressure


def reference_et(df: DataFrame, coastal: bool = False, albedo: float = 0.23) -> DataFrame:
    """Add every intermediate and final FAO-56 quantity to a daily weather table in one projection chain.

    Needs columns doy, tmin, tmax, tdew, twet, rh_min, rh_max, wind, wind_height, radn, sunshine_hours,
    altitude, latitude (radians), t_month_prev, t_month_next. Narrow: no shuffle.
    """
    c = F.col
    base = df.withColumns({
        "tmean": (c("tmax") + c("tmin")) / 2,
        "pressure": air_pressure(c("altitude")),
        "svp_tmin": saturation_vp(c("tmin")),
        "svp_tmax": saturation_vp(c("tmax")),
        "wind_2m": wind_at_2m(c("wind"), c("wind_height")),
        "declination": solar_declination(c("doy")),
        "sun_distance": inverse_sun_distance(c("doy")),
        "rh_mean": (c("rh_min") + c("rh_max")) / 2,
    })
    second = base.withColumns({
        "svp": (c("svp_tmin") + c("svp_tmax")) / 2,
        "svp_slope": svp_slope(c("tmean")),
        "psy": 0.000665 * c("pressure"),
        "psy_ventilated": psychrometer_constant(1, c("pressure")),
        "psy_natural": psychrometer_constant(2, c("pressure")),
        "psy_indoor": psychrometer_constant(3, c("pressure")),
        "avp_tmin": 0.611 * F.exp(17.27 * c("tmin") / (c("tmin") + 237.3)),
        "avp_tdew": saturation_vp(c("tdew")),
        "avp_rh": (c("svp_tmin") * c("rh_max") / 100 + c("svp_tmax") * c("rh_min") / 100) / 2,
        "avp_rhmax": c("svp_tmin") * c("rh_max") / 100,
        "avp_rhmean": c("rh_mean") / 100 * (c("svp_tmax") + c("svp_tmin")) / 2,
        "sunset": sunset_angle(c("latitude"), c("declination")),
        "heat_flux_centred": 0.07 * (c("t_month_next") - c("t_month_prev")),
        "heat_flux_previous": 0.14 * (c("tmean") - c("t_month_prev")),
    })
    third = second.withColumns({
        "avp_wet_bulb": saturation_vp(c("twet")) - c("psy_ventilated") * (c("tmax") - c("twet")),
        "daylight": 24 / math.pi * c("sunset"),
        "et_rad": extraterrestrial_radiation(c("latitude"), c("declination"), c("sunset"), c("sun_distance")),
        "rh_actual": 100 * c("avp_tdew") / c("svp"),
    })
    fourth = third.withColumns({
        "clear_sky_rad": (0.00002 * c("altitude") + 0.75) * c("et_rad"),
        "rad_from_sun": (0.5 * F.try_divide(c("sunshine_hours"), c("daylight")) + 0.25) * c("et_rad"),
        "rad_island": 0.7 * c("et_rad") - 4.0,
        "net_short": (1 - albedo) * c("radn"),
    })
    kelvin4 = (F.pow(c("tmax") + 273.16, F.lit(4.0)) + F.pow(c("tmin") + 273.16, F.lit(4.0))) / 2
    fifth = fourth.withColumns({
        "rad_from_temp": F.least((0.19 if coastal else 0.16) * F.sqrt(c("tmax") - c("tmin")) * c("et_rad"),
                                 c("clear_sky_rad")),
        "net_long": STEFAN_BOLTZMANN * kelvin4 * (0.34 - 0.14 * F.sqrt(c("avp_tdew")))
        * (1.35 * F.try_divide(c("radn"), c("clear_sky_rad")) - 0.35),
    })
    return (fifth.withColumn("net_rad", c("net_short") - c("net_long"))
            .withColumns({
                "equivalent_evaporation": 0.408 * c("net_rad"),
                "et_hargreaves": hargreaves_et(c("tmin"), c("tmax"), c("tmean"), c("et_rad")),
                "et_fao56": fao56_et(c("net_rad"), c("tmean") + 273.0, c("wind_2m"), c("svp"), c("avp_tdew"),
                                     c("svp_slope"), c("psy")),
            }))
