"""Column to Column rules. All stay in generated code; none starts a Python worker."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions.calendar import lookup

NEG_INF = float("-inf")


def log10_safe(p: Column) -> Column:
    """log10 that keeps log10(0) = -inf instead of null; negative input is null."""
    return F.when(p == 0, F.lit(NEG_INF)).otherwise(F.log10(p))


def pow10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def tail_prob(rest: Column, rest_per: Column, from_zero: bool = False) -> Column:
    """log10 probability of a restriction at least as extreme as its quantile; 0 where rest is 0."""
    tail = (1 - rest_per) if from_zero else (0.5 - F.abs(0.5 - rest_per))
    return F.when(rest == 0, F.lit(0.0)).otherwise(log10_safe(tail))


def round_half_even(x: Column, decimals: int = 0) -> Column:
    return F.bround(x, decimals)


def round_to_half(x: Column) -> Column:
    """Nearest 0.5, ties to even as numpy rounds."""
    return F.bround(x * 2, 0) / 2


def isclose(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to [low, high]; null stays null (least/greatest alone would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def clean_restriction(x: Column) -> Column:
    """Above 1 becomes 1; below 0.001 becomes 0."""
    return F.when(x > 1, 1.0).when(x < 0.001, 0.0).otherwise(x)


def polynomial5(x: Column, coefficients: tuple, low: float, high: float) -> Column:
    """Degree-5 curve by Horner's rule, 0 outside the open interval (low, high)."""
    value = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        value = value * x + F.lit(float(c))
    return F.when((x <= low) | (x >= high), 0.0).when(x.isNotNull(), value)


def restriction_from_flow(flow: Column) -> Column:
    """Restriction fraction from river flow; the middle branch rises with flow, as published."""
    return (F.when(flow >= 63, 0.0).when(flow <= 41, 1.0)
            .otherwise((flow * 501.86 - 20576) / 1000 / C.SCHEME_TAKE))


def regime_restriction(nat: Column, start: Column, stop: Column) -> Column:
    """Restriction of a (start, stop) regime; between the limits it divides by `stop`, as published."""
    return (F.when(nat >= start, 0.0).when(nat <= stop, 1.0).otherwise(1 - (nat - stop) / stop))


def water_temp(air_temp: Column, slope: Column | float, intercept: Column | float) -> Column:
    return air_temp * slope + intercept


def score(value: Column, low: Column, high: Column, higher_better: Column) -> Column:
    """Place a value between low and high on -3..3 in steps of 0.5; 0 where low equals high."""
    scaled = F.try_divide(value - low, high - low) * 2 - 1
    signed = scaled * F.when(higher_better, 3).otherwise(-3)
    return F.when(low == high, 0.0).otherwise(round_to_half(signed))


def restriction_tolerance(r: Column) -> Column:
    return F.greatest(F.lit(0.02), r * 0.1)


def in_irrigation_season(doy: Column) -> Column:
    return (doy <= C.IRRIGATION_STOP_DOY) | (doy >= C.IRRIGATION_START_DOY)


def max_irrigation(rest: Column, doy: Column) -> Column:
    """Daily irrigation limit, 0 outside the irrigation days."""
    return F.when(in_irrigation_season(doy), C.MAX_IRRIGATION * (1 - rest)).otherwise(0.0)


def irrigation_trigger(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), 0.75).otherwise(0.60)


def irrigation_target(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), 0.90).otherwise(0.75)


def erf(x: Column) -> Column:
    """Error function from built-in arithmetic: Taylor terms near 0, a continued fraction beyond.

    Spark SQL has no erf. Both branches are unrolled at plan time and agree with the true value to
    about 1e-12, so no Python worker is needed.
    """
    a = F.abs(x)
    square = a * a
    terms = 40
    series = F.lit(0.0)
    for n in range(terms, -1, -1):
        series = series * square + F.lit((-1.0) ** n / (math.factorial(n) * (2 * n + 1)))
    small = 2 / math.sqrt(math.pi) * a * series
    fraction = a
    for k in range(60, 0, -1):
        fraction = a + F.lit(k / 2.0) / fraction
    large = 1 - F.exp(-square) / (fraction * math.sqrt(math.pi))
    return F.signum(x) * F.when(a < 2.0, small).when(a > 6.5, 1.0).otherwise(large)


def z_to_percentile(z: Column) -> Column:
    return (erf(z / math.sqrt(2.0)) + 1) * 0.5


def oversample_count(n: Column, p_fail: Column) -> Column:
    """Realisations to make so that about n pass when a share p_fail fails."""
    return F.floor(n / (1 - p_fail) + 1).cast("long")


# ---- class codes and keys -------------------------------------------------------------------------

def recode_temp(code: Column) -> Column:
    return lookup(C.TEMP_CODES, code.cast("int"))


def recode_precip(code: Column) -> Column:
    return lookup(C.PRECIP_CODES, code.cast("int"))


def code_temp(name: Column) -> Column:
    return lookup({"C": -1, "AT": 0, "A": 0, "H": 1}, name)


def code_precip(name: Column) -> Column:
    return lookup({"W": -1, "AP": 0, "A": 0, "D": 1}, name)


def strip_class(name: Column) -> Column:
    """AT / AP -> A."""
    return F.regexp_replace(name, "^A[TP]$", "A")


def spell_temp(name: Column) -> Column:
    return F.when(name == "A", "AT").otherwise(name)


def spell_precip(name: Column) -> Column:
    return F.when(name == "A", "AP").otherwise(name)


def dry_state(precip: Column) -> Column:
    """D stays D, any other class is ND, null stays null."""
    return F.when(precip == "D", "D").when(precip.isNotNull(), "ND")


def combo_key(prev: Column, cur: Column) -> Column:
    """Key of the restriction tables: previous then current class, each D or ND."""
    return F.concat_ws("-", dry_state(prev), dry_state(cur))


def regime_index(temp: Column, precip: Column) -> Column:
    """1..9 from temperature (C, A, H) and rain (W, A, D); {1,4,7}, {2,5,8}, {3,6,9} share a rain class."""
    t = F.when(temp == "C", 0).when(temp.isin("A", "AT"), 1).when(temp == "H", 2)
    p = F.when(precip == "W", 1).when(precip.isin("A", "AP"), 2).when(precip == "D", 3)
    return t * 3 + p


def state_key(temp: Column, precip: Column) -> Column:
    return F.concat_ws("-", temp, precip)


def month_state_key(month: Column, precip: Column) -> Column:
    """m01-D or m01-ND."""
    return F.format_string("m%02d-%s", month.cast("int"), dry_state(precip))
