"""Growth-model inputs, harvest calendars, baselines and historic exceedance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import scalars as S
from rainshade.functions.calendar import drop_leap_day, lookup
from rainshade.operators import aggregates as A
from rainshade.operators import joins as J
from rainshade.operators import windows as W
from rainshade.operators.sampling import bootstrap_years
from rainshade.operators.shape import growth_correction


def model_input(weather: DataFrame, restriction: DataFrame | None, mode: str, keys: Sequence[str] = (), fix_leap: bool = True) -> DataFrame:
    """Daily weather with irrigation limit, trigger and target by mode; a missing day fails the job.

    weather has date, year, doy, month, radn, tmin, tmax, rain, pet; restriction has date and f_rest.
    """
    base = drop_leap_day(weather) if fix_leap else weather
    if mode == "dryland":
        if restriction is not None:
            raise ValueError("dryland takes no restriction")
        rows = base.withColumn("f_rest", F.lit(None).cast("double"))
    elif mode == "irrigated" or "store" in mode:
        rows = base.join(restriction.select("date", "f_rest"), "date", "left")
    else:
        raise ValueError(f"unexpected mode {mode}")
    full = J.date_spine(rows, keys, leap=not fix_leap)
    present = F.col("radn").isNotNull() & (F.lit(mode == "dryland") | F.col("f_rest").isNotNull())
    checked = F.when(present, F.col("date")).otherwise(F.raise_error(F.concat(F.lit("missing day "), F.col("date").cast("string"))).cast("date"))
    zero = F.lit(0.0)
    if mode == "dryland":
        limit, trigger, target = zero, zero, zero
    else:
        limit = S.max_irrigation(F.col("f_rest"), F.col("doy"))
        trigger, target = S.irrigation_trigger(F.col("month")), S.irrigation_target(F.col("month"))
    return full.select(*keys, checked.alias("date"), "year", "doy", "radn", "tmin", "tmax", "rain", "pet", limit.alias("max_irr"),
                       trigger.alias("irr_trig"), target.alias("irr_targ"), zero.alias("irr_trig_store"), zero.alias("irr_targ_store"),
                       zero.alias("external_inflow"))


def reseed_rule(mode: str, site: str) -> tuple[float, float]:
    """(trigger, basal cover after reseeding) of a site-mode."""
    if (mode, site) in C.STORE_BASAL:
        return tuple(C.STORE_BASAL[mode, site] * share for share in C.STORE_RESEED_SHARES)
    if (mode, site) not in C.RESEED_RULE:
        raise ValueError(f"no reseed rule for {mode} at {site}")
    return C.RESEED_RULE[mode, site]


def harvest_calendar(days: DataFrame, mode: str, site: str, keys: Sequence[str] = (), fix_leap: bool = True) -> DataFrame:
    """Harvest trigger, target, weed fraction and reseed limits for every day of a series.

    Irrigated modes harvest every 15 days from the sixth day, dryland at month ends from the sixth day on;
    the last day is always a harvest. A harvest that falls on Feb 29 moves to Feb 28. The day of harvest is
    a rule on the distance to the series' first day, so only one row per series is joined back.
    """
    spans = days.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_z"))
    rows = (days.join(spans, list(keys)) if keys else A.attach_small(days, spans, ()))
    month = F.month("date")
    distance = F.date_diff(F.col("date"), F.col("_a")) - 5
    store = mode != "dryland"
    if store:
        hit = (distance >= 0) & (F.pmod(distance, F.lit(C.HARVEST_STEP_DAYS)) == 0)
        moved = (distance + 1 >= 0) & (F.pmod(distance + 1, F.lit(C.HARVEST_STEP_DAYS)) == 0) & (F.date_add("date", 1) <= F.col("_z"))
    else:
        hit = (distance >= 0) & (F.col("date") == F.last_day("date"))
        moved = (distance + 1 >= 0) & (F.date_add("date", 1) == F.last_day("date"))
    leap_next = (month == 2) & (F.dayofmonth("date") == 28) & (F.dayofmonth(F.date_add("date", 1)) == 29)
    if fix_leap:
        hit = (hit & ~((month == 2) & (F.dayofmonth("date") == 29))) | (leap_next & moved)
    harvest = hit | (F.col("date") == F.col("_z"))
    if store:
        trig, targ = (F.lit(v) for v in C.IRRIGATED_TRIGGER_TARGET)
        weed = F.lit(0.0)
    else:
        summer = month.isin(*C.DRYLAND_SUMMER)
        trig = F.when(summer, C.DRYLAND_SUMMER_TRIGGER_TARGET[0]).otherwise(C.DRYLAND_TRIGGER_TARGET[0])
        targ = F.when(summer, C.DRYLAND_SUMMER_TRIGGER_TARGET[1]).otherwise(C.DRYLAND_TRIGGER_TARGET[1])
        weed = lookup(C.DRYLAND_WEED, month)
    rule = reseed_rule(mode, site)
    reseed = F.dayofyear("date") == C.RESEED_DOY
    return rows.select(*keys, "date", F.year("date").alias("year"), F.dayofyear("date").alias("doy"), F.lit(1.0).alias("frac_harv"),
                       F.when(harvest, trig).otherwise(-1).alias("harv_trig"), F.when(harvest, targ).otherwise(0).alias("harv_targ"),
                       weed.alias("weed_dm_frac"), F.when(reseed, rule[0]).otherwise(-1.0).alias("reseed_trig"),
                       F.when(reseed, rule[1]).otherwise(0.0).alias("reseed_basal"))


def paddock_split(df: DataFrame, rest: str = "f_rest") -> DataFrame:
    """Four quarter bands per row with their daily limit: 5 below, 0 above, 5 (r - lo) / 0.25 inside as published."""
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("paddock"), F.lit(i * 0.25).alias("lo"), F.lit((i + 1) * 0.25).alias("hi")) for i in range(4)]))
    rows = df.withColumn("_b", bands).select(*df.columns, "_b.*")
    r = F.col(rest)
    limit = (F.when(r <= F.col("lo"), C.MAX_IRRIGATION).when(r >= F.col("hi"), 0.0)
             .otherwise(C.MAX_IRRIGATION * (r - F.col("lo")) / 0.25))
    return rows.withColumn("max_irr", limit).drop("lo", "hi")


def paddock_mean(paddocks: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return paddocks.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def align_baseline(base: DataFrame, sim: DataFrame, keys: Sequence[str], value: str = "pg", by: str = "month", order: str = "date") -> DataFrame:
    """Anomaly of a simulation to a baseline that repeats over later years, matched by month or doy, and its running sum.

    The baseline keeps one row per calendar slot, so repeating it is a plain join on the slot.
    """
    slot = base.groupBy(by).agg(F.avg(value).alias(value))
    return W.cumulative_anomaly(sim, slot, keys, [by], order, value, days=by == "month")


def historic_exceedance(annual: DataFrame, keys: Sequence[str], nyr: int, sequential: bool, draws: DataFrame | None = None,
                        value: str = "pg_yr1", year: str = "year", step: float = 0.1, seed: int = 1, uniform=None) -> DataFrame:
    """Exceedance curve of n-year growth sums, from running sums or from resampled years (growth in tons)."""
    tons = annual.withColumn(value, F.col(value) / 1000)
    if sequential:
        sums = W.nyear_sequential(tons, keys, year, value, nyr).select(*keys, F.col(f"{value}_{nyr}yr").alias("_s"))
    else:
        extra = {"uniform": uniform} if uniform else {}
        sums = bootstrap_years(draws, tons, nyr, sums=[value], year=year, keys=keys, seed=seed, **extra).select(*keys, F.col(value).alias("_s"))
    return A.exceedance_curve(sums, keys, "_s", step)


def original_and_corrected(monthly_pg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Annual growth per key with and without the growth correction, as a `version` column."""
    raw = monthly_pg.withColumn("version", F.lit("original"))
    fixed = growth_correction(monthly_pg).withColumn("version", F.lit("corrected"))
    return raw.unionByName(fixed).groupBy(*keys, "version").agg(F.sum("pg").alias("pg_yr1"))


def abandonment_differences(runs: DataFrame, restriction: DataFrame, keys: Sequence[str], base: str, value: str = "pg") -> DataFrame:
    """Monthly means per run minus the base run, beside 1, 2, 3, 6 and 12 month restriction sums.

    runs is (keys, run, date, value); restriction (keys, date, f_rest).
    """
    months = runs.groupBy(*keys, "run", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg(value).alias("_v"))
    is_base = F.col("run") == base
    base_rows = months.where(is_base).select(*keys, "year", "month", F.col("_v").alias("_b"))
    diff = months.where(~is_base).join(base_rows, [*keys, "year", "month"]).select(
        *keys, "run", "year", "month", (F.col("_v") - F.col("_b")).alias("pg_dif"))
    rest = restriction.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("f_rest").alias("monthly_rest"))
    rest = rest.withColumn("_t", F.col("year") * 12 + F.col("month"))
    for n in (2, 3, 6, 12):
        rest = W.rolling(rest, keys, "_t", "monthly_rest", n, "sum", f"sum_{n}m")
    return diff.join(rest.drop("_t"), [*keys, "year", "month"])
