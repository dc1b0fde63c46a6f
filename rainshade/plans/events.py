"""Monthly event classes and event recurrence from daily weather."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import scalars as S
from rainshade.functions.calendar import date_parts, lookup, month_days, nonleap_doy
from rainshade.operators import aggregates as A
from rainshade.operators import windows as W
from rainshade.operators.folds import soil_moisture_deficit_monthly
from rainshade.operators.joins import lookup_side
from rainshade.operators.ranking import intersect_months, joint_probability
from rainshade.operators.shape import threshold_grid


def monthly_weather(weather: DataFrame, keys: Sequence[str] = ("site",), start_deficit: dict | None = None) -> DataFrame:
    """Daily weather to monthly means of tmean, soil-moisture anomaly and deficit.

    The series are dealt out by their keys once. Months, days of the year and months again are finer than the keys, so the fold, the
    means per day of the year and the monthly means need no exchange of their own.
    """
    dealt = weather.select(*keys, "date", "rain", "pet", ((F.col("tmax") + F.col("tmin")) / 2).alias("tmean"))
    if keys:
        dealt = dealt.repartition(*keys)
    daily = soil_moisture_deficit_monthly(dealt, keys, month_start=start_deficit, carry=["tmean"]).withColumn("doy", nonleap_doy(F.col("date")))
    level = F.avg("smd").over(Window.partitionBy(*keys, "doy"))
    return A.monthly(date_parts(daily.withColumn("sma", F.col("smd") - level)), ["tmean", "sma", "smd"], "mean", [*keys, "year", "month"])


def class_codes(tmean: Column, t_low: Column, t_high: Column, sma: Column, s_low: Column, s_high: Column) -> tuple[Column, Column]:
    """-1/0/1 codes; on ties the later rule wins: cold over hot, dry over wet."""
    temp = F.when(tmean <= t_low, -1).when(tmean >= t_high, 1).otherwise(0)
    precip = F.when(sma <= s_low, 1).when(sma >= s_high, -1).otherwise(0)
    return F.when(tmean.isNotNull(), temp), F.when(sma.isNotNull(), precip)


def classify(months: DataFrame, limits: DataFrame | None = None, keys: Sequence[str] = ("site",), temp: str = "tmean",
             moisture: str = "sma") -> DataFrame:
    """Monthly classes with codes and previous codes; limits may come from another record."""
    limit_keys = [*keys, "month"]
    names = [f"{v}_{s}" for v in (temp, moisture) for s in ("low", "high")]
    if limits is None:
        # a calendar month of a series has one row per year
        own = Window.partitionBy(*limit_keys)
        joined = months.withColumns({f"{v}_{s}": F.percentile(v, q).over(own) for v in (temp, moisture) for s, q in (("low", 0.25), ("high", 0.75))})
    else:
        by = [k for k in limit_keys if k in limits.columns]
        joined = months.join(limits.select(*by, *names), by)
    t, p = class_codes(*[F.col(c) for c in (temp, f"{temp}_low", f"{temp}_high", moisture, f"{moisture}_low", f"{moisture}_high")])
    coded = joined.withColumns({"temp": t, "precip": p, "_t": F.col("year") * 12 + F.col("month")})
    lagged = W.lag_state(coded, keys, "_t", {"temp": 0, "precip": 0})
    return (lagged.withColumns({"temp_class": S.strip_class(S.recode_temp(F.col("temp"))), "precip_class": S.strip_class(S.recode_precip(F.col("precip")))})
            .withColumn("state", S.state_key(F.col("temp_class"), F.col("precip_class")))
            .drop("_t", *names))


def classify_months(weather: DataFrame, limits: DataFrame | None = None, keys: Sequence[str] = ("site",)) -> DataFrame:
    return classify(monthly_weather(weather, keys), limits, keys)


def add_restriction(classes: DataFrame, rest_daily: DataFrame, value: str = "f_rest") -> DataFrame:
    """Monthly restriction sum and its fraction of the fixed month length beside the classes; no record gives 0."""
    months = date_parts(rest_daily).groupBy("year", "month").agg(F.sum(value).alias("rest_cum"))
    joined = classes.join(lookup_side(months), ["year", "month"], "left").na.fill(0.0, ["rest_cum"])
    return joined.withColumn("rest", F.col("rest_cum") / month_days(F.col("month")))


# ---- recurrence ----------------------------------------------------------------------------------------

def event_grid(kind: str) -> tuple[list[tuple[str, Column]], tuple[int, ...]]:
    """Named daily flags and day counts of an event kind."""
    c = F.col
    if kind == "hot":
        return [(f"d_{v}_{t:02d}", c(v) >= t) for t in C.HOT_THRESHOLDS for v in ("tmax", "tmean")], (3, 5, 7, 10, 14)
    if kind == "cold":
        return [(f"d_tmean_{t:02d}", c("tmean_3") <= t) for t in C.COLD_THRESHOLDS], (3, 5, 7, 10, 14)
    if kind == "dry":
        pairs = ((0, -20), (-110, 0), (-110, -20))
    elif kind == "monthly_dry":
        pairs = tuple((0, a) for a in C.DRY_ANOMALIES)
    elif kind == "wet":
        return [(f"d_r{r}_smd{d}", (c("rain") >= r) & (c("smd") >= d)) for r in C.WET_RAIN_THRESHOLDS for d in C.WET_DEFICIT_THRESHOLDS], (7, 10, 14)
    elif kind == "restriction":
        return [(f"d_>{n}_rest", c("f_rest") >= t) for n, t in C.REST_THRESHOLDS.items()], (1, 5, 7, 10, 14)
    else:
        raise ValueError(f"unknown event kind {kind}")
    return [(f"d_smd{s:03d}_sma{a:02d}", (c("smd") <= s) & (c("sma") <= a)) for s, a in pairs], (5, 7, 10, 14)


Growth = DataFrame | dict[str, DataFrame] | None


def recurrence(flags: DataFrame, growth: Growth = None, years: int = C.RECORD_YEARS, keys: Sequence[str] = ()) -> DataFrame:
    """Per event and month: count, probability and, given growth anomalies, their describe on the event months.

    growth is one table of anomalies, or several by name, whose columns then end in the name.
    """
    group = [*keys, "event", "month"]
    probs = A.occurrence(flags, group)
    out = A.drop_degenerate(probs, "event", years) if not keys else probs
    tables = growth if isinstance(growth, dict) else {} if growth is None else {"": growth}
    for name, table in tables.items():
        hits = flags.where("flag").join(table, [*keys, "year", "month"])
        described = A.describe_by(hits, group, "anomaly")
        if name:
            described = described.withColumnsRenamed({c: f"{c}_{name}" for c in described.columns if c not in group})
        out = out.join(described, group, "left")
    return out


def event_years(flags: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The (event, month, year) list of every criterion that occurs."""
    return flags.where("flag").select(*keys, "event", "month", "year").distinct()


def event_flags(daily: DataFrame, kind: str) -> DataFrame:
    """Flag of each criterion of a threshold grid per (year, month).

    daily needs year, month and the tested columns (tmax, tmean, rain and smd, smd and sma, or f_rest).
    """
    grid, ndays = event_grid(kind)
    if kind == "cold":
        daily = W.rolling(daily, ["site"] if "site" in daily.columns else [], "date", "tmean", 3, "mean", "tmean_3")
    return threshold_grid(daily, ["year", "month"], grid, ndays)


def event_recurrence(daily: DataFrame, kind: str, growth: Growth = None, years: int = C.RECORD_YEARS) -> DataFrame:
    """Monthly probability of a threshold grid without the degenerate criteria, growth on event months."""
    return recurrence(event_flags(daily, kind), growth, years)


def wet_day_flags(daily: DataFrame, limits: dict[int, int] | None = None) -> DataFrame:
    """Months with at least the month's limit of days with rain above 0.01."""
    months = daily.groupBy("year", "month").agg(F.count_if(F.col("rain") > 0.01).alias("days"))
    return months.select("year", "month", F.lit("org").alias("event"), (F.col("days") >= lookup(limits or C.WET_DAYS_LIMIT, F.col("month"))).alias("flag"))


def wet_day_recurrence(daily: DataFrame, limits: dict[int, int] | None = None, years: int = C.RECORD_YEARS, growth: Growth = None) -> DataFrame:
    return recurrence(wet_day_flags(daily, limits), growth, years)


def month_dry_flags(daily: DataFrame, limits: dict[str, dict[int, float]] | None = None) -> DataFrame:
    """Months whose rain sum is at or below the month's limit; limits by name and month."""
    limits = limits or {n: {m: v + (shift if m in C.SHOULDER_MONTHS else 0) for m, v in C.MONTH_RAIN_LIMITS.items()} for n, shift in C.MONTH_RAIN_SHIFTS.items()}
    months = daily.groupBy("year", "month").agg(F.sum("rain").alias("total"))
    each = [F.struct(F.lit(n).alias("event"), F.coalesce(F.col("total") <= lookup({m: float(v) for m, v in lim.items()}, F.col("month")), F.lit(False)).alias("flag")) for n, lim in limits.items()]
    return months.select("year", "month", F.explode(F.array(*each)).alias("_e")).select("year", "month", "_e.*")


def month_dry_recurrence(daily: DataFrame, limits: dict[str, dict[int, float]] | None = None, years: int = C.RECORD_YEARS, growth: Growth = None) -> DataFrame:
    return recurrence(month_dry_flags(daily, limits), growth, years)


def variable_hot_flags(daily: DataFrame, shifts: dict[str, float] | None = None, days: dict[str, int] | None = None) -> DataFrame:
    """Months with enough hot days: by mean temperature and shifted limits in the shoulder months, by the maximum in the others.

    An event is named `<limit>_<days>`; daily needs tmax and tmean.
    """
    month, shoulder = F.col("month"), F.col("month").isin(*C.SHOULDER_MONTHS)
    tested = F.when(shoulder, F.col("tmean")).otherwise(F.col("tmax"))
    limits = {n: {m: float(C.SHOULDER_HOT_LIMITS.get(m, C.OTHER_HOT_LIMIT) + (shift if m in C.SHOULDER_MONTHS else 0)) for m in range(1, 13)}
              for n, shift in (shifts or C.SHOULDER_HOT_SHIFTS).items()}
    counts = daily.groupBy("year", "month").agg(*[F.count_if(tested >= lookup(lim, month)).alias(f"_{i}") for i, lim in enumerate(limits.values())])
    pairs = [F.struct(F.lit(f"{n}_{d}").alias("event"), (F.col(f"_{i}") >= F.when(shoulder, F.lit(k)).otherwise(F.lit(C.OTHER_HOT_DAYS))).alias("flag"))
             for i, n in enumerate(limits) for d, k in (days or C.SHOULDER_HOT_DAYS).items()]
    return counts.select("year", "month", F.explode(F.array(*pairs)).alias("_e")).select("year", "month", "_e.*")


def variable_hot_recurrence(daily: DataFrame, years: int = C.RECORD_YEARS, growth: Growth = None) -> DataFrame:
    return recurrence(variable_hot_flags(daily), growth, years)


def rolling_rain_limits() -> dict[str, dict[int, float]]:
    """The published limits of the trailing rain sum by name: eased by some mm, or one level."""
    eased = {f"first-{k}" if k else "first": {m: v - k for m, v in C.ROLLING_DRY_LIMITS.items()} for k in C.ROLLING_DRY_EASED}
    return eased | {n: dict.fromkeys(C.ROLLING_DRY_LIMITS, v) for n, v in C.ROLLING_DRY_LEVELS.items()}


def rolling_dry_flags(daily: DataFrame, day_limits: dict[str, dict[int, int]], rain_limits: dict[str, dict[int, float]] | None = None,
                      keys: Sequence[str] = (), window: int = 10) -> DataFrame:
    """Months with enough days whose trailing rain sum is at or below the month's limit.

    Both limits are by name and month; an event is named `<rain limit>_<day limit>`. A month without a
    rain limit can never be dry.
    """
    rain_limits = rain_limits or rolling_rain_limits()
    rolled = W.rolling(daily, keys, "date", "rain", window, "sum", "_roll")
    month = F.col("month")
    counts = rolled.groupBy("year", "month").agg(*[
        F.count_if(F.col("_roll") <= lookup({m: float(v) for m, v in lim.items()}, month)).alias(f"_{i}") for i, lim in enumerate(rain_limits.values())])
    pairs = [F.struct(F.lit(f"{r}_{d}").alias("event"), (F.col(f"_{i}") >= lookup(nd, month)).alias("flag"))
             for i, r in enumerate(rain_limits) for d, nd in day_limits.items()]
    return counts.select("year", "month", F.explode(F.array(*pairs)).alias("_e")).select("year", "month", "_e.event", F.coalesce("_e.flag", F.lit(False)).alias("flag"))


def rolling_dry_recurrence(daily: DataFrame, day_limits: dict[str, dict[int, int]], rain_limits: dict[str, dict[int, float]] | None = None,
                           keys: Sequence[str] = (), window: int = 10, years: int = C.RECORD_YEARS, growth: Growth = None) -> DataFrame:
    return recurrence(rolling_dry_flags(daily, day_limits, rain_limits, keys, window), growth, years)


def cumulative_restriction_flags(daily: DataFrame, ndays: Sequence[int] = (1, 5, 7, 10, 14, 21, 25, 29)) -> DataFrame:
    """Months whose restriction sum reaches a number of full days."""
    months = daily.groupBy("year", "month").agg(F.sum("f_rest").alias("total"))
    return months.withColumn("nd", F.explode(F.array(*[F.lit(n) for n in ndays]))).select(
        "year", "month", F.format_string("%02d", "nd").alias("event"), (F.col("total") >= F.col("nd")).alias("flag"))


def cumulative_restriction_recurrence(daily: DataFrame, ndays: Sequence[int] = (1, 5, 7, 10, 14, 21, 25, 29), years: int = C.RECORD_YEARS, growth: Growth = None) -> DataFrame:
    return recurrence(cumulative_restriction_flags(daily, ndays), growth, years)


def spell_flags(daily: DataFrame, thresholds: dict[str, float] | None = None, con_days: Sequence[int] = (5, 7, 10),
                ndays: Sequence[int] = (5, 7, 10, 15, 20), keys: Sequence[str] = ()) -> DataFrame:
    """Months with a spell of at least l days and at least nd restricted days in all."""
    frames = []
    for name, t in (thresholds or C.REST_THRESHOLDS).items():
        spells = W.runs(daily, keys, "date", F.col("f_rest") >= t, ["year", "month"])
        summary = A.spell_summary(spells, daily)
        pairs = F.explode(F.array(*[F.struct(F.lit(length).alias("l"), F.lit(nd).alias("nd")) for length in con_days for nd in ndays]))
        frames.append(summary.withColumn("_p", pairs).select(
            "year", "month", F.format_string(f"%dd_{name}_%dtot", "_p.l", "_p.nd").alias("event"),
            ((F.col("max_length") >= F.col("_p.l")) & (F.col("total_days") >= F.col("_p.nd"))).alias("flag")))
    return reduce(DataFrame.unionByName, frames)


def spell_recurrence(daily: DataFrame, thresholds: dict[str, float] | None = None, con_days: Sequence[int] = (5, 7, 10),
                     ndays: Sequence[int] = (5, 7, 10, 15, 20), keys: Sequence[str] = (), years: int = C.RECORD_YEARS, growth: Growth = None) -> DataFrame:
    return recurrence(spell_flags(daily, thresholds, con_days, ndays, keys), growth, years)


def joint_recurrence(events: DataFrame, left: Sequence[str], right: Sequence[str], growth: DataFrame, years: int = C.RECORD_YEARS) -> DataFrame:
    """Per pair of definitions and month: probability that both occur, and the growth anomalies of those months."""
    pairs = intersect_months(events, left, right)
    hits = pairs.join(lookup_side(growth), ["year", "month"])
    return joint_probability(pairs, years).join(A.describe_by(hits, ["left", "right", "month"], "anomaly"), ["left", "right", "month"], "left")


def growth_anomaly_on(events: DataFrame, growth: DataFrame) -> DataFrame:
    """Describe of growth anomalies per month over listed (month, year)."""
    hits = growth.join(events.select("month", "year").distinct(), ["month", "year"], "left_semi")
    return A.describe_by(hits, ["month"], "anomaly")
