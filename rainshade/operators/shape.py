"""Projections and filters: renames, units, thresholds, long and wide forms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import scalars as S
from rainshade.functions.calendar import lookup, month_days
from rainshade.operators.joins import lookup_side

# Unit conversions, source unit -> (factor, offset).
UNITS = {"kelvin": (1.0, -273.15), "kg_m2_s": (86400.0, 0.0), "w_m2": (86400e-6, 0.0)}


def rename_select(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep only the mapped columns under their canonical names, so scans read nothing else."""
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items()])


def convert_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Kelvin to Celsius, kg/m2/s to mm/day, W/m2 to MJ/m2/day by column."""
    return df.withColumns({c: F.col(c) * UNITS[u][0] + UNITS[u][1] for c, u in units.items()})


def derived_weather(df: DataFrame) -> DataFrame:
    """Mean temperature, rain minus evaporation and wet-day flag (rain above 0.01)."""
    return df.withColumns({"tmean": (F.col("tmax") + F.col("tmin")) / 2, "rain_less_pet": F.col("rain") - F.col("pet"),
                           "wet_day": F.col("rain") > 0.01})


def season_mask(df: DataFrame, columns: dict[str, Sequence[int]], month: str = "month") -> DataFrame:
    """Set a class back to 0 outside the months where it is defined."""
    return df.withColumns({c: F.when(F.col(month).isin(*ms), F.col(c)).otherwise(0) for c, ms in columns.items()})


def year_range(df: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    return df.where(F.col(year).between(first, last))


def number_key(x: float, width: int) -> str:
    return f"{x:0{width}d}" if isinstance(x, int) else str(x)


def threshold_flags(grid: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """Conditional day counts of a fixed grid of flags; they aggregate map-side, nothing is exploded."""
    return {k: F.sum(F.when(flag, 1).otherwise(0)) for k, flag in grid}


def threshold_grid(df: DataFrame, keys: Sequence[str], grid: Sequence[tuple[str, Column]],
                   ndays: Sequence[int]) -> DataFrame:
    """Monthly flags for every (daily flag, number of days): columns keys, event, days, flag.

    One partial aggregation counts the days of all flags; the long form is an unpivot of the small
    monthly result, named like `10d_<flag>`.
    """
    counts = df.groupBy(*keys).agg(*[e.alias(k) for k, e in threshold_flags(grid).items()])
    names = [k for k, _ in grid]
    long = counts.unpivot(list(keys), names, "criterion", "days")
    nd = F.explode(F.array(*[F.lit(n) for n in ndays]))
    return (long.withColumn("nd", nd)
            .select(*keys, F.format_string("%02dd_%s", "nd", "criterion").alias("event"), "days",
                    (F.col("days") >= F.col("nd")).alias("flag")))


def monthly_threshold(df: DataFrame, limits: DataFrame, candidates: Sequence[str], month: str = "month") -> DataFrame:
    """Join limits (month, var, threshold, ndays) and flag by the variable that month tests."""
    value = F.coalesce(*[F.when(F.col("var") == v, F.col(v)) for v in candidates])
    return df.join(lookup_side(limits), month).withColumn("day_flag", value >= F.col("threshold"))


def bounded_suite(df: DataFrame, bounds: DataFrame, story: str = "story_id") -> DataFrame:
    """Stories whose every bounded value lies inside its inclusive limits; null limit = unbounded.

    df is long (story, site, mode, period, value); bounds is (site, mode, period, low, high). A missing
    value fails its bound; a bound with both limits null asks nothing, and without any bound all stories stay. Count of satisfied bounds per story is compared with the number of bounds.
    """
    real = bounds.where(F.col("low").isNotNull() | F.col("high").isNotNull())
    n_bounds = real.count()
    if not n_bounds:
        return df.select(story).distinct()
    inside = ((F.col("low").isNull() | (F.col("value") >= F.col("low")))
              & (F.col("high").isNull() | (F.col("value") <= F.col("high"))) & F.col("value").isNotNull())
    return (df.join(lookup_side(real), ["site", "mode", "period"]).groupBy(story)
            .agg(F.count_if(inside).alias("_ok")).where(F.col("_ok") == n_bounds).drop("_ok"))


def require_rows(df: DataFrame, message: str = "the suite is empty") -> DataFrame:
    """Return df, or raise where it has no row (one task reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def state_limited(stories: DataFrame, limits: dict[int, dict], story: str = "story_id") -> DataFrame:
    """Stories where every listed month has allowed classes and quantile; '*' or absent = any.

    limits: month -> {'temp': set or '*', 'precip': set or '*', 'rest_per': (low, high)}.
    The limits become one boolean expression, so the check is one grouped pass without a join.
    """
    ok, listed = F.lit(False), F.col("month").isin(*limits)
    for m, lim in limits.items():
        cond = F.col("month") == m
        for name, column in (("temp", "temp_class"), ("precip", "precip_class")):
            if lim.get(name, "*") != "*":
                cond = cond & F.col(column).isin(*sorted(lim[name]))
        if lim.get("rest_per", "*") != "*":
            cond = cond & F.col("rest_per").between(*lim["rest_per"])
        ok = ok | cond
    return (stories.where(listed).groupBy(story)
            .agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_all"), F.count_distinct("month").alias("_n"))
            .where(F.col("_all") & (F.col("_n") == len(limits))).select(story))


def keep_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with null, NaN or infinite values in the columns."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(cond)


def growth_correction(df: DataFrame, value: str = "pg") -> DataFrame:
    """Fixed winter growth in months 6-8, a factor elsewhere; store modes use the irrigated constants."""
    mode = F.when(F.col("mode").startswith("store"), "irrigated").otherwise(F.col("mode"))
    fixed = {f"{m}|{s}|{k}": float(rate * C.MONTH_LENGTH[k])
             for (m, s), by_month in C.WINTER_RATE.items() for k, rate in by_month.items()}
    winter = lookup(fixed, F.concat_ws("|", mode, F.col("site"), F.col("month").cast("string")))
    factor = lookup(C.MONTH_FACTOR, F.col("month").cast("int"))
    return df.withColumn(value, F.when(F.col("month").isin(6, 7, 8), winter).otherwise(F.col(value) * factor))


def yearly_growth(df: DataFrame, keys: Sequence[str], value: str = "pg") -> DataFrame:
    """Year total from the months, null when a month is missing."""
    total = F.when(F.count(value) == 12, F.sum(value))
    return df.groupBy(*keys).agg(total.alias(f"{value}_yr1"))


def normalise_to_mode(df: DataFrame, old_base: DataFrame, new_base: DataFrame, value: str = "pg") -> DataFrame:
    """value x (old base / new base) per (story, site, month)."""
    keys = ["story_id", "site", "month"]
    return (df.join(old_base.select(*keys, F.col(value).alias("_old")), keys)
            .join(new_base.select(*keys, F.col(value).alias("_new")), keys)
            .withColumn(value, F.col(value) * F.try_divide(F.col("_old"), F.col("_new"))).drop("_old", "_new"))


def ratio_to_mode(df: DataFrame, base_mode: str, value: str = "pg", out: str = "ratio") -> DataFrame:
    """value / value of the base mode of the same story, site and month, in one grouped window."""
    from pyspark.sql import Window
    w = Window.partitionBy("story_id", "site", "month")
    base = F.max(F.when(F.col("mode") == base_mode, F.col(value))).over(w)
    return df.withColumn(out, F.try_divide(F.col(value), base))


def to_daily_rate(df: DataFrame, value: str = "pg", month: str | None = "month") -> DataFrame:
    days = month_days(F.col(month)) if month else F.lit(365)
    return df.withColumn(value, F.col(value) / days)


def difference_dataset(linked: DataFrame, unlinked: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    right = unlinked.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return linked.join(right, list(keys)).select(*keys, *[(F.col(v) - F.col(f"_{v}")).alias(v) for v in values])


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name",
                 value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def long_to_wide(df: DataFrame, ids: Sequence[str], name: str, values: Sequence, agg: Column) -> DataFrame:
    """Pivot with the wanted values given, so Spark needs no extra pass to find them."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(agg)


def split_growth_names(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """`{site}-{mode}_pg_m{mm}` / `_pg_yr1` columns to (site, mode, period, value)."""
    names = [c for c in df.columns if "_pg_" in c]
    pattern = r"^(.+)-(.+)_pg_(.+)$"
    return (df.unpivot(list(ids), names, "_n", "value")
            .select(*ids, F.regexp_extract("_n", pattern, 1).alias("site"),
                    F.regexp_extract("_n", pattern, 2).alias("mode"),
                    F.regexp_extract("_n", pattern, 3).alias("period"), "value"))


def parse_tuple(text: Column) -> tuple[Column, Column]:
    """'(month, year)' to two ints, blank to null."""
    pattern = r"\(\s*(-?\d+)(?:\.0)?\s*,\s*(-?\d+)(?:\.0)?\s*\)"
    first, second = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return (F.when(first != "", first).cast("int"), F.when(second != "", second).cast("int"))


def filter_month_regime(daily: DataFrame, classes: DataFrame, month: int = 0, regime: int = 0,
                        same_rain_class: bool = False) -> DataFrame:
    """Daily rows whose (year, month) class is the regime; 0 = all; optionally the 3 regimes of its rain class."""
    out = daily.join(lookup_side(classes.select("year", "month", "regime")), ["year", "month"])
    if month:
        out = out.where(F.col("month") == month)
    if regime:
        out = (out.where(F.col("regime") % 3 == regime % 3) if same_rain_class
               else out.where(F.col("regime") == regime))
    return out


def columns_containing(df: DataFrame, *parts: str, exclude: bool = False) -> list[str]:
    """Column names that contain any of the parts (or none of them)."""
    return [c for c in df.columns if any(p in c for p in parts) != exclude]


def apply_rule(df: DataFrame, column: str, rule: Callable[[Column], Column], out: str) -> DataFrame:
    """A user scalar rule, such as flow -> restriction, as a Column expression."""
    return df.withColumn(out, rule(F.col(column)))


def clean_restriction(df: DataFrame, column: str = "f_rest") -> DataFrame:
    return df.withColumn(column, S.clean_restriction(F.col(column)))
