"""Ordered folds: the soil water bucket, whose state is carried from day to day.

A day maps the water at its start to the water at its end by a piecewise-linear function, and such functions compose. So a series needs no
single long fold: the days of each year are composed into one function, a scan over the years of a series hands each year its
first water, and the days of each year are then filled in. Years and months are folded side by side, all in generated or interpreted JVM code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshade.constants import MONTH_START_DEFICIT, SOIL_CAPACITY
from rainshade.functions.calendar import lookup, nonleap_doy
from rainshade.operators.windows import anomaly

DAY_ROWS = "array<struct<d:date,rain:double,pet:double,smd:double,drain:double,aet:double>>"


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once: as the variable of a one-element transform."""
    return F.transform(F.array(value), use)[0]


def _day(date: str, carry: Sequence[str] = ()) -> Column:
    """A day as (d, r, e) and a struct x of carried columns; missing and not-a-number are null."""
    def number(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)
    rest = [F.struct(*carry).alias("x")] if carry else []
    return F.struct(F.col(date).alias("d"), number("rain").alias("r"), number("pet").alias("e"), *rest)


def _uptake(water: Column, e: Column, a: float, p: float) -> Column:
    return F.least(e, a * e * water * p)


def _filled(water: Column, day: Column, a: float, p: float) -> Column:
    """Water after rain and uptake, before the surplus drains; null once a day is missing."""
    # least and greatest skip nulls, so a missing day must be told
    known = water.isNotNull() & day["r"].isNotNull() & day["e"].isNotNull()
    return F.when(known, F.greatest(water + day["r"] - _uptake(water, day["e"], a, p), F.lit(0.0)))


def _fold(days: Column, first: Column, capacity: float, a: float, p: float) -> Column:
    """Rows of DAY_ROWS for days in order from a first water."""
    zero = F.struct(first.cast("double").alias("w"), F.from_json(F.lit("[]"), DAY_ROWS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        def row(filled: Column) -> Column:
            water = F.when(filled.isNotNull(), F.least(filled, F.lit(capacity)))
            used = F.when(filled.isNotNull(), _uptake(acc["w"], x["e"], a, p))
            day = F.struct(x["d"].alias("d"), x["r"].alias("rain"), x["e"].alias("pet"), (water - capacity).alias("smd"), (filled - water).alias("drain"), used.alias("aet"))
            return F.struct(water.alias("w"), F.concat(acc["out"], F.array(day)).alias("out"))
        return _bind(_filled(acc["w"], x, a, p), row)
    return F.aggregate(days, zero, step, lambda acc: acc["out"])


def _bends(day: Column, capacity: float, a: float, p: float) -> Column:
    """Waters at which the function of a day bends: where uptake turns from a share of the water to the whole demand, and where it meets 0 or the capacity."""
    r, e = day["r"], day["e"]
    if a * p <= 0:
        return F.array(capacity - r, -r)
    kink = 1 / (a * p)
    share = a * p * e

    # a share below the kink and the demand above it; the other way round for a negative demand
    def on_share(x: Column) -> Column:
        return F.when((share != 1) & ((x < kink) == (e >= 0)), x)

    def on_demand(x: Column) -> Column:
        return F.when((x > kink) == (e >= 0), x)
    slope = F.when(share != 1, 1 - share)
    return F.array(F.lit(kink), on_share((capacity - r) / slope), on_share(-r / slope), on_demand(capacity - r + e), on_demand(e - r))


def composed(days: Column, capacity: float = SOIL_CAPACITY, a: float = 0.0073, p: float = 1.0) -> Column:
    """The function of several days as its knots, an array of (x, y) from x = 0 to x = capacity; null where a day is missing.

    Per day, knots are set where the water so far meets a bend of the day, all values pass through the day, and knots inside a flat part go. Wet and dry
    spells flatten a function, so that few knots are left.
    """
    def knot(x, y) -> Column:
        return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))

    def step(acc: Column, day: Column) -> Column:
        def cuts(bends: Column) -> Column:
            def inside(k: Column, i: Column) -> Column:
                def between(n: Column) -> Column:
                    met = F.filter(bends, lambda b: (b - k["y"]) * (b - n["y"]) < 0)
                    return F.transform(met, lambda b: knot(k["x"] + (b - k["y"]) / (n["y"] - k["y"]) * (n["x"] - k["x"]), b))
                # the last knot has no next one; its own is never beyond a bend
                return _bind(F.coalesce(F.get(acc, i + 1), k), between)
            return F.array_sort(F.concat(acc, F.flatten(F.transform(acc, inside))))

        moved = F.transform(_bind(_bends(day, capacity, a, p), cuts), lambda k: knot(k["x"], F.least(_filled(k["y"], day, a, p), F.lit(capacity))))

        def thin(m: Column) -> Column:
            def flat(k: Column, i: Column) -> Column:
                before, after = F.get(m, i - 1), F.get(m, i + 1)
                return before.isNull() | after.isNull() | (before["y"] != k["y"]) | (after["y"] != k["y"])
            return F.filter(m, flat)
        return _bind(moved, thin)
    known = ~F.exists(days, lambda x: x["r"].isNull() | x["e"].isNull())
    return F.when(known, F.aggregate(days, F.array(knot(0.0, 0.0), knot(capacity, capacity)), step))


def evaluate(knots: Column, x: Column) -> Column:
    """The function at x, linear between its knots."""
    def ends(pair: Column) -> Column:
        lo, hi = pair["lo"], pair["hi"]
        return F.when(lo["x"] == hi["x"], lo["y"]).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (x - lo["x"]) / (hi["x"] - lo["x"]))
    below, above = F.filter(knots, lambda k: k["x"] <= x), F.filter(knots, lambda k: k["x"] >= x)
    return _bind(F.struct(F.get(below, F.size(below) - 1).alias("lo"), F.get(above, F.lit(0)).alias("hi")), ends)


def soil_moisture_deficit(df: DataFrame, keys: Sequence[str], date: str = "date", capacity: float = SOIL_CAPACITY,
                          start: float = 1.0, a: float = 0.0073, p: float = 1.0) -> DataFrame:
    """Daily smd, drain and aet of a bucket per series; start is the filled share of capacity (0-1).

    The work is one group of days per (series, year): the first pass composes its days, a scan over the years of a series gives each its first
    water, the second pass fills in the days. Days are taken in order of date, those of one date in order of rain. From a day without
    rain or pet on, the series is null. An empty table gives no rows.
    """
    if not 0 <= start <= 1:
        raise ValueError("start must be a share between 0 and 1")
    years = df.groupBy(*keys, F.year(date).alias("_y")).agg(F.array_sort(F.collect_list(_day(date))).alias("_days"))
    maps = years.select(*keys, F.struct("_y", composed(F.col("_days"), capacity, a, p).alias("f")).alias("_m"))
    zero = F.struct(F.lit(capacity * start).alias("w"), F.from_json(F.lit("[]"), "array<struct<y:int,w:double>>").alias("out"))

    def scan(acc: Column, m: Column) -> Column:
        after = F.when(m["f"].isNotNull() & acc["w"].isNotNull(), evaluate(m["f"], acc["w"]))
        return F.struct(after.alias("w"), F.concat(acc["out"], F.array(F.struct(m["_y"].alias("y"), acc["w"].alias("w")))).alias("out"))
    ordered = F.array_sort(F.collect_list("_m"), lambda x, y: x["_y"] - y["_y"])
    starts = maps.groupBy(*keys).agg(F.aggregate(ordered, zero, scan, lambda acc: acc["out"]).alias("_s")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.inline("_s"))
    # keys may be null
    same = F.col("_y").eqNullSafe(F.col("y"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    filled = years.join(starts, same).select(*keys, F.explode(_fold(F.col("_days"), F.col("w"), capacity, a, p)).alias("_o"))
    return filled.select(*keys, F.col("_o.d").alias(date), *[F.col(f"_o.{c}").alias(c) for c in ("rain", "pet", "smd", "drain", "aet")])


def soil_moisture_deficit_monthly(df: DataFrame, keys: Sequence[str], date: str = "date", capacity: float = SOIL_CAPACITY,
                                  month_start: dict[int, float] | None = None, a: float = 0.0073, p: float = 1.0, carry: Sequence[str] = ()) -> DataFrame:
    """The same bucket restarted on day 1 of each month at a fixed deficit; parallel over (series, year, month).

    Columns named in `carry` (of types with an order) pass through, so that no join brings them back.
    """
    begin = lookup({m: float(v) for m, v in (month_start or MONTH_START_DEFICIT).items()}, F.month("_first"))
    months = (df.groupBy(*keys, F.year(date).alias("_y"), F.month(date).alias("_m"))
              .agg(F.array_sort(F.collect_list(_day(date, carry))).alias("_days"), F.min(date).alias("_first")))
    folded = _fold(F.col("_days"), begin + capacity, capacity, a, p)
    both = months.withColumn("_b", F.explode(F.zip_with("_days", folded, lambda day, out: F.struct(day.alias("i"), out.alias("o")))))
    return both.select(*keys, F.col("_b.o.d").alias(date), *[F.col(f"_b.o.{c}").alias(c) for c in ("rain", "pet", "smd", "drain", "aet")],
                       *[F.col(f"_b.i.x.{c}").alias(c) for c in carry])


def soil_moisture_anomaly(smd: DataFrame, keys: Sequence[str], date: str = "date", years: tuple[int, int] | None = (1981, 2010),
                          over: str = "doy") -> DataFrame:
    """Deficit minus its day-of-year mean over the given years, or minus the mean over all simulations per day.

    over='doy' groups by (keys, day of year of the 365-day calendar); over='day' groups by date alone.
    """
    dated = smd.withColumns({"doy": nonleap_doy(F.col(date)), "year": F.year(date)})
    group = [*keys, "doy"] if over == "doy" else [date]
    return anomaly(dated, group, "smd", "mean", years if over == "doy" else None, out="sma").drop("sma_rel")


def doy_mean_table(smd: DataFrame, keys: Sequence[str], date: str = "date", years: tuple[int, int] | None = None) -> DataFrame:
    """The exported table of mean deficit per day of year."""
    value = F.when(F.year(date).between(*years), F.col("smd")) if years else F.col("smd")
    return smd.groupBy(*keys, nonleap_doy(F.col(date)).alias("doy")).agg(F.avg(value).alias("smd"))
