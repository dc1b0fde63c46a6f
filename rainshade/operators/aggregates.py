"""Grouped statistics, quantiles, histograms and exceedance curves.

Every aggregation combines map-side before its shuffle. Exact quantiles of groups that grow with the
data go through `quantiles`, which ranks value counts inside narrow value bins and never holds a group
in one task; `percentile` is used only where a group is bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade.constants import RECORD_YEARS, SITE_MODES, TARGET_RANGES
from rainshade.functions import scalars as S
from rainshade.functions.calendar import month_days
from rainshade.operators.joins import interp_join, lookup_side, resident
from rainshade.operators.shape import long_to_wide

Agg = Callable[[Column], Column]
AGGREGATES: dict[str, Agg] = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median,
                              "count": F.count, "std": F.stddev_samp}


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def resolve(fun: str | Agg) -> Agg:
    """An aggregate by name or a user function Column -> Column (also a grouped-agg pandas UDF)."""
    if callable(fun):
        return fun
    if fun not in AGGREGATES:
        raise ValueError(f"unknown aggregate {fun}, use one of {sorted(AGGREGATES)}")
    return AGGREGATES[fun]


@dataclass(frozen=True)
class UserAggregate:
    """A user's aggregate as four functions on a state, a list of numbers of fixed length.

    zero() is the state of no values, update(state, values) takes in a numpy array, merge(a, b) joins two states and finish(state) gives the result.
    merge must not care about order, as tasks end in any order.
    """

    zero: Callable[[], Sequence[float]]
    update: Callable[[Sequence[float], np.ndarray], Sequence[float]]
    merge: Callable[[Sequence[float], Sequence[float]], Sequence[float]]
    finish: Callable[[Sequence[float]], float | None]


HELD_KEYS = 100_000


def user_aggregate(df: DataFrame, keys: Sequence[str], value: str, fun: UserAggregate, out: str = "value") -> DataFrame:
    """(keys, out): a user's aggregate of a value per key; nulls and not-a-numbers are left out, and a key of nothing else gets finish(zero()).

    Every task keeps one state per key and sends states, not values: a key of any size reaches its last task as one short row per task. A task that
    meets over HELD_KEYS keys sends what it holds and goes on. An empty table gives no rows.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Sequence[float]] = {}

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(list(states), columns=names, dtype=object)
            frame["_state"] = [[float(x) for x in s] for s in states.values()]
            return frame
        for pdf in batches:
            groups = pdf.groupby(names, dropna=False, sort=False)["_v"] if names else [((), pdf["_v"])]
            for key, values in groups:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                clean = values.to_numpy(float)
                states[key] = fun.update(states.get(key, fun.zero()), clean[~np.isnan(clean)])
            if len(states) > HELD_KEYS:
                yield flush()
                states = {}
        if states:
            yield flush()

    def final(states: pd.Series) -> float:
        done = fun.zero()
        for s in states:
            done = fun.merge(done, list(s))
        return fun.finish(done)
    parts = rows.mapInPandas(partial, f"{kinds}{', ' if kinds else ''}_state array<double>")
    merged = F.pandas_udf(_typed(final), "double")
    return parts.groupBy(*keys).agg(merged("_state").alias(out))


def _typed(final: Callable[[pd.Series], float]) -> Callable[[pd.Series], float]:
    """The hints of a grouped aggregate, which a nested function under postponed annotations does not carry."""
    def run(states):
        return final(states)
    run.__annotations__ = {"states": pd.Series, "return": float}
    return run


# n and the sum of logarithms; a value of 0 or less has no geometric mean
GEOMETRIC_MEAN = UserAggregate(lambda: (0.0, 0.0), lambda s, v: (s[0] + len(v), s[1] + float(np.log(v).sum())) if (v > 0).all() else (float("nan"), 0.0),
                               lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: None if not s[0] > 0 else math.exp(s[1] / s[0]))


def monthly(df: DataFrame, values: Sequence[str], fun: str | Agg = "mean", keys: Sequence[str] = ("year", "month")) -> DataFrame:
    """Monthly sum or mean, NaN skipped."""
    f = resolve(fun)
    return df.groupBy(*keys).agg(*[f(nan_to_null(F.col(v))).alias(v) for v in values])


def agg_map(df: DataFrame, keys: Sequence[str], how: dict[str, str], date: str = "date") -> DataFrame:
    """Mixed aggregates per column; 'first' is the value at the earliest date."""
    def one(c: str, f: str) -> Column:
        return (F.min_by(c, date) if f == "first" else resolve(f)(F.col(c))).alias(c)
    return df.groupBy(*keys).agg(*[one(c, f) for c, f in how.items()])


FINE = 4096


def value_bin(x: Column, per_efold: int = 4096) -> Column:
    """A bin number that never falls as x rises and depends on x alone; never null."""
    finite = F.greatest(F.least(x, F.lit(1e300)), F.lit(-1e300))
    return F.coalesce(F.floor(F.signum(finite) * F.log1p(F.abs(finite)) * per_efold).cast("long"), F.lit(0))


def ranked_counts(df: DataFrame, keys: Sequence[str], value: str, wanted: Callable[[Column, Column, Column], Column] | None = None,
                  bins_per_efold: int = 4096) -> DataFrame:
    """Distinct values per key with their zero-based rank range [_lo, _hi) and the key's size _n, for groups of any size.

    1. Count equal values per key (combined map-side). 2. Sum the counts in bins that are a monotone function of the value alone, and
    rank the bins per key: a few ten thousand rows at most. 3. Cut each bin into FINE equal parts between its own least and greatest value, so
    values that lie close together are spread out as well, and rank the parts. 4. Rank values inside their own part only. With
    `wanted(start, end, n)` only bins and parts that satisfy it go on, so most values never reach the sort.
    """
    v = F.col(value).cast("double")
    counts = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, (v + F.lit(0.0)).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", value_bin(F.col("_v"), bins_per_efold)))

    def offsets(sums: DataFrame, within: Sequence[str], by: str, before: Column) -> DataFrame:
        run = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("_off", before + F.coalesce(F.sum("_s").over(run), F.lit(0)))

    def needed(sums: DataFrame) -> DataFrame:
        return sums if wanted is None else sums.where(wanted(F.col("_off"), F.col("_off") + F.col("_s"), F.col("_n")))

    bins = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    bins = offsets(bins, keys, "_b", F.lit(0)).withColumn("_n", F.sum("_s").over(Window.partitionBy(*keys)))
    in_bins = counts.join(needed(bins).drop("_s"), [*keys, "_b"])
    width = F.col("_most") - F.col("_least")
    part = F.when(width > 0, F.floor(F.least((F.col("_v") - F.col("_least")) / width * FINE, F.lit(FINE - 1.0)))).otherwise(F.lit(0)).cast("int")
    in_bins = in_bins.withColumn("_p", F.coalesce(part, F.lit(0)))
    parts = in_bins.groupBy(*keys, "_b", "_p").agg(F.sum("_c").alias("_s"), F.first("_off").alias("_from"), F.first("_n").alias("_n"))
    parts = needed(offsets(parts, [*keys, "_b"], "_p", F.col("_from"))).select(*keys, "_b", "_p", F.col("_off").alias("_start"))
    near = in_bins.join(parts, [*keys, "_b", "_p"])
    inner = Window.partitionBy(*keys, "_b", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.col("_start") + F.sum("_c").over(inner)
    return near.select(*keys, "_v", "_c", "_n", hi.alias("_hi")).withColumn("_lo", F.col("_hi") - F.col("_c"))


def refined_counts(df: DataFrame, keys: Sequence[str], value: str, wanted: Callable[[Column, Column, Column], Column], bins_per_efold: int = 256) -> DataFrame:
    """ranked_counts for wanted ranks alone, by histograms that are refined where a wanted rank lies.

    The first pass counts rows per bin of values, the second counts FINE equal parts of the bins that hold a wanted rank, the third moves the values of
    the wanted parts and ranks them. Bins, parts and their bounds combine map-side, and the bins and parts to go on with are broadcast after a check
    of their size; so no other row reaches an exchange. Where too many bins are wanted (many small keys), values are ranked at once.
    The input is read once per pass: store it first where it is dear.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, (v + F.lit(0.0)).alias("_v")).withColumn("_b", value_bin(F.col("_v"), bins_per_efold))

    def offsets(sums: DataFrame, within: Sequence[str], by: str, before: Column) -> DataFrame:
        run = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("_off", before + F.coalesce(F.sum("_s").over(run), F.lit(0)))

    def needed(sums: DataFrame) -> tuple[DataFrame, int | None]:
        return resident(sums.where(wanted(F.col("_off"), F.col("_off") + F.col("_s"), F.col("_n"))))
    bins = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_s"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    total = F.sum("_s").over(Window.partitionBy(*keys))
    chosen, size = needed(offsets(bins, keys, "_b", F.lit(0)).withColumn("_n", total))
    if size is None:
        return ranked_counts(df, keys, value, wanted)
    in_bins = rows.join(F.broadcast(chosen.drop("_s")), [*keys, "_b"])
    width = F.col("_most") - F.col("_least")
    part = F.when(width > 0, F.floor(F.least((F.col("_v") - F.col("_least")) / width * FINE, F.lit(FINE - 1.0)))).otherwise(F.lit(0)).cast("int")
    in_bins = in_bins.withColumn("_p", F.coalesce(part, F.lit(0)))
    parts = in_bins.groupBy(*keys, "_b", "_p").agg(F.count(F.lit(1)).alias("_s"), F.first("_off").alias("_from"), F.first("_n").alias("_n"))
    chosen, size = needed(offsets(parts, [*keys, "_b"], "_p", F.col("_from")).select(*keys, "_b", "_p", "_off", "_s", "_n"))
    if size is None:
        return ranked_counts(df, keys, value, wanted)
    near = in_bins.drop("_n", "_off").join(F.broadcast(chosen.select(*keys, "_b", "_p", F.col("_off").alias("_start"), "_n")), [*keys, "_b", "_p"])
    counts = near.groupBy(*keys, "_b", "_p", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_start").alias("_start"), F.first("_n").alias("_n"))
    inner = Window.partitionBy(*keys, "_b", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.col("_start") + F.sum("_c").over(inner)
    return counts.select(*keys, "_v", "_c", "_n", hi.alias("_hi")).withColumn("_lo", F.col("_hi") - F.col("_c"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], refine: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles per key as rows (keys, q, value), for groups of any size.

    refine suits large tables that are cheap to read again: three passes, but only values near a quantile are shuffled (`refined_counts`).
    """
    wanted = F.array(*[F.lit(float(q)) for q in probs])

    def position(q: Column, n: Column) -> Column:
        return q * (n - 1)

    ranked = (refined_counts if refine else ranked_counts)(df, keys, value, lambda start, end, n: F.exists(
        wanted, lambda q: (F.floor(position(q, n)) < end) & (F.ceil(position(q, n)) >= start)))

    def inside(rank: Column) -> Column:
        return (rank >= F.col("_lo")) & (rank < F.col("_hi"))

    n = F.col("_n")
    hits = F.filter(wanted, lambda q: inside(F.floor(position(q, n))) | inside(F.ceil(position(q, n))))
    rows = ranked.where(F.size(hits) > 0).withColumn("q", F.explode(hits))
    pos = position(F.col("q"), n)
    picked = rows.groupBy(*keys, "q").agg(
        F.max(F.when(inside(F.floor(pos)), F.col("_v"))).alias("_a"),
        F.max(F.when(inside(F.ceil(pos)), F.col("_v"))).alias("_z"), F.max(pos - F.floor(pos)).alias("_f"))
    return picked.select(*keys, "q", (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias("value"))


def describe_by(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75), refine: bool = False) -> DataFrame:
    """count, mean, sample std, min, percentiles, max per key; percentile columns are named p25, p50 ...; refine as for `quantiles`."""
    base = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"),
                                 F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    names = {q: f"p{round(q * 100):02d}" for q in percentiles}
    wide = (quantiles(df, keys, value, percentiles, refine).groupBy(*keys)
            .agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in names.items()]))
    return base.join(wide, list(keys), "left").select(*keys, "count", "mean", "std", "min", *names.values(), "max")


def occurrence(df: DataFrame, keys: Sequence[str], flag: str = "flag", years: int | None = None) -> DataFrame:
    """Number of flagged rows and their share of the group, or of a fixed number of years."""
    hits = F.sum(F.col(flag).cast("int"))
    share = hits / F.lit(years) if years else F.avg(F.col(flag).cast("int"))
    return df.groupBy(*keys).agg(hits.alias("sum"), share.alias("prob"))


def class_limits(months: DataFrame, values: Sequence[str], low: float = 0.25, high: float = 0.75,
                 keys: Sequence[str] = ("month",)) -> DataFrame:
    """Exact lower and upper quantile of each variable per calendar month of one record.

    A group holds one row per year, so `percentile` is bounded by the calendar.
    """
    aggs = [F.percentile(v, q).alias(f"{v}_{n}") for v in values for n, q in (("low", low), ("high", high))]
    return months.groupBy(*keys).agg(*aggs)


def quantile_table(df: DataFrame, value: str = "rest", keys: Sequence[str] = ("combo", "month"),
                   combos: Sequence[str] = ("D-D", "D-ND", "ND-D", "ND-ND"), months: Sequence[int] = (9, 10, 11, 12, 1, 2, 3, 4), refine: bool = False) -> DataFrame:
    """99 quantiles of monthly restriction per (class combo, month); groups without data give 0, zeros 1e-8."""
    probs = [i / 100 for i in range(1, 100)]
    found = quantiles(df.where(F.col(keys[1]).isin(*months)), keys, value, probs, refine)
    grid = (df.sparkSession.range(1, 100).select((F.col("id") / 100).alias("q"))
            .withColumn(keys[0], F.explode(F.array(*[F.lit(c) for c in combos])))
            .withColumn(keys[1], F.explode(F.array(*[F.lit(m) for m in months]))))
    full = grid.withColumn("_q", F.round(F.col("q") * 100).cast("int")).join(
        found.select(*keys, F.round(F.col("q") * 100).cast("int").alias("_q"), "value"), [*keys, "_q"], "left").drop("_q")
    v = F.coalesce("value", F.lit(0.0))
    return full.select(*keys, "q", F.when(F.abs(v) <= 1e-8, 1e-8).otherwise(v).alias("rest"))


def percentile_curve(df: DataFrame, keys: Sequence[str], value: str, refine: bool = False) -> DataFrame:
    """Percentiles 0..100 of annual growth per key, NaN skipped; refine as for `quantiles`."""
    out = quantiles(df, keys, value, [i / 100 for i in range(101)], refine)
    return out.select(*keys, F.round(F.col("q") * 100).cast("int").alias("percentile"), "value")


def state_frequency(events: DataFrame, years: float = RECORD_YEARS) -> DataFrame:
    return events.groupBy("month", "state").agg((F.count(F.lit(1)) / F.lit(years)).alias("freq"))


def months_by_class(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct months in which each class or class pair occurred, sorted (at most 12 per class)."""
    return events.groupBy(*columns).agg(F.array_sort(F.collect_set("month")).alias("months"))


def median_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", refine: bool = False) -> DataFrame:
    return quantiles(df, keys, value, [0.5], refine).select(*keys, F.col("value").alias(out))


def count_days(df: DataFrame, keys: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Days that satisfy each condition; groups with none give 0."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()])


def probability_mass(df: DataFrame, selected: Column, log10p: str = "log10_prob") -> DataFrame:
    """Share of the whole suite's probability held by the selected rows, in one pass."""
    p = S.pow10(F.col(log10p))
    return df.agg((F.sum(F.when(selected, p).otherwise(0.0)) / F.sum(p)).alias("mass"))


def cluster_mass(df: DataFrame, cluster: str = "cluster", log10p: str = "log10_prob") -> DataFrame:
    """Per cluster: size, share of probability and share per story."""
    per = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.sum(S.pow10(F.col(log10p))).alias("_p"))
    total = F.sum("_p").over(Window.partitionBy(F.lit(1)))
    return (per.withColumn("share", F.try_divide(F.col("_p"), total))
            .withColumn("share_per_story", F.col("share") / F.col("size")).drop("_p"))


def restriction_cdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Reverse cumulative shares over {=0, (0,.25), (.25,.5), (.5,.75), (.75,1), =1} then 0.

    Edges are strict as published, so values exactly on .25, .5 and .75 count nowhere. No data gives 0.
    """
    v = F.col(value)
    bins = [v == 0, (v > 0) & (v < 0.25), (v > 0.25) & (v < 0.5), (v > 0.5) & (v < 0.75), (v > 0.75) & (v < 1), v == 1]
    counts = df.groupBy(*keys).agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(bins)])
    total = sum((F.col(f"_{i}") for i in range(1, 6)), F.col("_0"))
    shares = []
    for i in range(6):
        tail = sum((F.col(f"_{j}") for j in range(i + 1, 6)), F.col(f"_{i}"))
        shares.append(F.coalesce(F.try_divide(tail, total), F.lit(0.0)))
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("edge"), s.alias("share"))
                       for i, (e, s) in enumerate(zip((0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0), [*shares, F.lit(0.0)]))])
    return counts.select(*keys, F.explode(points).alias("p")).select(*keys, "p.i", "p.edge", "p.share")


def impact_histogram(df: DataFrame, keys: Sequence[str], value: str, step: float = 0.1) -> DataFrame:
    """Shares of rows in half-open bins of half a step from round(min - step) to round(max + step).

    Empty bins are kept. The bin number is arithmetic, counts combine map-side, and the bin list per key
    is bounded by range / step.
    """
    decimals = len(str(step).split(".")[-1])
    half = step / 2
    ends = df.groupBy(*keys).agg(F.bround(F.min(value) - step, decimals).alias("_a"),
                                 F.bround(F.max(value) + step, decimals).alias("_z"), F.count(value).alias("_n"))
    scale = 2 * 10 ** decimals
    # with a start on the decimal grid, bin numbers are exact in units of half a step from zero
    unit = round(half * scale)
    counts = (df.where(F.col(value).isNotNull())
              .withColumn("_i", F.floor(F.round(F.col(value) * (scale / unit), 9)).cast("long"))
              .groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("_c")))
    first = F.floor(F.round(F.col("_a") * (scale / unit), 6)).cast("long")
    last = F.ceil(F.round(F.col("_z") * (scale / unit), 6)).cast("long")
    grid = ends.select(*keys, "_n", F.explode(F.sequence(first, last)).alias("_i"))
    return (grid.join(counts, [*keys, "_i"], "left")
            .select(*keys, F.col("_i").alias("bin"), ((F.col("_i") + 0.5) * half).alias("centre"),
                    (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("share")))


def exceedance_curve(df: DataFrame, keys: Sequence[str], value: str, step: float = 0.1, more: bool = True) -> DataFrame:
    """Share of rows in bins at or above (or at or below) each bin centre."""
    hist = impact_histogram(df, keys, value, step)
    w = Window.partitionBy(*keys).orderBy(F.desc("bin") if more else F.asc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(*keys, "bin", F.col("centre").alias("pg"), F.sum("share").over(w).alias("prob"))


def exceedance_at(curve: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Growth at each exceedance probability by linear interpolation; outside the curve is an error.

    The curve is small (bins per key); the wanted probabilities expand each key's first row.
    """
    grid = (curve.groupBy(*keys).agg(F.min("prob").alias("_min"), F.max("prob").alias("_max"))
            .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))))
    outside = (F.col("prob") < F.col("_min")) | (F.col("prob") > F.col("_max"))
    checked = grid.withColumn("prob", F.when(outside, F.raise_error(F.lit("probability outside the curve")).cast("double"))
                              .otherwise(F.col("prob"))).drop("_min", "_max")
    return interp_join(checked, "prob", curve, "prob", "pg", "pg", keys, True, (0.0, 1.0), order="pg")


def density_2d(df: DataFrame, x: str, y: str, nbins: int, keys: Sequence[str] = ()) -> DataFrame:
    """(nbins-1)^2 cells between nbins equally spaced edges; share of rows, empty cells left out, last edge closed."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranges = df.groupBy(*keys).agg(*[f(c).alias(f"_{c}_{n}") for c in (x, y) for n, f in (("a", F.min), ("z", F.max))],
                                   F.count(F.lit(1)).alias("_n"))
    m = nbins - 1

    def cell(c: str) -> Column:
        scaled = F.try_divide(F.col(c) - F.col(f"_{c}_a"), F.col(f"_{c}_z") - F.col(f"_{c}_a")) * m
        return F.least(F.floor(F.coalesce(scaled, F.lit(0.0))), F.lit(m - 1)).cast("int")
    with_range = attach_small(df, ranges, keys)
    return (with_range.groupBy(*keys, cell(x).alias("ix"), cell(y).alias("iy"))
            .agg((F.count(F.lit(1)) / F.max("_n")).alias("share")))


def attach_small(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put a per-key row beside each row; without keys the single row becomes literals."""
    if keys:
        return df.join(lookup_side(per_key), list(keys))
    row = per_key.first()
    return df.withColumns({c: F.lit(row[c]) for c in per_key.columns})


def empirical_cdf(df: DataFrame, keys: Sequence[str], value: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram as cumulative shares at bin centres; empty bins are kept, last edge closed."""
    ranges = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_z"), F.count(value).alias("_n"))
    # a constant series spreads half a unit to both sides
    ranges = ranges.withColumns({"_a": F.when(F.col("_a") == F.col("_z"), F.col("_a") - 0.5).otherwise(F.col("_a")),
                                 "_z": F.when(F.col("_a") == F.col("_z"), F.col("_z") + 0.5).otherwise(F.col("_z"))})
    scaled = (F.col(value) - F.col("_a")) / (F.col("_z") - F.col("_a")) * bins
    i = F.least(F.floor(scaled), F.lit(bins - 1)).cast("int")
    counts = (attach_small(df.where(F.col(value).isNotNull()), ranges, keys).groupBy(*keys, i.alias("bin"))
              .agg(F.count(F.lit(1)).alias("_c")))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(counts, [*keys, "bin"], "left")
    width = (F.col("_z") - F.col("_a")) / bins
    return full.select(*keys, "bin", (F.col("_a") + (F.col("bin") + 0.5) * width).alias("centre"),
                       (F.sum(F.coalesce("_c", F.lit(0))).over(w) / F.col("_n")).alias("cdf"))


def refine_cdf(cdf: DataFrame, keys: Sequence[str], bins: int = 100, factor: int = 10) -> DataFrame:
    """bins x factor equally spaced points over the CDF by linear interpolation."""
    n = bins * factor
    ends = cdf.groupBy(*keys).agg(F.min("centre").alias("_a"), F.max("centre").alias("_z"))
    points = (ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
              .withColumn("x", F.col("_a") + F.col("point") * (F.col("_z") - F.col("_a")) / (n - 1)).drop("_a", "_z"))
    return interp_join(points, "x", cdf, "centre", "cdf", "cdf", keys, False)


def joint_wet_dry(df: DataFrame, site: str, base: str, keys: Sequence[str] = ()) -> DataFrame:
    """Chance of wet and dry at a site given wet or dry at the base."""
    wet_site, wet_base = F.col(site) != 0, F.col(base) != 0

    def share(hit: Column, given: Column) -> Column:
        return F.avg(F.when(given, hit.cast("int")))
    return df.groupBy(*keys).agg(share(wet_site, wet_base).alias("wet_given_wet"), share(~wet_site, wet_base).alias("dry_given_wet"),
                                 share(wet_site, ~wet_base).alias("wet_given_dry"), share(~wet_site, ~wet_base).alias("dry_given_dry"))


def group_and_total(df: DataFrame, cluster: str, values: Sequence[str]) -> DataFrame:
    """Rows, per-cluster means and the grand mean in one result with a level column."""
    rows = df.select(F.lit("row").alias("level"), cluster, *[F.col(v).cast("double").alias(v) for v in values])
    level = F.when(F.grouping(cluster) == 0, "cluster").otherwise("total")
    means = df.rollup(cluster).agg(level.alias("level"), *[F.avg(v).alias(v) for v in values])
    return rows.unionByName(means.select("level", cluster, *values))


def combo_counts(stories: DataFrame, parts: Sequence[str], pivot: bool = False) -> DataFrame:
    """Counts per month of class combos such as P-T-R, optionally with one column per month."""
    keyed = stories.withColumn("combo", F.concat_ws("-", *[F.col(p).cast("string") for p in parts]))
    if pivot:
        return long_to_wide(keyed, ["combo"], "month", list(range(1, 13)), F.count(F.lit(1)))
    return keyed.groupBy("month", "combo").agg(F.count(F.lit(1)).alias("n"))


def drop_degenerate(probs: DataFrame, event: str = "event", years: int = RECORD_YEARS) -> DataFrame:
    """Drop criteria that hold in every year of every month, or in none."""
    w = Window.partitionBy(event)
    lo, hi = F.min("sum").over(w), F.max("sum").over(w)
    return probs.withColumns({"_lo": lo, "_hi": hi}).where(~((F.col("_lo") == years) | (F.col("_hi") == 0))).drop("_lo", "_hi")


def spell_summary(spells: DataFrame, calendar: DataFrame, length: str = "length") -> DataFrame:
    """Per (year, month): total days, number, mean, min and max spell length; months without spells give 0."""
    got = spells.groupBy("year", "month").agg(F.sum(length).alias("total_days"), F.count(length).alias("n_spells"),
                                              F.avg(length).alias("mean_length"), F.min(length).alias("min_length"),
                                              F.max(length).alias("max_length"))
    return calendar.select("year", "month").distinct().join(got, ["year", "month"], "left").na.fill(0)


def share_without_spells(summary: DataFrame) -> DataFrame:
    none = (F.col("n_spells") == 0).cast("int")
    return summary.groupBy("month").agg(F.sum(none).alias("sum"), F.avg(none).alias("prob"))


def most_probable(annual: DataFrame, monthly_pg: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Mean monthly growth of the stories whose annual growth is in the range of their (mode, site)."""
    ranges = ranges or {(site, mode): TARGET_RANGES[("irrigated" if "store" in mode else mode, site)]
                        for site, mode in SITE_MODES}
    ok = F.lit(False)
    for (site, mode), (low, high) in ranges.items():
        ok = ok | ((F.col("site") == site) & (F.col("mode") == mode) & F.col("pg_yr1").between(low, high))
    keep = annual.where(ok).select("story_id", "site", "mode")
    return (monthly_pg.join(keep, ["story_id", "site", "mode"], "left_semi").groupBy("site", "mode", "month")
            .agg(F.avg("pg").alias("pg")))


def bias_ratio(hist: DataFrame, modelled: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Observed over modelled mean per key."""
    h = hist.groupBy(*keys).agg(F.avg(value).alias("_h"))
    m = modelled.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return h.join(m, list(keys)).select(*keys, F.try_divide("_h", "_m").alias("ratio"))


def apply_bias(df: DataFrame, ratio: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.join(lookup_side(ratio), list(keys)).withColumn(value, F.col(value) * F.col("ratio")).drop("ratio")


def total_combinations(options: DataFrame, count: str = "n") -> DataFrame:
    """Product over months of the option counts."""
    return options.agg(F.product(F.col(count).cast("double")).alias("total"))


def monthly_from_daily(df: DataFrame, keys: Sequence[str], variables: dict[str, str], realisation: str | None = None) -> DataFrame:
    """Mean over days (or sum where asked), then mean over realisations with NaN skipped."""
    inner = [*keys, realisation] if realisation else list(keys)
    months = df.groupBy(*inner).agg(*[resolve(f)(nan_to_null(F.col(v))).alias(v) for v, f in variables.items()])
    if not realisation:
        return months
    return months.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in variables])


def annual_from_monthly(df: DataFrame, keys: Sequence[str], rate: str = "pg", realisation: str | None = None) -> DataFrame:
    """Month mean x fixed month length, mean over realisations, year as the sum of the months."""
    months = df.groupBy(*keys, "month").agg(F.avg(F.col(rate) * month_days(F.col("month"))).alias(rate))
    return months.groupBy(*keys).agg(F.sum(rate).alias(f"{rate}_yr1"), F.count(rate).alias("n_months"))


def historical_baseline(daily: DataFrame, value: str, years: Sequence[int], fun: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """Monthly mean or median expanded to 365 daily rows per requested year; some keys have no baseline."""
    if value in ("PGRA", "PGRA_cum", "F_REST"):
        level = daily.groupBy(*keys, "month").agg(F.lit(None).cast("double").alias("baseline"))
    elif fun == "median":
        level = quantiles(daily, [*keys, "month"], value, [0.5]).select(*keys, "month", F.col("value").alias("baseline"))
    else:
        level = daily.groupBy(*keys, "month").agg(F.avg(value).alias("baseline"))
    per_day = level.withColumn("day", F.explode(F.sequence(F.lit(1), month_days(F.col("month")))))
    return per_day.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))


def quantile_by(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles as columns; for groups bounded by the calendar such as the days of one month."""
    return df.groupBy(*keys).agg(*[F.percentile(value, q).alias(f"q{round(q * 100):02d}") for q in probs])


def scenario_summary(impact: DataFrame, story_ids: DataFrame, keys: Sequence[str], value: str = "pg") -> DataFrame:
    """Mean and describe of the listed stories, tons to 2 decimals."""
    chosen = impact.join(story_ids.select("story_id").distinct(), "story_id", "left_semi")
    tons = chosen.withColumn("_t", F.col(value) / 1000)
    out = describe_by(tons, keys, "_t")
    return out.select(*keys, "count", *[F.bround(c, 2).alias(c) for c in out.columns if c not in (*keys, "count")])


def growth_profile(df: DataFrame, fun: str = "mean", value: str = "rate") -> DataFrame:
    """Month mean rate per year, then mean (or other) over years, and monthly total from the month length."""
    per_year = df.groupBy("year", "month").agg(F.avg(value).alias(value))
    return (per_year.groupBy("month").agg(resolve(fun)(F.col(value)).alias("rate"))
            .withColumn("total", F.col("rate") * month_days(F.col("month"))))


def yearly_totals(df: DataFrame, value: str = "rate") -> DataFrame:
    per_month = df.groupBy("year", "month").agg((F.avg(value) * F.max(month_days(F.col("month")))).alias("_t"))
    return per_month.groupBy("year").agg(F.sum("_t").alias("total"))
