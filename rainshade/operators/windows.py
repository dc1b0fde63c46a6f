"""Window operators over ordered series.

Contract: a series has one row per key and time step (sum or average duplicates first), so a window
partition is bounded by the calendar: a century of days is 36,525 rows. Every window takes series keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainshade.functions.calendar import month_days
from rainshade.operators.aggregates import attach_small, quantiles, ranked_counts, resolve
from rainshade.operators.joins import interp_join, lookup_side

Fun = str | Callable[[Column], Column]


def series(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def rolling(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, fun: Fun = "mean", out: str | None = None,
            center: bool = False, min_periods: int | None = None) -> DataFrame:
    """Row-based rolling sum or mean; null until min_periods (default n) values are present."""
    before = n // 2 if center else n - 1
    frame = series(keys, order).rowsBetween(-before, n - 1 - before)
    enough = F.count(value).over(frame) >= (n if min_periods is None else min_periods)
    return df.withColumn(out or f"{value}_{n}", F.when(enough, resolve(fun)(F.col(value)).over(frame)))


def lag_state(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, object], prefix: str = "prev_") -> DataFrame:
    """Previous row's value per column with a fill for the first row."""
    w = series(keys, order)
    return df.withColumns({f"{prefix}{c}": F.lag(c, 1, fill).over(w) for c, fill in columns.items()})


def difference(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, scale: float = 1000.0,
               removed: str | None = None) -> DataFrame:
    """Growth from first differences x scale, negatives to 0; with `removed` the previous day's harvest is added back."""
    w = series(keys, order)
    step = (F.col(value) - F.lag(value).over(w)) * scale
    if removed:
        step = step + F.lag(removed, 1).over(w)
    return df.withColumn(out, F.when(step < 0, 0.0).otherwise(step))


def fill(df: DataFrame, keys: Sequence[str], order: str, value: str, how: str = "ffill", out: str | None = None) -> DataFrame:
    """Carry the last (ffill) or next (bfill) known value."""
    w = series(keys, order)
    if how == "ffill":
        filled = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    elif how == "bfill":
        filled = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        raise ValueError("how must be ffill or bfill")
    return df.withColumn(out or value, filled)


def cumulative_anomaly(sim: DataFrame, base: DataFrame, keys: Sequence[str], on: Sequence[str], order: str,
                       value: str, days: bool = True) -> DataFrame:
    """Anomaly to a baseline and its running sum (x month length), nulls skipped, per realisation."""
    joined = sim.join(lookup_side(base.select(*on, F.col(value).alias("_base"))), list(on), "left")
    anomaly = F.col(value) - F.col("_base")
    weight = month_days(F.col("month")) if days else F.lit(1)
    out = joined.withColumn("anomaly", anomaly)
    run = series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cum_anomaly", F.sum(F.col("anomaly") * weight).over(run)).drop("_base")


def runs(df: DataFrame, keys: Sequence[str], order: str, flag: Column, within: Sequence[str] = ()) -> DataFrame:
    """Spells of consecutive flagged rows as (keys, within, first, last, length).

    `within` columns (year, month) break a spell at their edges. A spell is numbered by the difference of
    two row numbers, then aggregated: one sort and one grouping on the same keys.
    """
    part = [*keys, *within]
    w = Window.partitionBy(*part).orderBy(order)
    numbered = (df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_rn", F.row_number().over(w))
                .where(F.col("_flag")).withColumn("_grp", F.col("_rn") - F.row_number().over(w)))
    return (numbered.groupBy(*part, "_grp").agg(F.min(order).alias("first"), F.max(order).alias("last"),
                                                F.count(F.lit(1)).alias("length")).drop("_grp"))


def spell_counts(spells: DataFrame, keys: Sequence[str], lengths: Sequence[int] = (7, 14, 21, 28), prefix: str = "events",
                 longer_than: int = 0) -> DataFrame:
    """Number of spells of at least each length, total days, number and sorted lengths per key.

    longer_than=1 leaves out one-day spells. A key's spells are bounded by its days.
    """
    length = F.when(F.col("length") > longer_than, F.col("length"))
    counts = [F.count_if(F.col("length") >= n).alias(f"{prefix}_{n:02d}d") for n in lengths]
    return spells.groupBy(*keys).agg(*counts, F.sum(length).alias("total_days"), F.count(length).alias("n_spells"),
                                     F.array_sort(F.collect_list(length)).alias("lengths"))


def streak_index(df: DataFrame, keys: Sequence[str], order: str, flag: str, out: str = "streak") -> DataFrame:
    """Rows since the flag last changed: the first spell counts from 0, a change writes 0 and goes on at 1."""
    w = series(keys, order)
    changed = F.coalesce((F.lag(flag).over(w) != F.col(flag)).cast("int"), F.lit(0))
    marked = df.withColumn("_ch", changed)
    spell = marked.withColumn("_sp", F.sum("_ch").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spell.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_sp").orderBy(order)) - 1).drop("_ch", "_sp")


def streak_lengths(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Length of each finished spell and its state; the open last spell is left out."""
    w = series(keys, order)
    marked = df.withColumn("_ch", F.coalesce((F.lag(flag).over(w) != F.col(flag)).cast("int"), F.lit(0)))
    spell = marked.withColumn("spell", F.sum("_ch").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = spell.groupBy(*keys, "spell").agg(F.count(F.lit(1)).alias("length"), F.first(flag).alias("state"))
    last = F.lead("spell").over(Window.partitionBy(*keys).orderBy("spell")).isNull()
    return sizes.withColumn("_l", last).where(~F.col("_l")).drop("_l")


def persistence_by_streak(streaks: DataFrame, keys: Sequence[str], state: str, streak: str = "streak") -> DataFrame:
    """p(i) = min(1, n(i+1) / n(i)) for streak values i, up to the first value that never occurs."""
    n = streaks.groupBy(*keys, state, streak).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, state).orderBy(streak)
    top = F.max(streak).over(Window.partitionBy(*keys, state))
    unbroken = n.withColumns({"_rn": F.row_number().over(w) - 1, "_top": top})
    # equal to its own rank means that no smaller value is missing; the greatest value is not counted
    kept = unbroken.where((F.col(streak) == F.col("_rn")) & (F.col(streak) < F.col("_top")))
    following = kept.withColumn("_next", F.lead("n").over(w)).where(F.col("_next").isNotNull())
    return following.withColumn("p", F.least(F.lit(1.0), F.col("_next") / F.col("n"))).drop("_rn", "_top", "_next")


def nyear_sequential(df: DataFrame, keys: Sequence[str], year: str, value: str, n: int, fun: Fun = "sum") -> DataFrame:
    """Running n-year sum or mean, only where n years are present."""
    return rolling(df, keys, year, value, n, fun, out=f"{value}_{n}yr").where(F.col(f"{value}_{n}yr").isNotNull())


def nyear_chunks(df: DataFrame, keys: Sequence[str], year: str, value: str, n: int) -> DataFrame:
    """Sums of non-overlapping blocks of n years; a short last block is dropped."""
    chunk = F.floor((F.row_number().over(series(keys, year)) - 1) / n).cast("int")
    return (df.withColumn("chunk", chunk).groupBy(*keys, "chunk")
            .agg(F.sum(value).alias(f"{value}_{n}yr"), F.count(value).alias("_n")).where(F.col("_n") == n).drop("_n"))


RUN = 65_536


def flow_duration(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values in ascending order beside the reversed average ranks as 100 x rank / (n + 1).

    Equal values share one rank range; a range gives its own average rank and, mirrored, the average rank
    of the value at the opposite end. Ranks come from `ranked_counts`, so a key of any size is spread out.
    """
    ranked = ranked_counts(df, keys, value)
    # a value with many ties is listed in runs of bounded length, dealt out to other tasks
    runs = ranked.withColumn("_at", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"), F.lit(RUN).cast("long")))).repartition(*keys, "_v", "_at")
    rows = runs.withColumn("order", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + (RUN - 1), F.col("_hi"))))).drop("_at")
    ranks = rows.select(*keys, (F.col("_n") + 1 - F.col("order")).alias("order"), ((F.col("_lo") + 1 + F.col("_hi")) / 2).alias("_rank"))
    return (rows.select(*keys, "order", F.col("_v").alias(value), "_n").join(ranks, [*keys, "order"])
            .select(*keys, "order", value, (100 * F.col("_rank") / (F.col("_n") + 1)).alias("exceedance")))


def percentile_of_score(df: DataFrame, keys: Sequence[str], value: str, threshold: float, nearest: bool = True) -> DataFrame:
    """Mean-rank percentile of a threshold per key and |threshold - value at that percentile|.

    percentile = (count below + count at or below + [threshold present]) x 50 / n. Its place among the sorted values lies between the last value below the
    threshold and the first one above it, so both values next to that place are among these two and the threshold: one aggregation, no sort.
    """
    v, t = F.col(value).cast("double"), F.lit(float(threshold))
    totals = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys)
              .agg(F.count_if(v < t).alias("_lt"), F.count_if(v <= t).alias("_le"), F.count(F.lit(1)).alias("_m"),
                   F.max(F.when(v < t, v)).alias("_below"), F.min(F.when(v > t, v)).alias("_above")))
    present = (F.col("_le") > F.col("_lt")).cast("int")
    out = totals.withColumn("percentile", (F.col("_lt") + F.col("_le") + present) * 50.0 / F.col("_m"))
    if not nearest:
        return out.select(*keys, "percentile")
    pos = F.col("percentile") / 100 * (F.col("_m") - 1)

    def at(rank: Column) -> Column:
        return F.when(rank < F.col("_lt"), F.col("_below")).when(rank < F.col("_le"), t).otherwise(F.col("_above"))
    back = at(F.floor(pos)) + (at(F.ceil(pos)) - at(F.floor(pos))) * (pos - F.floor(pos))
    return out.select(*keys, "percentile", F.abs(t - back).alias("error"))


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """Pearson r of x[t] and x[t+l] for l = 0..lags-1 per series: one sort, one partial aggregation."""
    w = series(keys, order)
    led = df.withColumns({f"_l{i}": F.lead(value, i).over(w) for i in range(lags)})
    both = [F.corr(value, f"_l{i}").alias(str(i)) for i in range(lags)]
    wide = led.groupBy(*keys).agg(*both)
    return (wide.unpivot(list(keys), [str(i) for i in range(lags)], "lag", "r").withColumn("lag", F.col("lag").cast("int")))


def _lag_correlations(batches: Iterator[pa.RecordBatch], keys: Sequence[str], lags: int) -> Iterator[pa.RecordBatch]:
    """(keys, lag, r): Pearson r of x[t] and x[t+l] for l = 0..lags-1 of every array of a batch; none where a side has no spread or fewer than two values."""
    for b in batches:
        lists = b.column("_v")
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        # series of one length, such as the same month's of many years, are one matrix
        for n in np.unique(sizes[sizes > 1]).tolist():
            rows = np.flatnonzero(sizes == n)
            values = flat[starts[rows, None] + np.arange(n)]
            for lag in range(min(lags, n - 1)):
                early, late = values[:, :n - lag], values[:, lag:]
                spread = (early.min(axis=1) < early.max(axis=1)) & (late.min(axis=1) < late.max(axis=1))
                x, y = (v[spread] - v[spread].mean(axis=1, keepdims=True) for v in (early, late))
                found = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                at = pa.array(rows[spread])
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), pa.array(np.full(len(at), lag, np.int32)), pa.array(found)], names=[*keys, "lag", "r"])


def autocorrelation_bands(series: DataFrame, keys: Sequence[str], values: str, lags: int, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(keys, lag, q, r): quantiles of the lag correlations over all series of a key; series has one row per series with its array of values.

    All lags of a series come from its own array, so nothing is paired by a join; only (key, lag, r) is ranked. Series without spread
    at a lag do not count there; missing values are left out of their series first.
    """
    clean = series.select(*keys, F.filter(F.col(values).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x)).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _lag_correlations(batches, keys, lags)

    schema = T.StructType([*(clean.schema[k] for k in keys), T.StructField("lag", T.IntegerType()), T.StructField("r", T.DoubleType())])
    return quantiles(clean.mapInArrow(run, schema), [*keys, "lag"], "r", probs).withColumnRenamed("value", "r")


def anomaly(df: DataFrame, keys: Sequence[str], value: str, fun: str = "mean", years: tuple[int, int] | None = None,
            year: str = "year", out: str = "anomaly") -> DataFrame:
    """value - group mean (or median) and the relative anomaly; the mean may use only some years.

    The level is aggregated per key and joined back, so no group is held in one task.
    """
    base = F.when(F.col(year).between(*years), F.col(value)) if years else F.col(value)
    level = df.groupBy(*keys).agg(resolve(fun)(base).alias("_level"))
    joined = attach_small(df, level, keys)
    diff = F.col(value) - F.col("_level")
    return joined.withColumns({out: diff, f"{out}_rel": F.try_divide(diff, F.col("_level"))}).drop("_level")


def spread_yield(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "rate") -> DataFrame:
    """Divide each harvest's yield evenly over the days since the previous harvest; days after the last give null."""
    w = series(keys, order)
    period = F.count(value).over(w.rowsBetween(0, Window.unboundedFollowing))
    marked = df.withColumn("_p", period)
    p = Window.partitionBy(*keys, "_p")
    return marked.withColumn(out, F.max(value).over(p) / F.count(F.lit(1)).over(p)).drop("_p")


# Frequency codes to grouping columns over a date.
FREQUENCIES = {"1D": "day", "1M": "month", "1Y": "year"}


def resample(df: DataFrame, keys: Sequence[str], date: str, value: str, freq: str, fun: Fun = "mean") -> DataFrame:
    """Aggregate to day, month, year ('1D', '1M', '1Y') or n days ('10D') counted from the key's first day."""
    if freq in FREQUENCIES:
        period = F.date_trunc(FREQUENCIES[freq], date).cast("date")
        return df.groupBy(*keys, period.alias("period")).agg(resolve(fun)(F.col(value)).alias(value))
    n = int(freq[:-1])
    if freq[-1] != "D" or n < 1:
        raise ValueError(f"unknown frequency {freq}")
    start = df.groupBy(*keys).agg(F.min(date).alias("_s"))
    joined = attach_small(df, start, keys)
    k = F.floor(F.date_diff(F.col(date), F.col("_s")) / n).cast("int") * n
    return joined.groupBy(*keys, F.date_add("_s", k).alias("period")).agg(resolve(fun)(F.col(value)).alias(value))


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str | None = None) -> DataFrame:
    """Linear fill between known points by position in time; outside the known points the value stays null."""
    w = series(keys, order)
    x = F.unix_date(order) if dict(df.dtypes)[order] == "date" else F.col(order).cast("double")
    point = F.when(F.col(value).isNotNull(), F.struct(x.alias("x"), F.col(value).alias("y")))
    marked = df.withColumns({"_x": x, "_pt": point}).withColumns({
        "_p": F.last("_pt", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.first("_pt", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    slope = F.try_divide(F.col("_n.y") - F.col("_p.y"), F.col("_n.x") - F.col("_p.x"))
    line = F.col("_p.y") + slope * (F.col("_x") - F.col("_p.x"))
    return marked.withColumn(out or value, F.coalesce(F.col(value), line)).drop("_x", "_pt", "_p", "_n")


def annual_to_daily(annual: DataFrame, year: str, value: str, first_year: int, last_year: int, n: int) -> DataFrame:
    """Annual means placed mid-year, evaluated at n evenly spaced points from the start of the second year on."""
    start, stop = first_year + 1.0, last_year - 1.0 / 365
    curve = annual.where(F.col(year).between(first_year, last_year)).select((F.col(year) + 0.5).alias("at"), value)
    points = annual.sparkSession.range(n).select(F.col("id").alias("day_no"),
                                                 (F.col("id") * ((stop - start) / (n - 1)) + start).alias("x"))
    return interp_join(points, "x", curve, "at", value, value, (), False, (first_year + 0.5, last_year + 0.5))


def order_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "order") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def story_ids(df: DataFrame, order: str, prefix: str = "mrsl", blocks: int = 1024) -> DataFrame:
    """Sequential ids mrsl-000000 by `order`, numbered in two levels so no task numbers every row.

    Blocks are ranges of `order` between sampled splitters, so ids rise with it; equal values share a block and are numbered in any
    order, null values come first.
    """
    splits = df.agg(F.percentile_approx(F.col(order), F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), 10 * blocks).alias("s")).first()["s"] if _numeric(df, order) else None
    if splits is None:
        marks = df.where(F.col(order).isNotNull()).select(order).distinct().orderBy(F.xxhash64(order)).limit(blocks).toPandas()[order]
        splits = sorted(marks)
    bounds = F.array(*[F.lit(x) for x in sorted(set(splits))]).cast(f"array<{df.schema[order].dataType.simpleString()}>")
    tagged = df.withColumn("_b", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda x: x <= F.col(order)))))
    sizes = tagged.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # one row per block
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_b", before.alias("_off"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return (tagged.withColumn("_i", local).join(F.broadcast(offsets), "_b")
            .withColumn("ID", F.format_string(f"{prefix}-%06d", F.col("_off") + F.col("_i"))).drop("_b", "_i", "_off"))


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def last_day_flag(df: DataFrame, keys: Sequence[str], date: str = "date", out: str = "last_day") -> DataFrame:
    """True where the next row is in another month; the last row is true."""
    following = F.lead(F.month(date)).over(series(keys, date))
    return df.withColumn(out, following.isNull() | (following != F.month(date)))


def month_fold_key(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Number of the month a fold restarts in: counts day-1 rows up to each row."""
    w = series(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("fold", F.sum((F.dayofmonth(date) == 1).cast("int")).over(w))
