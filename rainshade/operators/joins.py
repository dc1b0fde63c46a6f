"""Joins: keyed, spine, nearest, interpolating and interval joins.

A lookup table is read once with a row limit (`resident`). Below the limit it becomes local rows with a
broadcast hint, so a fact table is never shuffled to meet it; above it the table stays distributed, the
join is a shuffled one and AQE splits skewed partitions. Interval lookups are equi joins on a cell and a group of
at most GROUP intervals, with a residual range filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade.constants import UNMAPPED_MONTHS
from rainshade.functions import scalars as S
from rainshade.functions.calendar import drop_leap_day

INF = float("inf")
MAX_RESIDENT_ROWS = 200_000
MAX_RESIDENT_BYTES = 64 * 2 ** 20
GROUP = 16


def resident(table: DataFrame, max_rows: int = MAX_RESIDENT_ROWS) -> tuple[DataFrame, int | None]:
    """(table as local rows, row count) when it is small, else (table, None).

    At most max_rows + 1 rows reach the driver. Give a lower max_rows where a row carries an array.
    """
    rows = table.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > MAX_RESIDENT_BYTES:
        return table, None
    return table.sparkSession.createDataFrame(rows, table.schema), rows.num_rows


def lookup_side(table: DataFrame, max_rows: int = MAX_RESIDENT_ROWS) -> DataFrame:
    """The lookup side of a join: broadcast when its checked size allows, as it is otherwise."""
    local, n = resident(table, max_rows)
    return local if n is None else F.broadcast(local)


def keyed_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Index-aligned join of daily or monthly tables."""
    return a.join(b, list(on), how)


def events_with_daily_mean(events: DataFrame, daily: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Events keep unmatched months; the daily side is averaged before the join, so a hot month stays one row."""
    means = daily.groupBy(*keys).agg(F.avg(value).alias(out))
    return events.join(means, list(keys), "left")


def strict_lookup(df: DataFrame, table: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Left join that fails the job when a key has no row in the table."""
    joined = df.join(lookup_side(table.withColumn("_hit", F.lit(True))), list(on), "left")
    message = F.concat(F.lit(f"no {value} for "), F.to_json(F.struct(*on)))
    return joined.where(F.when(F.col("_hit"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("_hit")


def replace_lookup(df: DataFrame, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Left join where an absent key keeps the key value itself."""
    return (df.join(lookup_side(table.select(key, F.col(value).alias("_v"), F.lit(True).alias("_hit"))), key, "left")
            .withColumn(out, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(key))).drop("_v", "_hit"))


def coalesce_full_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of keys; a's value if present else b's."""
    left = [c for c in a.columns if c not in keys]
    right = [c for c in b.columns if c not in keys]
    names = left + [c for c in right if c not in left]
    joined = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in left]).join(
        b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in right]), list(keys), "full")
    values = []
    for c in names:
        parts = [F.col(f"_{side}_{c}") for side, cols in (("a", left), ("b", right)) if c in cols]
        values.append(F.coalesce(*parts).alias(c))
    return joined.select(*keys, *values)


def date_spine(df: DataFrame, keys: Sequence[str] = (), date: str = "date", start=None, end=None,
               leap: bool = True) -> DataFrame:
    """Every calendar day present once per key; bounds default to each key's first and last day.

    Only (key, first, last) is aggregated and expanded, so the spine is bounded by the calendar.
    """
    first = F.lit(start).cast("date") if start is not None else F.min(date)
    last = F.lit(end).cast("date") if end is not None else F.max(date)
    spans = (df.groupBy(*keys).agg(F.min(date).alias("_min"), first.alias("_a"), last.alias("_b")).drop("_min"))
    spine = spans.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    spine = spine if leap else drop_leap_day(spine, date)
    return spine.join(df, [*keys, date], "left")


def date_report(df: DataFrame, keys: Sequence[str] = (), date: str = "date", start=None, end=None,
                leap: bool = True) -> DataFrame:
    """Rows (keys, date, problem) for missing, duplicate and extra days of a series."""
    counted = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_n"))
    full = date_spine(counted, keys, date, start, end, leap)
    missing = full.where(F.col("_n").isNull()).select(*keys, date, F.lit("missing").alias("problem"))
    duplicate = counted.where(F.col("_n") > 1).select(*keys, date, F.lit("duplicate").alias("problem"))
    outside = F.lit(False)
    if start is not None:
        outside = outside | (F.col(date) < F.lit(start).cast("date"))
    if end is not None:
        outside = outside | (F.col(date) > F.lit(end).cast("date"))
    if not leap:
        outside = outside | ((F.month(date) == 2) & (F.dayofmonth(date) == 29))
    extra = counted.where(outside).select(*keys, date, F.lit("extra").alias("problem"))
    return missing.unionByName(duplicate).unionByName(extra)


def key_skeleton(df: DataFrame, keys: Sequence[str], options: dict[str, Sequence]) -> DataFrame:
    """Every distinct key with every combination of fixed options, made by explode of literal arrays."""
    out = df.select(*keys).distinct()
    for name, values in options.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


# ---- interval lookup ---------------------------------------------------------------------------------

def table_domain(table: DataFrame, *columns: str) -> tuple[float, float]:
    """Finite min and max over the bound columns of a lookup table: one row reaches the driver."""
    finite = [F.when(F.abs(F.col(c)) < INF, F.col(c).cast("double")) for c in columns]
    row = table.agg(F.min(F.least(*finite) if len(finite) > 1 else finite[0]).alias("a"),
                    F.max(F.greatest(*finite) if len(finite) > 1 else finite[0]).alias("b")).first()
    a, b = row["a"], row["b"]
    if a is None:
        return 0.0, 1.0
    return (a, b) if b > a else (a, a + 1.0)


def _cell(x: Column, low: Column, width: Column, cells: int) -> Column:
    scaled = (x.cast("double") - low) / width
    return F.floor(F.greatest(F.least(scaled, F.lit(cells - 1.0)), F.lit(0.0))).cast("int")


def _key_domains(table: DataFrame, columns: Sequence[str], keys: Sequence[str], cells: int) -> DataFrame:
    """(keys, _from, _width): where the finite bounds of a key begin, and the width of one of its cells."""
    ends = [F.col(c).cast("double") for c in columns]
    finite = [F.when(F.abs(e) < INF, e) for e in ends]
    low = F.min(F.least(*finite) if len(finite) > 1 else finite[0])
    high = F.max(F.greatest(*finite) if len(finite) > 1 else finite[0])
    span = table.groupBy(*keys).agg(low.alias("_from"), high.alias("_to"))
    width = F.when(F.col("_to") > F.col("_from"), (F.col("_to") - F.col("_from")) / cells).otherwise(F.lit(1.0 / cells))
    return span.select(*keys, F.coalesce("_from", F.lit(0.0)).alias("_from"), F.coalesce(width, F.lit(1.0 / cells)).alias("_width"))


def interval_join(df: DataFrame, x: str, table: DataFrame, low: str, high: str, keys: Sequence[str] = (),
                  domain: tuple[float, float] | None = None, cells: int = 1024) -> DataFrame:
    """Each row of df once, with the table interval [low, high) of its keys that holds x.

    Intervals of a key are disjoint and cover the axis. A null or NaN x gets null columns; a row whose keys the table
    lacks fails the job. The x axis is cut into equal cells over `domain`, else over each key's own range; an interval is
    listed once per cell it touches. The intervals of a cell are ranked into groups of GROUP, so a cell that holds much of
    the table costs a row one search and one group, not the cell. Both steps are hash joins.
    """
    table, n = resident(table)
    if domain is None and keys:
        spans = lookup_side(_key_domains(table, (low, high), keys, cells))
        table, start, width = table.join(spans, list(keys)), F.col("_from"), F.col("_width")
        probe = df.join(spans, list(keys), "left").withColumn("_cell", _cell(F.col(x), start, width, cells)).drop("_from", "_width")
    else:
        a, b = domain or table_domain(table, low, high)
        start, width = F.lit(float(a)), F.lit((b - a) / cells)
        probe = df.withColumn("_cell", _cell(F.col(x), start, width, cells))
    listed = table.withColumn("_cell", F.explode(F.sequence(_cell(F.col(low), start, width, cells), _cell(F.col(high), start, width, cells))))
    listed = listed.drop("_from", "_width").withColumnsRenamed({low: "_low", high: "_high"})
    asked = F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    on = [*keys, "_cell"]
    if n is None or n > GROUP:
        order = Window.partitionBy(*on).orderBy("_low")
        listed = listed.withColumn("_group", F.floor((F.row_number().over(order) - 1) / GROUP).cast("int"))
        tops = listed.groupBy(*on, "_group").agg(F.min("_low").alias("_at")).groupBy(*on).agg(F.collect_list("_at").alias("_tops"))
        # a group's number is the count of group starts at or below x, less one
        probe = _meet(probe, tops, on, n).withColumn("_group", F.size(F.filter("_tops", lambda t: t <= F.col(x))) - 1).drop("_tops")
        on = [*on, "_group"]
    payload = [c for c in listed.columns if c not in (*on, "_low", "_high")]
    p, t = probe.alias("p"), (listed if n is None else F.broadcast(listed)).withColumn("_hit", F.lit(True)).alias("t")
    within = (F.col(f"p.{x}") >= F.col("t._low")) & ((F.col(f"p.{x}") < F.col("t._high")) | (F.col("t._high") == INF))
    cond = reduce(lambda c, k: c & (F.col(f"p.{k}") == F.col(f"t.{k}")), on, within)
    joined = p.join(t, cond, "left").select(*[F.col(f"p.{c}") for c in df.columns], *[F.when(asked, F.col(f"t.{c}")).alias(c) for c in payload], F.col("t._hit"))
    message = F.concat(F.lit("no interval for "), F.to_json(F.struct(*keys, F.col(x).alias("x"))))
    # a filter, so that no pruning of columns can lose the check
    return joined.where(F.when(~asked | F.col("_hit"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("_hit")


def _meet(probe: DataFrame, tops: DataFrame, on: Sequence[str], n: int | None) -> DataFrame:
    return probe.join(tops if n is None else F.broadcast(tops), list(on), "left").select(*probe.columns, "_tops")


def nearest_intervals(table: DataFrame, key: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Turn a table of key values into intervals [_lo, _hi) that are nearest to each value.

    Equal values keep the first row in `order`. A query exactly half way goes to the value whose row
    comes first in `order`, so the boundary belongs to the left interval when the left row is first;
    one extra ulp-free flag is avoided by closing the boundary through a tiny step of the double.
    """
    first = (table.groupBy(*keys, key).agg(F.min_by(F.struct(*[c for c in table.columns if c not in (*keys, key)]), order)
                                            .alias("_p")).select(*keys, key, "_p.*"))
    w = Window.partitionBy(*keys).orderBy(key)
    prev, nxt = F.lag(key).over(w), F.lead(key).over(w)
    prev_o, next_o = F.lag(order).over(w), F.lead(order).over(w)
    mid_low, mid_high = (prev + F.col(key)) / 2, (F.col(key) + nxt) / 2
    step = F.lit(2.0 ** -50)

    def above(m: Column) -> Column:
        return m + F.greatest(F.abs(m), F.lit(1e-300)) * step
    lo = F.when(prev.isNull(), F.lit(-INF)).when(prev_o < F.col(order), above(mid_low)).otherwise(mid_low)
    hi = F.when(nxt.isNull(), F.lit(INF)).when(F.col(order) < next_o, above(mid_high)).otherwise(mid_high)
    return first.withColumns({"_lo": lo, "_hi": hi})


def nearest_row(df: DataFrame, x: str, table: DataFrame, key: str, order: str, keys: Sequence[str] = (),
                domain: tuple[float, float] | None = None, cells: int = 1024) -> DataFrame:
    """Row of the table whose key is nearest to x; first row in `order` on ties."""
    return interval_join(df, x, nearest_intervals(table, key, order, keys), "_lo", "_hi", keys, domain, cells)


def nearest_quantile(stories: DataFrame, mapper: DataFrame, rest: str = "rest", out: str = "rest_per") -> DataFrame:
    """Quantile whose mapped restriction is nearest; of equal restrictions the one nearest 0.5; months 5-8 give 1.

    stories need combo, month and rest; mapper is (combo, q, month, rest). Equal restrictions are first
    reduced to one quantile per (combo, month, value), then the nearest value is an interval lookup whose
    half-way ties go to the quantile nearest 0.5, then the smaller one.
    """
    ranked = (mapper.withColumn("_r", F.round(F.col("rest"), 12)).groupBy("combo", "month", "_r")
              .agg(F.min(F.struct(F.round(F.abs(0.5 - F.col("q")), 12).alias("d"), F.col("q").alias("q"))).alias("_rank")))
    nearest = nearest_row(stories.where(~F.col("month").isin(*UNMAPPED_MONTHS)), rest, ranked, "_r", "_rank",
                          ["combo", "month"], (0.0, 1.0))
    mapped = nearest.withColumn(out, F.col("_rank.q")).drop("_rank")
    rest_of = stories.where(F.col("month").isin(*UNMAPPED_MONTHS)).withColumn(out, F.lit(1.0))
    return mapped.drop("_r").unionByName(rest_of.select(*mapped.drop("_r").columns))


def curve_segments(curve: DataFrame, x: str, y: str, keys: Sequence[str] = (), extrapolate: bool = True, order: str | None = None) -> DataFrame:
    """Segments (_lo, _hi, x0, y0, y_at, width, slope) between neighbouring knots; they cover the axis.

    Knots of equal x keep their first and their last y in `order` (y itself by default): the segment to the left ends in the first, the
    one to the right starts in the last, and y_at, the value at x0 itself, is the first where ends are extrapolated and the last where
    they are held, as the two common interpolators have it. A curve of one x has a value there, and when extrapolated none elsewhere.
    """
    by = F.col(order or y)
    value = F.col(y).cast("double")
    knots = curve.groupBy(*keys, F.col(x).cast("double").alias("x0")).agg(F.min_by(value, by).alias("_first_y"), F.max_by(value, by).alias("y0"))
    w = Window.partitionBy(*keys).orderBy("x0")
    nx, ny = F.lead("x0").over(w), F.lead("_first_y").over(w)
    seg = knots.select(*keys, "x0", "y0", "_first_y", nx.alias("_nx"), (nx - F.col("x0")).alias("width"), ((ny - F.col("y0")) / (nx - F.col("x0"))).alias("slope"),
                       (F.row_number().over(w) == 1).alias("_first"), F.lead("x0", 2).over(w).isNull().alias("_last"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_knots"))
    y_at = F.col("_first_y" if extrapolate else "y0").alias("y_at")
    if extrapolate:
        kept = seg.where(F.col("_nx").isNotNull() | (F.col("_knots") == 1))
        return kept.select(*keys, "x0", "y0", y_at, "width", "slope", F.when(F.col("_first"), -INF).otherwise(F.col("x0")).alias("_lo"),
                           F.when(F.col("_last"), INF).otherwise(F.col("_nx")).alias("_hi"))
    inner = seg.select(*keys, "x0", "y0", y_at, "width", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.col("x0").alias("_lo"), F.coalesce("_nx", F.lit(INF)).alias("_hi"))
    left = seg.where(F.col("_first")).select(*keys, "x0", F.col("_first_y").alias("y0"), F.col("_first_y").alias("y_at"), F.lit(None).cast("double").alias("width"),
                                             F.lit(0.0).alias("slope"), F.lit(-INF).alias("_lo"), F.col("x0").alias("_hi"))
    return inner.unionByName(left)


def interp_join(df: DataFrame, x: str, curve: DataFrame, curve_x: str, curve_y: str, out: str,
                keys: Sequence[str] = (), extrapolate: bool = True, domain: tuple[float, float] | None = None,
                cells: int = 1024, order: str | None = None) -> DataFrame:
    """Piecewise-linear y(x) per key, one row per row of df: ends extrapolated, or clamped as numpy's interp does.

    A null x gives null and a NaN gives NaN; keys without a curve fail the job. `order` is the table order among equal x.
    """
    segs = curve_segments(curve, curve_x, curve_y, keys, extrapolate, order)
    joined = interval_join(df, x, segs, "_lo", "_hi", keys, domain, cells)
    # a slope of 0 times an infinite distance is no number
    line = F.when(F.col("slope") == 0, F.col("y0")).otherwise(F.col("y0") + (F.col(x) - F.col("x0")) * F.col("slope"))
    y = F.when(F.col(x) == F.col("x0"), F.col("y_at")).otherwise(line)
    return joined.withColumn(out, F.when(F.isnan(F.col(x).cast("double")), F.lit(float("nan"))).otherwise(y)).drop("x0", "y0", "y_at", "width", "slope")


def non_exceedance(df: DataFrame, growth: str, curve: DataFrame, out: str, keys: Sequence[str] = (),
                   in_tons: bool = False) -> DataFrame:
    """100 - exceedance probability (%) of an annual growth in kg (or tons) on curves of (prob, pg in tons)."""
    scaled = curve.select(*keys, (F.col("pg") * 1000).alias("_kg"), (F.col("prob") * 100).alias("_pc"))
    probe = df.withColumn("_g", F.col(growth).cast("double") * (1000 if in_tons else 1))
    return (interp_join(probe, "_g", scaled, "_kg", "_pc", "_p", keys)
            .withColumn(out, 100 - F.col("_p")).drop("_g", "_p"))


def map_storyline_rest(stories: DataFrame, mapper: DataFrame, q: str = "rest", out: str = "rest",
                       story: str = "story_id", seq: str = "seq") -> DataFrame:
    """Restriction of each month from its quantile, previous class (first = A) and month; months 5-8 give 0.

    Stories that come with precip_class_prev need no window, and so no exchange by story.
    """
    w = Window.partitionBy(story).orderBy(seq)
    led = stories if "precip_class_prev" in stories.columns else stories.withColumn("precip_class_prev", F.lag("precip_class", 1, "A").over(w))
    keyed = (led.withColumns({"combo": S.combo_key(F.col("precip_class_prev"), F.col("precip_class")),
                              "_q": F.bround(F.col(q) * 100, 0).cast("int")}))
    table = mapper.select("combo", F.bround(F.col("q") * 100, 0).cast("int").alias("_q"), "month", F.col("rest").alias("_r"))
    joined = keyed.join(lookup_side(table), ["combo", "_q", "month"], "left")
    return joined.withColumn(out, F.when(F.col("month").isin(*UNMAPPED_MONTHS), 0.0).otherwise(F.col("_r"))).drop("_q", "_r")


def semi_join(df: DataFrame, keys_df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys_df.select(*on), list(on), "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def only_event(events: DataFrame, kind: str) -> DataFrame:
    """Months with the event and no other: one grouped pass over (month, year, event), no self join."""
    return (events.groupBy("month", "year")
            .agg(F.bool_or(F.col("event") == kind).alias("_has"), F.bool_or(F.col("event") != kind).alias("_other"))
            .where(F.col("_has") & ~F.col("_other")).select("month", "year"))


def transition_join(stories: DataFrame, transitions: DataFrame, story: str = "story_id", seq: str = "seq") -> DataFrame:
    """Each month with its successor's state and the probability of that step; the last month is dropped."""
    w = Window.partitionBy(story).orderBy(seq)
    steps = stories.withColumn("next_state", F.lead("state").over(w)).where(F.col("next_state").isNotNull())
    table = transitions.select("month", F.col("from_state").alias("state"), F.col("to_state").alias("next_state"), "p")
    return steps.join(lookup_side(table), ["month", "state", "next_state"], "left")


def cumulative_intervals(items: DataFrame, weight: str, order: str, keys: Sequence[str] = (),
                         block: Column | None = None, blocks: int = 1024) -> DataFrame:
    """Probability intervals [_lo, _hi) of weighted items, normalised to 1 per key.

    The running sum has two levels, so no task orders all items: sums per block, an ordered sum over
    the few blocks, then a running sum inside each block. Blocks default to a hash of the order column.
    """
    blk = block if block is not None else F.pmod(F.xxhash64(F.col(order)), F.lit(blocks))
    base = items.where(F.col(weight) > 0).withColumn("_blk", blk)
    sums = base.groupBy(*keys, "_blk").agg(F.sum(weight).alias("_s"))
    over_blocks = Window.partitionBy(*keys).orderBy("_blk")
    offsets = sums.select(*keys, "_blk",
                          F.coalesce(F.sum("_s").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)),
                                     F.lit(0.0)).alias("_off"),
                          F.sum("_s").over(Window.partitionBy(*keys)).alias("_tot"))
    offsets = offsets.withColumn("_next_off", F.lead("_off").over(over_blocks))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order)
    running = base.withColumn("_run", F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    ends = running.withColumns({"_before": F.coalesce(F.lag("_run").over(inner), F.lit(0.0)),
                                "_last": F.lead(order).over(inner).isNull()}).join(offsets, [*keys, "_blk"])
    # an upper end is the very double the next item starts with, so no draw falls between two items
    hi = (F.when(F.col("_last"), F.coalesce(F.col("_next_off") / F.col("_tot"), F.lit(INF)))
          .otherwise((F.col("_off") + F.col("_run")) / F.col("_tot")))
    return (ends.withColumns({"_lo": (F.col("_off") + F.col("_before")) / F.col("_tot"), "_hi": hi})
            .drop("_blk", "_off", "_tot", "_next_off", "_run", "_before", "_last"))


def inverse_cdf_join(draws: DataFrame, u: str, items: DataFrame, weight: str, order: str, keys: Sequence[str] = (),
                     cells: int = 10_000, block: Column | None = None) -> DataFrame:
    """Item whose cumulative probability interval holds the draw u in [0, 1).

    Draws are uniform over the cells, so no cell is hot even when one item holds a third of the weight; and where a few items hold nearly
    all of it, the many others share a few cells, whose groups keep a draw from meeting them all.
    """
    table = cumulative_intervals(items, weight, order, keys, block).drop(weight)
    return interval_join(draws, u, table, "_lo", "_hi", keys, (0.0, 1.0), cells)


def circular_window_join(daily: DataFrame, half_width: int = 5, doy: str = "doy") -> DataFrame:
    """Each row feeds the target days within half_width of its own, modulo 365: column target_doy."""
    offsets = F.explode(F.array(*[F.lit(i) for i in range(-half_width, half_width + 1)]))
    return (daily.where(F.col(doy) <= 365).withColumn("_o", offsets)
            .withColumn("target_doy", F.pmod(F.col(doy) - 1 + F.col("_o"), F.lit(365)) + 1).drop("_o"))


def cdf_value(df: DataFrame, p: str, cdf: DataFrame, cdf_p: str, cdf_x: str, out: str, keys: Sequence[str] = (),
              literal_weights: bool = False, domain: tuple[float, float] | None = None) -> DataFrame:
    """Value at a percentile of a tabulated CDF.

    Default is ordinary linear interpolation with clamped ends. With literal_weights the nearest CDF
    point and its neighbour towards p are mixed with swapped weights, as first published.
    """
    if not literal_weights:
        return interp_join(df, p, cdf, cdf_p, cdf_x, out, keys, False, domain)
    segs = curve_segments(cdf, cdf_p, cdf_x, keys, False)
    joined = interval_join(df, p, segs, "_lo", "_hi", keys, domain)
    offset = F.col(p) - F.col("x0")
    inside = F.col("width").isNotNull() & (offset > 0)
    # swapping the weights mirrors the point inside its segment
    mirrored = F.col("y0") + (F.col("width") - offset) * F.col("slope")
    return joined.withColumn(out, F.when(inside, mirrored).otherwise(F.col("y0"))).drop("x0", "y0", "y_at", "width", "slope")


def place_scenarios(scenarios: DataFrame, curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extra scenarios (label, pg, prob) on an exceedance curve; a missing prob is read from the curve.

    The schema is checked before anything runs.
    """
    types = dict(scenarios.dtypes)
    wrong = [c for c in ("label", "pg", "prob") if types.get(c) != ("string" if c == "label" else "double")]
    if wrong:
        raise ValueError(f"scenarios need label string, pg double, prob double; wrong or missing: {wrong}")
    placed = interp_join(scenarios, "pg", curve.select(*keys, F.col("pg").alias("_g"), F.col("prob").alias("_c")), "_g", "_c", "_p", keys)
    return placed.withColumn("prob", F.coalesce("prob", "_p")).drop("_p")
