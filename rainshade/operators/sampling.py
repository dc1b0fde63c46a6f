"""Seeded resampling at scale: block bootstrap, weighted draws, Markov paths, multi-year stories.

Draws are a pure function of (seed, row keys), so results do not change with partitioning or when a task
is repeated on another executor. Simulations are built map-side from small array tables.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import scalars as S
from rainshade.functions.calendar import drop_leap_day, month_days, shift_years
from rainshade.functions.draws import Uniform, draw_index, hash_uniform
from rainshade.operators.aggregates import value_bin
from rainshade.operators.joins import inverse_cdf_join, lookup_side, resident


MAX_MODES = 1000
MAX_STEPS = 20_000  # rows of a transition table that becomes a constant
MAX_ARRAYS = 2000  # rows that carry a whole record, at most about 1,500 values each


# ---- moving block bootstrap --------------------------------------------------------------------------

def bootstrap_inputs(record: DataFrame, classes: DataFrame, value: str = "f_rest", by_pair: bool = False) -> DataFrame:
    """Daily values per key mMM-D / mMM-ND (or mMM-prev-cur), days within the fixed month length.

    classes is (year, month, precip_class[, precip_class_prev]); keys no month has do not appear.
    """
    state = (S.combo_key(F.col("precip_class_prev"), F.col("precip_class")) if by_pair
             else S.dry_state(F.col("precip_class")))
    keyed = classes.select("year", "month", F.format_string("m%02d-%s", F.col("month"), state).alias("key"))
    daily = record.withColumns({"year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date")})
    return (daily.where(F.col("day") <= month_days(F.col("month"))).join(keyed, ["year", "month"])
            .select("key", "date", "year", "month", "day", F.col(value).alias("value")))


def months_per_key(inputs: DataFrame) -> DataFrame:
    """Months behind each key; the length must be a whole number of fixed month lengths."""
    n = inputs.groupBy("key", "month").agg(F.count(F.lit(1)).alias("_d"))
    whole = F.pmod(F.col("_d"), month_days(F.col("month"))) == 0
    checked = F.when(whole, (F.col("_d") / month_days(F.col("month"))).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("incomplete months for "), F.col("key"))).cast("int"))
    return n.select("key", checked.alias("n_months"))


def series_arrays(inputs: DataFrame, order: str = "date") -> DataFrame:
    """One row per key with its whole record as an array: days of one calendar month, bounded by the calendar."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").cast("double").alias("v"))))
    return inputs.groupBy("key").agg(F.transform(packed, lambda s: s["v"]).alias("record"))


def block_size(kind: str, block, u: Column) -> Column:
    """Block length from a uniform: 'single' n, 'list' choices, 'truncnormal' (mean, std, low, high) rounded.

    The truncated normal is drawn from its exact probabilities per whole length, so no Python is needed.
    """
    if kind == "single":
        return F.lit(int(block))
    if kind == "list":
        return F.element_at(F.array(*[F.lit(int(b)) for b in block]), draw_index(u, len(block)).cast("int") + 1)
    if kind == "truncnormal":
        mean, sd, low, high = block

        def cdf(x: float) -> float:
            return 0.5 * (1 + math.erf((min(max(x, low), high) - mean) / sd / math.sqrt(2)))
        total = cdf(high) - cdf(low)
        sizes = range(round(low), round(high) + 1)
        out, run = F.lit(int(sizes[-1])), 0.0
        steps = []
        for s in sizes:
            run += (cdf(s + 0.5) - cdf(s - 0.5)) / total
            steps.append((s, run))
        for s, edge in reversed(steps[:-1]):
            out = F.when(u < edge, s).otherwise(out)
        return out
    raise ValueError("block kind must be single, list or truncnormal")


def _every(joined: DataFrame, found: Column, message: str, *names: str) -> DataFrame:
    """Rows of a left join; one without a partner fails the job. A filter, so that no pruning of columns can lose the check."""
    text = F.concat(F.lit(message + " "), F.to_json(F.struct(*names)))
    return joined.where(F.when(found.isNotNull(), True).otherwise(F.raise_error(text).cast("boolean")))


def moving_block_bootstrap(arrays: DataFrame, sims: DataFrame, kind: str, block, sim_len: Column | int | None = None,
                           seed: int = 1, uniform: Uniform = hash_uniform, n_sizes: int = 50,
                           include_last_start: bool = False) -> DataFrame:
    """Add to each (key, sim) an array of sim_len values made of random blocks of its key's record.

    One block size per simulation; simulations are split over n_sizes sizes. A block starts in [0, n - b)
    (the last legal start is left out unless asked for). The record joins by key (few rows), then slices
    are cut and joined inside the row: no explosion, no shuffle of simulations.
    """
    joined = _every(sims.join(lookup_side(arrays, MAX_ARRAYS), "key", "left"), F.col("record"), "no record for", "key")
    n = F.size("record")
    length = F.lit(sim_len) if isinstance(sim_len, int) else (n if sim_len is None else sim_len)
    group = F.pmod(F.col("sim"), F.lit(n_sizes))
    sized = joined.withColumns({"block": block_size(kind, block, uniform(seed, F.lit("size"), F.col("key"), group)).cast("int"),
                                "_len": length.cast("int")})
    starts = n - F.col("block") + (1 if include_last_start else 0)
    checked = F.when(starts > 0, starts).otherwise(F.raise_error(F.lit("block is longer than the record")).cast("int"))
    per_sim = F.ceil(F.col("_len") / F.col("block")).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), per_sim), lambda i: F.slice(
        F.col("record"), draw_index(uniform(seed, F.col("key"), F.col("sim"), i), checked).cast("int") + 1, F.col("block")))
    return (sized.withColumn("values", F.slice(F.flatten(blocks), F.lit(1), F.col("_len")))
            .select(*sims.columns, "block", "values"))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def sim_statistic(sims: DataFrame, fun: Callable[[Column], Column] = array_mean, suffix: str = "mean") -> DataFrame:
    """One number per simulation from a Column -> Column function over its array (also a pandas UDF)."""
    return sims.withColumn(suffix, fun(F.col("values")).cast("double"))


def sim_statistic_rows(sims: DataFrame, fun: Callable[[Column], Column], suffix: str) -> DataFrame:
    """The same with an aggregate expression over the rows of each (key, sim)."""
    rows = sims.select("key", "sim", F.explode("values").alias("value"))
    return rows.groupBy("key", "sim").agg(fun(F.col("value")).alias(suffix))


def rank_sims(sims: DataFrame, suffix: str, bounds: DataFrame, blocks: int = 256, sub: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Number the simulations of each key by their statistic, and count those below each bound.

    bounds is (key, side, x): side 'a' counts statistics < x, side 'z' statistics <= x. Returns
    (sims with _rank, bounds with _count). Levels: value bin -> (value, sub-block of equal values) ->
    place; each level is a running sum over a bounded list. Bounds are rows of weight 0 in the same
    running sums, so no bound is paired with a simulation.
    """
    slim = sims.select("key", "sim", suffix).withColumns({
        "_b": value_bin(F.col(suffix)), "_sub": (sub if sub is not None else F.pmod(F.xxhash64("sim"), F.lit(blocks))).cast("long")})
    groups = slim.groupBy("key", "_b", F.col(suffix).alias("_x"), "_sub").agg(F.count(F.lit(1)).alias("_c"))
    marks = bounds.select("key", value_bin(F.col("x")).alias("_b"), F.col("x").alias("_x"), "side")
    # before the values it equals for '<', after them for '<='
    rows = groups.withColumns({"side": F.lit(None).cast("string"), "_place": F.lit(1)}).unionByName(marks.withColumns({
        "_sub": F.lit(0).cast("long"), "_c": F.lit(0).cast("long"), "_place": F.when(F.col("side") == "a", 0).otherwise(2)}))
    bins = rows.groupBy("key", "_b").agg(F.sum("_c").alias("_nb"))
    before = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select("key", "_b", F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("key", "_b").orderBy("_x", "_place", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(offsets, ["key", "_b"])
              .withColumn("_start", F.col("_off") + F.col("_in")))
    place = F.row_number().over(Window.partitionBy("key", "_b", suffix, "_sub").orderBy("sim")) - 1
    groups_at = starts.where(F.col("side").isNull()).select("key", "_b", F.col("_x").alias(suffix), "_sub", "_start")
    ranked = (slim.withColumn("_p", place).join(groups_at, ["key", "_b", suffix, "_sub"])
              .select("key", "sim", suffix, (F.col("_start") + F.col("_p")).alias("_rank")))
    return ranked, starts.where(F.col("side").isNotNull()).select("key", "side", F.col("_x").alias("x"), F.col("_start").alias("_count"))


def pull_sims(sims: DataFrame, requests: DataFrame, suffix: str = "mean", seed: int = 1, uniform: Uniform = hash_uniform,
              selection: str = "target", under_level: str = "warn", max_replacement: float = 0.1,
              sub: Column | None = None) -> DataFrame:
    """Draw, with replacement, simulations whose statistic suits each request.

    requests is (request, key, n) with target and tol ('target'), low and high ('bounds') or neither
    ('any'). One row per (request, draw): the chosen sim, its statistic, the number of suitable ones in
    `available`, and `short` where those are too few. A request without any suitable simulation fails.

    Suitable simulations are a run of ranks by statistic: a request's two bounds become two ranks, and a
    draw is one lookup by (key, rank). Requests with equal bounds share them, so a hot target costs nothing.
    Store the statistics as a table first: they are read once for the ranks and once for the draws.
    """
    if under_level not in ("warn", "raise", "pass"):
        raise ValueError("under_level must be warn, raise or pass")
    low, high = {"target": lambda: (F.col("target") - F.col("tol"), F.col("target") + F.col("tol")),
                 "bounds": lambda: (F.col("low"), F.col("high")),
                 "any": lambda: (F.lit(-1e300), F.lit(1e300))}[selection]()
    asked = requests.select("request", "key", "n", low.cast("double").alias("_low"), high.cast("double").alias("_high"))
    ends = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("_low").alias("x")), F.struct(F.lit("z").alias("side"), F.col("_high").alias("x"))))
    bounds = asked.select("key", ends.alias("_e")).select("key", "_e.*").distinct()
    ranked, counts = rank_sims(sims, suffix, bounds, sub=sub)
    counts, size = resident(counts)

    def count_of(side: str, x: str, out: str) -> DataFrame:
        one = counts.where(F.col("side") == side).select("key", F.col("x").alias(x), F.col("_count").alias(out))
        return one if size is None else F.broadcast(one)
    ranks = asked.join(count_of("a", "_low", "_from"), ["key", "_low"]).join(count_of("z", "_high", "_to"), ["key", "_high"])
    none = F.raise_error(F.concat(F.lit("no simulations for request "), F.col("request").cast("string"))).cast("long")
    found = F.col("_to") - F.col("_from")
    ranks = ranks.withColumn("available", F.when(found > 0, found).otherwise(none))
    short = F.col("available") <= (1 - max_replacement) * F.col("n")
    if under_level == "raise":
        ranks = ranks.where(F.when(short, F.raise_error(F.lit("too few unique simulations")).cast("boolean")).otherwise(F.lit(True)))
    elif under_level == "pass":
        short = F.lit(False)
    drawn = ranks.withColumn("short", short).withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    drawn = drawn.withColumn("_rank", F.col("_from") + draw_index(uniform(seed, F.col("request"), F.col("draw")), F.col("available")))
    return (drawn.select("request", "key", "draw", "available", "short", "_rank").join(ranked, ["key", "_rank"]).drop("_rank"))


def stitch_months(stories: DataFrame, pools: DataFrame, realisations: int, seed: int = 1, uniform: Uniform = hash_uniform,
                  dry_months: Sequence[int] = C.NO_RESTRICTION_MONTHS) -> DataFrame:
    """Daily series per (story, realisation): one random pool member of each month's key, months in order.

    pools is (key, member 0..n-1, n, values); months without irrigation give zeros. Twelve to thirty-six
    arrays meet per group, bounded by the story length.
    """
    asked = stories.withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))))
    dry = asked.where(F.col("month").isin(*dry_months))
    wet = asked.where(~F.col("month").isin(*dry_months))
    sizes = pools.groupBy("key").agg(F.max("n").alias("n"))
    sized = _every(wet.join(lookup_side(sizes), "key", "left"), F.col("n"), "no simulations for", "story_id", "key")
    drawn = sized.withColumn("member", draw_index(uniform(seed, F.col("story_id"), F.col("seq"), F.col("realisation")), F.col("n")))
    picked = _every(drawn.join(lookup_side(pools.drop("n"), MAX_ARRAYS), ["key", "member"], "left"), F.col("values"), "no simulation for", "key", "member")
    zeros = dry.withColumn("values", F.array_repeat(F.lit(0.0), month_days(F.col("month"))))
    cols = ["story_id", "realisation", "seq", "values"]
    both = picked.select(*cols).unionByName(zeros.select(*cols))
    daily = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "values"))), lambda s: s["values"]))
    return both.groupBy("story_id", "realisation").agg(daily.alias("values"))


# ---- weighted draws ----------------------------------------------------------------------------------

def nyear_suite(draws: DataFrame, suite: DataFrame, nyr: int, values: Sequence[str] = ("pg",), log10p: str = "log10_prob",
                story: str = "story_id", keys: Sequence[str] = (), seed: int = 1, uniform: Uniform = hash_uniform,
                block: Column | None = None, draw: str = "draw") -> DataFrame:
    """n draws of nyr stories with probability proportional to 10^log10p: sums of log-probability and growth.

    Each draw row becomes nyr slots; a slot meets its story through the cell join, then one map-side
    combined aggregation sums the slots of a draw. No index matrix is held anywhere.
    """
    slots = draws.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(nyr - 1))))
    slots = slots.withColumn("_u", uniform(seed, F.col(draw), F.col("slot")))
    weighted = suite.where(F.col(log10p) > S.NEG_INF).withColumn("_w", S.pow10(F.col(log10p)))
    joined = inverse_cdf_join(slots, "_u", weighted, "_w", story, keys, block=block)
    return joined.groupBy(*keys, draw).agg(F.sum(log10p).alias(log10p), *[F.sum(v).alias(v) for v in values])


def nyear_suite_by_mode(draws: DataFrame, suite: DataFrame, nyr: int, values: Sequence[str] = ("pg",), seed: int = 1, uniform: Uniform = hash_uniform, draw: str = "draw",
                        story: str = "story_id", keys: Sequence[str] = ("site", "mode"), mode: str = "mode", block: Column | None = None) -> DataFrame:
    """(keys, draw, log10_prob_dryland, log10_prob_irrigated, values): nyr weighted draws per site and mode, summed.

    suite is (story, keys, log10_prob_dryland, log10_prob_irrigated, values), one row per story, site and mode; a story with a null among them is left out
    of that site and mode. Stories of the dryland mode are drawn by the dryland probability, those of irrigated and storage modes by the irrigated one; both probabilities are
    summed over what is drawn. All modes use the same uniforms. `values` may be the months of a year as well as its total. There are at most
    MAX_MODES sites and modes.
    """
    prob = ["log10_prob_dryland", "log10_prob_irrigated"]
    whole = suite.select(story, *keys, *prob, *values).dropna()
    modes = whole.select(*keys).distinct().limit(MAX_MODES + 1).collect()
    if len(modes) > MAX_MODES:
        raise ValueError(f"more than {MAX_MODES} sites and modes")
    weight = F.when(F.col(mode) == "dryland", F.col(prob[0])).otherwise(F.col(prob[1]))
    items = whole.withColumn("_w", S.pow10(weight)).where(weight > S.NEG_INF)
    slots = draws.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(nyr - 1)))).withColumn("_u", uniform(seed, F.col(draw), F.col("slot")))
    each = F.explode(F.array(*[F.struct(*[F.lit(m[k]).alias(k) for k in keys]) for m in modes])) if modes else F.explode(F.array().cast(suite.select(F.struct(*keys)).schema[0].dataType.simpleString().join(("array<", ">"))))
    dealt = slots.withColumn("_m", each).select(draw, "_u", *[F.col(f"_m.{k}").alias(k) for k in keys])
    joined = inverse_cdf_join(dealt, "_u", items, "_w", story, keys, block=block)
    return joined.groupBy(*keys, draw).agg(*[F.sum(c).alias(c) for c in (*prob, *values)])


def nyear_probability(picks: DataFrame, prob: DataFrame, draw: str = "draw", story: str = "story_id") -> DataFrame:
    """Sum of per-story log-probability under other regimes per (regime, draw)."""
    return (picks.select(draw, story).join(prob, story).groupBy("regime", draw)
            .agg(F.sum("log10_prob").alias("log10_prob")))


def year_index(years: DataFrame, year: str = "water_year", keys: Sequence[str] = ()) -> DataFrame:
    """Number the years of each key 0..n-1 (bounded by the calendar) and carry n."""
    w = Window.partitionBy(*keys).orderBy(year)
    return years.withColumns({"_i": (F.row_number().over(w) - 1).cast("long"), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def bootstrap_years(draws: DataFrame, annual: DataFrame, nyr: int, means: Sequence[str] = (), sums: Sequence[str] = (),
                    year: str = "water_year", keys: Sequence[str] = (), seed: int = 1, uniform: Uniform = hash_uniform,
                    draw: str = "draw", summarise: bool = True) -> DataFrame:
    """Uniform draws of nyr water years: means of flows and takes, sums of growth per draw (or the picks).

    With keys, draws has one row per (draw, keys).
    """
    indexed = year_index(annual, year, keys)
    n_rows = indexed.select(*keys, "_n").distinct()
    slots = draws.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(nyr - 1))))
    if keys:
        slots = slots.join(lookup_side(n_rows), list(keys))
    else:
        slots = slots.withColumn("_n", F.lit(n_rows.first()["_n"]))
    picked = slots.withColumn("_i", draw_index(uniform(seed, *[F.col(k) for k in keys], F.col(draw), F.col("slot")), F.col("_n")))
    joined = picked.drop("_n").join(lookup_side(indexed.drop("_n")), [*keys, "_i"]).drop("_i")
    if not summarise:
        return joined
    return joined.groupBy(*keys, draw).agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])


def draw_to_daily(picks: DataFrame, daily: DataFrame, year: str = "water_year") -> DataFrame:
    """Expand the picks of a draw back to its daily rows, year numbered by slot."""
    return picks.select("draw", "slot", year).join(lookup_side(daily), year)


def transition_intervals(transitions: DataFrame) -> DataFrame:
    """(month, from_state, to_state) with the interval [_lo, _hi) of a uniform that takes this step."""
    group = Window.partitionBy("month", "from_state")
    order = group.orderBy("to_state")
    run = F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("p").over(group)
    cum = transitions.where(F.col("p") > 0).withColumn("_run", run)
    return cum.select("month", "from_state", "to_state", F.coalesce(F.lag("_run").over(order), F.lit(0.0)).alias("_lo"),
                      F.when(F.lead("_run").over(order).isNull(), 2.0).otherwise(F.col("_run")).alias("_hi"))


def markov_paths(sims: DataFrame, transitions: DataFrame, start: str = "A-A", seed: int = 1, uniform: Uniform = hash_uniform,
                 unique: bool = True, n: int | None = None, months: Sequence[int] = (7, 8, 9, 10, 11, 12, 1, 2, 3, 4, 5),
                 sim: str = "sim") -> DataFrame:
    """12-month state paths from July: each step by the transition column of the month it leaves.

    The steps of all months become one constant, a list of cumulative probabilities per (month, state), so a path is one fold over its
    months inside its row: no join and no shuffle. Duplicate paths keep their smallest sim (combined map-side); with n, the n smallest
    sims are kept and too few unique paths are an error, so give more sims than n. The fixed table is bounded by MAX_STEPS rows;
    a state that a month cannot leave ends the job.
    """
    rows = transition_intervals(transitions.where(F.col("month").isin(*months))).select("month", "from_state", "to_state", "_hi").limit(MAX_STEPS + 1).collect()
    if len(rows) > MAX_STEPS:
        raise ValueError(f"more than {MAX_STEPS} steps: the table of a month's states is not a small one")
    names = sorted({r["from_state"] for r in rows} | {r["to_state"] for r in rows} | {start})
    number = {s: i for i, s in enumerate(names)}
    steps: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for r in rows:
        steps.setdefault((months.index(r["month"]), number[r["from_state"]]), []).append((r["_hi"], number[r["to_state"]]))
    if (0, number[start]) not in steps:
        raise ValueError(f"no transition from {start} in month {months[0]}")
    # one row of doubles and one of states per (month, state), in the order of the intervals
    cells = [sorted(steps.get((m, s), [])) for m in range(len(months)) for s in range(len(names))]
    # each as one literal, which is parsed once while the plan is made
    ends = F.from_json(F.lit(json.dumps([[hi for hi, _ in c] for c in cells])), "array<array<double>>")
    targets = F.from_json(F.lit(json.dumps([[to for _, to in c] for c in cells])), "array<array<int>>")
    draws = F.array(*[uniform(seed, F.col(sim), F.lit(i)) for i in range(len(months))])

    def step(path: Column, u: Column) -> Column:
        i = F.size(path) - 1
        cell = i * len(names) + F.get(path, i)
        # the last interval's end is 2, so every draw has one where the state can be left at all
        below = F.size(F.filter(F.get(ends, cell), lambda hi: hi <= u))
        return F.concat(path, F.array(F.get(F.get(targets, cell), below)))
    walked = F.aggregate(draws, F.array(F.lit(number[start])), step)
    state = F.from_json(F.lit(json.dumps(names)), "array<string>")
    stuck = F.raise_error(F.lit("a path reached a state that has no transition in its month")).cast("string")
    paths = sims.withColumn("states", F.transform(walked, lambda s: F.coalesce(F.get(state, s), stuck)))
    if not unique:
        return paths
    others = [c for c in paths.columns if c not in ("states", sim)]
    out = paths.groupBy("states").agg(F.min(sim).alias(sim), *[F.min_by(c, sim).alias(c) for c in others])
    if n is None:
        return out
    if out.count() < n:
        raise ValueError("too few unique paths, give more simulations")
    return out.orderBy(sim).limit(n)


def weighted_choice(u: Column, options: Sequence, probs: Sequence[float]) -> Column:
    """One of a short fixed list by its probabilities (normalised to 1)."""
    total, run = sum(probs), 0.0
    edges = []
    for o, p in zip(options, probs):
        run += p / total
        edges.append((o, run))
    out = F.lit(edges[-1][0])
    for o, edge in reversed(edges[:-1]):
        out = F.when(u < edge, F.lit(o)).otherwise(out)
    return out


def irrigation_suites(sims: DataFrame, bad: bool = True, seed: int = 1, uniform: Uniform = hash_uniform, sim: str = "sim") -> DataFrame:
    """12 restriction quantiles per sim: months 3-10 of the season drawn, the others 0."""
    options = [q / 100 for q in (C.BAD_QUANTILES if bad else C.GOOD_QUANTILES)]
    # the lambda binds each uniform once, so it is not computed again for every edge
    us = F.array(*[uniform(seed, F.col(sim), F.lit(i)) for i in range(2, 10)])
    drawn = F.transform(us, lambda u: weighted_choice(u, options, C.QUANTILE_PROBABILITIES))
    outside = F.array(F.lit(0.0), F.lit(0.0))
    return sims.withColumn("rest", F.concat(outside, drawn, outside))


def frequency_paths(sims: DataFrame, frequency: DataFrame, seed: int = 1, uniform: Uniform = hash_uniform, sim: str = "sim") -> DataFrame:
    """Independent month states by past frequency (normalised per month): rows (sim, month, state)."""
    as_steps = frequency.select("month", F.lit("-").alias("from_state"), F.col("state").alias("to_state"), F.col("freq").alias("p"))
    table = transition_intervals(as_steps).select(F.col("month").alias("_m"), F.col("to_state").alias("state"), "_lo", "_hi")
    months = F.explode(F.array(*[F.lit(m) for m in (7, 8, 9, 10, 11, 12, 1, 2, 3, 4, 5, 6)]))
    drawn = sims.withColumn("month", months).withColumn("_u", uniform(seed, F.col(sim), F.col("month")))
    return drawn.join(lookup_side(table), (F.col("month") == F.col("_m")) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_m", "_lo", "_hi", "_u")


def random_suite(paths: DataFrame, suites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unique (weather, irrigation) pairs as 12-row stories labelled from July 2024.

    paths is (weather, states), suites (irrigation, rest), pairs (weather, irrigation). Map the quantiles
    with map_storyline_rest afterwards; each month brings the class of the month before from its path, so that needs no window.
    """
    unique = pairs.dropDuplicates(["weather", "irrigation"])
    joined = unique.join(paths, "weather").join(suites, "irrigation")
    before = F.concat(F.array(F.lit("A-A")), F.slice("states", F.lit(1), F.size("states") - 1)).alias("before")
    rows = joined.select("weather", "irrigation", "states", "rest", before).select(
        "weather", "irrigation", F.posexplode(F.arrays_zip("states", "rest", "before")).alias("seq", "_m"))
    month = F.pmod(F.col("seq") + 6, F.lit(12)) + 1
    return rows.select("weather", "irrigation", "seq", month.alias("month"),
                       (F.lit(2024) + (F.col("seq") > 5).cast("int")).alias("year"),
                       F.split_part("_m.states", F.lit("-"), F.lit(1)).alias("temp_class"),
                       F.split_part("_m.states", F.lit("-"), F.lit(2)).alias("precip_class"),
                       F.split_part("_m.before", F.lit("-"), F.lit(2)).alias("precip_class_prev"),
                       F.col("_m.rest").alias("rest_per"))


def multi_year_stories(draws: DataFrame, year_sets: Sequence[DataFrame], seed: int = 1, uniform: Uniform = hash_uniform,
                       draw: str = "draw", story: str = "story_id", block: Callable[[Column], Column] | None = None) -> DataFrame:
    """An independent draw per year slot from that slot's set: ids and log-probabilities per slot, and their sum.

    A set of stories is (story_id, log10_prob); each has the same weight. `block` maps an id to its block
    in the two-level running sum (a hash by default).
    """
    out = draws
    for i, s in enumerate(year_sets):
        n = s.count()
        picked = out.withColumn("_u", uniform(seed, F.col(draw), F.lit(i)))
        even = s.select(F.col(story).alias(f"id_{i}"), F.col("log10_prob").alias(f"log10_prob_{i}")).withColumn("_w", F.lit(1.0 / n))
        out = inverse_cdf_join(picked, "_u", even, "_w", f"id_{i}", block=block(F.col(f"id_{i}")) if block else None).drop("_u")
    total = sum((F.col(f"log10_prob_{i}") for i in range(1, len(year_sets))), F.col("log10_prob_0"))
    return out.withColumn("log10_prob", total)


def expand_multi_year(chosen: DataFrame, stories: DataFrame, slots: int, draw: str = "draw") -> DataFrame:
    """Monthly rows of each slot's story with dates shifted by the slot."""
    pairs = chosen.select(draw, F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"id_{i}").alias("story_id"))
                                                    for i in range(slots)])).alias("_p")).select(draw, "_p.*")
    return pairs.join(stories, "story_id").withColumn("date", shift_years(F.col("date"), F.col("slot")))


def sample_without_replacement(df: DataFrame, n: int, *keys: str, seed: int = 1, uniform: Uniform = hash_uniform) -> DataFrame:
    """n distinct rows, the ones with the smallest hash; an error when fewer exist."""
    out = df.withColumn("_u", uniform(seed, *[F.col(k) for k in keys])).orderBy("_u", *keys).limit(n).drop("_u")
    if df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return out


def sample_size_study(ensemble: DataFrame, sizes: Sequence[int], resamples: int, keys: Sequence[str] = ("key",),
                      value: str = "value", seed: int = 1, uniform: Uniform = hash_uniform, relative_from: float = 10.0) -> DataFrame:
    """Error of the mean of m resamples of size n against the full mean, relative where the mean is at least 10.

    ensemble is (keys, member, value) with members of any numbers; nulls are left out. The ensemble is read once: a key's members become one array in
    order of member, and a resample is one fold over its n draws in that array. No draw becomes a row, and none is joined; what is shuffled is
    the ensemble, and a mean per (key, n, resample). An array holds the realisations of one key.
    """
    held = F.array_sort(F.collect_list(F.struct("member", F.col(value).cast("double").alias("v"))))
    arrays = ensemble.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("full_mean"), F.transform(held, lambda x: x["v"]).alias("_v"))
    plan = arrays.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def pick(total: Column, d: Column) -> Column:
        u = uniform(seed, *[F.col(k) for k in keys], F.col("n"), F.col("resample"), d)
        return total + F.get(F.col("_v"), draw_index(u, F.size("_v")).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), pick)
    means = plan.select(*keys, "n", "resample", "full_mean", (total / F.col("n")).alias("_m"))
    diff = F.abs(F.col("_m") - F.col("full_mean"))
    error = F.when(F.abs(F.col("full_mean")) >= relative_from, diff / F.abs(F.col("full_mean"))).otherwise(diff)
    return means.withColumn("error", error).groupBy(*keys, "n").agg(F.avg("error").alias("mean_error"), F.max("error").alias("max_error"))


def record_without_leap(df: DataFrame, date: str = "date") -> DataFrame:
    return drop_leap_day(df, date)
