"""Storyline probability, validity, selection and restriction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import scalars as S
from rainshade.functions.calendar import month_name, season_order, season_year
from rainshade.operators import aggregates as A
from rainshade.operators import joins as J
from rainshade.operators import statistics as M
from rainshade.operators.shape import bounded_suite, long_to_wide, require_rows, state_limited
from rainshade.plans.events import class_codes


MAX_REGIMES = 1000


def story_log10_prob(stories: DataFrame, transitions: DataFrame, initial: DataFrame, irr_prob_from_zero: bool = False,
                     add_irr_prob: bool = True, story: str = "story_id") -> DataFrame:
    """log10 probability per story: first state, every step out of months other than 5-7, and restriction tails.

    The last row's restriction never counts; a step with probability 0 gives -inf and is kept. A state or
    step that is missing from its table fails the job. One window and one aggregation on the story key.
    """
    weather, tail = _probability_terms(irr_prob_from_zero)
    total = weather + tail if add_irr_prob else weather
    return _story_steps(stories, transitions, initial, story).groupBy(story).agg(F.sum(total).alias("log10_prob"))


def story_log10_probs(stories: DataFrame, transitions: DataFrame, initial: DataFrame, irr_prob_from_zero: bool = False,
                      story: str = "story_id") -> DataFrame:
    """Irrigated and dryland log-probability of each story in one pass."""
    weather, tail = _probability_terms(irr_prob_from_zero)
    return _story_steps(stories, transitions, initial, story).groupBy(story).agg(
        F.sum(weather + tail).alias("log10_prob_irrigated"), F.sum(weather).alias("log10_prob_dryland"))


def _story_steps(stories: DataFrame, transitions: DataFrame, initial: DataFrame, story: str) -> DataFrame:
    """Each month beside its successor, the probability of that step and of its own state."""
    rows = stories.select(story, "month", "rest", "rest_per", (F.col("year") * 12 + F.col("month")).alias("_t"),
                          S.state_key(S.strip_class(F.col("temp_class")), S.strip_class(F.col("precip_class"))).alias("state"))
    w = Window.partitionBy(story).orderBy("_t")
    steps = rows.withColumns({"next_state": F.lead("state").over(w), "_first": F.row_number().over(w) == 1})
    trans = transitions.select("month", F.col("from_state").alias("state"), F.col("to_state").alias("next_state"), F.col("p").alias("_p"))
    first = initial.select("month", "state", F.col("p").alias("_p0"))
    return steps.join(J.lookup_side(trans), ["month", "state", "next_state"], "left").join(J.lookup_side(first), ["month", "state"], "left")


def _probability_terms(from_zero: bool) -> tuple[Column, Column]:
    def needed(p: str) -> Column:
        missing = F.concat(F.lit("no probability for "), F.to_json(F.struct("month", "state", "next_state")))
        return S.log10_safe(F.coalesce(F.col(p), F.raise_error(missing).cast("double")))
    counted = F.col("next_state").isNotNull() & ~F.col("month").isin(*C.SKIPPED_TRANSITION_MONTHS)
    weather = F.when(F.col("_first"), needed("_p0")).otherwise(0.0) + F.when(counted, needed("_p")).otherwise(0.0)
    return weather, F.when(counted, S.tail_prob(F.col("rest"), F.col("rest_per"), from_zero)).otherwise(0.0)


def recalc_story_prob(stories: DataFrame, weather_prob: DataFrame, mappers: DataFrame, story: str = "story_id") -> DataFrame:
    """Log-probability under each regime: weather part + tail of the quantile its restriction has there.

    mappers is (regime, combo, q, month, rest); the quantile is clamped interpolation of q over rest.
    Zero restrictions add nothing.
    """
    w = Window.partitionBy(story).orderBy("year", "month")
    keyed = (stories.withColumn("_prev", F.lag("precip_class", 1, "A").over(w))
             .withColumn("combo", S.combo_key(F.col("_prev"), F.col("precip_class")))
             .where((F.col("rest") > 0) & F.col("month").isin(*C.IRRIGATION_MONTHS)))
    regimes = mappers.select("regime").distinct()
    # of equal restrictions the last quantile stands for the value itself
    asked = keyed.select(story, "combo", "month", F.col("rest").cast("double").alias("rest"))
    names = [r["regime"] for r in regimes.orderBy("regime").limit(MAX_REGIMES + 1).collect()]
    if len(names) > MAX_REGIMES:
        raise ValueError(f"more than {MAX_REGIMES} regimes")
    asked = asked.withColumn("regime", F.explode(F.array(*[F.lit(n) for n in names])))
    curve = mappers.select("regime", "combo", "month", F.col("rest").alias("_r"), F.col("q").alias("_q"))
    placed = J.interp_join(asked, "rest", curve, "_r", "_q", "q_new", ["regime", "combo", "month"], False, (0.0, 1.0), 256, "_q")
    tails = placed.groupBy(story, "regime").agg(F.sum(S.log10_safe(0.5 - F.abs(0.5 - F.col("q_new")))).alias("_tail"))
    base = weather_prob.withColumn("regime", F.explode(F.array(*[F.lit(n) for n in names])))
    return base.join(tails, [story, "regime"], "left").select(
        story, "regime", (F.col("log10_prob") + F.coalesce("_tail", F.lit(0.0))).alias("log10_prob"))


def invalid_stories(stories: DataFrame, acceptable: DataFrame, story: str = "story_id") -> DataFrame:
    """Stories that break a rule, with one flag per rule.

    acceptable is (state, month). Rules: known classes, restriction in [0, 1], starts in July, no month
    missing or doubled, no restriction in 6-8, class pair seen in that month.
    """
    seen = acceptable.select("state", "month", F.lit(True).alias("_seen"))
    rows = stories.withColumn("state", S.state_key(F.col("temp_class"), F.col("precip_class"))).join(J.lookup_side(seen), ["state", "month"], "left")
    t = F.col("year") * 12 + F.col("month")
    flags = rows.groupBy(story).agg(
        F.bool_or(~F.coalesce(F.col("temp_class").isin("C", "A", "H") & F.col("precip_class").isin("W", "A", "D"), F.lit(False))).alias("bad_class"),
        F.bool_or(~F.coalesce(F.col("rest").between(0, 1), F.lit(False))).alias("bad_rest"),
        (F.min_by("month", t) != 7).alias("bad_start"),
        ((F.max(t) - F.min(t) + 1 != F.count(F.lit(1))) | (F.count_distinct(t) != F.count(F.lit(1)))).alias("bad_dates"),
        F.bool_or(F.col("month").isin(*C.NO_RESTRICTION_MONTHS) & (F.col("rest") != 0)).alias("bad_winter"),
        F.bool_or(F.col("_seen").isNull()).alias("bad_state"))
    names = [c for c in flags.columns if c.startswith("bad_")]
    broken = F.lit(False)
    for n in names:
        broken = broken | F.col(n)
    return flags.where(broken)


def zero_transitions(transitions: DataFrame, acceptable: DataFrame) -> DataFrame:
    """Every pair of acceptable (month, state) -> (next month, state) as zero, non-zero or no data.

    A month has at most nine states, so a pair list per month has at most 81 rows.
    """
    a = acceptable.select("month", F.col("state").alias("from_state"))
    b = acceptable.select(F.when(F.col("month") == 1, 12).otherwise(F.col("month") - 1).alias("month"), F.col("state").alias("to_state"))
    pairs = a.join(b, "month").join(transitions, ["month", "from_state", "to_state"], "left")
    kind = F.when(F.col("p").isNull(), "no data").when(F.col("p") == 0, "zero").otherwise("non-zero")
    return pairs.select("month", "from_state", "to_state", "p", kind.alias("kind"))


def scenario_limits(scenario: DataFrame, tolerance: float, value: str = "pg") -> DataFrame:
    """(site, mode, period, low, high) bounds around the mean monthly growth of a scenario.

    A tolerance below 5 kg becomes 300 kg; months 6-8 and dryland have no bound.
    """
    means = (scenario.where(~F.col("month").isin(6, 7, 8) & (F.col("mode") != "dryland")).groupBy("site", "mode", "month")
             .agg(F.avg(value).alias("_m")))
    tol = F.col("_m") * tolerance
    tol = F.when(tol < 5, 300.0).otherwise(tol)
    return means.select("site", "mode", F.format_string("m%02d", F.col("month").cast("int")).alias("period"),
                        (F.col("_m") - tol).alias("low"), (F.col("_m") + tol).alias("high"))


def growth_periods(monthly_pg: DataFrame, value: str = "pg") -> DataFrame:
    """Long growth with monthly and yearly periods: (story_id, site, mode, period, value)."""
    keys = ["story_id", "site", "mode"]
    months = monthly_pg.select(*keys, F.format_string("m%02d", F.col("month").cast("int")).alias("period"), F.col(value).alias("value"))
    years = monthly_pg.groupBy(*keys).agg(F.sum(value).alias("value")).select(*keys, F.lit("yr1").alias("period"), "value")
    return months.unionByName(years)


def storyline_subclusters(stories: DataFrame, monthly_pg: DataFrame, probs: DataFrame, bounds: DataFrame, limits: dict | None,
                          k: int, n_pcs: int = 15, curves: DataFrame | None = None, seed: int = 1) -> dict[str, DataFrame]:
    """Select stories by growth bounds and state limits, cluster them, and report each cluster.

    Returns clusters (story, cluster), mass (size, share of probability), growth (rows, cluster and grand
    means) and, with exceedance curves, the exceedance of the cluster means.
    """
    kept = bounded_suite(growth_periods(monthly_pg), bounds)
    if limits:
        kept = kept.join(state_limited(stories, limits), "story_id", "left_semi")
    # components, leaves and clusters each pass over the features several times
    features = require_rows(M.stored(M.story_features(stories.join(kept, "story_id", "left_semi"))))
    names = [c for c in features.columns if c != "story_id"]
    comps, explained = M.pca(features, names, min(n_pcs, len(names)))
    clusters = M.hierarchical_clusters(comps, k, n_pcs, seed).select("story_id", "cluster")
    with_prob = clusters.join(probs, "story_id")
    annual = monthly_pg.groupBy("story_id", "site", "mode").agg(F.sum("pg").alias("pg")).join(clusters, "story_id")
    means = annual.groupBy("site", "mode", "cluster").agg(F.avg("pg").alias("pg"))
    out = {"clusters": clusters, "explained": explained, "mass": A.cluster_mass(with_prob), "growth": A.group_and_total(annual, "cluster", ["pg"])}
    if curves is not None:
        table = curves.withColumn("_kg", F.col("pg") * 1000).select("site", "mode", "_kg", "prob", F.row_number().over(
            Window.partitionBy("site", "mode").orderBy("pg")).alias("_row"))
        out["exceedance"] = J.nearest_row(means, "pg", table, "_kg", "_row", ["site", "mode"]).drop("_row")
    return out


def unique_event_impact(events: DataFrame, base_state: str = "A-A") -> DataFrame:
    """Growth of single-month events by months since the event, minus the base event of the same month.

    events is (event, month0, state, rest, seq, value); the base is the A-A event of that month with
    rest 50, or 0 in months 5-8. The base is one value per (month0, months since), a few hundred at most.
    """
    starts = Window.partitionBy("event")
    since = events.withColumn("since", F.col("seq") - F.min("seq").over(starts))
    base_rest = F.when(F.col("month0").isin(*C.UNMAPPED_MONTHS), 0).otherwise(50)
    is_base = (F.col("state") == base_state) & (F.col("rest") == base_rest)
    base = since.groupBy("month0", "since").agg(F.max(F.when(is_base, F.col("value"))).alias("_base"))
    return since.join(J.lookup_side(base), ["month0", "since"]).select(
        "event", "month0", "state", "rest", "since", (F.col("value") - F.col("_base")).alias("impact"))


def verify_realisations(months: DataFrame, story: DataFrame, limits: DataFrame) -> DataFrame:
    """Reclassify each realisation's months with given limits and compare with its story.

    months is (key, realisation, month, tmean, sma); story (key, month, temp_class, precip_class). One row
    per realisation: number of mismatches, their keys (at most the story's months) and `bad`.
    """
    t, p = class_codes(*[F.col(c) for c in ("tmean", "tmean_low", "tmean_high", "sma", "sma_low", "sma_high")])
    got = months.join(limits, "month").withColumns({"_gt": S.strip_class(S.recode_temp(t)), "_gp": S.strip_class(S.recode_precip(p))})
    both = got.join(story, ["key", "month"])
    wrong = (F.col("_gt") != F.col("temp_class")) | (F.col("_gp") != F.col("precip_class"))
    label = F.format_string("m%02d:%s-%s", F.col("month").cast("int"), F.col("_gt"), F.col("_gp"))
    return (both.groupBy("key", "realisation").agg(F.count_if(wrong).alias("mismatches"),
                                                   F.array_sort(F.collect_list(F.when(wrong, label))).alias("keys"))
            .withColumn("bad", F.col("mismatches") > 0))


def failure_rate(checked: DataFrame) -> DataFrame:
    return checked.groupBy("key").agg(F.avg(F.col("bad").cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))


def drop_bad(sims: DataFrame, checked: DataFrame) -> DataFrame:
    return sims.join(checked.where("bad").select("key", "realisation"), ["key", "realisation"], "left_anti")


def restriction_table_for_events(frequency: DataFrame, mapper: DataFrame, quantiles: Sequence[int] = C.EVENT_QUANTILES) -> DataFrame:
    """Restriction at fixed quantiles for every observed (month, state), previous class A; one column per quantile."""
    asked = frequency.select("month", "state").distinct().withColumn("_q", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    combo = S.combo_key(F.lit("A"), S.strip_class(F.split_part("state", F.lit("-"), F.lit(2))))
    table = mapper.select("combo", "month", F.bround(F.col("q") * 100).cast("int").alias("_q"), F.col("rest").alias("_r"))
    joined = asked.withColumn("combo", combo).join(table, ["combo", "month", "_q"], "left")
    value = F.when(F.col("month").isin(*C.UNMAPPED_MONTHS), 0.0).otherwise(F.col("_r"))
    return long_to_wide(joined.withColumn("_v", value), ["month", "state"], "_q", list(quantiles), F.max("_v"))


def options_text(frequency: DataFrame) -> DataFrame:
    """Month name and its observed states as one text (at most nine states)."""
    return frequency.groupBy("month").agg(F.concat_ws(",", F.array_sort(F.collect_set("state"))).alias("options")).withColumn("name", month_name(F.col("month")))


def historic_storylines(classes: DataFrame, first: int = 1972, last: int = 2018, keys: Sequence[str] = ()) -> DataFrame:
    """Each complete July-June season as a 12-month story with the previous month's class."""
    w = Window.partitionBy(*keys).orderBy("year", "month")
    rows = (classes.withColumn("precip_class_prev", F.lag("precip_class", 1, "A").over(w))
            .withColumns({"season": season_year(F.col("year"), F.col("month")), "seq": season_order(F.col("month")),
                          "rest": F.bround("rest", 2)}))
    rows = rows.where(F.col("season").between(first, last))
    full = F.count(F.lit(1)).over(Window.partitionBy(*keys, "season"))
    story = F.concat_ws("-", F.lit("hist"), *[F.col(k).cast("string") for k in keys], F.col("season").cast("string"))
    return rows.withColumn("_n", full).where(F.col("_n") == 12).drop("_n").withColumn("story_id", story)


def quantify_storylines(stories: DataFrame, mapper: DataFrame) -> DataFrame:
    """Restriction fractions of historic stories to quantiles."""
    keyed = stories.withColumn("combo", S.combo_key(F.col("precip_class_prev"), F.col("precip_class")))
    return J.nearest_quantile(keyed, mapper, "rest", "rest_per")
