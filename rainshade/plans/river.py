"""River flow regimes, hydro-year statistics and ecological scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import scalars as S
from rainshade.functions.calendar import literal_map, water_year
from rainshade.operators import windows as W
from rainshade.operators.aggregates import agg_map, count_days
from rainshade.operators.shape import long_to_wide
from rainshade.operators.joins import interp_join


def naturalise_flow(df: DataFrame, first_year: int = C.NATURALISE_FROM_YEAR) -> DataFrame:
    """Add the take back to the flow in irrigation days since the scheme started."""
    taken = (F.col("year") >= first_year) & S.in_irrigation_season(F.col("doy"))
    return df.withColumn("nat", F.when(taken, F.col("flow") + F.col("take")).otherwise(F.col("flow")))


def restriction_scenario(nat: DataFrame, regimes: dict[str, tuple] | None = None, winter_take: bool = False) -> DataFrame:
    """Restriction, take and flow of each regime on naturalised flow; the regimes are exploded from a literal."""
    options = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(float(a)).alias("start"), F.lit(float(b)).alias("stop"))
                                  for n, (a, b) in (regimes or C.REGIMES).items()]))
    rows = nat.withColumn("_r", options).select("*", "_r.*").drop("_r")
    rest = S.regime_restriction(F.col("nat"), F.col("start"), F.col("stop"))
    if not winter_take:
        rest = F.when(S.in_irrigation_season(F.col("doy")), rest).otherwise(1.0)
    return (rows.withColumn("f_rest", rest).withColumn("take", (1 - F.col("f_rest")) * C.SCHEME_TAKE)
            .withColumn("flow", F.col("nat") - F.col("take")).drop("start", "stop"))


def hydro_year_stats(df: DataFrame, scenario: Sequence[str] = ("scenario",), date: str = "date", flow: str = "flow",
                     temp: str = "temp", slope: float = 1.0, intercept: float = 0.0, require_full: bool = True) -> DataFrame:
    """25 statistics per (scenario, hydro year) of daily flow and air temperature.

    The 7-day mean is centred, needs 4 values and crosses year ends. One window pass over the series, one
    window pass inside hydro years for the spells, one aggregation; all share the scenario key.
    """
    daily = df.withColumns({"hydro_year": water_year(F.col(date), "end"), "_water": S.water_temp(F.col(temp), slope, intercept)})
    daily = W.rolling(daily, scenario, date, flow, 7, "mean", "_roll", center=True, min_periods=4)
    group = [*scenario, "hydro_year"]
    w = Window.partitionBy(*group).orderBy(date)
    limits = {"malf": C.MALF, "flow_limit": C.FLOW_LIMIT}
    below = {n: F.col(flow) < v for n, v in limits.items()}
    # length of the current run below each limit: rows since the last row at or above it
    run = {}
    for n, cond in below.items():
        daily = daily.withColumn(f"_rn", F.row_number().over(w))
        last_above = F.max(F.when(cond, F.lit(0)).otherwise(F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        run[n] = f"_run_{n}"
        daily = daily.withColumn(run[n], F.col("_rn") - F.coalesce(last_above, F.lit(0)))
    # a spell of at least k days passes through run length k exactly once
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_days"), F.min("_roll").alias("alf"), F.median(flow).alias("median_flow"),
                          F.max(flow).alias("max_flow"), F.count_if(below["malf"]).alias("days_below_malf"),
                          F.count_if(below["flow_limit"]).alias("days_below_flow_limit"), F.count_if(F.col(flow) > C.MAF).alias("days_above_maf")]
    aggs += [F.count_if(F.col("_water") > t).alias(f"days_above_{t}C") for t in C.TEMPERATURE_THRESHOLDS]
    aggs += [F.count_if(F.col(run[n]) == k).alias(f"{n}_events_{k:02d}d") for k in C.SPELL_LENGTHS for n in limits]
    stats = daily.groupBy(*group).agg(*aggs)
    if require_full:
        whole = F.col("n_days").between(365, 366)
        # a filter, so that no pruning of columns can lose the check
        stats = stats.where(F.when(whole, True).otherwise(F.raise_error(F.lit("hydro years must have 365 or 366 days")).cast("boolean")))
    out = stats.withColumns({"malf_anomaly": C.MALF - F.col("alf"), "maf_anomaly": F.col("max_flow") - C.MAF,
                             "maf_malf_product": F.col("days_above_maf") * F.col("days_below_malf")})
    habitat = {f"{s}_wua": S.polynomial5(F.col("alf"), k, *C.HABITAT_RANGE) for s, k in C.HABITAT_COEFFICIENTS.items()}
    return out.withColumns(habitat)


def stats_long(stats: DataFrame, scenario: Sequence[str] = ("scenario",)) -> DataFrame:
    names = list(C.SCORED_STATISTICS)
    cast = stats.select(*scenario, "hydro_year", *[F.col(n).cast("double").alias(n) for n in names])
    return cast.unpivot([*scenario, "hydro_year"], names, "stat", "value")


def eco_scores(stats: DataFrame, weightings: Sequence[str] = tuple(C.WEIGHTINGS), scenario: Sequence[str] = ("scenario",),
               baseline: dict[str, tuple] | None = None) -> DataFrame:
    """Weighted score per (scenario, weighting, hydro year): mean over statistics of score x weight.

    A pure projection of the wide statistics: weights and ranges are literals, so nothing is joined.
    """
    ranges = baseline or dict(zip(C.SCORED_STATISTICS, C.BASELINE_RANGES))
    scored = stats.select(*scenario, "hydro_year", *[
        S.score(F.col(s).cast("double"), F.lit(float(ranges[s][0])), F.lit(float(ranges[s][1])), F.lit(s in C.HIGHER_IS_BETTER)).alias(s)
        for s in C.SCORED_STATISTICS])
    parts = []
    for name in weightings:
        if name not in C.WEIGHTINGS:
            raise ValueError(f"weighting must be one of {sorted(C.WEIGHTINGS)}, got {name}")
        total = F.lit(0.0)
        for stat, weight in zip(C.SCORED_STATISTICS, C.WEIGHTINGS[name]):
            total = total + F.lit(float(weight)) * F.col(stat)
        parts.append(F.struct(F.lit(name).alias("weighting"), (total / len(C.SCORED_STATISTICS)).alias("score")))
    return scored.select(*scenario, "hydro_year", F.explode(F.array(*parts)).alias("_s")).select(*scenario, "hydro_year", "_s.*")


def mean_scores(scores: DataFrame, scenario: Sequence[str] = ("scenario",)) -> DataFrame:
    return scores.groupBy(*scenario, "weighting").agg(F.avg("score").alias("score"))


def statistic_scores(stats: DataFrame, scenario: Sequence[str] = ("scenario",), weighting: str = "unweighted") -> DataFrame:
    """Score x weight of each statistic in long form."""
    weights = literal_map({s: float(w) for s, w in zip(C.SCORED_STATISTICS, C.WEIGHTINGS[weighting])})
    lows = literal_map({s: float(r[0]) for s, r in zip(C.SCORED_STATISTICS, C.BASELINE_RANGES)})
    highs = literal_map({s: float(r[1]) for s, r in zip(C.SCORED_STATISTICS, C.BASELINE_RANGES)})
    s = F.col("stat")
    value = S.score(F.col("value"), lows[s], highs[s], s.isin(*C.HIGHER_IS_BETTER)) * weights[s]
    return stats_long(stats, scenario).withColumn("score", value)


def annual_low_flow(df: DataFrame, keys: Sequence[str], date: str = "date", flow: str = "flow", variant: str = "centred",
                    label: str = "end") -> DataFrame:
    """Least 7-day mean per hydro year.

    'centred' needs 4 values and crosses year ends, 'trailing' needs 7 and crosses, 'within' needs 7 and
    restarts in each hydro year.
    """
    dated = df.withColumn("hydro_year", water_year(F.col(date), label))
    part = [*keys, "hydro_year"] if variant == "within" else list(keys)
    if variant == "centred":
        rolled = W.rolling(dated, part, date, flow, 7, "mean", "_roll", center=True, min_periods=4)
    elif variant in ("trailing", "within"):
        rolled = W.rolling(dated, part, date, flow, 7, "mean", "_roll")
    else:
        raise ValueError("variant must be centred, trailing or within")
    return rolled.groupBy(*keys, "hydro_year").agg(F.min("_roll").alias("alf"))


def low_flow_report(df: DataFrame, keys: Sequence[str], date: str = "date", flow: str = "flow", stress: float = C.FLOW_LIMIT) -> DataFrame:
    """Per series: median flow, mean annual low flow, worst 1, 2 and 3 year low flow and their anomalies."""
    alf = annual_low_flow(df, keys, date, flow, "within", "start")
    w = Window.partitionBy(*keys).orderBy("hydro_year")
    sums = alf.withColumns({f"_s{n}": F.when(F.count("alf").over(w.rowsBetween(-(n - 1), 0)) == n,
                                             F.sum("alf").over(w.rowsBetween(-(n - 1), 0))) for n in (2, 3)})
    worst = sums.groupBy(*keys).agg(F.avg("alf").alias("malf"), F.min("alf").alias("worst_1"), F.min("_s2").alias("worst_2"), F.min("_s3").alias("worst_3"))
    out = worst.withColumns({f"anomaly_{n}": F.col("malf") - F.col(f"worst_{n}") for n in (1, 2, 3)})
    median = df.groupBy(*keys).agg(F.median(flow).alias("median_flow"), F.count_if(F.col(flow) < stress).alias("stress_days"))
    return out.join(median, list(keys))


def low_flow_years(df: DataFrame, report: DataFrame, keys: Sequence[str], date: str = "date", flow: str = "flow", stress: float = C.FLOW_LIMIT) -> DataFrame:
    """Per hydro year: days below the mean annual low flow, stress days and lengths of stress spells over a day."""
    dated = df.withColumn("hydro_year", water_year(F.col(date), "start"))
    group = [*keys, "hydro_year"]
    joined = dated.join(report.select(*keys, "malf"), list(keys))
    days = count_days(joined, group, {"days_below_malf": F.col(flow) < F.col("malf"), "stress_days": F.col(flow) < stress})
    spells = W.spell_counts(W.runs(dated, keys, date, F.col(flow) <= stress, ["hydro_year"]), group, (), longer_than=1)
    return days.join(spells.select(*group, "n_spells", "lengths"), group, "left")


def flow_pg_daily(nat: DataFrame, growth: DataFrame | None = None, regimes: dict | None = None, winter_take: bool = False,
                  date: str = "date") -> DataFrame:
    """Flow, trailing 7-day flow, take (and growth per site-mode) of each regime and day."""
    daily = restriction_scenario(nat, regimes, winter_take).withColumn("water_year", water_year(F.col(date), "start"))
    daily = W.rolling(daily, ["regime"], date, "flow", 7, "mean", "alf")
    return daily if growth is None else daily.join(growth, ["regime", date])


def flow_pg_annual(daily: DataFrame, growth: Sequence[str] = ()) -> DataFrame:
    """Least 7-day flow and summed take (and growth) per regime and water year."""
    return agg_map(daily, ["regime", "water_year"], {"alf": "min", "take": "sum", **{g: "sum" for g in growth}})


def restriction_pivot(daily: DataFrame) -> DataFrame:
    """Monthly restriction by regime as one column per regime."""
    months = daily.withColumns({"year": F.year("date"), "month": F.month("date")})
    return long_to_wide(months, ["year", "month"], "regime", list(C.REGIMES), F.avg("f_rest"))


def growth_exceedance(annual: DataFrame, curve: DataFrame, growth: str, keys: Sequence[str] = ()) -> DataFrame:
    return interp_join(annual, growth, curve, "pg", "prob", "prob", keys)
