"""Orders, top-k reports and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade.functions import scalars as S
from rainshade.functions.calendar import month_days, season_order


def order_by_season(df: DataFrame, *first: str, month: str = "month") -> DataFrame:
    """July-first order; range partitioned, so each task sorts its own part."""
    return df.orderBy(*first, season_order(F.col(month)))


def top_probable(df: DataFrame, n: int, target: float | None = None, value: str = "anomaly", atol: float = 1e-8,
                 log10p: str = "log10_prob", story: str = "story_id") -> DataFrame:
    """The n most probable stories (close to a target value), ranked; ties by id."""
    near = df if target is None else df.where(S.isclose(F.col(value), F.lit(target), atol))
    top = near.orderBy(F.desc(log10p), F.asc(story)).limit(n)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(log10p), F.asc(story))
    ranked = top.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("name", F.format_string("rank_%02d-%s", "rank", F.col(story).cast("string")))


def best_fit_stories(growth: DataFrame, profile: DataFrame, k: int = 10,
                     months: Sequence[int] = (9, 10, 11, 12, 1, 2, 3, 4, 5)) -> DataFrame:
    """Stories with the smallest L1 distance to a (site, mode, month) profile over the growing months."""
    target = profile.where(F.col("month").isin(*months)).select("site", "mode", "month", F.col("pg").alias("_t"))
    n = target.count()
    dist = (growth.join(target, ["site", "mode", "month"]).groupBy("story_id")
            .agg(F.sum(F.abs(F.col("pg") - F.col("_t"))).alias("distance"), F.count("pg").alias("_n")))
    return dist.where(F.col("_n") == n).select("story_id", "distance").orderBy("distance", "story_id").limit(k)


def spread_extremes(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key the groups with least, greatest and nearest-to-mean population standard deviation."""
    sd = df.groupBy(*keys, group).agg(F.stddev_pop(value).alias("sd"))
    means = sd.groupBy(*keys).agg(F.avg("sd").alias("_m"))
    # one row per key
    joined = sd.join(F.broadcast(means), list(keys)) if keys else sd.withColumn("_m", F.avg("sd").over(Window.partitionBy()))
    near = F.min(F.struct(F.round(F.abs(F.col("sd") - F.col("_m")), 9), F.col(group).alias("g"))).getField("g")
    return joined.groupBy(*keys).agg(F.min(F.struct("sd", group)).getField(group).alias("least"),
                                     F.min(F.struct((-F.col("sd")).alias("o"), F.col(group).alias("g"))).getField("g").alias("greatest"), near.alias("middle"))


def sorted_impact_table(df: DataFrame, event: str = "event", value: str = "anomaly") -> DataFrame:
    """Events by annual impact: sum of daily anomaly x month length over 12 months."""
    impact = F.sum(F.col(value) * month_days(F.col("month")))
    return df.groupBy(event).agg(impact.alias("impact")).orderBy("impact", event)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_months(events: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Months in which a left and a right event both occur, per pair of definitions.

    A month's events are collected (bounded by the number of definitions) and paired, so no month is
    joined with itself.
    """
    sets = events.groupBy("month", "year").agg(F.collect_set("event").alias("_e"))
    return (sets.select("month", "year", F.explode(F.array_intersect("_e", F.array(*[F.lit(x) for x in left]))).alias("left"), "_e")
            .select("month", "year", "left", F.explode(F.array_intersect("_e", F.array(*[F.lit(x) for x in right]))).alias("right")))


def joint_probability(pairs: DataFrame, years: int) -> DataFrame:
    return pairs.groupBy("left", "right", "month").agg((F.count(F.lit(1)) / F.lit(years)).alias("prob"))


def except_months(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (month, year) of a that are not in b."""
    return a.select("month", "year").subtract(b.select("month", "year"))


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(columns))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null-safe changed flag per column over all keys of both tables."""
    joined = a.alias("a").join(b.alias("b"), list(keys), "full")
    return joined.select(*keys, *[(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_changed") for c in columns])


def changes_by(compared: DataFrame, key: str) -> DataFrame:
    flags = [c for c in compared.columns if c.endswith("_changed")]
    return compared.groupBy(key).agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in flags])


def normalise_name(name: Column) -> Column:
    """Lower case, runs of other characters to one underscore: names of two model versions meet."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")
