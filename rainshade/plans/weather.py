"""Weather statistics per month and regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainshade.operators import aggregates as A
from rainshade.operators import statistics as M
from rainshade.operators import windows as W


def weather_statistics(daily: DataFrame, classes: DataFrame, variables: Sequence[str] = ("tmax", "tmin", "radn", "pet"),
                       bins: int = 100, rain_bins: int = 1000, only: Sequence[str] = ("persistence", "cdf", "rain_cdf", "matrices")) -> dict[str, DataFrame]:
    """Statistics for every (month, regime) in one job each: streak persistence, wet and dry CDFs, rain CDF, lag matrices.

    Only the asked ones are planned, as some look at their input while they are. daily is one site's record (date, rain, variables); classes is (year, month, regime).
    """
    flagged = W.last_day_flag(daily.withColumns({"year": F.year("date"), "month": F.month("date")}), [], "date")
    flagged = W.streak_index(flagged.withColumn("dry", F.col("rain") == 0), [], "date", "dry")
    keyed = flagged.join(classes.select("year", "month", "regime"), ["year", "month"])
    keys = ["month", "regime"]
    long = keyed.select(*keys, "dry", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x"))
                                                          for v in variables])).alias("_s")).select(*keys, "dry", "_s.*")
    cdf_keys = [*keys, "variable", "dry"]
    make = {
        "persistence": lambda: W.persistence_by_streak(keyed, keys, "dry"),
        "cdf": lambda: A.refine_cdf(A.empirical_cdf(long, cdf_keys, "x", bins), cdf_keys, bins),
        "rain_cdf": lambda: A.empirical_cdf(keyed.where(F.col("rain") != 0), keys, "rain", rain_bins),
        "matrices": lambda: M.lag_correlation_matrices(keyed, keys, "date", variables),
    }
    return {name: make[name]() for name in only}
