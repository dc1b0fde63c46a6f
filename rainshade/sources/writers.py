"""Report and table sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions.calendar import lookup
from rainshade.operators.aggregates import nan_to_null, resolve


def report_columns(df: DataFrame, percent: Sequence[str] | None = None) -> DataFrame:
    """Probability columns x100 printed as '%.1f%%', but never columns named with sum or count."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float")] if percent is None else list(percent)
    chosen = [c for c in numeric if "sum" not in c and "count" not in c]
    return df.withColumns({c: F.format_string("%.1f%%", F.col(c) * 100) for c in chosen})


def write_report_csv(df: DataFrame, path: str, comment: str = "", percent: Sequence[str] | None = None, pct: bool = True) -> None:
    """CSV folder with a header; comment lines go to a sidecar so the data files stay plain CSV."""
    out = report_columns(df, percent) if pct else df
    out.write.mode("overwrite").csv(path, header=True)
    if comment:
        lines = [(f"# {line}",) for line in comment.splitlines()]
        df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}.comment")


def site_mode_table(df: DataFrame, values: Sequence[str], fun: str | Callable[[Column], Column] = "mean",
                    keys: Sequence[str] = ("site", "mode", "year", "month", "day")) -> DataFrame:
    """Aggregate over realisations with a chosen function, NaN skipped."""
    f = resolve(fun)
    return df.groupBy(*keys).agg(*[f(nan_to_null(F.col(v).cast("double"))).alias(v) for v in values])


def write_by_site_mode(df: DataFrame, path: str, values: Sequence[str], fun="mean", keys=("site", "mode", "year", "month", "day")) -> None:
    site_mode_table(df, values, fun, keys).write.mode("overwrite").partitionBy("site", "mode").parquet(path)


def packed(x: Column, scale: float, high: int = C.PACKED_MISSING - 1) -> Column:
    """Round half to even of x * scale, null to 65535; a value outside 0..high fails the job."""
    v = F.bround(x * scale, 0).cast("long")
    bad = F.raise_error(F.concat(F.lit("out of packed range: "), v.cast("string"))).cast("long")
    return F.when(v.isNull(), C.PACKED_MISSING).when((v < 0) | (v > high), bad).otherwise(v).cast("int")


def pack_scaled_int(df: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    """Classes as 0/1/2, log10 p x -100, rest x 1000, rest_per x 100, other columns by their scale."""
    rules = {"log10_prob_irrigated": -100, "log10_prob_dryland": -100, "rest": 1000, "rest_per": 100, **(scales or {})}
    out = {c: packed(F.col(c), s) for c, s in rules.items() if c in df.columns}
    for c, codes in (("precip_class", C.PACKED_PRECIP), ("temp_class", C.PACKED_TEMP)):
        if c in df.columns:
            out[c] = F.coalesce(lookup(codes, F.col(c)), F.lit(C.PACKED_MISSING)).cast("int")
    return df.withColumns(out)


def unpack_scaled_int(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != C.PACKED_MISSING, F.col(c) / s) for c, s in scales.items()})


def finite_stories(stories: DataFrame, probs: DataFrame, log10p: str = "log10_prob") -> DataFrame:
    """Only stories with a finite probability."""
    keep = probs.where(F.col(log10p) > float("-inf")).select("story_id")
    return stories.join(keep, "story_id", "left_semi")


def write_story_dirs(stories: DataFrame, probs: DataFrame, path: str, log10p: str = "log10_prob") -> None:
    """One table of the kept stories, partitioned by irrigation type instead of one file per story."""
    finite_stories(stories, probs, log10p).write.mode("overwrite").partitionBy("irr_type").parquet(path)
