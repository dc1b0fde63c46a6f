"""Readers for banner CSVs, story folders, matrices, mappers and gridded climate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainshade.constants import MONTH_NAMES
from rainshade.functions import scalars as S
from rainshade.functions.calendar import date_parts, month_number

RESTRICTION_SCHEMA = T.StructType([
    T.StructField("day", T.IntegerType()), T.StructField("doy", T.IntegerType()), T.StructField("f_rest", T.DoubleType()),
    T.StructField("flow", T.DoubleType()), T.StructField("month", T.IntegerType()), T.StructField("take", T.DoubleType()),
    T.StructField("year", T.IntegerType())])


def _without_banner(skip: int):
    """Drop the first skip + 1 lines of every file from lines that come with their file and the place of their split in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, goes_on = None, 0, False

        def check() -> None:
            if goes_on and seen <= skip:
                raise ValueError(f"the first {skip} lines of {at[0]} do not end in its first split")
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, (file, start, end, size) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "start", "end", "size")))):
                if (file, start) != at:
                    check()
                    at, seen, goes_on = (file, start), 0, start == 0 and end < size
                if start == 0:
                    seen += 1
                    keep[i] = seen > skip + 1
            if keep.any():
                yield pa.RecordBatch.from_arrays([b.column("value").filter(pa.array(keep))], names=["value"])
        check()
    return run


def read_banner_csv(spark: SparkSession, path: str, schema: T.StructType, skip: int | None = None, comment: str | None = None) -> DataFrame:
    """CSV with free text before its header.

    comment='#': Spark skips those lines itself. skip=n: the first n lines of each file are dropped by position with the header. Files are
    read in splits like any text; only the split at a file's start counts its lines, and fails where a longer file's banner does not end in it.
    A quoted field never spans lines. Columns match the schema by position, so an unnamed index column gets the schema's name; empty files have no rows.
    """
    if skip is None:
        return spark.read.csv(path, schema=schema, header=True, comment=comment, enforceSchema=True)
    place = F.col("_metadata")
    lines = spark.read.text(path).select("value", place["file_path"].alias("file"), place["file_block_start"].alias("start"),
                                         (place["file_block_start"] + place["file_block_length"]).alias("end"), place["file_size"].alias("size"))
    body = lines.mapInArrow(_without_banner(skip), "value string").where(F.trim("value") != "")
    return body.select(F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " ")).alias("r")).select("r.*")


def read_restriction_record(spark: SparkSession, paths: dict[str, str], version: str) -> DataFrame:
    """Typed daily restriction record; version names the file ('trended' or 'detrended')."""
    if version not in paths:
        raise ValueError(f"version must be one of {sorted(paths)}")
    schema = T.StructType([T.StructField("date", T.StringType()), *RESTRICTION_SCHEMA.fields])
    raw = spark.read.csv(paths[version], schema=schema, header=True)
    return raw.withColumn("date", F.to_date("date", "yyyy-MM-dd")).orderBy("date")


STORY_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("precip_class", T.StringType()), T.StructField("temp_class", T.StringType()),
    T.StructField("rest", T.DoubleType()), T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("rest_per", T.DoubleType())])


def read_story_dir(spark: SparkSession, path: str, schema: T.StructType = STORY_SCHEMA, pattern: str = r"([^/]+)\.csv$") -> DataFrame:
    """One small CSV per story, columns by the names in each file's header; id and good/bad come from the file path.

    Files of several layouts may lie in one folder: columns are found by name, others (an unnamed index, say) are passed over, and a
    file without one of the names fails the job. A story is a few dozen lines, so a file is one row; fields hold no commas.
    pattern has one group, the id; a folder name such as `story=rsl-000001bad` can carry it as well.
    """
    files = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("_lines"), F.col("_metadata.file_path").alias("_file"))
    header = files.withColumn("_names", F.transform(F.split(F.col("_lines")[0], ","), lambda n: F.trim(n)))
    rows = header.select("_file", "_names", F.explode(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))).alias("_line")).where(F.trim("_line") != "")
    fields = F.split("_line", ",", -1)

    def named(f: T.StructField):
        at = F.array_position("_names", f.name).cast("int")
        missing = F.raise_error(F.concat(F.lit(f"no column {f.name} in "), F.col("_file"))).cast("string")
        return F.nullif(F.when(at > 0, F.element_at(fields, at)).otherwise(missing), F.lit("")).cast(f.dataType).alias(f.name)
    df = rows.select(*[named(f) for f in schema.fields], F.regexp_extract("_file", pattern, 1).alias("story_id"))
    return df.withColumn("irr_type", F.nullif(F.regexp_extract("story_id", "(good|bad)", 1), F.lit("")))


STATES = ("AT,AP", "AT,D", "AT,W", "C,AP", "C,D", "C,W", "H,AP", "H,D", "H,W")


def _state(label):
    return F.concat_ws("-", S.strip_class(F.split_part(label, F.lit(","), F.lit(1))), S.strip_class(F.split_part(label, F.lit(","), F.lit(2))))


MONTH_PATTERN = f"[/=]({'|'.join(MONTH_NAMES)})[_/][^/]*$"
COMBO_PATTERN = "((?:N?D)-(?:N?D))[^/]*(?:/[^/]*)?$"


def read_transitions(spark: SparkSession, path: str, states: Sequence[str] = STATES) -> DataFrame:
    """Wide monthly matrices to (month, from_state, to_state, p); columns are the from-states.

    The month comes from the file name (Jan_...) or its folder (name=Jan).
    """
    ids = [f"s{i}" for i in range(len(states))]
    schema = T.StructType([T.StructField("to", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ids]])
    raw = spark.read.csv(path, schema=schema, header=True, comment="#").select(*schema.names, F.col("_metadata.file_path").alias("_f"))
    month = month_number(F.regexp_extract("_f", MONTH_PATTERN, 1))
    long = raw.withColumn("month", month).unpivot(["month", "to"], ids, "_c", "p")
    names = F.create_map(*[F.lit(x) for pair in zip(ids, states) for x in pair])
    return long.select("month", _state(F.element_at(names, F.col("_c"))).alias("from_state"), _state(F.col("to")).alias("to_state"), "p")


def read_initial(spark: SparkSession, path: str, states: Sequence[str] = STATES) -> DataFrame:
    """month x state matrix to (month, state, p)."""
    ids = [f"s{i}" for i in range(len(states))]
    schema = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ids]])
    raw = spark.read.csv(path, schema=schema, header=True, comment="#").withColumn("month", month_number(F.col("name")))
    names = F.create_map(*[F.lit(x) for pair in zip(ids, states) for x in pair])
    return (raw.unpivot(["month"], ids, "_c", "p")
            .select("month", _state(F.element_at(names, F.col("_c"))).alias("state"), "p"))


def read_quantile_mapper(spark: SparkSession, path: str, months: Sequence[int] = (9, 10, 11, 12, 1, 2, 3, 4)) -> DataFrame:
    """Wide files named by class combo to (combo, q, month, rest); values close to 0 become 1e-8."""
    schema = T.StructType([T.StructField("q", T.DoubleType()), *[T.StructField(f"m{m}", T.DoubleType()) for m in months]])
    raw = spark.read.csv(path, schema=schema, header=True).select(*schema.names, F.col("_metadata.file_path").alias("_f"))
    long = raw.withColumn("combo", F.regexp_extract("_f", COMBO_PATTERN, 1)).unpivot(
        ["combo", "q"], [f"m{m}" for m in months], "_m", "rest")
    return long.select("combo", "q", F.substring("_m", 2, 2).cast("int").alias("month"),
                       F.when(F.abs("rest") <= 1e-8, 1e-8).otherwise(F.col("rest")).alias("rest"))


def nearest_axis_value(grid: DataFrame, axis: str, x: float) -> float:
    """Axis value nearest to x (smallest on ties): a map-side combined minimum, one row to the driver."""
    return grid.agg(F.min(F.struct(F.abs(F.col(axis) - x).alias("d"), F.col(axis).alias("v"))).getField("v").alias("v")).first()["v"]


def grid_point_series(grid: DataFrame, lat: float, lon: float, years: tuple[int, int] | None = None,
                      variables: Sequence[str] = (), axis: DataFrame | None = None) -> DataFrame:
    """Daily series of the cell nearest on each axis independently, with date parts.

    The cell and year filters reach the scan; give `axis` (a table of cells) to avoid scanning for the axes.
    """
    cells = axis if axis is not None else grid.select("lat", "lon").distinct()
    at_lat, at_lon = nearest_axis_value(cells, "lat", lat), nearest_axis_value(cells, "lon", lon)
    out = grid.where((F.col("lat") == at_lat) & (F.col("lon") == at_lon))
    if years:
        out = out.where(F.col("year").between(*years)) if "year" in grid.columns else out.where(F.year("date").between(*years))
    out = out.select("date", "lat", "lon", *variables) if variables else out
    return date_parts(out)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], recalc: bool = False) -> DataFrame:
    """Read a named intermediate if it was finished before, else compute and write it.

    Only a folder with its success marker counts, so a job that died half way is computed again.
    """
    if recalc or not _exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
