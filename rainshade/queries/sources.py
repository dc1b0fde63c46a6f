"""Scans, sources and sinks (S1-S7, K1-K4): write what Spark derives from the tables, read it back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainshade.constants import MONTH_NAMES
from rainshade.functions.calendar import date_parts, month_name
from rainshade.operators.shape import long_to_wide
from rainshade.queries.base import query, r, rounded, scratch, text_date, with_
from rainshade.sources import readers as R
from rainshade.sources import writers as K

MONTHLY_FLOW = "SELECT CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, round(avg(flow), 4) AS flow FROM flow GROUP BY 1, 2"


@query("s1_read_banner_csv", with_("flow") + MONTHLY_FLOW)
def _(t):
    # a monthly report has one row per calendar month, so it is one small file under its banner
    m = t.flow.groupBy(F.month("date").alias("month"), F.year("date").alias("year")).agg(r(F.avg("flow"), 4).alias("flow"))
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in m.columns])
    text = m.agg(F.array_sort(F.collect_list(line)).alias("x")).select(F.concat_ws(
        "\n", F.lit("monthly flow"), F.lit("second line, free text"), F.lit("month,year,flow"), F.concat_ws("\n", "x")).alias("value"))
    path = scratch(t.spark)
    text.write.text(path)
    schema = T.StructType([T.StructField("month", T.IntegerType()), T.StructField("year", T.IntegerType()), T.StructField("flow", T.DoubleType())])
    return R.read_banner_csv(t.spark, path, schema, skip=2)


@query("s2_read_restriction_record", with_("rest", "flow") + """
SELECT CAST(r.date AS VARCHAR) AS date, CAST(day(r.date) AS INTEGER) AS day, CAST(dayofyear(r.date) AS INTEGER) AS doy, f_rest, flow,
  CAST(month(r.date) AS INTEGER) AS month, round((1 - f_rest) * 11.041e0, 4) AS take, CAST(year(r.date) AS INTEGER) AS year
FROM rest r JOIN flow f ON r.date = f.date""")
def _(t):
    j = date_parts(t.rest.join(t.flow.drop("n"), "date")).withColumn("take", F.round((1 - F.col("f_rest")) * 11.041, 4))
    path = scratch(t.spark)
    j.select("date", "day", "doy", "f_rest", "flow", "month", "take", "year").write.csv(path, header=True)
    return text_date(R.read_restriction_record(t.spark, {"detrended": path}, "detrended"), "date")


def _season_stories(t):
    """The most frequent class of each month per season and irrigation type: one story file each."""
    s = t.story_months.withColumn("season", F.floor(F.col("story_id") % 10000).cast("int"))
    c = s.groupBy("season", "irr_type", "seq", "year", "month", "precip_class", "temp_class").agg(
        F.count(F.lit(1)).alias("c"), F.round(F.max("rest"), 4).alias("rest"), F.max("rest_per").alias("rest_per"))
    top = F.max(F.struct("c", "precip_class", "temp_class", "rest", "rest_per")).alias("m")
    g = c.groupBy("season", "irr_type", "seq", "year", "month").agg(top)
    return g.select(F.concat(F.lit("rsl-"), F.col("season").cast("string"), "irr_type").alias("story"),
                    F.make_date("year", "month", F.lit(1)).alias("date"), "m.precip_class", "m.temp_class", "m.rest", "year", "month", "m.rest_per")


SEASON_STORIES = """ss_c AS (SELECT story_id % 10000 AS season, irr_type, seq, year, month, precip_class, temp_class, count(*) AS c,
  round(max(rest), 4) AS rest, max(rest_per) AS rest_per FROM stories GROUP BY ALL),
ss AS (SELECT *, row_number() OVER (PARTITION BY season, irr_type, month ORDER BY c DESC, precip_class DESC, temp_class DESC) AS rn FROM ss_c)"""


@query("s3_read_story_dir", with_("stories", extra=SEASON_STORIES) + """
SELECT CAST(make_date(year, month, 1) AS VARCHAR) AS date, precip_class, temp_class, rest, year, month, rest_per,
  'rsl-' || season || irr_type AS story_id, irr_type FROM ss WHERE rn = 1""")
def _(t):
    path = scratch(t.spark)
    _season_stories(t).repartition("story").write.partitionBy("story").csv(path, header=True)
    return R.read_story_dir(t.spark, path, pattern="story=([^/]+)/")


@query("s4_read_transitions", with_("stories", "transitions") + """
, ms AS (SELECT DISTINCT month FROM transitions), ts AS (SELECT DISTINCT to_state FROM transitions), fs AS (SELECT unnest(['A-A','A-D','A-W','C-A','C-D','C-W','H-A','H-D','H-W']) AS from_state)
SELECT mt.month, fs.from_state, mt.to_state, coalesce(t.p, 0e0) AS p FROM (SELECT DISTINCT month, to_state FROM transitions) mt, fs
LEFT JOIN transitions t ON t.month = mt.month AND t.from_state = fs.from_state AND t.to_state = mt.to_state""")
def _(t):
    states = [s.replace("AT", "A").replace("AP", "A").replace(",", "-") for s in R.STATES]
    wide = long_to_wide(t.transitions, ["month", "to_state"], "from_state", states, F.first("p")).na.fill(0.0)
    spell = F.concat_ws(",", *[F.when(F.col(c) == "A", a).otherwise(F.col(c)) for c, a in (("_t", "AT"), ("_p", "AP"))])
    parts = wide.withColumns({"_t": F.split_part("to_state", F.lit("-"), F.lit(1)), "_p": F.split_part("to_state", F.lit("-"), F.lit(2))})
    path = scratch(t.spark)
    parts.select(month_name(F.col("month")).alias("name"), spell.alias("to"), *[F.col(f"`{s}`") for s in states]).write.partitionBy("name").csv(path, header=True)
    return R.read_transitions(t.spark, path)


@query("s5_read_quantile_mapper", with_("mapper") + "SELECT combo, q, month, CASE WHEN abs(rest) <= 1e-8 THEN 1e-8 ELSE rest END AS rest FROM mapper")
def _(t):
    months = [9, 10, 11, 12, 1, 2, 3, 4]
    wide = long_to_wide(t.mapper, ["combo", "q"], "month", months, F.first("rest"))
    path = scratch(t.spark)
    wide.write.partitionBy("combo").csv(path, header=True)
    return R.read_quantile_mapper(t.spark, path, months)


@query("s6_grid_point_series", """WITH grid AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 10 AS DOUBLE) AS lat, CAST(l_partkey % 7 AS DOUBLE) AS lon,
  round(avg(l_quantity), 6) AS rain FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(date AS VARCHAR) AS date, lat, lon, rain, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
  CAST(dayofyear(date) AS INTEGER) AS doy FROM grid WHERE lat = 3 AND lon = 5 AND year(date) BETWEEN 1996 AND 1999""")
def _(t):
    x = t.table("lineitem").select(F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 10).cast("double").alias("lat"),
                                   (F.col("l_partkey") % 7).cast("double").alias("lon"), "l_quantity")
    grid = x.groupBy("date", "lat", "lon").agg(r(F.avg("l_quantity")).alias("rain"))
    cells = x.select("lat", "lon").distinct()
    return text_date(R.grid_point_series(grid, 3.5, 5.2, (1996, 1999), ["rain"], axis=cells), "date")


@query("s7_read_cached", with_("flow") + MONTHLY_FLOW)
def _(t):
    path = scratch(t.spark)
    m = t.flow.groupBy(F.month("date").alias("month"), F.year("date").alias("year")).agg(r(F.avg("flow"), 4).alias("flow"))
    R.read_cached(t.spark, path, lambda: m)
    return R.read_cached(t.spark, path, lambda: m.limit(0))


@query("k1_write_report_csv", with_("flow") + """SELECT CAST(CAST(month(date) AS INTEGER) AS VARCHAR) AS month, CAST(count(*) AS VARCHAR) AS count,
  format('{:.1f}%', avg(CASE WHEN flow < 50 THEN 1e0 ELSE 0e0 END) * 100) AS prob FROM flow GROUP BY month(date)""")
def _(t):
    low = F.when(F.col("flow") < 50, 1.0).otherwise(0.0)
    m = t.flow.groupBy(F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("count"), F.avg(low).alias("prob"))
    path = scratch(t.spark)
    K.write_report_csv(m, path, "probability of low flow\nby month")
    return t.spark.read.csv(path, header=True)


@query("k2_write_by_site_mode", with_("stories") + """SELECT site, mode, month, round(avg(pg), 6) AS pg, round(avg(rest), 6) AS rest FROM stories GROUP BY 1, 2, 3""")
def _(t):
    path = scratch(t.spark)
    K.write_by_site_mode(t.story_months, path, ["pg", "rest"], "mean", ["site", "mode", "month"])
    return rounded(t.spark.read.parquet(path)).select("site", "mode", "month", "pg", "rest")


@query("k3_pack_scaled_int", with_("stories") + """SELECT story_id, month, CASE precip_class WHEN 'D' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS precip_class,
  CASE temp_class WHEN 'C' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS temp_class, CAST(round_even(rest * 1000, 0) AS INTEGER) AS rest,
  CAST(round_even(rest_per * 100, 0) AS INTEGER) AS rest_per, CAST(round_even(pg * 1e0, 0) AS INTEGER) AS pg FROM stories""")
def _(t):
    return K.pack_scaled_int(t.story_months.select("story_id", "month", "precip_class", "temp_class", "rest", "rest_per", "pg"), {"pg": 1.0})


@query("k4_write_story_dirs", with_("stories", "impact") + """SELECT story_id, month, irr_type, state FROM stories WHERE story_id IN (SELECT story_id FROM impact WHERE n_months >= 11)""")
def _(t):
    path = scratch(t.spark)
    probs = t.impact.select("story_id", F.when(F.col("n_months") >= 11, F.col("log10_prob")).otherwise(float("-inf")).alias("log10_prob"))
    K.write_story_dirs(t.story_months.select("story_id", "month", "irr_type", "state"), probs, path)
    return t.spark.read.parquet(path).select("story_id", "month", "irr_type", "state")
