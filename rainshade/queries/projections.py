"""Projections and filters (P1-P25)."""

from pyspark.sql import functions as F

from rainshade.constants import SITE_MODES
from rainshade.functions import calendar as D
from rainshade.functions import scalars as S
from rainshade.operators import shape as P
from rainshade.queries.base import query, r, rounded, text_date, with_


@query("p1_rename_select", "SELECT o_orderkey AS id, o_totalprice AS flow, o_orderstatus AS status FROM orders")
def _(t):
    return P.rename_select(t.table("orders"), {"o_orderkey": "id", "o_totalprice": "flow", "o_orderstatus": "status"})


@query("p2_convert_units", """SELECT l_orderkey, l_linenumber, round(l_quantity + 250 - 273.15e0, 6) AS tmax, round(l_discount * 86400e0, 6) AS rain,
  round(l_extendedprice * 86400e-6, 6) AS radn FROM lineitem""")
def _(t):
    x = t.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 250).alias("tmax"), F.col("l_discount").alias("rain"), F.col("l_extendedprice").alias("radn"))
    return rounded(P.convert_units(x, {"tmax": "kelvin", "rain": "kg_m2_s", "radn": "w_m2"}))


@query("p3_date_parts", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy FROM orders""")
def _(t):
    x = t.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date"))
    return text_date(D.date_parts(x, fmt="yyyyMMdd"), "date")


@query("p4_water_year", """SELECT o_orderkey, CAST(year(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH) AS INTEGER) AS start_year,
  CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS end_year FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.table("orders").select("o_orderkey", D.water_year(d).alias("start_year"), D.water_year(d, "end").alias("end_year"))


@query("p5_nonleap_doy", """SELECT o_orderkey, CAST(dayofyear(o_orderdate) - CASE WHEN dayofyear(last_day(make_date(year(o_orderdate), 2, 1))) = 60 AND month(o_orderdate) > 2
  THEN 1 ELSE 0 END AS INTEGER) AS doy FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)""")
def _(t):
    x = D.drop_leap_day(t.table("orders"), "o_orderdate")
    return x.select("o_orderkey", D.nonleap_doy(F.col("o_orderdate")).alias("doy"))


@query("p6_derived_weather", with_("weather") + """SELECT site, CAST(date AS VARCHAR) AS date, round((tmax + tmin) / 2, 6) AS tmean, round(rain - pet, 6) AS rain_less_pet,
  CAST(rain > 0.01e0 AS INTEGER) AS wet_day FROM weather""")
def _(t):
    x = P.derived_weather(t.weather).withColumn("wet_day", F.col("wet_day").cast("int"))
    return rounded(text_date(x, "date").select("site", "date", "tmean", "rain_less_pet", "wet_day"))


@query("p7_season_mask", with_("classes") + """SELECT year, month, CASE WHEN month IN (11,12,1,2,3) AND temp_class = 'H' THEN 1 ELSE 0 END AS hot,
  CASE WHEN month IN (5,6,7,8,9) AND precip_class = 'W' THEN 1 ELSE 0 END AS wet FROM classes""")
def _(t):
    x = t.rest_classes.select("year", "month", (F.col("temp_class") == "H").cast("int").alias("hot"), (F.col("precip_class") == "W").cast("int").alias("wet"))
    return P.season_mask(x, {"hot": (11, 12, 1, 2, 3), "wet": (5, 6, 7, 8, 9)})


@query("p8_year_range", with_("flow") + "SELECT CAST(date AS VARCHAR) AS date, flow FROM flow WHERE year(date) BETWEEN 1996 AND 1998")
def _(t):
    return text_date(P.year_range(t.flow.withColumn("year", F.year("date")), 1996, 1998).select("date", "flow"), "date")


@query("p9_threshold_grid", with_("weather", extra="""g AS (SELECT site, date, tmax, tmin, unnest([15, 16, 17, 18]) AS thr FROM weather),
c AS (SELECT site, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, thr, count(*) FILTER (tmax >= thr AND tmin <= 4) AS days FROM g GROUP BY 1, 2, 3, 4)""") + """
SELECT site, year, month, printf('%02dd_d_tmax_%02d', nd, thr) AS event, days, CAST(days >= nd AS INTEGER) AS flag FROM c, (VALUES (3), (5), (10)) v(nd)""")
def _(t):
    x = D.date_parts(t.weather)
    grid = [(f"d_tmax_{k:02d}", (F.col("tmax") >= k) & (F.col("tmin") <= 4)) for k in (15, 16, 17, 18)]
    return P.threshold_grid(x, ["site", "year", "month"], grid, [3, 5, 10]).withColumn("flag", F.col("flag").cast("int"))


MONTH_LIMITS = [(m, "tmax" if m in (11, 12, 1, 2, 3) else "tmin", 17.0 if m in (11, 12, 1, 2, 3) else 3.0, 5 + m % 3) for m in range(1, 13)]


@query("p10_monthly_threshold", with_("weather") + """, lim AS (SELECT m AS month, CASE WHEN m IN (11,12,1,2,3) THEN 'tmax' ELSE 'tmin' END AS var,
  CASE WHEN m IN (11,12,1,2,3) THEN 17e0 ELSE 3e0 END AS threshold, 5 + m % 3 AS ndays FROM range(1, 13) x(m))
SELECT site, CAST(year(date) AS INTEGER) AS year, CAST(l.month AS INTEGER) AS month,
  CAST(count(*) FILTER (CASE var WHEN 'tmax' THEN tmax ELSE tmin END >= threshold) >= max(ndays) AS INTEGER) AS flag
FROM weather w JOIN lim l ON month(w.date) = l.month GROUP BY 1, 2, 3""")
def _(t):
    lim = t.spark.createDataFrame(MONTH_LIMITS, "month int, var string, threshold double, ndays int")
    x = P.monthly_threshold(D.date_parts(t.weather), lim, ["tmax", "tmin"])
    return x.groupBy("site", "year", "month").agg((F.count_if("day_flag") >= F.max("ndays")).cast("int").alias("flag"))


@query("p11_isclose", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice - l_quantity * 2500) <= 100 + 1e-5 * abs(l_quantity * 2500)""")
def _(t):
    x = t.table("lineitem")
    return x.where(S.isclose(F.col("l_extendedprice"), F.col("l_quantity") * 2500, atol=100.0)).select("l_orderkey", "l_linenumber")


@query("p12_bounded_suite", with_("stories") + """, per AS (SELECT story_id, site, mode, printf('m%02d', month) AS period, pg AS value FROM stories
  UNION ALL SELECT story_id, site, mode, 'yr1', round(sum(pg), 6) FROM stories GROUP BY 1, 2, 3),
b AS (SELECT * FROM (VALUES ('oxford', 'irrigated', 'yr1', 12000e0, 16000e0), ('oxford', 'irrigated', 'm10', 500e0, NULL), ('oxford', 'irrigated', 'm01', NULL, 1900e0)) v(site, mode, period, low, high))
SELECT story_id FROM per JOIN b USING (site, mode, period) GROUP BY 1 HAVING count(*) FILTER (value IS NOT NULL AND (low IS NULL OR value >= low) AND (high IS NULL OR value <= high)) = 3""")
def _(t):
    rows = [("oxford", "irrigated", "yr1", 12000.0, 16000.0), ("oxford", "irrigated", "m10", 500.0, None), ("oxford", "irrigated", "m01", None, 1900.0)]
    bounds = t.spark.createDataFrame(rows, "site string, mode string, period string, low double, high double")
    s = t.story_months
    months = s.select("story_id", "site", "mode", F.format_string("m%02d", F.col("month")).alias("period"), F.col("pg").alias("value"))
    years = s.groupBy("story_id", "site", "mode").agg(r(F.sum("pg")).alias("value")).select("story_id", "site", "mode", F.lit("yr1").alias("period"), "value")
    return P.bounded_suite(months.unionByName(years), bounds)


@query("p13_state_limited", with_("stories") + """SELECT story_id FROM stories WHERE month IN (9, 12) GROUP BY 1
HAVING bool_and(CASE month WHEN 9 THEN temp_class IN ('A', 'H') ELSE precip_class IN ('D', 'A') AND rest_per BETWEEN 0.1e0 AND 0.9e0 END) AND count(DISTINCT month) = 2""")
def _(t):
    return P.state_limited(t.story_months, {9: {"temp": {"A", "H"}, "precip": "*"}, 12: {"temp": "*", "precip": {"D", "A"}, "rest_per": (0.1, 0.9)}})


@query("p14_recode_classes", """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey % 4 - 1 END AS code FROM orders)
SELECT o_orderkey, CASE code WHEN -1 THEN 'C' WHEN 0 THEN 'AT' WHEN 1 THEN 'H' END AS temp, CASE code WHEN -1 THEN 'W' WHEN 0 THEN 'AP' WHEN 1 THEN 'D' END AS precip,
  CASE code WHEN -1 THEN 'C' WHEN 0 THEN 'A' WHEN 1 THEN 'H' END AS stripped, CAST(code AS INTEGER) AS back FROM c""")
def _(t):
    x = t.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 3, F.col("o_orderkey") % 4 - 1).alias("code"))
    temp = S.recode_temp(F.col("code"))
    return x.select("o_orderkey", temp.alias("temp"), S.recode_precip(F.col("code")).alias("precip"), S.strip_class(temp).alias("stripped"), S.code_temp(temp).alias("back"))


@query("p15_simplify_state", with_("stories") + """, s AS (SELECT *, lag(precip_class, 1, 'A') OVER (PARTITION BY story_id ORDER BY seq) AS prev FROM stories)
SELECT story_id, month, CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END AS state, CASE prev WHEN 'D' THEN 'D' ELSE 'ND' END || '-' || CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END AS combo FROM s""")
def _(t):
    from rainshade.operators.windows import lag_state
    x = lag_state(t.story_months, ["story_id"], "seq", {"precip_class": "A"})
    return x.select("story_id", "month", S.dry_state(F.col("precip_class")).alias("state"), S.combo_key(F.col("prev_precip_class"), F.col("precip_class")).alias("combo"))


@query("p16_regime_index", with_("stories") + """SELECT story_id, month, CASE temp_class WHEN 'C' THEN 0 WHEN 'A' THEN 3 ELSE 6 END + CASE precip_class WHEN 'W' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS regime FROM stories""")
def _(t):
    return t.story_months.select("story_id", "month", S.regime_index(F.col("temp_class"), F.col("precip_class")).alias("regime"))


@query("p17_keep_finite", "SELECT l_orderkey, l_linenumber, round(log10(l_discount), 6) AS log10_prob FROM lineitem WHERE l_discount > 0")
def _(t):
    x = t.table("lineitem").select("l_orderkey", "l_linenumber", r(S.log10_safe(F.col("l_discount"))).alias("log10_prob"))
    return P.keep_finite(x, ["log10_prob"])


CORRECTION = """CASE WHEN month IN (6,7,8) THEN CASE WHEN month = 6 THEN 150e0 WHEN month = 7 AND site = 'eyrewell' THEN 310e0 WHEN month = 7 THEN 155e0
  WHEN site = 'eyrewell' THEN 465e0 ELSE 310e0 END ELSE pg * CASE WHEN month IN (9,10) THEN 1.4e0 WHEN month IN (12,1,2,3) THEN 0.8e0 ELSE 1e0 END END"""


@query("p18_growth_correction", with_("stories", extra=f"fixed AS (SELECT *, {CORRECTION} AS pg2 FROM stories)") + """
SELECT story_id, site, mode, round(CASE WHEN count(*) = 12 THEN sum(pg2) END, 4) AS pg_yr1 FROM fixed GROUP BY 1, 2, 3""")
def _(t):
    x = P.growth_correction(t.story_months)
    return rounded(P.yearly_growth(x, ["story_id", "site", "mode"]), 4)


@query("p19_normalise_to_mode", with_("stories", extra="""m AS (SELECT story_id % 10000 AS story_id, site, mode, month, round(avg(pg), 6) AS pg FROM stories GROUP BY 1, 2, 3, 4)""") + """
SELECT a.story_id, a.site, a.month, a.mode, round(a.pg * o.pg / n.pg, 6) AS pg, round(a.pg / o.pg, 6) AS ratio FROM m a
JOIN m o ON o.story_id = a.story_id AND o.site = a.site AND o.month = a.month AND o.mode = 'irrigated'
JOIN m n ON n.story_id = a.story_id AND n.site = a.site AND n.month = a.month AND n.mode = 'dryland'""")
def _(t):
    m = t.story_months.groupBy((F.col("story_id") % 10000).alias("story_id"), "site", "mode", "month").agg(r(F.avg("pg")).alias("pg"))
    with_ratio = P.ratio_to_mode(m, "irrigated")
    out = P.normalise_to_mode(with_ratio, m.where("mode = 'irrigated'"), m.where("mode = 'dryland'"))
    return rounded(out.select("story_id", "site", "month", "mode", "pg", "ratio"))


@query("p20_to_daily_rate", with_("stories") + """SELECT story_id, month, round(pg / CASE WHEN month = 2 THEN 28 WHEN month IN (4,6,9,11) THEN 30 ELSE 31 END, 6) AS pg FROM stories""")
def _(t):
    return rounded(P.to_daily_rate(t.story_months).select("story_id", "month", "pg"))


@query("p21_difference_dataset", with_("stories", extra="""a AS (SELECT grp, month, round(avg(pg), 6) AS pg, round(avg(rest), 6) AS rest FROM stories GROUP BY 1, 2),
b AS (SELECT grp, month, round(max(pg), 6) AS pg, round(max(rest), 6) AS rest FROM stories GROUP BY 1, 2)""") + """
SELECT grp, month, round(a.pg - b.pg, 6) AS pg, round(a.rest - b.rest, 6) AS rest FROM a JOIN b USING (grp, month)""")
def _(t):
    s = t.story_months
    a = s.groupBy("grp", "month").agg(r(F.avg("pg")).alias("pg"), r(F.avg("rest")).alias("rest"))
    b = s.groupBy("grp", "month").agg(r(F.max("pg")).alias("pg"), r(F.max("rest")).alias("rest"))
    return rounded(P.difference_dataset(a, b, ["grp", "month"], ["pg", "rest"]))


@query("p22_wide_to_long", with_("stories") + """, w AS (SELECT story_id, site, mode, CAST(m AS INTEGER) AS month, s.pg FROM (SELECT DISTINCT story_id, site, mode FROM stories) d
  CROSS JOIN range(1, 13) x(m) LEFT JOIN stories s USING (story_id) WHERE s.month = m OR s.month IS NULL)
SELECT story_id, site, mode, printf('m%02d', month) AS period, pg AS value FROM stories""")
def _(t):
    s = t.story_months.withColumn("name", F.format_string("_pg_m%02d", F.col("month")))
    names = [f"_pg_m{m:02d}" for m in range(1, 13)]
    wide = P.long_to_wide(s, ["story_id", "site", "mode"], "name", names, F.first("pg"))
    # one wide frame per site-mode carries the names `{site}-{mode}_pg_m01`, as the growth tables do
    out = None
    for site, mode in SITE_MODES[:3]:
        one = wide.where((F.col("site") == site) & (F.col("mode") == mode)).select("story_id", *[F.col(n).alias(f"{site}-{mode}{n}") for n in names])
        long = P.split_growth_names(one, ["story_id"]).where(F.col("value").isNotNull())
        out = long if out is None else out.unionByName(long)
    return out


@query("p23_parse_tuple", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(month(o_orderdate) AS INTEGER) END AS month,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""")
def _(t):
    x = t.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(
        F.format_string("(%d, %d)", F.month("o_orderdate"), F.year("o_orderdate"))).alias("text"))
    m, y = P.parse_tuple(F.col("text"))
    return x.select("o_orderkey", m.alias("month"), y.alias("year"))


@query("p24_clip", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 12 > 1 THEN 1e0 WHEN l_discount * 12 < 0.001e0 THEN 0e0 ELSE round(l_discount * 12, 6) END AS f_rest,
  greatest(l_quantity - 25, 0e0) AS diff FROM lineitem""")
def _(t):
    x = t.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12).alias("f_rest"), S.clip(F.col("l_quantity") - 25, low=0.0).alias("diff"))
    return rounded(P.clean_restriction(x))


@query("p25_filter_month_regime", with_("record", "classes") + """SELECT CAST(date AS VARCHAR) AS date, rain FROM record w JOIN classes c ON year(w.date) = c.year AND month(w.date) = c.month
WHERE c.month = 3 AND c.regime % 3 = 5 % 3""")
def _(t):
    daily = D.date_parts(t.record)
    return text_date(P.filter_month_regime(daily, t.rest_classes, 3, 5, same_rain_class=True).select("date", "rain"), "date")
