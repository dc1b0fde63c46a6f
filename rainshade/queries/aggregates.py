"""Aggregations (A1-A33)."""

from pyspark.sql import functions as F

from rainshade.functions.calendar import date_parts
from rainshade.operators import aggregates as A
from rainshade.operators import windows as W
from rainshade.plans.river import annual_low_flow
from rainshade.queries.base import query, rounded, text_date, with_
from rainshade.queries.joins import EVENTS3, events3

YM = "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month"


@query("a1_monthly", with_("weather") + f"SELECT site, {YM}, round(avg(rain), 6) AS rain, round(avg(tmax), 6) AS tmax FROM weather GROUP BY 1, 2, 3")
def _(t):
    return rounded(A.monthly(date_parts(t.weather), ["rain", "tmax"], "mean", ["site", "year", "month"]))


@query("a2_agg_map", with_("weather") + f"SELECT site, {YM}, round(sum(rain), 6) AS rain, round(avg(pet), 6) AS pet, round(min(tmin), 6) AS tmin, round(arg_min(radn, date), 6) AS radn FROM weather GROUP BY 1, 2, 3")
def _(t):
    return rounded(A.agg_map(date_parts(t.weather), ["site", "year", "month"], {"rain": "sum", "pet": "mean", "tmin": "min", "radn": "first"}))


@query("a3_describe_by", """SELECT o_orderstatus, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std,
  min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75,
  max(o_totalprice) AS max FROM orders GROUP BY 1, 2""")
def _(t):
    return rounded(A.describe_by(t.table("orders").withColumn("month", F.month("o_orderdate")), ["o_orderstatus", "month"], "o_totalprice", refine=True), 4)


@query("a4_occurrence", with_("weather") + """SELECT site, CAST(month(date) AS INTEGER) AS month, count(*) FILTER (rain > 0.01e0) AS sum, round(avg(CASE WHEN rain > 0.01e0 THEN 1e0 ELSE 0e0 END), 6) AS prob FROM weather GROUP BY 1, 2""")
def _(t):
    return rounded(A.occurrence(date_parts(t.weather).withColumn("flag", F.col("rain") > 0.01), ["site", "month"]))


@query("a4_occurrence_48", with_("classes", extra=EVENTS3) + "SELECT event, month, count(*) AS sum, round(count(*) / 48e0, 6) AS prob FROM ev GROUP BY 1, 2")
def _(t):
    return rounded(A.occurrence(events3(t).withColumn("flag", F.lit(True)), ["event", "month"], years=48))


@query("a5_class_limits", with_("months") + """SELECT site, month, round(quantile_cont(tmean, 0.25), 6) AS tmean_low, round(quantile_cont(tmean, 0.75), 6) AS tmean_high,
  round(quantile_cont(rain, 0.25), 6) AS rain_low, round(quantile_cont(rain, 0.75), 6) AS rain_high FROM months GROUP BY 1, 2""")
def _(t):
    return rounded(A.class_limits(t.months, ["tmean", "rain"], keys=["site", "month"]))


@query("a6_quantile_table", with_("stories") + """, s AS (SELECT *, lag(precip_class, 1, 'A') OVER (PARTITION BY story_id ORDER BY seq) AS prev FROM stories),
k AS (SELECT CASE prev WHEN 'D' THEN 'D' ELSE 'ND' END || '-' || CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END AS combo, month, pg - 900 AS v FROM s),
g AS (SELECT combo, CAST(m AS INTEGER) AS month, CAST(i AS INTEGER) AS i FROM (VALUES ('D-D'), ('D-ND'), ('ND-D'), ('ND-ND')) c(combo), (SELECT unnest([9,10,11,12,1,2,3,4]) AS m), range(1, 100) t(i)),
q AS (SELECT combo, month, quantile_cont(greatest(v, 0e0), [0.01,0.02,0.03,0.04,0.05,0.06,0.07,0.08,0.09,0.1,0.11,0.12,0.13,0.14,0.15,0.16,0.17,0.18,0.19,0.2,0.21,0.22,0.23,0.24,0.25,0.26,0.27,0.28,0.29,0.3,0.31,0.32,0.33,0.34,0.35,0.36,0.37,0.38,0.39,0.4,0.41,0.42,0.43,0.44,0.45,0.46,0.47,0.48,0.49,0.5,0.51,0.52,0.53,0.54,0.55,0.56,0.57,0.58,0.59,0.6,0.61,0.62,0.63,0.64,0.65,0.66,0.67,0.68,0.69,0.7,0.71,0.72,0.73,0.74,0.75,0.76,0.77,0.78,0.79,0.8,0.81,0.82,0.83,0.84,0.85,0.86,0.87,0.88,0.89,0.9,0.91,0.92,0.93,0.94,0.95,0.96,0.97,0.98,0.99]) AS a FROM k GROUP BY 1, 2)
SELECT g.combo, g.month, i / 100e0 AS q, CASE WHEN coalesce(a[i], 0e0) <= 1e-8 THEN 1e-8 ELSE round(a[i], 6) END AS rest FROM g LEFT JOIN q ON q.combo = g.combo AND q.month = g.month""")
def _(t):
    from rainshade.functions import scalars as S
    x = W.lag_state(t.story_months, ["story_id"], "seq", {"precip_class": "A"})
    x = x.select(S.combo_key(F.col("prev_precip_class"), F.col("precip_class")).alias("combo"), "month", F.greatest(F.col("pg") - 900, F.lit(0.0)).alias("rest"))
    out = A.quantile_table(x)
    return out.withColumn("rest", F.when(F.col("rest") > 1e-8, F.round("rest", 6)).otherwise(F.col("rest")))


PCT = "[" + ",".join(str(i / 100) for i in range(101)) + "]"


@query("a7_percentile_curve", with_("impact") + f""", q AS (SELECT site, mode, quantile_cont(pg, {PCT}) AS a FROM impact GROUP BY 1, 2)
SELECT site, mode, CAST(i AS INTEGER) AS percentile, round(a[i + 1], 5) AS value FROM q, range(0, 101) t(i)""")
def _(t):
    return rounded(A.percentile_curve(t.impact, ["site", "mode"], "pg"), 5)


@query("a8_state_frequency", with_("stories") + "SELECT month, state, round(count(*) / 48e0, 6) AS freq FROM stories GROUP BY 1, 2")
def _(t):
    return rounded(A.state_frequency(t.story_months))


@query("a9_months_by_class", with_("stories") + "SELECT state, array_to_string(list_sort(list(DISTINCT month)), ',') AS months FROM stories GROUP BY 1")
def _(t):
    return A.months_by_class(t.story_months, ["state"]).withColumn("months", F.concat_ws(",", F.col("months").cast("array<string>")))


@query("a10_median_by", "SELECT o_custkey, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def _(t):
    return rounded(A.median_by(t.table("orders"), ["o_custkey"], "o_totalprice"), 4)


@query("a11_count_days", with_("flow") + """SELECT CAST(year(date - INTERVAL 6 MONTH) AS INTEGER) + 1 AS hydro_year, count(*) FILTER (flow < 42.2007397e0) AS below_malf, count(*) FILTER (flow > 90) AS above FROM flow GROUP BY 1""")
def _(t):
    from rainshade.functions.calendar import water_year
    return A.count_days(t.flow.withColumn("hydro_year", water_year(F.col("date"), "end")), ["hydro_year"], {"below_malf": F.col("flow") < 42.2007397, "above": F.col("flow") > 90})


def _alf_sql(frame: str, need: int, part: str = "") -> str:
    return with_("flow") + f""", h AS (SELECT *, CAST(year(date - INTERVAL 6 MONTH) AS INTEGER) + 1 AS hydro_year FROM flow),
w AS (SELECT hydro_year, CASE WHEN count(flow) OVER x >= {need} THEN avg(flow) OVER x END AS v FROM h WINDOW x AS ({part} ORDER BY date ROWS BETWEEN {frame}))
SELECT hydro_year, round(min(v), 6) AS alf FROM w GROUP BY 1"""


@query("a12_annual_low_flow", _alf_sql("3 PRECEDING AND 3 FOLLOWING", 4))
def _(t):
    return rounded(annual_low_flow(t.flow, []))


@query("a12_annual_low_flow_trailing", _alf_sql("6 PRECEDING AND CURRENT ROW", 7))
def _(t):
    return rounded(annual_low_flow(t.flow, [], variant="trailing"))


@query("a12_annual_low_flow_within", _alf_sql("6 PRECEDING AND CURRENT ROW", 7, "PARTITION BY hydro_year"))
def _(t):
    return rounded(annual_low_flow(t.flow, [], variant="within"))


@query("a13_probability_mass", with_("impact") + "SELECT round(sum(CASE WHEN site = 'oxford' AND pg > 9000 THEN pow(10, log10_prob) ELSE 0 END) / sum(pow(10, log10_prob)), 6) AS mass FROM impact")
def _(t):
    return rounded(A.probability_mass(t.impact, (F.col("site") == "oxford") & (F.col("pg") > 9000)))


@query("a13_cluster_mass", with_("impact") + """, c AS (SELECT story_id % 7 AS cluster, count(*) AS size, sum(pow(10, log10_prob)) AS p FROM impact GROUP BY 1)
SELECT cluster, size, round(p / sum(p) OVER (), 6) AS share, round(p / sum(p) OVER () / size, 8) AS share_per_story FROM c""")
def _(t):
    x = A.cluster_mass(t.impact.withColumn("cluster", F.col("story_id") % 7))
    return x.withColumns({"share": F.round("share", 6), "share_per_story": F.round("share_per_story", 8)})


@query("a14_restriction_cdf", with_("stories") + """, b AS (SELECT month, precip_class, unnest([count(*) FILTER (v = 0), count(*) FILTER (v > 0 AND v < 0.25e0), count(*) FILTER (v > 0.25e0 AND v < 0.5e0), count(*) FILTER (v > 0.5e0 AND v < 0.75e0),
  count(*) FILTER (v > 0.75e0 AND v < 1), count(*) FILTER (v = 1), 0]) AS c, generate_subscripts([1,2,3,4,5,6,7], 1) - 1 AS i FROM (SELECT month, precip_class, CASE WHEN month IN (5,6,7,8) THEN 0e0 ELSE rest_per END AS v FROM stories) GROUP BY 1, 2)
SELECT month, precip_class, CAST(i AS INTEGER) AS i, [0e0, 0e0, 0.25e0, 0.5e0, 0.75e0, 1e0, 1e0][i + 1] AS edge,
  round(coalesce(CAST(sum(c) OVER (PARTITION BY month, precip_class ORDER BY i DESC) AS DOUBLE) / nullif(CAST(sum(c) OVER (PARTITION BY month, precip_class) AS DOUBLE), 0), 0), 6) AS share FROM b""")
def _(t):
    x = t.story_months.withColumn("v", F.when(F.col("month").isin(5, 6, 7, 8), 0.0).otherwise(F.col("rest_per")))
    return rounded(A.restriction_cdf(x, ["month", "precip_class"], "v"))


# step 0.5: bins of a quarter unit, edges from round(min - step) to round(max + step)
HIST = """tons AS (SELECT site, mode, pg / 1000 AS v FROM impact), e AS (SELECT site, mode, round_even(min(v) - 0.5e0, 1) AS a, round_even(max(v) + 0.5e0, 1) AS z, count(*) AS n FROM tons GROUP BY 1, 2),
c AS (SELECT site, mode, CAST(floor(round(v * 4, 9)) AS BIGINT) AS i, count(*) AS c FROM tons GROUP BY 1, 2, 3),
g AS (SELECT site, mode, n, unnest(range(CAST(floor(round(a * 4, 6)) AS BIGINT), CAST(ceil(round(z * 4, 6)) AS BIGINT) + 1)) AS i FROM e),
hist AS (SELECT g.site, g.mode, g.i AS bin, (g.i + 0.5e0) * 0.25e0 AS centre, coalesce(c, 0) / CAST(n AS DOUBLE) AS share FROM g LEFT JOIN c ON c.site = g.site AND c.mode = g.mode AND c.i = g.i)"""


def tons(t):
    return t.impact.select("story_id", "site", "mode", (F.col("pg") / 1000).alias("v"))


@query("a15_impact_histogram", with_("impact", extra=HIST) + "SELECT site, mode, bin, round(centre, 6) AS centre, round(share, 6) AS share FROM hist")
def _(t):
    return rounded(A.impact_histogram(tons(t), ["site", "mode"], "v", 0.5))


@query("a16_exceedance_curve", with_("impact", extra=HIST) + "SELECT site, mode, bin, round(centre, 6) AS pg, round(sum(share) OVER (PARTITION BY site, mode ORDER BY bin DESC), 6) AS prob FROM hist")
def _(t):
    return rounded(A.exceedance_curve(tons(t), ["site", "mode"], "v", 0.5))


@query("a16_exceedance_curve_less", with_("impact", extra=HIST) + "SELECT site, mode, bin, round(centre, 6) AS pg, round(sum(share) OVER (PARTITION BY site, mode ORDER BY bin), 6) AS prob FROM hist")
def _(t):
    return rounded(A.exceedance_curve(tons(t), ["site", "mode"], "v", 0.5, more=False))


@query("a17_exceedance_at", with_("impact", extra=HIST) + """, cu AS (SELECT site, mode, centre AS pg, round(sum(share) OVER (PARTITION BY site, mode ORDER BY bin DESC), 12) AS prob FROM hist),
kn AS (SELECT site, mode, prob, min(pg) AS pa, max(pg) AS pg FROM cu GROUP BY 1, 2, 3), seg AS (SELECT *, lead(prob) OVER w AS np, lead(pa) OVER w AS nx FROM kn WINDOW w AS (PARTITION BY site, mode ORDER BY prob))
SELECT site, mode, i / 100e0 AS prob, round(CASE WHEN i / 100e0 = prob THEN pa ELSE pg + (i / 100e0 - prob) * (nx - pg) / (np - prob) END, 6) AS pg FROM seg JOIN range(1, 100) t(i) ON i / 100e0 >= prob AND i / 100e0 < np""")
def _(t):
    curve = A.exceedance_curve(tons(t), ["site", "mode"], "v", 0.5).withColumn("prob", F.round("prob", 12)).drop("bin")
    return rounded(A.exceedance_at(curve, ["site", "mode"], [i / 100 for i in range(1, 100)]).select("site", "mode", "prob", "pg"))


@query("a18_density_2d", """WITH b AS (SELECT l_returnflag, min(l_quantity) AS xa, max(l_quantity) AS xz, min(l_extendedprice) AS ya, max(l_extendedprice) AS yz, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, CAST(least(floor((l_quantity - xa) / (xz - xa) * 19), 18) AS INTEGER) AS ix, CAST(least(floor((l_extendedprice - ya) / (yz - ya) * 19), 18) AS INTEGER) AS iy, round(count(*) / CAST(max(n) AS DOUBLE), 8) AS share
FROM lineitem l JOIN b ON b.l_returnflag = l.l_returnflag GROUP BY 1, 2, 3""")
def _(t):
    return rounded(A.density_2d(t.table("lineitem"), "l_quantity", "l_extendedprice", 20, ["l_returnflag"]), 8)


@query("a19_empirical_cdf", """WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS a, max(l_extendedprice) AS z, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT l.l_returnflag, CAST(least(floor((l_extendedprice - a) / (z - a) * 100), 99) AS INTEGER) AS bin, count(*) AS c FROM lineitem l JOIN b ON b.l_returnflag = l.l_returnflag GROUP BY 1, 2),
g AS (SELECT *, unnest(range(0, 100)) AS bin FROM b)
SELECT g.l_returnflag, CAST(g.bin AS INTEGER) AS bin, round(a + (g.bin + 0.5e0) * ((z - a) / 100), 8) AS centre, round(CAST(sum(coalesce(c, 0)) OVER (PARTITION BY g.l_returnflag ORDER BY g.bin) AS DOUBLE) / n, 8) AS cdf
FROM g LEFT JOIN c ON c.l_returnflag = g.l_returnflag AND c.bin = g.bin""")
def _(t):
    x = A.empirical_cdf(t.table("lineitem"), ["l_returnflag"], "l_extendedprice", 100)
    return rounded(x, 8)


@query("a20_joint_wet_dry", with_("weather") + """, j AS (SELECT a.site, month(a.date) AS month, a.rain AS s, b.rain AS b FROM weather a JOIN weather b ON a.date = b.date AND a.site <> 0 AND b.site = 0)
SELECT site, CAST(month AS INTEGER) AS month, round(avg(CASE WHEN b <> 0 THEN CASE WHEN s <> 0 THEN 1e0 ELSE 0e0 END END), 6) AS wet_given_wet, round(avg(CASE WHEN b <> 0 THEN CASE WHEN s = 0 THEN 1e0 ELSE 0e0 END END), 6) AS dry_given_wet,
round(avg(CASE WHEN b = 0 THEN CASE WHEN s <> 0 THEN 1e0 ELSE 0e0 END END), 6) AS wet_given_dry, round(avg(CASE WHEN b = 0 THEN CASE WHEN s = 0 THEN 1e0 ELSE 0e0 END END), 6) AS dry_given_dry FROM j GROUP BY 1, 2""")
def _(t):
    a = t.weather.where("site <> 0").select("site", "date", F.col("rain").alias("s"))
    b = t.weather.where("site = 0").select("date", F.col("rain").alias("b"))
    return rounded(A.joint_wet_dry(a.join(b, "date").withColumn("month", F.month("date")), "s", "b", ["site", "month"]))


@query("a21_group_and_total", with_("impact") + """, i AS (SELECT story_id % 5 AS cluster, pg FROM impact)
SELECT 'row' AS level, cluster, round(pg, 6) AS pg FROM i UNION ALL SELECT 'cluster', cluster, round(avg(pg), 6) FROM i GROUP BY cluster UNION ALL SELECT 'total', NULL, round(avg(pg), 6) FROM i""")
def _(t):
    return rounded(A.group_and_total(t.impact.withColumn("cluster", F.col("story_id") % 5), "cluster", ["pg"]))


@query("a22_combo_counts", with_("stories") + "SELECT month, precip_class || '-' || temp_class || '-' || irr_type AS combo, count(*) AS n FROM stories GROUP BY 1, 2")
def _(t):
    return A.combo_counts(t.story_months, ["precip_class", "temp_class", "irr_type"])


@query("a22_combo_counts_pivot", with_("stories") + "SELECT precip_class || '-' || temp_class AS combo, " + ", ".join(f'nullif(count(*) FILTER (month = {m}), 0) AS "{m}"' for m in range(1, 13)) + " FROM stories GROUP BY 1")
def _(t):
    return A.combo_counts(t.story_months, ["precip_class", "temp_class"], pivot=True)


@query("a23_drop_degenerate", with_("weather") + """, m AS (SELECT year(date) AS y, month(date) AS m, count(*) FILTER (rain > 0.01e0) AS d FROM weather GROUP BY 1, 2),
f AS (SELECT CAST(nd AS INTEGER) AS nd, m, d >= nd AS flag FROM m, (VALUES (1), (30), (45), (60), (200)) v(nd)), p AS (SELECT nd, m, count(*) FILTER (flag) AS s FROM f GROUP BY 1, 2),
k AS (SELECT *, min(s) OVER (PARTITION BY nd) AS lo, max(s) OVER (PARTITION BY nd) AS hi FROM p)
SELECT CAST(nd AS VARCHAR) AS event, CAST(m AS INTEGER) AS month, s AS sum FROM k WHERE NOT (lo = 6 OR hi = 0)""")
def _(t):
    m = date_parts(t.weather).groupBy("year", "month").agg(F.count_if(F.col("rain") > 0.01).alias("d"))
    f = m.withColumn("nd", F.explode(F.array(*[F.lit(n) for n in (1, 30, 45, 60, 200)])))
    p = A.occurrence(f.select("month", F.col("nd").cast("string").alias("event"), (F.col("d") >= F.col("nd")).alias("flag")), ["event", "month"])
    return A.drop_degenerate(p, years=6).select("event", "month", "sum")


SPELLS = """fl AS (SELECT *, year(date) AS y, month(date) AS m, row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date) AS rn FROM rest),
gr AS (SELECT *, rn - row_number() OVER (PARTITION BY y, m ORDER BY date) AS g FROM fl WHERE f_rest >= 0.5e0), sp AS (SELECT y, m, g, count(*) AS length, min(date) AS first, max(date) AS last FROM gr GROUP BY 1, 2, 3)"""


@query("a24_spell_summary", with_("rest", extra=SPELLS) + """, k AS (SELECT DISTINCT y, m FROM fl), s AS (SELECT y, m, sum(length) AS t, count(*) AS n, avg(length) AS a, min(length) AS lo, max(length) AS hi FROM sp GROUP BY 1, 2)
SELECT CAST(k.y AS INTEGER) AS year, CAST(k.m AS INTEGER) AS month, CAST(coalesce(t, 0) AS BIGINT) AS total_days, coalesce(n, 0) AS n_spells, round(coalesce(a, 0e0), 6) AS mean_length, coalesce(lo, 0) AS min_length, coalesce(hi, 0) AS max_length FROM k LEFT JOIN s ON s.y = k.y AND s.m = k.m""")
def _(t):
    x = date_parts(t.rest)
    return rounded(A.spell_summary(W.runs(x, [], "date", F.col("f_rest") >= 0.5, ["year", "month"]), x))


@query("a25_most_probable", with_("stories", "impact") + """SELECT site, mode, month, round(avg(s.pg), 6) AS pg FROM stories s JOIN impact i USING (story_id, site, mode)
WHERE i.pg BETWEEN CASE WHEN site = 'oxford' AND mode = 'dryland' THEN 9000 WHEN site = 'eyrewell' THEN 10000 ELSE 8000 END AND 15000 GROUP BY 1, 2, 3""")
def _(t):
    ranges = {("oxford", "dryland"): (9000, 15000), ("eyrewell", "irrigated"): (10000, 15000), ("oxford", "irrigated"): (8000, 15000)}
    return rounded(A.most_probable(t.impact.withColumnRenamed("pg", "pg_yr1"), t.story_months, ranges))


@query("a26_bias_ratio", with_("stories", extra="""h AS (SELECT month, avg(pg) AS v FROM stories WHERE irr_type = 'good' GROUP BY 1), m AS (SELECT month, avg(pg) AS v FROM stories WHERE irr_type = 'bad' GROUP BY 1)""") + """
SELECT story_id, s.month, round(pg * (h.v / m.v), 6) AS pg FROM stories s JOIN h ON h.month = s.month JOIN m ON m.month = s.month WHERE irr_type = 'bad'""")
def _(t):
    s = t.story_months
    ratio = A.bias_ratio(s.where("irr_type = 'good'"), s.where("irr_type = 'bad'"), ["month"], "pg")
    return rounded(A.apply_bias(s.where("irr_type = 'bad'"), ratio, ["month"], "pg").select("story_id", "month", "pg"))


@query("a27_total_combinations", with_("stories") + ", o AS (SELECT month, count(DISTINCT precip_class) AS n FROM stories GROUP BY 1) SELECT CAST(product(n) AS DOUBLE) AS total FROM o")
def _(t):
    return A.total_combinations(t.story_months.groupBy("month").agg(F.count_distinct("precip_class").alias("n")))


@query("a28_monthly_from_daily", with_("weather") + """, m AS (SELECT site, year(date) AS y, month(date) AS m, avg(tmax) AS tmax, sum(rain) AS rain FROM weather GROUP BY 1, 2, 3)
SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, round(avg(tmax), 6) AS tmax, round(avg(rain), 6) AS rain FROM m GROUP BY 1, 2""")
def _(t):
    return rounded(A.monthly_from_daily(date_parts(t.weather), ["year", "month"], {"tmax": "mean", "rain": "sum"}, "site"))


@query("a29_annual_from_monthly", with_("stories") + """, m AS (SELECT story_id % 10000 AS season, site, mode, month, avg(pg / 30 * CASE WHEN month = 2 THEN 28 WHEN month IN (4,6,9,11) THEN 30 ELSE 31 END) AS pg FROM stories GROUP BY 1, 2, 3, 4)
SELECT season, site, mode, round(sum(pg), 4) AS rate_yr1, count(*) AS n_months FROM m GROUP BY 1, 2, 3""")
def _(t):
    x = t.story_months.select((F.col("story_id") % 10000).alias("season"), "site", "mode", "month", (F.col("pg") / 30).alias("rate"))
    return rounded(A.annual_from_monthly(x, ["season", "site", "mode"], "rate"), 4)


@query("a30_historical_baseline", with_("weather") + """, l AS (SELECT site, CAST(month(date) AS INTEGER) AS month, median(radn) AS baseline FROM weather GROUP BY 1, 2)
SELECT site, month, CAST(unnest(range(1, CASE WHEN month = 2 THEN 29 WHEN month IN (4,6,9,11) THEN 31 ELSE 32 END)) AS INTEGER) AS day, CAST(y AS INTEGER) AS year, round(baseline, 6) AS baseline FROM l, (VALUES (2024), (2025)) v(y)""")
def _(t):
    return rounded(A.historical_baseline(date_parts(t.weather), "radn", [2024, 2025], "median", ["site"]))


@query("a31_quantile_by", with_("flow") + f"SELECT {YM}, round(quantile_cont(flow, 0.25), 6) AS q25, round(quantile_cont(flow, 0.5), 6) AS q50, round(quantile_cont(flow, 0.75), 6) AS q75 FROM flow GROUP BY 1, 2")
def _(t):
    return rounded(A.quantile_by(date_parts(t.flow), ["year", "month"], "flow"))


@query("a32_scenario_summary", with_("impact") + """, x AS (SELECT site, mode, pg / 1000 AS v FROM impact WHERE irr_type = 'good')
SELECT site, mode, count(*) AS count, round_even(avg(v), 2) AS mean, round_even(stddev_samp(v), 2) AS std, round_even(min(v), 2) AS min, round_even(quantile_cont(v, 0.25), 2) AS p25, round_even(quantile_cont(v, 0.5), 2) AS p50,
 round_even(quantile_cont(v, 0.75), 2) AS p75, round_even(max(v), 2) AS max FROM x GROUP BY 1, 2""")
def _(t):
    ids = t.impact.where("irr_type = 'good'").select("story_id")
    return A.scenario_summary(t.impact, ids, ["site", "mode"])


@query("a33_growth_profile", with_("weather") + """, y AS (SELECT year(date) AS y, month(date) AS m, avg(radn) AS v FROM weather GROUP BY 1, 2)
SELECT CAST(m AS INTEGER) AS month, round(avg(v), 6) AS rate, round(avg(v) * max(CASE WHEN m = 2 THEN 28 WHEN m IN (4,6,9,11) THEN 30 ELSE 31 END), 6) AS total FROM y GROUP BY 1""")
def _(t):
    return rounded(A.growth_profile(date_parts(t.weather), "mean", "radn"))


@query("a33_yearly_totals", with_("weather") + """, y AS (SELECT year(date) AS y, month(date) AS m, avg(radn) * max(CASE WHEN month(date) = 2 THEN 28 WHEN month(date) IN (4,6,9,11) THEN 30 ELSE 31 END) AS v FROM weather GROUP BY 1, 2)
SELECT CAST(y AS INTEGER) AS year, round(sum(v), 5) AS total FROM y GROUP BY 1""")
def _(t):
    return rounded(A.yearly_totals(date_parts(t.weather), "radn"), 5)
