"""Joins (J1-J17)."""

from pyspark.sql import functions as F

from rainshade.functions.calendar import date_parts, nonleap_doy
from rainshade.functions.draws import md5_uniform
from rainshade.operators import joins as J
from rainshade.operators import windows as W
from rainshade.queries.base import query, r, rounded, text_date, with_


def u_sql(seed: int, *keys: str) -> str:
    """The md5 uniform of functions.draws in SQL."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13)) AS BIGINT) / 4503599627370496e0)"


@query("j1_inner_join", with_("flow", "rest") + "SELECT CAST(date AS VARCHAR) AS date, flow, f_rest FROM flow JOIN rest USING (date)")
def _(t):
    return text_date(J.keyed_join(t.flow.drop("n"), t.rest, ["date"]), "date")


@query("j2_left_join_daily_mean", with_("classes", "rest") + """SELECT c.year, c.month, precip_class, round(avg(f_rest), 6) AS f_rest FROM classes c
LEFT JOIN (SELECT * FROM rest WHERE month(date) <> 7) r ON year(r.date) = c.year AND month(r.date) = c.month GROUP BY 1, 2, 3""")
def _(t):
    daily = date_parts(t.rest.where(F.month("date") != 7))
    return rounded(J.events_with_daily_mean(t.rest_classes.select("year", "month", "precip_class"), daily, ["year", "month"], "f_rest", "f_rest"))


@query("j3_lookup", with_("weather") + """, mm AS (SELECT site, month(date) AS m, avg(rain) AS v FROM weather GROUP BY 1, 2)
SELECT w.site, CAST(date AS VARCHAR) AS date, round(rain - v, 6) AS rain_anomaly, CASE WHEN w.site = 2 THEN 2 ELSE w.site + 10 END AS replaced FROM weather w JOIN mm ON mm.site = w.site AND mm.m = month(date)""")
def _(t):
    x = t.weather.withColumn("month", F.month("date"))
    means = x.groupBy("site", "month").agg(F.avg("rain").alias("v"))
    codes = t.spark.createDataFrame([(0, 10), (1, 11)], "site int, code int")
    y = J.replace_lookup(J.strict_lookup(x, means, ["site", "month"], "v"), codes, "site", "code", "replaced")
    return rounded(text_date(y, "date").select("site", "date", (F.col("rain") - F.col("v")).alias("rain_anomaly"), "replaced"))


@query("j4_coalesce_full_join", with_("flow", "rest") + """SELECT CAST(coalesce(a.date, b.date) AS VARCHAR) AS date, coalesce(a.v, b.v) AS v, coalesce(a.w, b.w) AS w
FROM (SELECT date, flow AS v, CASE WHEN n > 5 THEN n END AS w FROM flow WHERE month(date) < 10) a FULL JOIN (SELECT date, f_rest AS v, CAST(-1 AS BIGINT) AS w FROM rest WHERE month(date) > 3) b ON a.date = b.date""")
def _(t):
    a = t.flow.where(F.month("date") < 10).select("date", F.col("flow").alias("v"), F.when(F.col("n") > 5, F.col("n")).alias("w"))
    b = t.rest.where(F.month("date") > 3).select("date", F.col("f_rest").alias("v"), F.lit(-1).cast("long").alias("w"))
    return text_date(J.coalesce_full_join(a, b, ["date"]), "date")


@query("j5_date_spine", with_("weather") + """, b AS (SELECT site, min(date) AS a, max(date) AS z FROM weather GROUP BY 1),
sp AS (SELECT site, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT sp.site, CAST(sp.date AS VARCHAR) AS date, w.rain FROM sp LEFT JOIN weather w ON w.site = sp.site AND w.date = sp.date""")
def _(t):
    return text_date(J.date_spine(t.weather.select("site", "date", "rain"), ["site"]), "date")


@query("j5_date_report", with_("weather") + """, b AS (SELECT site, min(date) AS a, max(date) AS z FROM weather GROUP BY 1),
sp AS (SELECT site, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT site, CAST(date AS VARCHAR) AS date, 'missing' AS problem FROM sp WHERE NOT (month(date) = 2 AND day(date) = 29) AND (site, date) NOT IN (SELECT (site, date) FROM weather)
UNION ALL SELECT site, CAST(date AS VARCHAR), 'extra' FROM weather WHERE month(date) = 2 AND day(date) = 29""")
def _(t):
    return text_date(J.date_report(t.weather.select("site", "date"), ["site"], leap=False), "date")


@query("j6_key_skeleton", with_("weather") + """SELECT site, CAST(m AS INTEGER) AS month, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT site FROM weather), range(1, 13) a(m), range(1994, 2003) b(y)""")
def _(t):
    return J.key_skeleton(t.weather, ["site"], {"month": list(range(1, 13)), "year": list(range(1994, 2003))})


CURVE = """kn AS (SELECT o_custkey % 40 AS k, avg(o_totalprice) AS a FROM orders GROUP BY 1),
curve AS (SELECT k AS row_no, round(k * 12500e0 + 100, 4) AS x, round((1 - k / 40e0) , 6) AS y FROM kn)"""


def _curve(t):
    """Forty knots over the price range, derived from the orders."""
    k = t.table("orders").select((F.col("o_custkey") % 40).alias("k")).distinct()
    return k.select(F.col("k").alias("row_no"), r(F.col("k") * 12500.0 + 100, 4).alias("x"), r(1 - F.col("k") / 40.0).alias("y"))


@query("j7_nearest_row", f"WITH {CURVE}" + """ SELECT o_orderkey, arg_min(c.row_no, (abs(c.x - o_totalprice), c.row_no)) AS row_no FROM orders, curve c GROUP BY 1""")
def _(t):
    return J.nearest_row(t.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", _curve(t), "x", "row_no").select("o_orderkey", "row_no")


@query("j8_nearest_quantile", with_("stories", "mapper") + """, s AS (SELECT *, CASE lag(precip_class, 1, 'A') OVER (PARTITION BY story_id ORDER BY seq) WHEN 'D' THEN 'D' ELSE 'ND' END || '-' ||
  CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END AS combo FROM stories)
SELECT story_id, s.month, CASE WHEN s.month IN (5,6,7,8) THEN 1e0 ELSE arg_min(m.q, (round(abs(round(m.rest, 12) - s.rest), 12), round(abs(0.5 - m.q), 12), m.q)) END AS rest_per
FROM s LEFT JOIN mapper m ON m.combo = s.combo AND m.month = s.month GROUP BY story_id, s.month""")
def _(t):
    from rainshade.functions import scalars as S
    x = W.lag_state(t.story_months, ["story_id"], "seq", {"precip_class": "A"})
    x = x.withColumn("combo", S.combo_key(F.col("prev_precip_class"), F.col("precip_class"))).select("story_id", "month", "combo", "rest")
    return J.nearest_quantile(x, t.mapper).select("story_id", "month", "rest_per")


@query("j9_interp_join", f"WITH {CURVE}" + """, seg AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w = 1 AS first, lead(x, 2) OVER w IS NULL AS last FROM curve WINDOW w AS (ORDER BY x))
SELECT o_orderkey, round(100 - (100 * (y + (v - x) * (ny - y) / (nx - x))), 6) AS prob FROM (SELECT o_orderkey, o_totalprice * 1.1e0 - 20000 AS v FROM orders) o
JOIN seg ON nx IS NOT NULL AND (first OR v >= x) AND (last OR v < nx)""")
def _(t):
    o = t.table("orders").select("o_orderkey", (F.col("o_totalprice") * 1.1 - 20000).alias("v"))
    curve = _curve(t).select((F.col("x") / 1000).alias("pg"), F.col("y").alias("prob"))
    return rounded(J.non_exceedance(o, "v", curve, "prob").select("o_orderkey", "prob"))


@query("j10_interp_clamped", f"WITH {CURVE}" + """, seg AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM curve WINDOW w AS (ORDER BY x)),
b AS (SELECT min(x) AS a, max(x) AS z, arg_min(y, x) AS ya, arg_max(y, x) AS yz FROM curve)
SELECT o_orderkey, round(CASE WHEN v <= a THEN ya WHEN v >= z THEN yz ELSE y + (v - x) * (ny - y) / (nx - x) END, 10) AS y
FROM (SELECT o_orderkey, o_totalprice * 1.1e0 - 20000 AS v FROM orders) o CROSS JOIN b LEFT JOIN seg ON v >= x AND v < nx""")
def _(t):
    o = t.table("orders").select("o_orderkey", (F.col("o_totalprice") * 1.1 - 20000).alias("v"))
    return rounded(J.interp_join(o, "v", _curve(t).withColumnRenamed("y", "cy"), "x", "cy", "y", extrapolate=False).select("o_orderkey", "y"), 10)


@query("j11_map_storyline_rest", with_("stories", "mapper") + """, s AS (SELECT *, lag(precip_class, 1, 'A') OVER (PARTITION BY story_id ORDER BY seq) AS prev FROM stories),
k AS (SELECT *, CASE prev WHEN 'D' THEN 'D' ELSE 'ND' END || '-' || CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END AS combo FROM s)
SELECT story_id, k.month, prev AS precip_class_prev, CASE WHEN k.month IN (5,6,7,8) THEN 0e0 ELSE m.rest END AS rest FROM k
LEFT JOIN mapper m ON m.combo = k.combo AND m.month = k.month AND round(m.q * 100) = round(k.rest_per * 100)""")
def _(t):
    x = J.map_storyline_rest(t.story_months.drop("rest"), t.mapper, "rest_per", "rest")
    return x.select("story_id", "month", "precip_class_prev", "rest")


@query("j12_semi_join", with_("flow", "classes") + """SELECT CAST(date AS VARCHAR) AS date, flow FROM flow f WHERE EXISTS (SELECT 1 FROM classes c WHERE c.precip_class = 'D' AND c.year = year(f.date) AND c.month = month(f.date))
AND day(date) <= CASE WHEN month(date) = 2 THEN 28 ELSE 31 END""")
def _(t):
    x = date_parts(t.flow).where((F.col("month") != 2) | (F.col("day") <= 28))
    return text_date(J.semi_join(x, t.rest_classes.where("precip_class = 'D'"), ["year", "month"]).select("date", "flow"), "date")


EVENTS3 = """ev AS (SELECT year, month, 'dry' AS event FROM classes WHERE precip_class = 'D' UNION ALL SELECT year, month, 'hot' FROM classes WHERE temp_class = 'H'
  UNION ALL SELECT year, month, 'wet' FROM classes WHERE precip_class = 'W')"""


def events3(t):
    c = t.rest_classes
    a = c.where("precip_class = 'D'").select("year", "month", F.lit("dry").alias("event"))
    b = c.where("temp_class = 'H'").select("year", "month", F.lit("hot").alias("event"))
    return a.unionByName(b).unionByName(c.where("precip_class = 'W'").select("year", "month", F.lit("wet").alias("event")))


@query("j13_anti_join", with_("classes", extra=EVENTS3) + """SELECT year, month FROM ev GROUP BY 1, 2 HAVING bool_or(event = 'dry') AND NOT bool_or(event <> 'dry')""")
def _(t):
    return J.only_event(events3(t), "dry")


@query("j14_transition_join", with_("stories", "transitions") + """, s AS (SELECT *, lead(state) OVER (PARTITION BY story_id ORDER BY seq) AS next_state FROM stories)
SELECT story_id, s.month, state, next_state, round(p, 6) AS p FROM s LEFT JOIN transitions t ON t.month = s.month AND t.from_state = s.state AND t.to_state = s.next_state WHERE next_state IS NOT NULL""")
def _(t):
    return rounded(J.transition_join(t.story_months.select("story_id", "month", "state", "seq"), t.transitions).select("story_id", "month", "state", "next_state", "p"))


@query("j15_inverse_cdf_join", with_("impact") + f""", c AS (SELECT story_id, sum(pow(10, log10_prob)) OVER (ORDER BY story_id) / sum(pow(10, log10_prob)) OVER () AS hi,
  row_number() OVER (ORDER BY story_id DESC) = 1 AS last FROM impact),
k AS (SELECT story_id, coalesce(lag(hi) OVER (ORDER BY story_id), 0e0) AS lo, CASE WHEN last THEN 2e0 ELSE hi END AS hi FROM c),
d AS (SELECT o_orderkey, {u_sql(7, 'o_orderkey')} AS u FROM orders)
SELECT o_orderkey, story_id FROM d JOIN k ON u >= lo AND u < hi""")
def _(t):
    d = t.table("orders").select("o_orderkey", md5_uniform(7, F.col("o_orderkey")).alias("u"))
    items = t.impact.select("story_id", F.pow(F.lit(10.0), F.col("log10_prob")).alias("w"))
    block = F.floor(F.col("story_id") / 100000)
    return J.inverse_cdf_join(d, "u", items, "w", "story_id", block=block).select("o_orderkey", "story_id")


@query("j16_circular_window_join", with_("record") + """, d AS (SELECT dayofyear(date) - CASE WHEN dayofyear(last_day(make_date(year(date), 2, 1))) = 60 AND month(date) > 2 THEN 1 ELSE 0 END AS doy, tmax
  FROM record WHERE NOT (month(date) = 2 AND day(date) = 29) AND month(date) IN (12, 1, 2))
SELECT CAST((doy - 1 + o + 365) % 365 + 1 AS INTEGER) AS target_doy, count(*) AS n, round(avg(tmax), 6) AS tmax FROM d, range(-5, 6) x(o) GROUP BY 1""")
def _(t):
    x = t.record.where(F.month("date").isin(12, 1, 2) & ~((F.month("date") == 2) & (F.dayofmonth("date") == 29)))
    y = J.circular_window_join(x.withColumn("doy", nonleap_doy(F.col("date"))))
    return rounded(y.groupBy("target_doy").agg(F.count(F.lit(1)).alias("n"), F.avg("tmax").alias("tmax")))


CDF = """cf AS (SELECT floor(o_totalprice / 10000) AS b, count(*) AS c FROM orders GROUP BY 1),
cdf AS (SELECT b * 10000e0 + 5000 AS x, sum(c) OVER (ORDER BY b) / (SELECT count(*) FROM orders) AS p FROM cf)"""


def _cdf(t):
    from pyspark.sql import Window
    o = t.table("orders")
    cf = o.groupBy(F.floor(F.col("o_totalprice") / 10000).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    # fifty bins of a fixed price range
    run = F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("b")) / F.sum("c").over(Window.partitionBy(F.lit(1)))
    return cf.select((F.col("b") * 10000.0 + 5000).alias("x"), run.alias("p"))


def _cdf_sql(value: str) -> str:
    return f"WITH {CDF}" + f""", seg AS (SELECT *, lead(x) OVER w AS nx, lead(p) OVER w AS np FROM cdf WINDOW w AS (ORDER BY p)),
b AS (SELECT min(p) AS a, max(p) AS z, min(x) AS xa, max(x) AS xz FROM cdf), d AS (SELECT o_orderkey, {u_sql(3, 'o_orderkey')} AS u FROM orders)
SELECT o_orderkey, round(CASE WHEN u <= a THEN xa WHEN u >= z THEN xz WHEN u = p THEN x ELSE {value} END, 4) AS value FROM d CROSS JOIN b LEFT JOIN seg ON u >= p AND u < np"""


@query("j17_cdf_value", _cdf_sql("x + (u - p) * (nx - x) / (np - p)"))
def _(t):
    d = t.table("orders").select("o_orderkey", md5_uniform(3, F.col("o_orderkey")).alias("u"))
    return rounded(J.cdf_value(d, "u", _cdf(t), "p", "x", "value", domain=(0.0, 1.0)).select("o_orderkey", "value"), 4)


@query("j17_cdf_value_literal", _cdf_sql("x + (np - u) * (nx - x) / (np - p)"))
def _(t):
    d = t.table("orders").select("o_orderkey", md5_uniform(3, F.col("o_orderkey")).alias("u"))
    return rounded(J.cdf_value(d, "u", _cdf(t), "p", "x", "value", literal_weights=True, domain=(0.0, 1.0)).select("o_orderkey", "value"), 4)
