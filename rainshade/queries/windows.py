"""Window functions (W1-W20)."""

from pyspark.sql import functions as F

from rainshade.functions.calendar import date_parts, water_year
from rainshade.operators import windows as W
from rainshade.queries.aggregates import SPELLS
from rainshade.queries.base import query, r, rounded, text_date, with_


@query("w1_rolling_trailing", with_("weather") + """SELECT site, CAST(date AS VARCHAR) AS date, CASE WHEN count(rain) OVER w >= 10 THEN round(sum(rain) OVER w, 6) END AS rain_10,
  CASE WHEN count(tmax) OVER w >= 10 THEN round(avg(tmax) OVER w, 6) END AS tmax_10 FROM weather WINDOW w AS (PARTITION BY site ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(t):
    x = W.rolling(W.rolling(t.weather, ["site"], "date", "rain", 10, "sum"), ["site"], "date", "tmax", 10)
    return rounded(text_date(x.select("site", "date", "rain_10", "tmax_10"), "date"))


@query("w2_rolling_centred", with_("flow") + """SELECT CAST(date AS VARCHAR) AS date, CASE WHEN count(flow) OVER w >= 4 THEN round(avg(flow) OVER w, 6) END AS flow_7 FROM flow WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def _(t):
    return rounded(text_date(W.rolling(t.flow, [], "date", "flow", 7, "mean", center=True, min_periods=4).select("date", "flow_7"), "date"))


@query("w3_lag_state", with_("stories") + """SELECT story_id, month, lag(temp_class, 1, 'A') OVER w AS prev_temp_class, lag(precip_class, 1, 'A') OVER w AS prev_precip_class FROM stories WINDOW w AS (PARTITION BY story_id ORDER BY seq)""")
def _(t):
    return W.lag_state(t.story_months, ["story_id"], "seq", {"temp_class": "A", "precip_class": "A"}).select("story_id", "month", "prev_temp_class", "prev_precip_class")


@query("w4_difference", with_("flow") + """, d AS (SELECT date, (flow - lag(flow) OVER w) * 1000 + lag(CASE WHEN n > 8 THEN 500e0 ELSE 0e0 END) OVER w AS v, (flow - lag(flow) OVER w) * 1000 AS p FROM flow WINDOW w AS (ORDER BY date))
SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN p < 0 THEN 0e0 ELSE p END, 6) AS growth, round(CASE WHEN v < 0 THEN 0e0 ELSE v END, 6) AS growth_removed FROM d""")
def _(t):
    x = t.flow.withColumn("cut", F.when(F.col("n") > 8, 500.0).otherwise(0.0))
    y = W.difference(W.difference(x, [], "date", "flow", "growth"), [], "date", "flow", "growth_removed", removed="cut")
    return rounded(text_date(y.select("date", "growth", "growth_removed"), "date"))


@query("w5_fill", with_("flow") + """, g AS (SELECT date, CASE WHEN n % 3 = 0 THEN NULL ELSE flow END AS v FROM flow)
SELECT CAST(date AS VARCHAR) AS date, last_value(v IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill, first_value(v IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM g""")
def _(t):
    x = t.flow.select("date", F.when(F.col("n") % 3 != 0, F.col("flow")).alias("v"))
    y = W.fill(W.fill(x, [], "date", "v", "ffill", "ffill"), [], "date", "v", "bfill", "bfill")
    return text_date(y.select("date", "ffill", "bfill"), "date")


@query("w6_cumulative_anomaly", with_("stories") + """, b AS (SELECT month, avg(pg) AS base FROM stories GROUP BY 1), a AS (SELECT story_id, s.month, seq, pg - base AS an FROM stories s JOIN b ON b.month = s.month)
SELECT story_id, month, round(an, 6) AS anomaly, round(sum(an * CASE WHEN month = 2 THEN 28 WHEN month IN (4,6,9,11) THEN 30 ELSE 31 END) OVER (PARTITION BY story_id ORDER BY seq), 5) AS cum_anomaly FROM a""")
def _(t):
    s = t.story_months
    x = W.cumulative_anomaly(s, s.groupBy("month").agg(F.avg("pg").alias("pg")), ["story_id"], ["month"], "seq", "pg")
    return x.select("story_id", "month", r("anomaly"), r("cum_anomaly", 5)).toDF("story_id", "month", "anomaly", "cum_anomaly")


@query("w7_runs", with_("rest", extra=SPELLS) + "SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, length FROM sp")
def _(t):
    return text_date(W.runs(date_parts(t.rest), [], "date", F.col("f_rest") >= 0.5, ["year", "month"]), "first", "last")


@query("w7_spell_counts", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS v FROM events GROUP BY 1, 2), fl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS rn FROM d),
gr AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY date) AS g FROM fl WHERE v > 60), sp AS (SELECT user_id, g, count(*) AS length FROM gr GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (length >= 2) AS events_02d, count(*) FILTER (length >= 4) AS events_04d, CAST(sum(length) FILTER (length > 1) AS BIGINT) AS total_days, count(*) FILTER (length > 1) AS n_spells,
 coalesce(array_to_string(list_sort(list(length) FILTER (length > 1)), ','), '') AS lengths FROM sp GROUP BY 1""")
def _(t):
    d = t.table("events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.sum("value").alias("v"))
    x = W.spell_counts(W.runs(d, ["user_id"], "date", F.col("v") > 60), ["user_id"], (2, 4), longer_than=1)
    return x.withColumn("lengths", F.concat_ws(",", F.col("lengths").cast("array<string>")))


STREAK = """f AS (SELECT site, date, rain = 0 AS dry FROM weather), c AS (SELECT *, CASE WHEN lag(dry) OVER w <> dry THEN 1 ELSE 0 END AS ch FROM f WINDOW w AS (PARTITION BY site ORDER BY date)),
sp AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY site ORDER BY date) AS BIGINT) AS spell FROM c), st AS (SELECT *, row_number() OVER (PARTITION BY site, spell ORDER BY date) - 1 AS streak FROM sp)"""


def _streaks(t):
    return W.streak_index(t.weather.select("site", "date", (F.col("rain") == 0).alias("dry")), ["site"], "date", "dry")


@query("w8_streak_index", with_("weather", extra=STREAK) + "SELECT site, CAST(date AS VARCHAR) AS date, CAST(dry AS INTEGER) AS dry, CAST(streak AS INTEGER) AS streak FROM st")
def _(t):
    return text_date(_streaks(t).withColumn("dry", F.col("dry").cast("int")), "date")


@query("w8_streak_lengths", with_("weather", extra=STREAK) + ", z AS (SELECT site, spell, count(*) AS length, any_value(dry) AS s FROM sp GROUP BY 1, 2) SELECT site, spell, length, CAST(s AS INTEGER) AS state FROM z QUALIFY spell < max(spell) OVER (PARTITION BY site)")
def _(t):
    x = W.streak_lengths(t.weather.withColumn("dry", F.col("rain") == 0), ["site"], "date", "dry")
    return x.withColumn("state", F.col("state").cast("int"))


@query("w9_persistence_by_streak", with_("weather", extra=STREAK) + """, n AS (SELECT site, dry, streak, count(*) AS n FROM st GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY site, dry ORDER BY streak) - 1 AS rn, max(streak) OVER (PARTITION BY site, dry) AS top FROM n), u AS (SELECT * FROM k WHERE streak = rn AND streak < top)
SELECT site, CAST(dry AS INTEGER) AS dry, CAST(streak AS INTEGER) AS streak, n, round(p, 6) AS p FROM (SELECT *, least(1e0, lead(n) OVER (PARTITION BY site, dry ORDER BY streak) / CAST(n AS DOUBLE)) AS p, lead(n) OVER (PARTITION BY site, dry ORDER BY streak) AS nn FROM u) WHERE nn IS NOT NULL""")
def _(t):
    return rounded(W.persistence_by_streak(_streaks(t), ["site"], "dry").withColumn("dry", F.col("dry").cast("int")))


@query("w10_nyear_sequential", with_("impact") + """, y AS (SELECT site, mode, story_id % 10000 AS year, avg(pg) AS pg FROM impact GROUP BY 1, 2, 3)
SELECT site, mode, year, round(s, 4) AS pg_3yr FROM (SELECT *, sum(pg) OVER w AS s, count(*) OVER w AS c FROM y WINDOW w AS (PARTITION BY site, mode ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE c = 3""")
def _(t):
    y = t.impact.groupBy("site", "mode", (F.col("story_id") % 10000).alias("year")).agg(F.avg("pg").alias("pg"))
    return rounded(W.nyear_sequential(y, ["site", "mode"], "year", "pg", 3), 4).select("site", "mode", "year", "pg_3yr")


@query("w11_nyear_chunks", with_("impact") + """, y AS (SELECT site, mode, story_id % 10000 AS year, avg(pg) AS pg FROM impact GROUP BY 1, 2, 3), c AS (SELECT *, (row_number() OVER (PARTITION BY site, mode ORDER BY year) - 1) // 3 AS chunk FROM y)
SELECT site, mode, CAST(chunk AS INTEGER) AS chunk, round(sum(pg), 4) AS pg_3yr FROM c GROUP BY 1, 2, 3 HAVING count(*) = 3""")
def _(t):
    y = t.impact.groupBy("site", "mode", (F.col("story_id") % 10000).alias("year")).agg(F.avg("pg").alias("pg"))
    return rounded(W.nyear_chunks(y, ["site", "mode"], "year", "pg", 3), 4)


@query("w12_flow_duration", with_("weather") + """, k AS (SELECT site, rain, rank() OVER (PARTITION BY site ORDER BY rain) + (count(*) OVER (PARTITION BY site, rain) - 1) / 2e0 AS rk, row_number() OVER (PARTITION BY site ORDER BY rain) AS o, count(*) OVER (PARTITION BY site) AS n FROM weather)
SELECT a.site, a.o AS "order", round(a.rain, 6) AS rain, round(100 * b.rk / (a.n + 1), 6) AS exceedance FROM k a JOIN k b ON b.site = a.site AND b.o = a.n + 1 - a.o""")
def _(t):
    return rounded(W.flow_duration(t.weather, ["site"], "rain"))


@query("w13_percentile_of_score", with_("weather") + """, a AS (SELECT site, CAST(month(date) AS INTEGER) AS month, (count(*) FILTER (tmax < 16.5e0) + count(*) FILTER (tmax <= 16.5e0) + CASE WHEN count(*) FILTER (tmax = 16.5e0) > 0 THEN 1 ELSE 0 END) * 50e0 / count(*) AS per, list_sort(list(tmax)) AS l FROM weather GROUP BY 1, 2),
p AS (SELECT *, per / 100 * (len(l) - 1) AS pos FROM a)
SELECT site, month, round(per, 6) AS percentile, round(abs(16.5e0 - (l[CAST(floor(pos) AS BIGINT) + 1] + (l[CAST(ceil(pos) AS BIGINT) + 1] - l[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)))), 6) AS error FROM p""")
def _(t):
    return rounded(W.percentile_of_score(t.weather.withColumn("month", F.month("date")), ["site", "month"], "tmax", 16.5))


@query("w14_autocorrelation", with_("weather") + ", l AS (SELECT site, tmax" + "".join(f", lead(tmax, {i}) OVER w AS l{i}" for i in range(6)) + " FROM weather WINDOW w AS (PARTITION BY site ORDER BY date)) "
       + " UNION ALL ".join(f"SELECT site, {i} AS lag, round(corr(tmax, l{i}), 6) AS r FROM l GROUP BY 1" for i in range(6)))
def _(t):
    return rounded(W.autocorrelation(t.weather, ["site"], "date", "tmax", 6))


@query("w15_anomaly", with_("weather") + """, m AS (SELECT site, month(date) AS m, avg(CASE WHEN year(date) BETWEEN 1996 AND 1999 THEN pet END) AS v FROM weather GROUP BY 1, 2)
SELECT w.site, CAST(date AS VARCHAR) AS date, round(pet - v, 6) AS anomaly, round((pet - v) / v, 6) AS anomaly_rel FROM weather w JOIN m ON m.site = w.site AND m.m = month(w.date)""")
def _(t):
    x = W.anomaly(date_parts(t.weather), ["site", "month"], "pet", "mean", (1996, 1999))
    return rounded(text_date(x.select("site", "date", "anomaly", "anomaly_rel"), "date"))


YIELD = """y AS (SELECT site, date, CASE WHEN dayofyear(date) % 15 = 0 THEN radn * 15 END AS yld FROM weather), p AS (SELECT *, count(yld) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM y),
s AS (SELECT site, date, max(yld) OVER (PARTITION BY site, p) / count(*) OVER (PARTITION BY site, p) AS rate FROM p)"""


def _spread(t):
    x = t.weather.select("site", "date", F.when(F.dayofyear("date") % 15 == 0, F.col("radn") * 15).alias("yld"))
    return W.spread_yield(x, ["site"], "date", "yld")


@query("w16_spread_yield", with_("weather", extra=YIELD) + "SELECT site, CAST(date AS VARCHAR) AS date, round(rate, 6) AS rate FROM s")
def _(t):
    return rounded(text_date(_spread(t).select("site", "date", "rate"), "date"))


@query("w16_resample", with_("weather", extra=YIELD) + """, b AS (SELECT site, min(date) AS a FROM s GROUP BY 1)
SELECT s.site, CAST(a + CAST(date_diff('day', a, date) // 10 * 10 AS INTEGER) AS VARCHAR) AS period, round(avg(rate), 6) AS rate FROM s JOIN b ON b.site = s.site GROUP BY 1, 2""")
def _(t):
    return rounded(text_date(W.resample(_spread(t), ["site"], "date", "rate", "10D"), "period"))


@query("w17_interpolate_linear", with_("flow") + """, g AS (SELECT date, CASE WHEN n % 3 <> 0 THEN flow END AS v FROM flow), p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER a AS d0, last_value(v IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER b AS d1, first_value(v IGNORE NULLS) OVER b AS v1 FROM g WINDOW a AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN v IS NOT NULL THEN v WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN v0 + (v1 - v0) / CAST(date_diff('day', d0, d1) AS DOUBLE) * date_diff('day', d0, date) END, 6) AS v FROM p""")
def _(t):
    x = t.flow.select("date", F.when(F.col("n") % 3 != 0, F.col("flow")).alias("v"))
    return rounded(text_date(W.interpolate_linear(x, [], "date", "v").select("date", "v"), "date"))


@query("w18_stat_order", with_("weather") + "SELECT site, CAST(date AS VARCHAR) AS date, CAST(row_number() OVER (PARTITION BY site, month(date) ORDER BY rain, date) AS INTEGER) AS \"order\" FROM weather")
def _(t):
    x = W.order_number(t.weather.withColumn("month", F.month("date")), ["site", "month"], ["rain", "date"])
    return text_date(x.select("site", "date", "order"), "date")


@query("w18_story_ids", with_("impact") + "SELECT story_id, pg, printf('mrsl-%06d', row_number() OVER (ORDER BY story_id) - 1) AS ID FROM impact")
def _(t):
    return W.story_ids(t.impact.select("story_id", "pg"), "story_id")


@query("w19_last_day_flag", with_("weather") + "SELECT site, CAST(date AS VARCHAR) AS date, CAST(coalesce(lead(month(date)) OVER (PARTITION BY site ORDER BY date) <> month(date), true) AS INTEGER) AS last_day FROM weather")
def _(t):
    return text_date(W.last_day_flag(t.weather, ["site"]).select("site", "date", F.col("last_day").cast("int").alias("last_day")), "date")


@query("w20_monthly_reset_flag", with_("weather") + "SELECT site, CAST(date AS VARCHAR) AS date, CAST(sum(CASE WHEN day(date) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY date) AS BIGINT) AS fold FROM weather")
def _(t):
    return text_date(W.month_fold_key(t.weather, ["site"]).select("site", "date", "fold"), "date")
