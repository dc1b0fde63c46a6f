"""Sorts, top-k and set operations (T1-T5, U1-U5)."""

from pyspark.sql import functions as F

from rainshade.functions.calendar import season_order
from rainshade.operators import ranking as T
from rainshade.queries.base import query, r, rounded, with_
from rainshade.queries.joins import EVENTS3, events3


@query("t1_order_by_season", with_("stories") + "SELECT story_id, month, CAST(seq AS INTEGER) AS season_order, pg FROM stories")
def _(t):
    return T.order_by_season(t.story_months, "story_id").select("story_id", "month", season_order(F.col("month")).alias("season_order"), "pg")


@query("t2_top_probable", with_("impact") + """, k AS (SELECT story_id, log10_prob FROM impact WHERE abs(pg - 10000) <= 3000 + 1e-5 * 10000 ORDER BY log10_prob DESC, story_id LIMIT 20)
SELECT story_id, log10_prob, CAST(row_number() OVER (ORDER BY log10_prob DESC, story_id) AS INTEGER) AS rank, printf('rank_%02d-%s', row_number() OVER (ORDER BY log10_prob DESC, story_id), CAST(story_id AS VARCHAR)) AS name FROM k""")
def _(t):
    return T.top_probable(t.impact.select("story_id", "log10_prob", "pg"), 20, 10000.0, "pg", 3000.0).select("story_id", "log10_prob", "rank", "name")


@query("t3_best_fit_stories", with_("stories") + """, p AS (SELECT month, avg(pg) AS t FROM stories WHERE month NOT IN (6,7,8) GROUP BY 1)
SELECT story_id, round(sum(abs(pg - t)), 4) AS distance FROM stories s JOIN p ON p.month = s.month GROUP BY 1 HAVING count(*) = 9 ORDER BY sum(abs(pg - t)), story_id LIMIT 10""")
def _(t):
    # one site-mode stands for both: the profile is the mean story
    one = t.story_months.withColumns({"site": F.lit("oxford"), "mode": F.lit("irrigated")})
    profile = one.groupBy("site", "mode", "month").agg(F.avg("pg").alias("pg"))
    return rounded(T.best_fit_stories(one, profile), 4)


@query("t4_spread_extremes", with_("stories") + """, g AS (SELECT month, grp, stddev_pop(pg) AS sd FROM stories GROUP BY 1, 2), m AS (SELECT month, avg(sd) AS m FROM g GROUP BY 1)
SELECT g.month, arg_min(grp, (sd, grp)) AS least, arg_max(grp, (sd, -grp)) AS greatest, arg_min(grp, (round(abs(sd - m), 9), grp)) AS middle FROM g JOIN m ON m.month = g.month GROUP BY 1""")
def _(t):
    return T.spread_extremes(t.story_months, "grp", "pg", ["month"])


@query("t5_sorted_impact_table", with_("stories") + """, m AS (SELECT month, avg(pg) AS a FROM stories GROUP BY 1)
SELECT precip_class || '-' || temp_class AS event, round(sum((pg - a) / 30 * CASE WHEN s.month = 2 THEN 28 WHEN s.month IN (4,6,9,11) THEN 30 ELSE 31 END), 3) AS impact FROM stories s JOIN m ON m.month = s.month GROUP BY 1""")
def _(t):
    m = t.story_months.groupBy("month").agg(F.avg("pg").alias("a"))
    x = t.story_months.join(m, "month").select("month", F.concat_ws("-", "precip_class", "temp_class").alias("event"), ((F.col("pg") - F.col("a")) / 30).alias("anomaly"))
    return rounded(T.sorted_impact_table(x), 3)


@query("u1_union_all", with_("impact") + """SELECT story_id, pg, log10_prob, NULL AS note FROM impact WHERE irr_type = 'good' UNION ALL SELECT story_id, pg, NULL, 'bad' FROM impact WHERE irr_type = 'bad'""")
def _(t):
    good = t.impact.where("irr_type = 'good'").select("story_id", "pg", "log10_prob")
    bad = t.impact.where("irr_type = 'bad'").select("story_id", "pg", F.lit("bad").alias("note"))
    return T.union_all(good, bad)


@query("u2_intersect_months", with_("classes", extra=EVENTS3) + """SELECT a.event AS left, b.event AS right, a.month, round(count(*) / 48e0, 6) AS prob FROM ev a JOIN ev b ON a.year = b.year AND a.month = b.month AND a.event = 'hot' AND b.event IN ('dry', 'wet') GROUP BY 1, 2, 3""")
def _(t):
    return rounded(T.joint_probability(T.intersect_months(events3(t), ["hot"], ["dry", "wet"]), 48))


@query("u3_except_months", with_("classes", extra=EVENTS3) + "SELECT month, year FROM ev WHERE event = 'dry' EXCEPT SELECT month, year FROM ev WHERE event = 'hot'")
def _(t):
    e = events3(t)
    return T.except_months(e.where("event = 'dry'"), e.where("event = 'hot'"))


@query("u4_distinct_pairs", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def _(t):
    return T.distinct_pairs(t.table("lineitem").select("l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"])


@query("u5_compare_tables", with_("stories") + """, a AS (SELECT story_id, month, temp_class, round(pg) AS pg FROM stories WHERE month <> 3),
b AS (SELECT story_id, month, CASE WHEN story_id % 7 = 0 THEN 'H' ELSE temp_class END AS temp_class, CASE WHEN month = 5 THEN NULL ELSE round(pg) END AS pg FROM stories WHERE month <> 4)
SELECT coalesce(a.month, b.month) AS month, CAST(sum(CASE WHEN a.temp_class IS DISTINCT FROM b.temp_class THEN 1 ELSE 0 END) AS BIGINT) AS temp_class_changed, CAST(sum(CASE WHEN a.pg IS DISTINCT FROM b.pg THEN 1 ELSE 0 END) AS BIGINT) AS pg_changed
FROM a FULL JOIN b ON a.story_id = b.story_id AND a.month = b.month GROUP BY 1""")
def _(t):
    s = t.story_months
    a = s.where("month <> 3").select("story_id", "month", "temp_class", F.round("pg").alias("pg"))
    b = s.where("month <> 4").select("story_id", "month", F.when(F.col("story_id") % 7 == 0, "H").otherwise(F.col("temp_class")).alias("temp_class"),
                                     F.when(F.col("month") != 5, F.round("pg")).alias("pg"))
    return T.changes_by(T.compare_tables(a, b, ["story_id", "month"], ["temp_class", "pg"]), "month")


@query("u5_normalise_names", "SELECT p_partkey, regexp_replace(lower(trim(p_brand || ' ' || p_name)), '[^a-z0-9]+', '_', 'g') AS name FROM part")
def _(t):
    return t.table("part").select("p_partkey", T.normalise_name(F.concat_ws(" ", "p_brand", "p_name")).alias("name"))
