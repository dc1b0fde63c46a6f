"""User functions (X1-X5): aggregates, rules and extra frames passed in by the caller."""

from pyspark.sql import functions as F

from rainshade.operators import aggregates as A
from rainshade.operators import joins as J
from rainshade.operators import sampling as R
from rainshade.operators import shape as P
from rainshade.operators import windows as W
from rainshade.queries.aggregates import HIST, tons
from rainshade.queries.base import query, rounded, text_date, with_
from rainshade.queries.sampling import INPUTS, SIMS, sims
from rainshade.sources.writers import site_mode_table


@query("x1_simulation_function", with_("rest", "classes", extra=INPUTS + ",\n" + SIMS) + "SELECT sim, key, round(max(v) - min(v), 6) AS spread, count(*) FILTER (v > 0.5e0) AS high FROM vals GROUP BY 1, 2")
def _(t):
    s = sims(t)
    spread = R.sim_statistic_rows(s, lambda v: F.max(v) - F.min(v), "spread")
    high = s.select("sim", "key", F.size(F.filter("values", lambda v: v > 0.5)).cast("long").alias("high"))
    return rounded(spread.join(high, ["key", "sim"]).select("sim", "key", "spread", "high"))


@query("x2_realisation_aggregator", with_("stories") + "SELECT site, mode, month, round(sqrt(avg(pg * pg)), 6) AS pg FROM stories GROUP BY 1, 2, 3")
def _(t):
    return rounded(site_mode_table(t.story_months, ["pg"], lambda c: F.sqrt(F.avg(c * c)), ["site", "mode", "month"]))


@query("x2_user_aggregate", "SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, round(exp(avg(ln(o_totalprice))), 4) AS value FROM orders GROUP BY 1, 2")
def _(t):
    o = t.table("orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice")
    return rounded(A.user_aggregate(o, ["o_orderpriority", "year"], "o_totalprice", A.GEOMETRIC_MEAN), 4)


@query("x3_resample_function", with_("weather") + "SELECT site, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS period, round(sum(rain), 6) AS rain FROM weather GROUP BY 1, 2")
def _(t):
    return rounded(text_date(W.resample(t.weather, ["site"], "date", "rain", "1M", "sum"), "period"))


@query("x4_scalar_rule", with_("flow") + "SELECT CAST(date AS VARCHAR) AS date, round(least(greatest((80 - flow) / 40, 0e0), 1e0), 6) AS f_rest FROM flow")
def _(t):
    x = P.apply_rule(t.flow, "flow", lambda q: F.least(F.greatest((80 - q) / 40, F.lit(0.0)), F.lit(1.0)), "f_rest")
    return rounded(text_date(x.select("date", "f_rest"), "date"))


@query("x5_extra_scenarios", with_("impact", extra=HIST) + """, cu AS (SELECT site, mode, centre AS pg, sum(share) OVER (PARTITION BY site, mode ORDER BY bin DESC) AS prob FROM hist),
seg AS (SELECT *, lead(pg) OVER w AS nx, lead(prob) OVER w AS np, row_number() OVER w = 1 AS first, lead(pg, 2) OVER w IS NULL AS last FROM cu WINDOW w AS (PARTITION BY site, mode ORDER BY pg)),
sc AS (SELECT site, mode, irr_type AS label, avg(pg) / 1000 AS pg, CASE WHEN irr_type = 'good' THEN 0.5e0 END AS prob FROM impact GROUP BY ALL)
SELECT sc.site, sc.mode, label, round(sc.pg, 6) AS pg, round(coalesce(sc.prob, seg.prob + (sc.pg - seg.pg) * (np - seg.prob) / (nx - seg.pg)), 6) AS prob FROM sc JOIN seg ON seg.site = sc.site AND seg.mode = sc.mode AND nx IS NOT NULL AND (first OR sc.pg >= seg.pg) AND (last OR sc.pg < nx)""")
def _(t):
    curve = A.exceedance_curve(tons(t), ["site", "mode"], "v", 0.5)
    extra = t.impact.groupBy("site", "mode", F.col("irr_type").alias("label")).agg((F.avg("pg") / 1000).alias("pg"))
    extra = extra.withColumn("prob", F.when(F.col("label") == "good", 0.5))
    return rounded(J.place_scenarios(extra, curve, ["site", "mode"]))
