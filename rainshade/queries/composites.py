"""Composite domain operators (E1-E24)."""

from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions.calendar import date_parts
from rainshade.functions.draws import md5_uniform
from rainshade.operators import aggregates as A
from rainshade.operators import folds as Q
from rainshade.operators import joins as J
from rainshade.operators import windows as W
from rainshade.plans import events as EV
from rainshade.plans import growth as G
from rainshade.plans import river as RV
from rainshade.plans import stories as ST
from rainshade.plans import weather as WX
from rainshade.queries.aggregates import SPELLS
from rainshade.queries.base import query, r, rounded, text_date, values_sql, with_
from rainshade.queries.folds import NONLEAP, Q2
from rainshade.queries.joins import EVENTS3, events3, u_sql
from rainshade.queries.projections import CORRECTION

YEARS = 7
SMA = f"""ka AS (SELECT *, {NONLEAP} AS doy FROM smd), sma AS (SELECT site, date, smd, smd - avg(smd) OVER (PARTITION BY site, doy) AS sma FROM ka)"""
E1 = f"""{Q2},
{SMA},
mo AS (SELECT w.site, CAST(year(w.date) AS INTEGER) AS year, CAST(month(w.date) AS INTEGER) AS month, avg((tmax + tmin) / 2) AS tmean, avg(sma) AS sma FROM weather w JOIN sma ON sma.site = w.site AND sma.date = w.date GROUP BY 1, 2, 3),
lim AS (SELECT site, month, quantile_cont(tmean, 0.25) AS tl, quantile_cont(tmean, 0.75) AS th, quantile_cont(sma, 0.25) AS sl, quantile_cont(sma, 0.75) AS sh FROM mo GROUP BY 1, 2),
cls AS (SELECT mo.site, mo.year, mo.month, CASE WHEN tmean <= tl THEN -1 WHEN tmean >= th THEN 1 ELSE 0 END AS temp, CASE WHEN sma <= sl THEN 1 WHEN sma >= sh THEN -1 ELSE 0 END AS precip FROM mo JOIN lim ON lim.site = mo.site AND lim.month = mo.month)"""


@query("e1_classify_months", with_("weather", extra=E1, recursive=True) + """SELECT site, year, month, temp, precip, lag(temp, 1, 0) OVER w AS prev_temp, lag(precip, 1, 0) OVER w AS prev_precip,
 CASE temp WHEN -1 THEN 'C' WHEN 0 THEN 'A' ELSE 'H' END || '-' || CASE precip WHEN -1 THEN 'W' WHEN 0 THEN 'A' ELSE 'D' END AS state FROM cls WINDOW w AS (PARTITION BY site ORDER BY year, month)""")
def _(t):
    return EV.classify_months(t.weather).select("site", "year", "month", "temp", "precip", "prev_temp", "prev_precip", "state")


@query("e1_state_frequency", with_("weather", extra=E1, recursive=True) + """SELECT month, CASE temp WHEN -1 THEN 'C' WHEN 0 THEN 'A' ELSE 'H' END || '-' || CASE precip WHEN -1 THEN 'W' WHEN 0 THEN 'A' ELSE 'D' END AS state, round(count(*) / 21e0, 6) AS freq FROM cls GROUP BY 1, 2""")
def _(t):
    return rounded(A.state_frequency(EV.classify_months(t.weather), 21))


def _recur_sql(grid: list[tuple[str, str]], ndays, source: str, pre: str = "") -> str:
    """Check SQL of event recurrence over one record: daily flags, monthly counts, probability, degenerate criteria dropped."""
    days = ", ".join(f"count(*) FILTER ({cond}) AS c{i}" for i, (_, cond) in enumerate(grid))
    long = " UNION ALL ".join(f"SELECT y, m, '{name}' AS k, c{i} AS d FROM dc" for i, (name, _) in enumerate(grid))
    return f"""{pre}dc AS (SELECT year(date) AS y, month(date) AS m, {days} FROM {source} GROUP BY 1, 2), lg AS ({long}),
fl AS (SELECT y, m, printf('%02dd_', CAST(nd AS INTEGER)) || k AS event, d >= nd AS flag FROM lg, (SELECT unnest({list(ndays)}) AS nd)),
pr AS (SELECT event, m, count(*) FILTER (flag) AS s, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) AS p FROM fl GROUP BY 1, 2),
kp AS (SELECT *, min(s) OVER (PARTITION BY event) AS lo, max(s) OVER (PARTITION BY event) AS hi FROM pr)"""


# the folds are keyed by site, so the record stands as one
ONE_SITE = "weather AS (SELECT 0 AS site, * FROM record),\n"
KEEP = f"SELECT event, CAST(m AS INTEGER) AS month, s AS sum, round(p, 6) AS prob FROM kp WHERE NOT (lo = {YEARS} OR hi = 0)"
HOT = [(f"d_{v}_{k:02d}", f"{e} >= {k}") for k in C.HOT_THRESHOLDS for v, e in (("tmax", "tmax"), ("tmean", "(tmax + tmin) / 2"))]


def _record(t):
    x = date_parts(t.record)
    return x.withColumn("tmean", (F.col("tmax") + F.col("tmin")) / 2)


@query("e2_hot", with_("record", extra=_recur_sql(HOT, (3, 5, 7, 10, 14), "record")) + KEEP)
def _(t):
    return rounded(EV.event_recurrence(_record(t), "hot", years=YEARS))


@query("e2_hot_with_growth", with_("record", extra=_recur_sql(HOT, (3, 5, 7, 10, 14), "record")) + f""", g AS (SELECT year(date) AS y, month(date) AS m, avg(radn) AS v FROM record GROUP BY 1, 2), ga AS (SELECT y, m, v - avg(v) OVER (PARTITION BY m) AS a FROM g)
SELECT kp.event, CAST(kp.m AS INTEGER) AS month, s AS sum, count(a) AS count, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.5), 6) AS p50 FROM kp LEFT JOIN fl ON fl.event = kp.event AND fl.m = kp.m AND fl.flag LEFT JOIN ga ON ga.y = fl.y AND ga.m = fl.m WHERE NOT (lo = {YEARS} OR hi = 0) GROUP BY 1, 2, 3""")
def _(t):
    x = _record(t)
    g = x.groupBy("year", "month").agg(F.avg("radn").alias("v"))
    g = W.anomaly(g, ["month"], "v").select("year", "month", "anomaly")
    out = EV.event_recurrence(x, "hot", g, YEARS)
    return rounded(out.select("event", "month", "sum", F.coalesce("count", F.lit(0)).alias("count"), "mean", "p50"))


COLD = "cd AS (SELECT date, CASE WHEN count(*) OVER w >= 3 THEN avg((tmax + tmin) / 2 - 4) OVER w END AS t3 FROM record WINDOW w AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), "


@query("e2_cold", with_("record", extra=_recur_sql([(f"d_tmean_{k:02d}", f"t3 <= {k}") for k in C.COLD_THRESHOLDS], (3, 5, 7, 10, 14), "cd", COLD)) + KEEP)
def _(t):
    return rounded(EV.event_recurrence(_record(t).withColumn("tmean", F.col("tmean") - 4), "cold", years=YEARS))


def _smd(t):
    smd = Q.soil_moisture_deficit_monthly(t.record.withColumn("site", F.lit(0)), ["site"])
    return date_parts(Q.soil_moisture_anomaly(smd, ["site"], years=None).select("site", "date", "smd", "sma"))


@query("e2_dry", with_("record", extra=ONE_SITE + Q2 + ",\n" + SMA + ",\n" + _recur_sql([(f"d_smd{s:03d}_sma{a:02d}", f"smd <= {s} AND sma <= {a}") for s, a in ((0, -20), (-110, 0), (-110, -20))], (5, 7, 10, 14), "sma"), recursive=True)
       + KEEP)
def _(t):
    return rounded(EV.event_recurrence(_smd(t), "dry", years=YEARS))


@query("e2_monthly_dry", with_("record", extra=ONE_SITE + Q2 + ",\n" + SMA + ",\n" + _recur_sql([(f"d_smd000_sma{a:02d}", f"smd <= 0 AND sma <= {a}") for a in C.DRY_ANOMALIES], (5, 7, 10, 14), "sma"), recursive=True) + KEEP)
def _(t):
    return rounded(EV.event_recurrence(_smd(t), "monthly_dry", years=YEARS))


WET = {m: 14 + m % 4 for m in range(1, 13)}
WETGRID = [(f"d_r{r}_smd{d}", f"rain >= {r} AND smd >= {d}") for r in C.WET_RAIN_THRESHOLDS for d in C.WET_DEFICIT_THRESHOLDS]


@query("e2_wet", with_("record", extra=ONE_SITE + Q2 + ",\n" + SMA + ",\nwd AS (SELECT s.date, s.smd, r.rain FROM sma s JOIN record r ON r.date = s.date),\n" + _recur_sql(WETGRID, (7, 10, 14), "wd"), recursive=True) + KEEP)
def _(t):
    x = _smd(t).join(t.record.select("date", "rain"), "date")
    return rounded(EV.event_recurrence(x, "wet", years=YEARS))


def _long_sql(names: dict[str, str], source: str) -> str:
    """Check SQL of flags by name over months: probability, degenerate criteria dropped."""
    union = " UNION ALL ".join(f"SELECT y, m, '{n}' AS event, coalesce({cond}, false) AS flag FROM {source}" for n, cond in names.items())
    return f"""fl AS ({union}), pr AS (SELECT event, m, count(*) FILTER (flag) AS s, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) AS p FROM fl GROUP BY 1, 2),
kp AS (SELECT *, min(s) OVER (PARTITION BY event) AS lo, max(s) OVER (PARTITION BY event) AS hi FROM pr)"""


def _by_month(limits: dict[int, float]) -> str:
    return "CASE m " + " ".join(f"WHEN {m} THEN {v}" for m, v in limits.items()) + " END"


# the record of the tables is wetter and warmer than the published limits are for
WETTER, COOLER = 40, 12
MONTHDRY = {n: f"v <= {WETTER} + " + _by_month({m: v + (shift if m in C.SHOULDER_MONTHS else 0) for m, v in C.MONTH_RAIN_LIMITS.items()}) for n, shift in C.MONTH_RAIN_SHIFTS.items()}
HOTDAYS = {n: {m: C.SHOULDER_HOT_LIMITS.get(m, C.OTHER_HOT_LIMIT) + (s if m in C.SHOULDER_MONTHS else 0) for m in range(1, 13)} for n, s in C.SHOULDER_HOT_SHIFTS.items()}
VARHOT = {f"{n}_{d}": f"d{i} >= CASE WHEN m IN {C.SHOULDER_MONTHS} THEN {k} ELSE {C.OTHER_HOT_DAYS} END" for i, n in enumerate(HOTDAYS) for d, k in C.SHOULDER_HOT_DAYS.items()}
HOTSRC = f"""vd AS (SELECT year(date) AS y, month(date) AS m, CASE WHEN month(date) IN {C.SHOULDER_MONTHS} THEN (tmax + tmin) / 2 - {COOLER} ELSE tmax END AS v FROM record),
hc AS (SELECT y, m, {', '.join(f"count(*) FILTER (v >= {_by_month(lim)}) AS d{i}" for i, lim in enumerate(HOTDAYS.values()))} FROM vd GROUP BY 1, 2),
"""


@query("e2_month_dry", with_("record", extra="rs AS (SELECT year(date) AS y, month(date) AS m, sum(rain) AS v FROM record GROUP BY 1, 2),\n" + _long_sql(MONTHDRY, "rs")) + KEEP)
def _(t):
    limits = {n: {m: WETTER + v + (shift if m in C.SHOULDER_MONTHS else 0) for m, v in C.MONTH_RAIN_LIMITS.items()} for n, shift in C.MONTH_RAIN_SHIFTS.items()}
    return rounded(EV.month_dry_recurrence(_record(t), limits, YEARS))


@query("e2_variable_hot", with_("record", extra=HOTSRC + _long_sql(VARHOT, "hc")) + KEEP)
def _(t):
    return rounded(EV.variable_hot_recurrence(_record(t).withColumn("tmean", F.col("tmean") - COOLER), YEARS))


@query("e2_event_years", with_("record", extra=HOTSRC + _long_sql(VARHOT, "hc")) + "SELECT event, CAST(m AS INTEGER) AS month, CAST(y AS INTEGER) AS year FROM fl WHERE flag")
def _(t):
    return EV.event_years(EV.variable_hot_flags(_record(t).withColumn("tmean", F.col("tmean") - COOLER)))


@query("e2_wet_days_growth", with_("record") + f""", d AS (SELECT year(date) AS y, month(date) AS m, count(*) FILTER (rain > 0.01e0) AS d, avg(radn) AS r, avg(tmax) AS t FROM record GROUP BY 1, 2),
a AS (SELECT y, m, d >= 14 + m % 4 AS flag, r - avg(r) OVER (PARTITION BY m) AS irr, t - avg(t) OVER (PARTITION BY m) AS dry FROM d)
SELECT 'org' AS event, CAST(m AS INTEGER) AS month, count(*) FILTER (flag) AS sum, count(irr) FILTER (flag) AS count_irr, round(avg(irr) FILTER (flag), 6) AS mean_irr, count(dry) FILTER (flag) AS count_dry, round(avg(dry) FILTER (flag), 6) AS mean_dry FROM a GROUP BY m""")
def _(t):
    x = _record(t)
    months = x.groupBy("year", "month").agg(F.avg("radn").alias("r"), F.avg("tmax").alias("t"))
    growth = {n: W.anomaly(months, ["month"], c).select("year", "month", "anomaly") for n, c in (("irr", "r"), ("dry", "t"))}
    out = EV.wet_day_recurrence(x, WET, YEARS, growth)
    return rounded(out.select("event", "month", "sum", *[F.coalesce(f"count_{n}", F.lit(0)).alias(f"count_{n}") for n in growth], *[f"mean_{n}" for n in growth]))


@query("e2_restriction", with_("rest", extra=_recur_sql([(f"d_>{n}_rest", f"f_rest >= {v}e0") for n, v in (("half", 0.5), ("3/4", 0.75), ("full", 1.0))], (1, 5, 7, 10, 14), "rest")) + KEEP)
def _(t):
    return rounded(EV.event_recurrence(date_parts(t.rest), "restriction", years=YEARS))


@query("e2_wet_days", with_("record") + f""", d AS (SELECT year(date) AS y, month(date) AS m, count(*) FILTER (rain > 0.01e0) AS d FROM record GROUP BY 1, 2)
SELECT 'org' AS event, CAST(m AS INTEGER) AS month, count(*) FILTER (d >= 14 + m % 4) AS sum, round(avg(CASE WHEN d >= 14 + m % 4 THEN 1e0 ELSE 0e0 END), 6) AS prob FROM d GROUP BY 2""")
def _(t):
    return rounded(EV.wet_day_recurrence(_record(t), WET, YEARS))


@query("e2_rolling_dry", with_("record") + f""", w AS (SELECT date, CASE WHEN count(*) OVER x >= 10 THEN sum(rain) OVER x END AS v FROM record WINDOW x AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
d AS (SELECT year(date) AS y, month(date) AS m, count(*) FILTER (v <= 20 + 2 * month(date)) AS d1, count(*) FILTER (v <= 30 AND month(date) <> 7) AS d2 FROM w GROUP BY 1, 2), f AS (SELECT m, k || '_' || event AS event, CASE k WHEN 'flat' THEN d2 ELSE d1 END >= nd AS flag FROM d, (VALUES ('ndays5', 5), ('ndays10', 10), ('ndays15', 15), ('ndays20', 20)) q(event, nd), (VALUES ('season'), ('flat')) r(k)),
p AS (SELECT event, m, count(*) FILTER (flag) AS s, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) AS p FROM f GROUP BY 1, 2), k AS (SELECT *, min(s) OVER (PARTITION BY event) AS lo, max(s) OVER (PARTITION BY event) AS hi FROM p)
SELECT event, CAST(m AS INTEGER) AS month, s AS sum, round(p, 6) AS prob FROM k WHERE NOT (lo = {YEARS} OR hi = 0)""")
def _(t):
    days = {f"ndays{n}": {m: n for m in range(1, 13)} for n in (5, 10, 15, 20)}
    rain = {"season": {m: 20 + 2 * m for m in range(1, 13)}, "flat": {m: 30 for m in range(1, 13) if m != 7}}
    return rounded(EV.rolling_dry_recurrence(_record(t), days, rain, years=YEARS))


@query("e2_cumulative_restriction", with_("rest") + f""", d AS (SELECT year(date) AS y, month(date) AS m, sum(f_rest) AS v FROM rest GROUP BY 1, 2), f AS (SELECT m, printf('%02d', CAST(nd AS INTEGER)) AS event, v >= nd AS flag FROM d, (SELECT unnest([1,5,7,10,14,21,25,29]) AS nd)),
p AS (SELECT event, m, count(*) FILTER (flag) AS s, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) AS p FROM f GROUP BY 1, 2), k AS (SELECT *, min(s) OVER (PARTITION BY event) AS lo, max(s) OVER (PARTITION BY event) AS hi FROM p)
SELECT event, CAST(m AS INTEGER) AS month, s AS sum, round(p, 6) AS prob FROM k WHERE NOT (lo = {YEARS} OR hi = 0)""")
def _(t):
    return rounded(EV.cumulative_restriction_recurrence(date_parts(t.rest), years=YEARS))


@query("e2_spell_length", with_("rest", extra=SPELLS) + f""", k0 AS (SELECT DISTINCT y, m FROM fl), s AS (SELECT y, m, sum(length) AS t, max(length) AS hi FROM sp GROUP BY 1, 2), z AS (SELECT k0.y, k0.m, coalesce(t, 0) AS t, coalesce(hi, 0) AS mx FROM k0 LEFT JOIN s ON s.y = k0.y AND s.m = k0.m),
f AS (SELECT m, printf('%dd_half_%dtot', CAST(l AS INTEGER), CAST(nd AS INTEGER)) AS event, mx >= l AND t >= nd AS flag FROM z, (SELECT unnest([5,7,10]) AS l), (SELECT unnest([5,7,10,15,20]) AS nd)),
p AS (SELECT event, m, count(*) FILTER (flag) AS s, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) AS p FROM f GROUP BY 1, 2), k AS (SELECT *, min(s) OVER (PARTITION BY event) AS lo, max(s) OVER (PARTITION BY event) AS hi FROM p)
SELECT event, CAST(m AS INTEGER) AS month, s AS sum, round(p, 6) AS prob FROM k WHERE NOT (lo = {YEARS} OR hi = 0)""")
def _(t):
    return rounded(EV.spell_recurrence(date_parts(t.rest), {"half": 0.5}, years=YEARS))


@query("e2_joint", with_("record", "classes", extra=EVENTS3) + """, g AS (SELECT year(date) AS y, month(date) AS m, avg(radn) AS v FROM record GROUP BY 1, 2), ga AS (SELECT y, m, v - avg(v) OVER (PARTITION BY m) AS a FROM g)
SELECT p.event AS left, q.event AS right, p.month, round(count(*) / 48e0, 6) AS prob, count(a) AS count, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.75), 6) AS p75 FROM ev p JOIN ev q ON p.year = q.year AND p.month = q.month AND p.event = 'hot' AND q.event IN ('dry', 'wet')
LEFT JOIN ga ON ga.y = p.year AND ga.m = p.month GROUP BY 1, 2, 3""")
def _(t):
    g = _record(t).groupBy("year", "month").agg(F.avg("radn").alias("v"))
    g = W.anomaly(g, ["month"], "v").select("year", "month", "anomaly")
    return rounded(EV.joint_recurrence(events3(t), ["hot"], ["dry", "wet"], g).select("left", "right", "month", "prob", "count", "mean", "p75"))


@query("e2_growth_on_event", with_("record", "classes", extra=EVENTS3) + """, g AS (SELECT year(date) AS y, month(date) AS m, avg(radn) AS v FROM record GROUP BY 1, 2), ga AS (SELECT y, m, v - avg(v) OVER (PARTITION BY m) AS a FROM g)
SELECT CAST(m AS INTEGER) AS month, count(*) AS count, round(avg(a), 6) AS mean, round(min(a), 6) AS min, round(quantile_cont(a, 0.5), 6) AS p50, round(max(a), 6) AS max FROM ga WHERE EXISTS (SELECT 1 FROM ev WHERE ev.year = y AND ev.month = m AND event = 'hot') GROUP BY 1""")
def _(t):
    g = _record(t).groupBy("year", "month").agg(F.avg("radn").alias("v"))
    g = W.anomaly(g, ["month"], "v").select("year", "month", "anomaly")
    return rounded(EV.growth_anomaly_on(events3(t).where("event = 'hot'"), g).select("month", "count", "mean", "min", "p50", "max"))


E3 = """e3 AS (SELECT story_id, month, state, rest, rest_per, lead(state) OVER w AS nxt, row_number() OVER w = 1 AS first FROM stories WINDOW w AS (PARTITION BY story_id ORDER BY year, month)),
e3p AS (SELECT e3.*, t.p, i.p AS p0 FROM e3 LEFT JOIN transitions t ON t.month = e3.month AND t.from_state = state AND t.to_state = nxt LEFT JOIN initial i ON i.month = e3.month AND i.state = e3.state)"""
STEP = "CASE WHEN first THEN log10(p0) ELSE 0e0 END + CASE WHEN nxt IS NOT NULL AND month NOT IN (5,6,7) THEN log10(p){tail} ELSE 0e0 END"
TAIL = " + CASE WHEN rest = 0 THEN 0e0 ELSE log10(0.5e0 - abs(0.5e0 - rest_per)) END"


@query("e3_story_log10_prob", with_("stories", "transitions", "initial", extra=E3) + f"SELECT story_id, round(sum({STEP.format(tail=TAIL)}), 6) AS log10_prob_irrigated, round(sum({STEP.format(tail='')}), 6) AS log10_prob_dryland FROM e3p GROUP BY 1")
def _(t):
    return rounded(ST.story_log10_probs(t.story_months, t.transitions, t.initial))


@query("e3_story_log10_prob_from_zero", with_("stories", "transitions", "initial", extra=E3) + f"SELECT story_id, round(sum({STEP.format(tail=' + CASE WHEN rest = 0 THEN 0e0 ELSE log10(1e0 - rest_per) END')}), 6) AS log10_prob FROM e3p GROUP BY 1")
def _(t):
    return rounded(ST.story_log10_prob(t.story_months, t.transitions, t.initial, irr_prob_from_zero=True))


@query("e4_recalc_story_prob", with_("stories", "impact", "mapper") + """, mp AS (SELECT regime, combo, month, q, rest * f AS rest FROM mapper, (VALUES ('current', 1e0), ('eco_both', 0.75e0)) v(regime, f)),
s AS (SELECT *, CASE lag(precip_class, 1, 'A') OVER (PARTITION BY story_id ORDER BY year, month) WHEN 'D' THEN 'D' ELSE 'ND' END || '-' || CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END AS combo FROM stories),
seg AS (SELECT *, lead(rest) OVER w AS nr, lead(q) OVER w AS nq FROM mp WINDOW w AS (PARTITION BY regime, combo, month ORDER BY rest)), b AS (SELECT regime, combo, month, min(rest) AS a, max(rest) AS z FROM mp GROUP BY 1, 2, 3),
j AS (SELECT s.story_id, b.regime, CASE WHEN s.rest <= a THEN 0.01e0 WHEN s.rest >= z THEN 0.99e0 ELSE seg.q + (s.rest - seg.rest) * (nq - seg.q) / (nr - seg.rest) END AS qn FROM s JOIN b ON b.combo = s.combo AND b.month = s.month
 LEFT JOIN seg ON seg.regime = b.regime AND seg.combo = s.combo AND seg.month = s.month AND s.rest >= seg.rest AND s.rest < nr WHERE s.rest > 0),
tl AS (SELECT story_id, regime, sum(log10(0.5e0 - abs(0.5e0 - qn))) AS t FROM j GROUP BY 1, 2)
SELECT i.story_id, v.regime, round(log10_prob + coalesce(t, 0e0), 5) AS log10_prob FROM impact i CROSS JOIN (VALUES ('current'), ('eco_both')) v(regime) LEFT JOIN tl ON tl.story_id = i.story_id AND tl.regime = v.regime""")
def _(t):
    regimes = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(f).alias("f")) for n, f in (("current", 1.0), ("eco_both", 0.75))]))
    mappers = t.mapper.withColumn("_r", regimes).select("_r.regime", "combo", "q", "month", (F.col("rest") * F.col("_r.f")).alias("rest"))
    return rounded(ST.recalc_story_prob(t.story_months, t.impact.select("story_id", "log10_prob"), mappers), 5)


@query("e5_invalid_stories", with_("stories") + """, bs AS (SELECT * REPLACE (CASE WHEN grp % 11 = 0 AND month = 7 THEN 0.5e0 WHEN grp % 13 = 0 AND month = 10 THEN 1.5e0 ELSE rest END AS rest) FROM stories WHERE NOT (grp % 5 = 0 AND month = 9) AND NOT (grp % 17 = 0 AND month = 7)),
acc AS (SELECT DISTINCT state, month FROM stories WHERE year < 1997), s AS (SELECT s.*, acc.state IS NOT NULL AS seen, year * 12 + s.month AS t FROM bs s LEFT JOIN acc ON acc.state = s.state AND acc.month = s.month),
f AS (SELECT story_id, false AS bad_class, bool_or(rest NOT BETWEEN 0 AND 1) AS bad_rest, arg_min(month, t) <> 7 AS bad_start, max(t) - min(t) + 1 <> count(*) AS bad_dates, bool_or(month IN (6,7,8) AND rest <> 0) AS bad_winter, bool_or(NOT seen) AS bad_state FROM s GROUP BY 1)
SELECT story_id, CAST(bad_class AS INTEGER) AS bad_class, CAST(bad_rest AS INTEGER) AS bad_rest, CAST(bad_start AS INTEGER) AS bad_start, CAST(bad_dates AS INTEGER) AS bad_dates, CAST(bad_winter AS INTEGER) AS bad_winter, CAST(bad_state AS INTEGER) AS bad_state FROM f
WHERE bad_rest OR bad_start OR bad_dates OR bad_winter OR bad_state""")
def _(t):
    acc = t.story_months.where("year < 1997").select("state", "month").distinct()
    # some stories with a month too few, a late start, or a restriction that cannot be
    grp, month = F.col("grp"), F.col("month")
    rest = F.when((grp % 11 == 0) & (month == 7), 0.5).when((grp % 13 == 0) & (month == 10), 1.5).otherwise(F.col("rest"))
    broken = t.story_months.where(~((grp % 5 == 0) & (month == 9)) & ~((grp % 17 == 0) & (month == 7))).withColumn("rest", rest)
    x = ST.invalid_stories(broken, acc)
    return x.select("story_id", *[F.col(c).cast("int").alias(c) for c in x.columns if c.startswith("bad_")])


@query("e5_zero_transitions", with_("stories", "transitions") + """, acc AS (SELECT DISTINCT state, month FROM stories)
SELECT a.month, a.state AS from_state, b.state AS to_state, round(p, 6) AS p, CASE WHEN p IS NULL THEN 'no data' WHEN p = 0 THEN 'zero' ELSE 'non-zero' END AS kind FROM acc a JOIN acc b ON b.month = a.month % 12 + 1 LEFT JOIN transitions t ON t.month = a.month AND t.from_state = a.state AND t.to_state = b.state""")
def _(t):
    return rounded(ST.zero_transitions(t.transitions, t.story_months.select("state", "month").distinct()))


TAKE = """tk AS (SELECT f.date, flow, (1 - f_rest) * 11.041e0 AS take, dayofyear(f.date) AS doy, year(f.date) AS year FROM flow f JOIN rest r ON r.date = f.date),
nat AS (SELECT *, CASE WHEN year >= 1997 AND (doy <= 121 OR doy >= 244) THEN flow + take ELSE flow END AS nat FROM tk)"""
REGIME = "rg AS (SELECT * FROM " + values_sql([(n, float(a), float(b)) for n, (a, b) in C.REGIMES.items()], "v(regime, sa, so)") + """),
rs0 AS (SELECT date, doy, regime, nat, CASE WHEN NOT (doy <= 121 OR doy >= 244) THEN 1e0 WHEN nat >= sa THEN 0e0 WHEN nat <= so THEN 1e0 ELSE 1 - (nat - so) / so END AS f FROM nat, rg),
rs AS (SELECT date, regime, f AS f_rest, (1 - f) * 11.041e0 AS take, nat - (1 - f) * 11.041e0 AS flow FROM rs0)"""


def _nat(t):
    x = date_parts(t.flow.drop("n").join(t.rest, "date")).withColumn("take", (1 - F.col("f_rest")) * C.SCHEME_TAKE)
    return RV.naturalise_flow(x, 1997)


@query("e6_naturalise_flow", with_("flow", "rest", extra=TAKE) + "SELECT CAST(date AS VARCHAR) AS date, round(nat, 6) AS nat FROM nat")
def _(t):
    return rounded(text_date(_nat(t).select("date", "nat"), "date"))


@query("e7_restriction_scenario", with_("flow", "rest", extra=TAKE + ",\n" + REGIME) + "SELECT CAST(date AS VARCHAR) AS date, regime, round(f_rest, 6) AS f_rest, round(take, 6) AS take, round(flow, 6) AS flow FROM rs")
def _(t):
    return rounded(text_date(RV.restriction_scenario(_nat(t).drop("f_rest", "take")).select("date", "regime", "f_rest", "take", "flow"), "date"))


SPINE = """wy AS (SELECT year(min(date) - INTERVAL 6 MONTH) + 1 AS a, year(max(date) + INTERVAL 1 DAY - INTERVAL 6 MONTH) AS z FROM (SELECT date FROM flow UNION ALL SELECT date FROM record)),
sd AS (SELECT CAST(unnest(generate_series(make_date(a, 7, 1), make_date(z, 6, 30), INTERVAL 1 DAY)) AS DATE) AS date FROM wy),
sp AS (SELECT sd.date, last_value(f.flow IGNORE NULLS) OVER w AS flow, last_value(t.tmax IGNORE NULLS) OVER w AS temp FROM sd LEFT JOIN flow f ON f.date = sd.date LEFT JOIN record t ON t.date = sd.date WINDOW w AS (ORDER BY sd.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sc AS (SELECT scenario, date, flow * k AS flow, temp FROM sp, (VALUES ('low', 0.75e0), ('high', 1.25e0)) v(scenario, k))"""


def _scenarios(t):
    """Two full daily scenarios over the whole July years of the data: gaps take the last known value."""
    both = t.flow.select("date", "flow").join(t.record.select("date", F.col("tmax").alias("temp")), "date", "full")
    first = F.make_date(F.year(F.add_months(F.min("date"), -6)) + 1, F.lit(7), F.lit(1))
    last = F.make_date(F.year(F.add_months(F.date_add(F.max("date"), 1), -6)), F.lit(6), F.lit(30))
    full = both.agg(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("date")).join(both, "date", "left")
    full = W.fill(W.fill(full, [], "date", "flow"), [], "date", "temp")
    ks = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("k")) for n, k in (("low", 0.75), ("high", 1.25))]))
    return full.withColumn("_k", ks).select("_k.scenario", "date", (F.col("flow") * F.col("_k.k")).alias("flow"), "temp")


SLOPE, CUT = 1.25, 1.5
E8 = f"""hy AS (SELECT *, CAST(year(date - INTERVAL 6 MONTH) AS INTEGER) + 1 AS hydro_year, temp * {SLOPE} + {CUT} AS water, CASE WHEN count(flow) OVER w >= 4 THEN avg(flow) OVER w END AS roll FROM sc WINDOW w AS (PARTITION BY scenario ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
rn AS (SELECT *, row_number() OVER (PARTITION BY scenario, hydro_year ORDER BY date) AS rn FROM hy),
s1 AS (SELECT scenario, hydro_year, g, count(*) AS n FROM (SELECT *, rn - row_number() OVER (PARTITION BY scenario, hydro_year ORDER BY date) AS g FROM rn WHERE flow < {C.MALF}) GROUP BY 1, 2, 3),
s2 AS (SELECT scenario, hydro_year, g, count(*) AS n FROM (SELECT *, rn - row_number() OVER (PARTITION BY scenario, hydro_year ORDER BY date) AS g FROM rn WHERE flow < 50) GROUP BY 1, 2, 3),
e1 AS (SELECT scenario, hydro_year, {', '.join(f'count(*) FILTER (n >= {k}) AS malf_events_{k:02d}d' for k in C.SPELL_LENGTHS)} FROM s1 GROUP BY 1, 2),
e2 AS (SELECT scenario, hydro_year, {', '.join(f'count(*) FILTER (n >= {k}) AS flow_limit_events_{k:02d}d' for k in C.SPELL_LENGTHS)} FROM s2 GROUP BY 1, 2),
b AS (SELECT scenario, hydro_year, count(*) AS n_days, min(roll) AS alf, median(flow) AS median_flow, max(flow) AS max_flow, count(*) FILTER (flow < {C.MALF}) AS days_below_malf, count(*) FILTER (flow < 50) AS days_below_flow_limit, count(*) FILTER (flow > {C.MAF}) AS days_above_maf,
  {', '.join(f'count(*) FILTER (water > {k}) AS days_above_{k}C' for k in C.TEMPERATURE_THRESHOLDS)} FROM hy GROUP BY 1, 2),
stt AS (SELECT b.*, {', '.join(f'coalesce(malf_events_{k:02d}d, 0) AS malf_events_{k:02d}d, coalesce(flow_limit_events_{k:02d}d, 0) AS flow_limit_events_{k:02d}d' for k in C.SPELL_LENGTHS)}, {C.MALF} - alf AS malf_anomaly, max_flow - {C.MAF} AS maf_anomaly,
  days_above_maf * days_below_malf AS maf_malf_product, {', '.join(f"CASE WHEN alf <= 18 OR alf >= 130 THEN 0e0 ELSE {' + '.join(f'{c!r} * pow(alf, {5 - i})' for i, c in enumerate(k))} END AS {n}_wua" for n, k in C.HABITAT_COEFFICIENTS.items())}
  FROM b LEFT JOIN e1 ON e1.scenario = b.scenario AND e1.hydro_year = b.hydro_year LEFT JOIN e2 ON e2.scenario = b.scenario AND e2.hydro_year = b.hydro_year)"""
_INTS = ["n_days", "days_below_malf", "days_below_flow_limit", "days_above_maf", *[f"days_above_{k}C" for k in C.TEMPERATURE_THRESHOLDS],
         *[f"{n}_events_{k:02d}d" for k in C.SPELL_LENGTHS for n in ("malf", "flow_limit")], "maf_malf_product"]
_REALS = ["alf", "median_flow", "max_flow", "malf_anomaly", "maf_anomaly", *[f"{n}_wua" for n in C.HABITAT_COEFFICIENTS]]


@query("e8_hydro_year_stats", with_("flow", "record", extra=SPINE + ",\n" + E8) + f"SELECT scenario, hydro_year, {', '.join(_INTS)}, {', '.join(f'round({c}, 5) AS {c}' for c in _REALS)} FROM stt")
def _(t):
    x = RV.hydro_year_stats(_scenarios(t), slope=SLOPE, intercept=CUT)
    return rounded(x.select("scenario", "hydro_year", *_INTS, *_REALS), 5)


def _score_sql(stat: str) -> str:
    low, high = dict(zip(C.SCORED_STATISTICS, C.BASELINE_RANGES))[stat]
    sign = 3 if stat in C.HIGHER_IS_BETTER else -3
    return f"round_even((({stat} - ({low}e0)) / (({high}e0) - ({low}e0)) * 2 - 1) * {sign} * 2, 0) / 2"


E9 = ",\nsco AS (SELECT scenario, hydro_year, " + ", ".join(f"{_score_sql(s)} AS x{i}" for i, s in enumerate(C.SCORED_STATISTICS)) + " FROM stt),\nws AS (" + " UNION ALL ".join(
    f"SELECT scenario, hydro_year, '{n}' AS weighting, ({' + '.join(f'x{i} * {float(w)}e0' for i, w in enumerate(ws))}) / 22 AS score FROM sco" for n, ws in C.WEIGHTINGS.items()) + ")"


@query("e9_eco_scores", with_("flow", "record", extra=SPINE + ",\n" + E8 + E9) + "SELECT scenario, hydro_year, weighting, round(score, 6) AS score FROM ws")
def _(t):
    return rounded(RV.eco_scores(RV.hydro_year_stats(_scenarios(t), slope=SLOPE, intercept=CUT)))


@query("e9_mean_scores", with_("flow", "record", extra=SPINE + ",\n" + E8 + E9) + "SELECT scenario, weighting, round(avg(score), 6) AS score FROM ws GROUP BY 1, 2")
def _(t):
    return rounded(RV.mean_scores(RV.eco_scores(RV.hydro_year_stats(_scenarios(t), slope=SLOPE, intercept=CUT))))


E10 = """h AS (SELECT *, CAST(year(date - INTERVAL 6 MONTH) AS INTEGER) AS hydro_year FROM sc), w7 AS (SELECT scenario, hydro_year, CASE WHEN count(*) OVER w >= 7 THEN avg(flow) OVER w END AS v FROM h WINDOW w AS (PARTITION BY scenario, hydro_year ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
al AS (SELECT scenario, hydro_year, min(v) AS alf FROM w7 GROUP BY 1, 2),
sm AS (SELECT scenario, alf, CASE WHEN count(*) OVER b >= 2 THEN sum(alf) OVER b END AS s2, CASE WHEN count(*) OVER c >= 3 THEN sum(alf) OVER c END AS s3 FROM al WINDOW b AS (PARTITION BY scenario ORDER BY hydro_year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), c AS (PARTITION BY scenario ORDER BY hydro_year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
rp AS (SELECT scenario, avg(alf) AS malf, min(alf) AS w1, min(s2) AS w2, min(s3) AS w3 FROM sm GROUP BY 1)"""


@query("e10_low_flow_report", with_("flow", "record", extra=SPINE + ",\n" + E10) + """SELECT rp.scenario, round(malf, 6) AS malf, round(w1, 6) AS worst_1, round(w2, 6) AS worst_2, round(w3, 6) AS worst_3, round(malf - w1, 6) AS anomaly_1, round(malf - w2, 6) AS anomaly_2, round(malf - w3, 6) AS anomaly_3,
 round(m, 6) AS median_flow, s AS stress_days FROM rp JOIN (SELECT scenario, median(flow) AS m, count(*) FILTER (flow < 50) AS s FROM sc GROUP BY 1) x ON x.scenario = rp.scenario""")
def _(t):
    return rounded(RV.low_flow_report(_scenarios(t), ["scenario"]))


@query("e10_low_flow_years", with_("flow", "record", extra=SPINE + ",\n" + E10) + """, sr AS (SELECT *, row_number() OVER (PARTITION BY scenario, hydro_year ORDER BY date) AS rn FROM h), sg AS (SELECT *, rn - row_number() OVER (PARTITION BY scenario, hydro_year ORDER BY date) AS g FROM sr WHERE flow <= 50),
sl AS (SELECT scenario, hydro_year, g, count(*) AS n FROM sg GROUP BY 1, 2, 3), sx AS (SELECT scenario, hydro_year, count(*) FILTER (n > 1) AS c, coalesce(array_to_string(list_sort(list(n) FILTER (n > 1)), ','), '') AS l FROM sl GROUP BY 1, 2),
d AS (SELECT h.scenario, hydro_year, count(*) FILTER (flow < malf) AS days_below_malf, count(*) FILTER (flow < 50) AS stress_days FROM h JOIN rp ON rp.scenario = h.scenario GROUP BY 1, 2)
SELECT d.*, c AS n_spells, l AS lengths FROM d LEFT JOIN sx ON sx.scenario = d.scenario AND sx.hydro_year = d.hydro_year""")
def _(t):
    s = _scenarios(t)
    x = RV.low_flow_years(s, RV.low_flow_report(s, ["scenario"]), ["scenario"])
    return x.withColumn("lengths", F.when(F.col("lengths").isNotNull(), F.concat_ws(",", F.col("lengths").cast("array<string>"))))


@query("e11_storyline_subclusters")
def _(t):
    s = t.story_months
    bounds = t.spark.createDataFrame([("oxford", "irrigated", "yr1", 5000.0, None)], "site string, mode string, period string, low double, high double")
    pg = s.select("story_id", "site", "mode", "month", "pg")
    out = ST.storyline_subclusters(s, pg, t.impact.select("story_id", "log10_prob"), bounds, None, 4)
    return rounded(out["mass"])


@query("e11_subcluster_totals", with_("stories") + """, k AS (SELECT story_id FROM stories WHERE site = 'oxford' AND mode = 'irrigated' GROUP BY 1 HAVING sum(pg) >= 5000)
SELECT CAST(count(DISTINCT story_id) AS BIGINT) AS stories, 1e0 AS share FROM k""")
def _(t):
    """The clusters hold every chosen story once and share all of its probability."""
    s = t.story_months
    bounds = t.spark.createDataFrame([("oxford", "irrigated", "yr1", 5000.0, None)], "site string, mode string, period string, low double, high double")
    mass = ST.storyline_subclusters(s, s.select("story_id", "site", "mode", "month", "pg"), t.impact.select("story_id", "log10_prob"), bounds, None, 4)["mass"]
    return rounded(mass.agg(F.sum("size").alias("stories"), F.sum("share").alias("share")))


@query("e12_scenario_limits", with_("stories") + """, m AS (SELECT site, mode, month, avg(pg) AS m FROM stories WHERE month NOT IN (6,7,8) AND mode <> 'dryland' GROUP BY 1, 2, 3)
SELECT site, mode, printf('m%02d', month) AS period, round(m - CASE WHEN m * 0.2e0 < 5 THEN 300e0 ELSE m * 0.2e0 END, 5) AS low, round(m + CASE WHEN m * 0.2e0 < 5 THEN 300e0 ELSE m * 0.2e0 END, 5) AS high FROM m""")
def _(t):
    return rounded(ST.scenario_limits(t.story_months, 0.2), 5)


@query("e13_unique_event_impact", with_("stories") + """, e AS (SELECT story_id AS event, CAST(grp % 12 + 1 AS INTEGER) AS month0, CASE WHEN grp % 5 = 0 THEN 'A-A' ELSE 'C-D' END AS state, CASE WHEN grp % 12 + 1 IN (5,6,7,8) THEN 0 ELSE 50 END AS rest, seq, pg FROM stories),
s AS (SELECT *, seq - min(seq) OVER (PARTITION BY event) AS since FROM e)
SELECT event, month0, state, rest, CAST(since AS INTEGER) AS since, round(pg - max(CASE WHEN state = 'A-A' THEN pg END) OVER (PARTITION BY month0, since), 6) AS impact FROM s""")
def _(t):
    m0 = (F.col("grp") % 12 + 1).cast("int")
    e = t.story_months.select(F.col("story_id").alias("event"), m0.alias("month0"), F.when(F.col("grp") % 5 == 0, "A-A").otherwise("C-D").alias("state"),
                              F.when(m0.isin(5, 6, 7, 8), 0).otherwise(50).alias("rest"), "seq", F.col("pg").alias("value"))
    return rounded(ST.unique_event_impact(e))


VERIFY = """lm AS (SELECT month, quantile_cont(tmean, 0.25) AS tl, quantile_cont(tmean, 0.75) AS th, quantile_cont(rain, 0.25) AS sl, quantile_cont(rain, 0.75) AS sh FROM months WHERE site = 0 GROUP BY 1),
g AS (SELECT 'k' || site AS key, year AS realisation, m.month, CASE WHEN tmean <= tl THEN 'C' WHEN tmean >= th THEN 'H' ELSE 'A' END AS gt, CASE WHEN rain <= sl THEN 'D' WHEN rain >= sh THEN 'W' ELSE 'A' END AS gp FROM months m JOIN lm ON lm.month = m.month),
ck AS (SELECT key, realisation, count(*) FILTER (gt <> 'A' OR gp <> CASE WHEN month % 2 = 0 THEN 'A' ELSE 'D' END) AS mismatches, coalesce(array_to_string(list_sort(list(printf('m%02d:%s-%s', month, gt, gp)) FILTER (gt <> 'A' OR gp <> CASE WHEN month % 2 = 0 THEN 'A' ELSE 'D' END)), ','), '') AS keys FROM g GROUP BY 1, 2)"""


def _verified(t):
    m = t.months.select(F.concat(F.lit("k"), F.col("site").cast("string")).alias("key"), F.col("year").alias("realisation"), "month", "tmean", F.col("rain").alias("sma"))
    limits = A.class_limits(m.where("key = 'k0'"), ["tmean", "sma"])
    story = m.select("key", "month").distinct().withColumns({"temp_class": F.lit("A"), "precip_class": F.when(F.col("month") % 2 == 0, "A").otherwise("D")})
    return ST.verify_realisations(m, story, limits)


@query("e14_verify_realisations", with_("months", extra=VERIFY) + "SELECT *, CAST(mismatches > 0 AS INTEGER) AS bad FROM ck")
def _(t):
    return _verified(t).withColumns({"bad": F.col("bad").cast("int"), "keys": F.concat_ws(",", "keys")})


@query("e14_failure_rate", with_("months", extra=VERIFY) + "SELECT key, round(avg(CASE WHEN mismatches > 9 THEN 1e0 ELSE 0e0 END), 6) AS rate, count(*) AS n FROM ck GROUP BY 1")
def _(t):
    return rounded(ST.failure_rate(_verified(t).withColumn("bad", F.col("mismatches") > 9)))


FULLW = """fe AS (SELECT greatest((SELECT min(date) FROM record), (SELECT min(date) FROM rest)) AS a, least((SELECT max(date) FROM record), (SELECT max(date) FROM rest)) AS z),
fd AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM fe),
fw AS (SELECT fd.date, last_value(w.tmax IGNORE NULLS) OVER x AS tmax, last_value(w.rain IGNORE NULLS) OVER x AS rain, last_value(w.radn IGNORE NULLS) OVER x AS radn, last_value(r.f_rest IGNORE NULLS) OVER x AS f_rest FROM fd LEFT JOIN record w ON w.date = fd.date LEFT JOIN rest r ON r.date = fd.date
  WINDOW x AS (ORDER BY fd.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _full_weather(t):
    # from the first to the last day that both tables reach
    ends = [x.agg(F.min("date").alias("a"), F.max("date").alias("z")) for x in (t.record, t.rest)]
    days = ends[0].unionByName(ends[1]).agg(F.explode(F.sequence(F.max("a"), F.min("z"), F.expr("interval 1 day"))).alias("date"))
    full = days.join(t.record.join(t.rest, "date", "full"), "date", "left")
    for c in ("rain", "pet", "tmax", "tmin", "radn", "f_rest"):
        full = W.fill(full, [], "date", c)
    return date_parts(full)


@query("e15_model_input", with_("record", "rest", extra=FULLW) + """SELECT CAST(date AS VARCHAR) AS date, round(tmax, 6) AS tmax, round(rain, 6) AS rain, round(CASE WHEN dayofyear(date) <= 121 OR dayofyear(date) >= 244 THEN 5 * (1 - f_rest) ELSE 0e0 END, 6) AS max_irr,
 CASE WHEN month(date) IN (12,1,2) THEN 0.75e0 ELSE 0.6e0 END AS irr_trig, CASE WHEN month(date) IN (12,1,2) THEN 0.9e0 ELSE 0.75e0 END AS irr_targ FROM fw WHERE NOT (month(date) = 2 AND day(date) = 29)""")
def _(t):
    full = _full_weather(t)
    x = G.model_input(full.drop("f_rest"), full.select("date", "f_rest"), "irrigated")
    return rounded(text_date(x.select("date", "tmax", "rain", "max_irr", "irr_trig", "irr_targ"), "date"))


HARV = """d0 AS (SELECT site, date, min(date) OVER (PARTITION BY site) AS a, max(date) OVER (PARTITION BY site) AS z FROM weather),
hv AS (SELECT *, {hit} OR date = z AS h FROM d0)"""
HIT15 = """((date_diff('day', a, date) >= 5 AND (date_diff('day', a, date) - 5) % 15 = 0 AND NOT (month(date) = 2 AND day(date) = 29)) OR
 (month(date) = 2 AND day(date) = 28 AND month(date + 1) = 2 AND date_diff('day', a, date) >= 4 AND (date_diff('day', a, date) - 4) % 15 = 0 AND date + 1 <= z))"""
HITM = """((date_diff('day', a, date) >= 5 AND date = last_day(date) AND NOT (month(date) = 2 AND day(date) = 29)) OR (month(date) = 2 AND day(date) = 28 AND month(date + 1) = 2 AND date_diff('day', a, date) >= 4))"""


@query("e16_harvest_calendar", with_("weather", extra=HARV.format(hit=HIT15)) + """SELECT site, CAST(date AS VARCHAR) AS date, CASE WHEN h THEN 1501 ELSE -1 END AS harv_trig, CASE WHEN h THEN 1500 ELSE 0 END AS harv_targ,
 CASE WHEN dayofyear(date) = 152 THEN 0.696e0 ELSE -1e0 END AS reseed_trig, CASE WHEN dayofyear(date) = 152 THEN 0.727e0 ELSE 0e0 END AS reseed_basal FROM hv""")
def _(t):
    x = G.harvest_calendar(t.weather.select("site", "date"), "irrigated", "eyrewell", ["site"])
    return text_date(x.select("site", "date", "harv_trig", "harv_targ", "reseed_trig", "reseed_basal"), "date")


@query("e16_harvest_calendar_dryland", with_("weather", extra=HARV.format(hit=HITM)) + """SELECT site, CAST(date AS VARCHAR) AS date, CASE WHEN NOT h THEN -1 WHEN month(date) IN (12,1,2,3) THEN 801 ELSE 601 END AS harv_trig,
 [0.42e0, 0.3e0, 0.27e0, 0.25e0, 0.27e0, 0.2e0, 0.2e0, 0.2e0, 0.13e0, 0.22e0, 0.53e0, 0.6e0][month(date)] AS weed_dm_frac FROM hv""")
def _(t):
    x = G.harvest_calendar(t.weather.select("site", "date"), "dryland", "oxford", ["site"])
    return text_date(x.select("site", "date", "harv_trig", "weed_dm_frac"), "date")


@query("e17_paddock_split", with_("rest") + """, p AS (SELECT date, i, CASE WHEN f_rest <= i * 0.25e0 THEN 5e0 WHEN f_rest >= (i + 1) * 0.25e0 THEN 0e0 ELSE 5 * (f_rest - i * 0.25e0) / 0.25e0 END AS m FROM rest, range(0, 4) t(i))
SELECT CAST(date AS VARCHAR) AS date, round(avg(m), 6) AS max_irr, round(max(CASE WHEN i = 1 THEN m END), 6) AS paddock_1 FROM p GROUP BY 1""")
def _(t):
    p = G.paddock_split(t.rest).withColumn("paddock_1", F.when(F.col("paddock") == 1, F.col("max_irr")))
    return rounded(text_date(G.paddock_mean(p, ["date"], ["max_irr", "paddock_1"]), "date"))


@query("e18_align_baseline", with_("weather") + """, b AS (SELECT month(date) AS m, avg(radn) AS v FROM weather WHERE site = 1 GROUP BY 1), a AS (SELECT site, date, month(date) AS m, radn - v AS an FROM weather w JOIN b ON b.m = month(w.date) WHERE site <> 1)
SELECT site, CAST(date AS VARCHAR) AS date, round(an, 6) AS anomaly, round(sum(an * CASE WHEN m = 2 THEN 28 WHEN m IN (4,6,9,11) THEN 30 ELSE 31 END) OVER (PARTITION BY site ORDER BY date), 4) AS cum_anomaly FROM a""")
def _(t):
    x = date_parts(t.weather)
    y = G.align_baseline(x.where("site = 1"), x.where("site <> 1"), ["site"], "radn")
    return text_date(y.select("site", "date", r("anomaly").alias("anomaly"), r("cum_anomaly", 4).alias("cum_anomaly")), "date")


E19 = """fd AS (SELECT date, regime, take, flow, CAST(year(date - INTERVAL 6 MONTH) AS INTEGER) AS water_year, CASE WHEN count(*) OVER w >= 7 THEN avg(flow) OVER w END AS alf FROM rs WINDOW w AS (PARTITION BY regime ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


@query("e19_flow_pg_daily", with_("flow", "rest", extra=TAKE + ",\n" + REGIME + ",\n" + E19) + "SELECT CAST(date AS VARCHAR) AS date, regime, water_year, round(flow, 6) AS flow, round(alf, 6) AS alf FROM fd")
def _(t):
    return rounded(text_date(RV.flow_pg_daily(_nat(t).drop("f_rest", "take")).select("date", "regime", "water_year", "flow", "alf"), "date"))


@query("e19_flow_pg_annual", with_("flow", "rest", extra=TAKE + ",\n" + REGIME + ",\n" + E19) + "SELECT regime, water_year, round(min(alf), 6) AS alf, round(sum(take), 5) AS take FROM fd GROUP BY 1, 2")
def _(t):
    x = RV.flow_pg_annual(RV.flow_pg_daily(_nat(t).drop("f_rest", "take")))
    return x.select("regime", "water_year", r("alf").alias("alf"), r("take", 5).alias("take"))


@query("e19_restriction_pivot", with_("flow", "rest", extra=TAKE + ",\n" + REGIME) + "SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, " + ", ".join(f"round(avg(f_rest) FILTER (regime = '{n}'), 6) AS {n}" for n in C.REGIMES) + " FROM rs GROUP BY 1, 2")
def _(t):
    return rounded(RV.restriction_pivot(RV.restriction_scenario(_nat(t).drop("f_rest", "take"))))


@query("e20_restriction_table", with_("stories", "mapper") + """, s AS (SELECT DISTINCT month, state FROM stories), k AS (SELECT s.month, state, m.q, m.rest FROM s LEFT JOIN mapper m ON m.month = s.month AND m.combo = 'ND-' || CASE WHEN split_part(state, '-', 2) = 'D' THEN 'D' ELSE 'ND' END)
SELECT month, state, """ + ", ".join(f'CASE WHEN month IN (5,6,7,8) THEN 0e0 ELSE max(rest) FILTER (round(q * 100) = {q}) END AS "{q}"' for q in C.EVENT_QUANTILES) + " FROM k GROUP BY 1, 2")
def _(t):
    return ST.restriction_table_for_events(A.state_frequency(t.story_months), t.mapper)


@query("e20_options_text", with_("stories") + "SELECT month, array_to_string(list_sort(list(DISTINCT state)), ',') AS options, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month] AS name FROM stories GROUP BY 1")
def _(t):
    return ST.options_text(A.state_frequency(t.story_months))


@query("e21_historic_storylines", with_("classes", "rest", "mapper") + """, rm AS (SELECT year(date) AS y, month(date) AS m, sum(f_rest) / max(CASE WHEN month(date) = 2 THEN 28 WHEN month(date) IN (4,6,9,11) THEN 30 ELSE 31 END) AS rest FROM rest GROUP BY 1, 2), c AS (SELECT c.*, round_even(rm.rest, 2) AS rest, year - CASE WHEN month < 7 THEN 1 ELSE 0 END AS season FROM classes c JOIN rm ON rm.y = c.year AND rm.m = c.month),
f AS (SELECT *, count(*) OVER (PARTITION BY season) AS n, CASE precip_class_prev WHEN 'D' THEN 'D' ELSE 'ND' END || '-' || CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END AS combo FROM c)
SELECT 'hist-' || season AS story_id, year, f.month, any_value(precip_class) AS precip_class, any_value(f.rest) AS rest, CASE WHEN f.month IN (5,6,7,8) THEN 1e0 ELSE arg_min(m.q, (round(abs(round(m.rest, 12) - f.rest), 12), round(abs(0.5 - m.q), 12), m.q)) END AS rest_per
FROM f LEFT JOIN mapper m ON m.combo = f.combo AND m.month = f.month WHERE n = 12 GROUP BY season, year, f.month""")
def _(t):
    classes = EV.add_restriction(t.rest_classes.drop("precip_class_prev"), t.rest)
    x = ST.quantify_storylines(ST.historic_storylines(classes, 1994, 2001), t.mapper)
    return x.select("story_id", "year", "month", "precip_class", "rest", "rest_per")


ANN = """an AS (SELECT story_id % 10000 AS year, site, mode, round(avg(pg), 4) AS pg_yr1 FROM impact GROUP BY 1, 2, 3)"""


def _exceed_sql(source: str) -> str:
    return f"""e AS (SELECT site, mode, round_even(min(s) - 0.5e0, 1) AS a, round_even(max(s) + 0.5e0, 1) AS z, count(*) AS n FROM {source} GROUP BY 1, 2), c AS (SELECT site, mode, CAST(floor(round(s * 4, 9)) AS BIGINT) AS i, count(*) AS c FROM {source} GROUP BY 1, 2, 3),
gg AS (SELECT site, mode, n, unnest(range(CAST(floor(round(a * 4, 6)) AS BIGINT), CAST(ceil(round(z * 4, 6)) AS BIGINT) + 1)) AS i FROM e)
SELECT gg.site, gg.mode, gg.i AS bin, round((gg.i + 0.5e0) * 0.25e0, 6) AS pg, round(sum(coalesce(c, 0) / CAST(n AS DOUBLE)) OVER (PARTITION BY gg.site, gg.mode ORDER BY gg.i DESC), 6) AS prob FROM gg LEFT JOIN c ON c.site = gg.site AND c.mode = gg.mode AND c.i = gg.i"""


def _annual(t):
    return t.impact.groupBy((F.col("story_id") % 10000).alias("year"), "site", "mode").agg(r(F.avg("pg"), 4).alias("pg_yr1"))


@query("e22_historic_exceedance", with_("impact", extra=ANN + """,
sq AS (SELECT site, mode, s FROM (SELECT site, mode, round(sum(pg_yr1 / 1000) OVER w, 9) AS s, count(*) OVER w AS k FROM an WINDOW w AS (PARTITION BY site, mode ORDER BY year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) WHERE k = 2),
""" + _exceed_sql("sq").split("\nSELECT gg")[0]) + "SELECT gg" + _exceed_sql("sq").split("\nSELECT gg")[1])
def _(t):
    return rounded(G.historic_exceedance(_annual(t), ["site", "mode"], 2, True, step=0.5))


@query("e22_resampled_exceedance", with_("impact", extra=ANN + f""",
ix AS (SELECT *, row_number() OVER (PARTITION BY site, mode ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY site, mode) AS n FROM an), dd AS (SELECT c_custkey AS draw, s, site, mode, CAST(least(floor({u_sql(15, 'site', 'mode', 'c_custkey', 's')} * n), n - 1) AS BIGINT) AS i FROM customer, range(0, 3) t(s), (SELECT DISTINCT site, mode, n FROM ix)),
sq AS (SELECT dd.site, dd.mode, round(sum(pg_yr1 / 1000), 9) AS s FROM dd JOIN ix ON ix.site = dd.site AND ix.mode = dd.mode AND ix.i = dd.i GROUP BY draw, dd.site, dd.mode),
""" + _exceed_sql("sq").split("\nSELECT gg")[0]) + "SELECT gg" + _exceed_sql("sq").split("\nSELECT gg")[1])
def _(t):
    draws = t.table("customer").select(F.col("c_custkey").alias("draw")).withColumn("_s", F.explode(F.array(*[F.struct(F.lit(s).alias("site"), F.lit(m).alias("mode")) for s, m in
        (("oxford", "dryland"), ("eyrewell", "irrigated"), ("oxford", "irrigated"))]))).select("draw", "_s.*")
    return rounded(G.historic_exceedance(_annual(t), ["site", "mode"], 3, False, draws, step=0.5, seed=15, uniform=md5_uniform))


@query("e22_original_and_corrected", with_("stories", extra=f"fx AS (SELECT story_id, site, mode, 'corrected' AS version, {CORRECTION} AS v FROM stories UNION ALL SELECT story_id, site, mode, 'original', pg FROM stories)") + "SELECT story_id, site, mode, version, round(sum(v), 4) AS pg_yr1 FROM fx GROUP BY 1, 2, 3, 4")
def _(t):
    x = t.story_months.select("story_id", "site", "mode", "month", "pg")
    return rounded(G.original_and_corrected(x, ["story_id", "site", "mode"]), 4)


@query("e23_abandonment_differences", with_("weather", "rest") + """, m AS (SELECT site, year(date) AS y, month(date) AS m, avg(radn) AS v FROM weather GROUP BY 1, 2, 3),
rm AS (SELECT year(date) AS y, month(date) AS m, sum(f_rest) AS s FROM rest GROUP BY 1, 2), rr AS (SELECT y, m, s""" + "".join(f", CASE WHEN count(*) OVER w{n} >= {n} THEN sum(s) OVER w{n} END AS s{n}" for n in (2, 3, 6, 12)) + " FROM rm WINDOW " +
       ", ".join(f"w{n} AS (ORDER BY y, m ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (2, 3, 6, 12)) + """)
SELECT 'run' || a.site AS run, CAST(a.y AS INTEGER) AS year, CAST(a.m AS INTEGER) AS month, round(a.v - b.v, 6) AS pg_dif, round(s, 6) AS monthly_rest, """ + ", ".join(f"round(s{n}, 6) AS sum_{n}m" for n in (2, 3, 6, 12)) + """
FROM m a JOIN m b ON b.y = a.y AND b.m = a.m AND b.site = 0 AND a.site <> 0 JOIN rr ON rr.y = a.y AND rr.m = a.m""")
def _(t):
    runs = t.weather.select(F.concat(F.lit("run"), F.col("site").cast("string")).alias("run"), "date", "radn")
    return rounded(G.abandonment_differences(runs, t.rest, [], "run0", "radn"))


def _weather_stats(t, name):
    return WX.weather_statistics(t.record, t.rest_classes, rain_bins=50, only=[name])[name]


@query("e24_persistence", with_("record", "classes", extra="""f AS (SELECT date, rain = 0 AS dry FROM record), c AS (SELECT *, CASE WHEN lag(dry) OVER (ORDER BY date) <> dry THEN 1 ELSE 0 END AS ch FROM f),
sp AS (SELECT *, sum(ch) OVER (ORDER BY date) AS spell FROM c), st AS (SELECT *, row_number() OVER (PARTITION BY spell ORDER BY date) - 1 AS streak FROM sp), j AS (SELECT c.month, c.regime, dry, streak FROM st JOIN classes c ON c.year = year(date) AND c.month = month(date)),
n AS (SELECT month, regime, dry, streak, count(*) AS n FROM j GROUP BY ALL), k AS (SELECT *, row_number() OVER w - 1 AS rn, max(streak) OVER (PARTITION BY month, regime, dry) AS top FROM n WINDOW w AS (PARTITION BY month, regime, dry ORDER BY streak)), u AS (SELECT * FROM k WHERE streak = rn AND streak < top)""") + """
SELECT month, regime, CAST(dry AS INTEGER) AS dry, CAST(streak AS INTEGER) AS streak, n, round(least(1e0, nx / CAST(n AS DOUBLE)), 6) AS p FROM (SELECT *, lead(n) OVER (PARTITION BY month, regime, dry ORDER BY streak) AS nx FROM u) WHERE nx IS NOT NULL""")
def _(t):
    return rounded(_weather_stats(t, "persistence").withColumn("dry", F.col("dry").cast("int")))


@query("e24_rain_cdf", with_("record", "classes", extra="""j AS (SELECT c.month, c.regime, rain FROM record w JOIN classes c ON c.year = year(w.date) AND c.month = month(w.date) WHERE rain <> 0), b0 AS (SELECT month, regime, min(rain) AS a, max(rain) AS z, count(*) AS n FROM j GROUP BY 1, 2),
b AS (SELECT month, regime, CASE WHEN a = z THEN a - 0.5e0 ELSE a END AS a, CASE WHEN a = z THEN z + 0.5e0 ELSE z END AS z, n FROM b0),
c AS (SELECT j.month, j.regime, CAST(least(floor((rain - a) / (z - a) * 50), 49) AS INTEGER) AS bin, count(*) AS c FROM j JOIN b ON b.month = j.month AND b.regime = j.regime GROUP BY 1, 2, 3), g AS (SELECT *, unnest(range(0, 50)) AS bin FROM b)""") + """
SELECT g.month, g.regime, CAST(g.bin AS INTEGER) AS bin, a + (g.bin + 0.5e0) * ((z - a) / 50) AS centre, round(CAST(sum(coalesce(c, 0)) OVER (PARTITION BY g.month, g.regime ORDER BY g.bin) AS DOUBLE) / n, 8) AS cdf FROM g LEFT JOIN c ON c.month = g.month AND c.regime = g.regime AND c.bin = g.bin""")
def _(t):
    x = _weather_stats(t, "rain_cdf")
    return x.withColumn("cdf", F.round("cdf", 8))


@query("e24_variable_cdf")
def _(t):
    return rounded(_weather_stats(t, "cdf").withColumn("dry", F.col("dry").cast("int")))


@query("e24_lag_matrices")
def _(t):
    m = _weather_stats(t, "matrices")
    return m.select("month", "regime", F.posexplode("m0").alias("cell", "m0")).withColumn("m0", F.round("m0", 6))
