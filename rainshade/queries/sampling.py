"""Resampling and sampling (R1-R15); md5 uniforms let SQL repeat every draw."""

from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import scalars as S
from rainshade.functions.calendar import water_year
from rainshade.functions.draws import md5_uniform
from rainshade.operators import joins as J
from rainshade.operators import sampling as R
from rainshade.queries.base import query, r, rounded, scratch, with_
from rainshade.queries.joins import u_sql

LEN = "CASE WHEN {m} = 2 THEN 28 WHEN {m} IN (4,6,9,11) THEN 30 ELSE 31 END"
INPUTS = f"""inp AS (SELECT printf('m%02d-%s', CAST(month(date) AS INTEGER), CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END) AS key, r.date, month(date) AS m, f_rest AS v FROM rest r JOIN classes c ON year(r.date) = c.year AND month(r.date) = c.month
  WHERE day(date) <= {LEN.format(m='month(date)')}),
arr AS (SELECT key, list(v ORDER BY date) AS a FROM inp GROUP BY 1)"""
SIMS = f"""sims AS (SELECT o_orderkey AS sim, printf('m%02d-%s', CAST(month(o_orderdate) AS INTEGER), CASE WHEN o_custkey % 2 = 0 THEN 'D' ELSE 'ND' END) AS key, CAST({LEN.format(m='month(o_orderdate)')} AS INTEGER) AS n FROM orders),
blk AS (SELECT s.sim, s.key, n, a, i, CAST(least(floor({u_sql(5, 's.key', 's.sim', 'i')} * (len(a) - 5)), len(a) - 6) AS BIGINT) AS st FROM sims s JOIN arr ON arr.key = s.key, LATERAL (SELECT unnest(range(1, CAST(ceil(n / 5) AS BIGINT) + 1)) AS i)),
vals AS (SELECT sim, key, (i - 1) * 5 + j AS pos, a[st + j + 1] AS v FROM blk, range(0, 5) t(j) WHERE (i - 1) * 5 + j < n)"""


def inputs(t):
    return R.bootstrap_inputs(t.rest, t.rest_classes)


def sims(t):
    """One simulation per order, keyed by its month and a class."""
    o = t.dealt("orders", "o_orderkey", "o_custkey", "o_orderdate")
    state = F.when(F.col("o_custkey") % 2 == 0, "D").otherwise("ND")
    base = o.select(F.col("o_orderkey").alias("sim"), F.format_string("m%02d-%s", F.month("o_orderdate"), state).alias("key"), F.month("o_orderdate").alias("_m"))
    from rainshade.functions.calendar import month_days
    arrays = R.series_arrays(inputs(t))
    return R.moving_block_bootstrap(arrays, base, "single", 5, month_days(F.col("_m")), seed=5, uniform=md5_uniform)


@query("r1_moving_block_bootstrap", with_("rest", "classes", extra=INPUTS + ",\n" + SIMS) + "SELECT sim, key, count(*) AS n, arg_min(v, pos) AS first, arg_max(v, pos) AS last, round(sum(v * (pos + 1)), 4) AS weighted FROM vals GROUP BY 1, 2")
def _(t):
    s = sims(t)
    w = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return s.select("sim", "key", F.size("values").cast("long").alias("n"), F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last"), r(w, 4).alias("weighted"))


@query("r1_truncnormal_blocks")
def _(t):
    base = t.table("orders").select(F.col("o_orderkey").alias("sim"), F.format_string("m%02d-ND", F.month("o_orderdate")).alias("key"))
    s = R.moving_block_bootstrap(R.series_arrays(inputs(t)), base, "truncnormal", (7.0, 3.0, 2.0, 12.0), 30, seed=3, n_sizes=50)
    return s.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"), r(F.avg(R.array_mean(F.col("values")))).alias("mean"))


@query("r2_sim_statistic", with_("rest", "classes", extra=INPUTS + ",\n" + SIMS) + "SELECT sim, key, avg(v) AS mean, max(v) AS top FROM vals GROUP BY 1, 2")
def _(t):
    s = R.sim_statistic(R.sim_statistic(sims(t)), F.array_max, "top")
    return s.select("sim", "key", "mean", "top")


LAGS = 6
BANDS = f"""mon AS (SELECT key, r.date, v, row_number() OVER (PARTITION BY key, year(date) ORDER BY date) AS pos, 'input' AS source, CAST(year(date) AS BIGINT) AS sim FROM inp r),
vv AS (SELECT source, sim, key, pos, v FROM mon UNION ALL SELECT 'sim', sim, key, pos, v FROM vals),
pr AS (SELECT a.source, a.sim, a.key, l AS lag, corr(a.v, b.v) AS r FROM range(0, {LAGS}) t(l), vv a JOIN vv b ON a.source = b.source AND a.sim = b.sim AND a.key = b.key AND b.pos = a.pos + l GROUP BY ALL),
qs AS (SELECT unnest([0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0]) AS q)"""


@query("w14_autocorrelation_bands", with_("rest", "classes", extra=INPUTS + ",\n" + SIMS + ",\n" + BANDS) + """SELECT source, key, CAST(lag AS INTEGER) AS lag, q,
  round(CASE q WHEN 0.05 THEN quantile_cont(r, 0.05) WHEN 0.25 THEN quantile_cont(r, 0.25) WHEN 0.5 THEN quantile_cont(r, 0.5) WHEN 0.75 THEN quantile_cont(r, 0.75) ELSE quantile_cont(r, 0.95) END, 6) AS r
FROM pr, qs WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY source, key, lag, q""")
def _(t):
    from rainshade.operators.windows import autocorrelation_bands
    # a record's months of one key are its series
    months = R.series_arrays(inputs(t).withColumn("key", F.concat_ws("|", "key", "year"))).select(F.split_part("key", F.lit("|"), F.lit(1)).alias("key"), F.col("record").alias("values"))
    both = months.select(F.lit("input").alias("source"), "key", "values").unionByName(sims(t).select(F.lit("sim").alias("source"), "key", "values"))
    return rounded(autocorrelation_bands(both, ["source", "key"], "values", LAGS))


PULL = f"""st AS (SELECT sim, key, avg(v) AS mean FROM vals GROUP BY 1, 2), req AS (SELECT c_custkey AS request, printf('m%02d-ND', CAST(c_custkey % 12 + 1 AS INTEGER)) AS key, 0.48e0 + (c_custkey % 5) / 100e0 AS target FROM customer),
ok AS (SELECT request, sim, mean, row_number() OVER (PARTITION BY request ORDER BY mean, sim) - 1 AS k, count(*) OVER (PARTITION BY request) AS n FROM req JOIN st ON st.key = req.key AND mean >= target - 0.05e0 AND mean <= target + 0.05e0),
av AS (SELECT DISTINCT request, n FROM ok), dr AS (SELECT request, n, d, CAST(least(floor({u_sql(9, 'request', 'd')} * n), n - 1) AS BIGINT) AS k FROM av, range(0, 3) t(d))"""


@query("r3_pull_sims", with_("rest", "classes", extra=INPUTS + ",\n" + SIMS + ",\n" + PULL) + "SELECT dr.request, CAST(d AS INTEGER) AS draw, dr.n AS available, CAST(dr.n <= 0.9e0 * 3 AS INTEGER) AS short, sim, mean FROM dr JOIN ok ON ok.request = dr.request AND ok.k = dr.k")
def _(t):
    # the statistic is stored once, so neither pass makes the simulations again
    path = scratch(t.spark)
    R.sim_statistic(sims(t)).select("key", "sim", "mean").write.parquet(path)
    stats = t.spark.read.parquet(path)
    req = t.table("customer").select(F.col("c_custkey").alias("request"), F.format_string("m%02d-ND", (F.col("c_custkey") % 12 + 1).cast("int")).alias("key"),
                                     F.lit(3).alias("n"), (F.lit(0.48) + (F.col("c_custkey") % 5) / 100).alias("target"), F.lit(0.05).alias("tol"))
    out = R.pull_sims(stats, req, seed=9, uniform=md5_uniform, sub=F.floor(F.col("sim") / 1000))
    return out.select("request", "draw", "available", F.col("short").cast("int").alias("short"), "sim", "mean")


POOL = f"""pm AS (SELECT key, year(date) AS y, list(v ORDER BY date) AS a FROM inp GROUP BY 1, 2), pool AS (SELECT key, a, row_number() OVER (PARTITION BY key ORDER BY y) - 1 AS member, count(*) OVER (PARTITION BY key) AS n FROM pm)"""


@query("r4_stitch_months", with_("rest", "classes", "stories", extra=INPUTS + ",\n" + POOL) + f""", a AS (SELECT story_id, seq, month, q, printf('m%02d-%s', month, CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END) AS key FROM stories, range(0, 2) t(q)),
n AS (SELECT key, max(n) AS n FROM pool GROUP BY 1), p AS (SELECT a.*, CAST(least(floor({u_sql(4, 'story_id', 'seq', 'q')} * n), n - 1) AS BIGINT) AS member FROM a JOIN n ON n.key = a.key WHERE month NOT IN (6,7,8)),
m AS (SELECT story_id, q, len(pool.a) AS d, list_sum(pool.a) AS s FROM p JOIN pool ON pool.key = p.key AND pool.member = p.member UNION ALL SELECT story_id, q, {LEN.format(m='month')}, 0e0 FROM a WHERE month IN (6,7,8))
SELECT story_id, CAST(q AS INTEGER) AS realisation, CAST(sum(d) AS BIGINT) AS days, round(sum(s), 4) AS total FROM m GROUP BY 1, 2""")
def _(t):
    per_month = R.series_arrays(inputs(t).withColumn("key", F.concat_ws("|", "key", "year")))
    months = per_month.select(F.split_part("key", F.lit("|"), F.lit(1)).alias("key"), F.split_part("key", F.lit("|"), F.lit(2)).cast("int").alias("year"), F.col("record").alias("values"))
    # members of a key are its years in the record
    pools = R.year_index(months, "year", ["key"]).select("key", F.col("_i").alias("member"), F.col("_n").alias("n"), "values")
    stories = t.story_months.select("story_id", "seq", "month", S.month_state_key(F.col("month"), F.col("precip_class")).alias("key"))
    out = R.stitch_months(stories, pools, 2, seed=4, uniform=md5_uniform)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return out.select("story_id", "realisation", F.size("values").cast("long").alias("days"), r(total, 4).alias("total"))


CUM = """c AS (SELECT story_id, log10_prob, pg, sum(pow(10, log10_prob)) OVER (ORDER BY story_id) / sum(pow(10, log10_prob)) OVER () AS hi, row_number() OVER (ORDER BY story_id DESC) = 1 AS last FROM impact),
k AS (SELECT story_id, log10_prob, pg, coalesce(lag(hi) OVER (ORDER BY story_id), 0e0) AS lo, CASE WHEN last THEN 2e0 ELSE hi END AS hi FROM c)"""


@query("r5_nyear_suite", with_("impact", extra=CUM) + f""", d AS (SELECT o_orderkey AS draw, {u_sql(11, 'o_orderkey', 's')} AS u FROM orders, range(0, 3) t(s))
SELECT draw, round(sum(log10_prob), 5) AS log10_prob, round(sum(pg), 4) AS pg FROM d JOIN k ON u >= lo AND u < hi GROUP BY 1""")
def _(t):
    draws = t.dealt("orders", "o_orderkey").select(F.col("o_orderkey").alias("draw"))
    out = R.nyear_suite(draws, t.impact.select("story_id", "log10_prob", "pg"), 3, seed=11, uniform=md5_uniform, block=F.floor(F.col("story_id") / 100000))
    return out.select("draw", r("log10_prob", 5).alias("log10_prob"), r("pg", 4).alias("pg"))


@query("r5_nyear_suite_by_mode", with_("impact", extra=f"""by_mode AS (SELECT story_id, site, m.mode, log10_prob AS dry, CASE WHEN story_id % 7 = 0 THEN NULL ELSE log10_prob * 1.25e0 END AS irr, pg * f AS pg FROM impact, (VALUES ('dryland', 0.5e0), ('irrigated', 1e0), ('store400', 0.75e0)) m(mode, f)),
pm AS (SELECT *, pow(10, CASE WHEN mode = 'dryland' THEN dry ELSE irr END) AS w FROM by_mode WHERE irr IS NOT NULL),
cm AS (SELECT *, sum(w) OVER (PARTITION BY site, mode ORDER BY story_id) / sum(w) OVER (PARTITION BY site, mode) AS hi, row_number() OVER (PARTITION BY site, mode ORDER BY story_id DESC) = 1 AS last FROM pm),
km AS (SELECT * REPLACE (CASE WHEN last THEN 2e0 ELSE hi END AS hi), coalesce(lag(hi) OVER (PARTITION BY site, mode ORDER BY story_id), 0e0) AS lo FROM cm),
d AS (SELECT c_custkey AS draw, {u_sql(13, 'c_custkey', 's')} AS u FROM customer, range(0, 3) t(s))""") + """SELECT site, mode, draw, round(sum(dry), 5) AS log10_prob_dryland, round(sum(irr), 5) AS log10_prob_irrigated, round(sum(pg), 4) AS pg FROM d JOIN km ON u >= lo AND u < hi GROUP BY 1, 2, 3""")
def _(t):
    factors = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(f).alias("f")) for m, f in (("dryland", 0.5), ("irrigated", 1.0), ("store400", 0.75))])).alias("_m")
    suite = t.impact.select("story_id", "site", "log10_prob", "pg", factors).select(
        "story_id", "site", "_m.mode", F.col("log10_prob").alias("log10_prob_dryland"),
        F.when(F.col("story_id") % 7 != 0, F.col("log10_prob") * 1.25).alias("log10_prob_irrigated"), (F.col("pg") * F.col("_m.f")).alias("pg"))
    out = R.nyear_suite_by_mode(t.table("customer").select(F.col("c_custkey").alias("draw")), suite, 3, seed=13, uniform=md5_uniform, block=F.floor(F.col("story_id") / 100000))
    return out.select("site", "mode", "draw", r("log10_prob_dryland", 5).alias("log10_prob_dryland"), r("log10_prob_irrigated", 5).alias("log10_prob_irrigated"), r("pg", 4).alias("pg"))


@query("r6_nyear_probability", with_("impact", extra=CUM) + f""", d AS (SELECT o_orderkey AS draw, {u_sql(11, 'o_orderkey', 's')} AS u FROM orders, range(0, 3) t(s)), g(regime, f) AS (VALUES ('current', 1e0), ('eco_both', 1.5e0))
SELECT regime, draw, round(sum(log10_prob * f), 5) AS log10_prob FROM d JOIN k ON u >= lo AND u < hi, g GROUP BY 1, 2""")
def _(t):
    slots = t.table("orders").select(F.col("o_orderkey").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot"))
    slots = slots.withColumn("u", md5_uniform(11, F.col("draw"), F.col("slot")))
    items = t.impact.select("story_id", S.pow10(F.col("log10_prob")).alias("w"))
    picks = J.inverse_cdf_join(slots, "u", items, "w", "story_id", block=F.floor(F.col("story_id") / 100000))
    regimes = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(f).alias("f")) for n, f in (("current", 1.0), ("eco_both", 1.5))]))
    prob = t.impact.withColumn("_r", regimes).select("story_id", "_r.regime", (F.col("log10_prob") * F.col("_r.f")).alias("log10_prob"))
    return R.nyear_probability(picks, prob).select("regime", "draw", r("log10_prob", 5).alias("log10_prob"))


YEARS = """wy AS (SELECT CAST(year(date - INTERVAL 6 MONTH) AS INTEGER) AS water_year, min(flow) AS alf, sum(flow) AS take FROM flow GROUP BY 1),
yi AS (SELECT *, row_number() OVER (ORDER BY water_year) - 1 AS i, count(*) OVER () AS n FROM wy)"""


def _annual(t):
    f = t.flow.withColumn("water_year", water_year(F.col("date")))
    return f, f.groupBy("water_year").agg(F.min("flow").alias("alf"), F.sum("flow").alias("take"))


@query("r7_bootstrap_years", with_("flow", extra=YEARS) + f""", d AS (SELECT c_custkey AS draw, {u_sql(6, 'c_custkey', 's')} AS u FROM customer, range(0, 5) t(s))
SELECT draw, round(avg(alf), 6) AS alf, round(sum(take), 4) AS take FROM d JOIN yi ON yi.i = least(floor(u * n), n - 1) GROUP BY 1""")
def _(t):
    _, annual = _annual(t)
    draws = t.table("customer").select(F.col("c_custkey").alias("draw"))
    out = R.bootstrap_years(draws, annual, 5, ["alf"], ["take"], seed=6, uniform=md5_uniform)
    return out.select("draw", r("alf").alias("alf"), r("take", 4).alias("take"))


@query("r7_draw_to_daily", with_("flow", extra=YEARS) + f""", d AS (SELECT s_suppkey AS draw, s, {u_sql(6, 's_suppkey', 's')} AS u FROM supplier, range(0, 2) t(s))
SELECT draw, CAST(s AS INTEGER) AS slot, CAST(month(f.date) AS INTEGER) AS month, count(*) AS days, round(sum(f.flow), 6) AS flow FROM d JOIN yi ON yi.i = least(floor(u * n), n - 1) JOIN flow f ON CAST(year(f.date - INTERVAL 6 MONTH) AS INTEGER) = yi.water_year GROUP BY 1, 2, 3""")
def _(t):
    daily, annual = _annual(t)
    draws = t.table("supplier").select(F.col("s_suppkey").alias("draw"))
    picks = R.bootstrap_years(draws, annual, 2, seed=6, uniform=md5_uniform, summarise=False)
    days = R.draw_to_daily(picks, daily.drop("n"))
    return rounded(days.groupBy("draw", "slot", F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("days"), F.sum("flow").alias("flow")))


MONTHS = "[7,8,9,10,11,12,1,2,3,4,5]"


def _paths_sql(source: str, key: str, seed: int) -> str:
    return f"""cm AS (SELECT month, from_state, to_state, coalesce(lag(h) OVER w, 0e0) AS lo, CASE WHEN lead(h) OVER w IS NULL THEN 2e0 ELSE h END AS hi FROM (SELECT *, sum(p) OVER (PARTITION BY month, from_state ORDER BY to_state) / sum(p) OVER (PARTITION BY month, from_state) AS h FROM transitions)
  WINDOW w AS (PARTITION BY month, from_state ORDER BY to_state)),
walk(sim, i, s, path) AS (SELECT {key}, 0, 'A-A', ['A-A'] FROM {source} UNION ALL SELECT sim, i + 1, to_state, list_append(path, to_state) FROM (SELECT *, {u_sql(seed, 'sim', 'i')} AS u FROM walk WHERE i < 11) w
  JOIN cm ON cm.month = {MONTHS}[w.i + 1] AND cm.from_state = w.s AND u >= lo AND u < hi)"""


@query("r8_markov_paths", with_("stories", "transitions", extra=_paths_sql("orders", "o_orderkey", 8), recursive=True) + "SELECT min(sim) AS sim, array_to_string(path, ' ') AS states FROM walk WHERE i = 11 GROUP BY 2")
def _(t):
    s = t.dealt("orders", "o_orderkey").select(F.col("o_orderkey").alias("sim"))
    return R.markov_paths(s, t.transitions, seed=8, uniform=md5_uniform).select("sim", F.concat_ws(" ", "states").alias("states"))


def _choice_sql(u: str, options, probs) -> str:
    total, run, parts = sum(probs), 0.0, []
    for o, p in zip(options, probs):
        run += p / total
        parts.append((o, run))
    return "CASE " + " ".join(f"WHEN {u} < {e!r} THEN {o!r}" for o, e in parts[:-1]) + f" ELSE {parts[-1][0]!r} END"


BAD = [q / 100 for q in C.BAD_QUANTILES]


@query("r9_irrigation_suites", f"""SELECT o_orderkey AS sim, CAST(i AS INTEGER) AS seq, CASE WHEN i BETWEEN 2 AND 9 THEN CAST({_choice_sql(u_sql(2, 'o_orderkey', 'i'), BAD, C.QUANTILE_PROBABILITIES)} AS DOUBLE) ELSE 0e0 END AS rest FROM orders, range(0, 12) t(i)""")
def _(t):
    s = R.irrigation_suites(t.table("orders").select(F.col("o_orderkey").alias("sim")), True, seed=2, uniform=md5_uniform)
    return s.select("sim", F.posexplode("rest").alias("seq", "rest"))


@query("r9_frequency_paths", with_("stories") + f""", f AS (SELECT month, state, count(*) / 48e0 AS p FROM stories GROUP BY 1, 2), h AS (SELECT month, state, sum(p) OVER (PARTITION BY month ORDER BY state) / sum(p) OVER (PARTITION BY month) AS h FROM f),
cm AS (SELECT month, state, coalesce(lag(h) OVER w, 0e0) AS lo, CASE WHEN lead(h) OVER w IS NULL THEN 2e0 ELSE h END AS hi FROM h WINDOW w AS (PARTITION BY month ORDER BY state))
SELECT c_custkey AS sim, month, state FROM (SELECT c_custkey, m, {u_sql(12, 'c_custkey', 'm')} AS u FROM customer, range(1, 13) t(m)) d JOIN cm ON cm.month = d.m AND u >= lo AND u < hi""")
def _(t):
    from rainshade.operators.aggregates import state_frequency
    return R.frequency_paths(t.table("customer").select(F.col("c_custkey").alias("sim")), state_frequency(t.story_months), seed=12, uniform=md5_uniform).select("sim", "month", "state")


@query("r10_random_suite", with_("stories", "transitions", "mapper", extra=_paths_sql("customer", "c_custkey", 8), recursive=True) + f""", pr AS (SELECT DISTINCT o_custkey AS weather, o_orderkey // 10 AS irrigation FROM orders),
rows AS (SELECT weather, irrigation, seq, (seq + 6) % 12 + 1 AS month, 2024 + CASE WHEN seq > 5 THEN 1 ELSE 0 END AS year, split_part(path[seq + 1], '-', 1) AS temp_class, split_part(path[seq + 1], '-', 2) AS precip_class,
  CASE WHEN seq BETWEEN 2 AND 9 THEN CAST({_choice_sql(u_sql(2, 'irrigation', 'seq'), BAD, C.QUANTILE_PROBABILITIES)} AS DOUBLE) ELSE 0e0 END AS rest_per FROM pr JOIN walk ON walk.sim = pr.weather AND walk.i = 11, range(0, 12) t(seq)),
k AS (SELECT *, CASE lag(precip_class, 1, 'A') OVER (PARTITION BY weather, irrigation ORDER BY seq) WHEN 'D' THEN 'D' ELSE 'ND' END || '-' || CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END AS combo FROM rows)
SELECT weather, irrigation, CAST(k.month AS INTEGER) AS month, CAST(year AS INTEGER) AS year, temp_class, precip_class, rest_per, CASE WHEN k.month IN (5,6,7,8) THEN 0e0 ELSE m.rest END AS rest FROM k LEFT JOIN mapper m ON m.combo = k.combo AND m.month = k.month AND round(m.q * 100) = round(rest_per * 100)""")
def _(t):
    c = t.dealt("customer", "c_custkey").select(F.col("c_custkey").alias("sim"))
    paths = R.markov_paths(c, t.transitions, seed=8, uniform=md5_uniform, unique=False).withColumnRenamed("sim", "weather")
    suites = R.irrigation_suites(c, True, seed=2, uniform=md5_uniform).withColumnRenamed("sim", "irrigation")
    pairs = t.table("orders").select(F.col("o_custkey").alias("weather"), F.floor(F.col("o_orderkey") / 10).alias("irrigation"))
    suite = R.random_suite(paths, suites, pairs).withColumn("story_id", F.concat_ws("|", "weather", "irrigation"))
    out = J.map_storyline_rest(suite, t.mapper, "rest_per", "rest")
    return out.select("weather", "irrigation", "month", "year", "temp_class", "precip_class", "rest_per", "rest")


@query("r11_multi_year_stories", with_("impact") + f""", g AS (SELECT story_id, log10_prob, row_number() OVER (ORDER BY story_id) - 1 AS i, count(*) OVER () AS n FROM impact WHERE irr_type = 'good'), b AS (SELECT story_id, log10_prob, row_number() OVER (ORDER BY story_id) - 1 AS i, count(*) OVER () AS n FROM impact WHERE irr_type = 'bad')
SELECT o_orderkey AS draw, g.story_id AS id_0, b.story_id AS id_1, round(g.log10_prob + b.log10_prob, 6) AS log10_prob FROM (SELECT o_orderkey, {u_sql(13, 'o_orderkey', '0')} AS u0, {u_sql(13, 'o_orderkey', '1')} AS u1 FROM orders) d JOIN g ON g.i = floor(u0 * g.n) JOIN b ON b.i = floor(u1 * b.n)""")
def _(t):
    draws = t.table("orders").select(F.col("o_orderkey").alias("draw"))
    sets = [t.impact.where(F.col("irr_type") == k).select("story_id", "log10_prob") for k in ("good", "bad")]
    out = R.multi_year_stories(draws, sets, seed=13, uniform=md5_uniform, block=lambda c: F.floor(c / 100000))
    return rounded(out.select("draw", "id_0", "id_1", "log10_prob"))


@query("r11_expand_multi_year", with_("stories") + """, d AS (SELECT o_orderkey AS draw, s, CASE s WHEN 0 THEN x.story_id ELSE y.story_id END AS story_id FROM orders JOIN (SELECT DISTINCT grp, story_id FROM stories WHERE story_id % 10000 = (SELECT min(story_id % 10000) FROM stories)) x ON x.grp = o_custkey // 15
  JOIN (SELECT DISTINCT grp, story_id FROM stories WHERE story_id % 10000 = (SELECT max(story_id % 10000) FROM stories)) y ON y.grp = o_custkey // 15, range(0, 2) t(s))
SELECT draw, CAST(make_date(year + CAST(s AS INTEGER), month, 1) AS VARCHAR) AS date, state FROM d JOIN stories USING (story_id)""")
def _(t):
    s = t.story_months
    o = t.table("orders").select(F.col("o_orderkey").alias("draw"), F.floor(F.col("o_custkey") / 15).alias("grp"))
    # each customer group's first season of the data with its last
    season = F.col("story_id") % 10000
    ends = s.agg(F.min(season), F.max(season)).first()
    a, b = (s.where(season == y).select("grp", F.col("story_id").alias(f"id_{i}")).distinct() for i, y in enumerate(ends))
    chosen = o.join(a, "grp").join(b, "grp")
    dated = s.select("story_id", F.make_date("year", "month", F.lit(1)).alias("date"), "state")
    return R.expand_multi_year(chosen, dated, 2).select("draw", F.col("date").cast("string").alias("date"), "state")


@query("r12_sample_without_replacement", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {u_sql(21, 'o_orderkey')}, o_orderkey LIMIT 100")
def _(t):
    return R.sample_without_replacement(t.table("orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey", seed=21, uniform=md5_uniform)


@query("r13_sample_size_study", f"""WITH f AS (SELECT avg(c_acctbal) AS m, count(*) AS n FROM customer), p AS (SELECT k, q, m, CAST(least(floor({u_sql(17, "'all'", 'k', 'q', 'd')} * n), n - 1) AS BIGINT) AS member FROM f, (VALUES (5), (20), (50)) v(k), range(0, 40) a(q), range(0, 50) b(d) WHERE d < k),
s AS (SELECT k, q, avg(c_acctbal) AS v, max(m) AS m FROM p JOIN customer ON c_custkey = member GROUP BY 1, 2), e AS (SELECT k, CASE WHEN abs(m) >= 10 THEN abs(v - m) / abs(m) ELSE abs(v - m) END AS e FROM s)
SELECT 'all' AS key, k AS n, round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error FROM e GROUP BY 2""")
def _(t):
    e = t.table("customer").select(F.lit("all").alias("key"), F.col("c_custkey").alias("member"), F.col("c_acctbal").alias("value"))
    return rounded(R.sample_size_study(e, [5, 20, 50], 40, seed=17, uniform=md5_uniform))


@query("r14_oversample_count", with_("stories") + "SELECT month, state, CAST(floor(100 / (1 - p) + 1) AS BIGINT) AS n FROM (SELECT month, state, avg(CASE WHEN pg > 1500 THEN 1e0 ELSE 0e0 END) / 2 AS p FROM stories GROUP BY 1, 2)")
def _(t):
    p = t.story_months.groupBy("month", "state").agg((F.avg(F.when(F.col("pg") > 1500, 1.0).otherwise(0.0)) / 2).alias("p"))
    return p.select("month", "state", S.oversample_count(F.lit(100), F.col("p")).alias("n"))


@query("r15_bootstrap_inputs", with_("rest", "classes", extra=INPUTS) + "SELECT key, count(*) AS days, round(sum(v), 6) AS total, round(min(v), 6) AS low FROM inp GROUP BY 1")
def _(t):
    return rounded(inputs(t).groupBy("key").agg(F.count(F.lit(1)).alias("days"), F.sum("value").alias("total"), F.min("value").alias("low")))


@query("r15_months_per_key", with_("rest", "classes") + """SELECT printf('m%02d-%s', month, CASE precip_class_prev WHEN 'D' THEN 'D' ELSE 'ND' END || '-' || CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END) AS key, CAST(count(*) AS INTEGER) AS n_months FROM classes WHERE year * 12 + month > (SELECT min(year(date) * 12 + month(date)) FROM rest) AND year * 12 + month < (SELECT max(year(date) * 12 + month(date)) FROM rest) GROUP BY 1""")
def _(t):
    # the record with its missing days filled, whole months only
    from rainshade.operators.windows import fill
    whole = F.col("year") * 12 + F.col("month")
    full = fill(J.date_spine(t.rest), [], "date", "f_rest")
    number = F.year("date") * 12 + F.month("date")
    ends = t.rest.agg(F.min(number).alias("_a"), F.max(number).alias("_z"))
    keep = t.rest_classes.join(F.broadcast(ends), (whole > F.col("_a")) & (whole < F.col("_z"))).drop("_a", "_z")
    return R.months_per_key(R.bootstrap_inputs(full, keep, by_pair=True))
