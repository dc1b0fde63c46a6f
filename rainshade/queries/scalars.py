"""Scalar functions (F1-F17)."""


from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import calendar as D
from rainshade.functions import evaporation as E
from rainshade.functions import scalars as S
from rainshade.operators import shape as P
from rainshade.operators import statistics as M
from rainshade.queries.base import query, r, rounded, text_date, with_


@query("f1_log10_safe", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(log10(l_discount), 6) END AS lg, round(pow(10e0, l_discount), 6) AS p FROM lineitem""")
def _(t):
    x = t.table("lineitem").select("l_orderkey", "l_linenumber", S.log10_safe(F.col("l_discount")).alias("lg"), r(S.pow10(F.col("l_discount"))).alias("p"))
    return x.withColumn("lg", F.when(F.col("lg") > float("-inf"), F.round("lg", 6)).otherwise(F.col("lg")))


@query("f2_tail_prob", with_("stories") + """SELECT story_id, month, round(CASE WHEN rest = 0 THEN 0e0 ELSE log10(1 - rest_per) END, 6) AS from_zero, round(CASE WHEN rest = 0 THEN 0e0 ELSE log10(0.5e0 - abs(0.5e0 - rest_per)) END, 6) AS two_sided FROM stories""")
def _(t):
    return rounded(t.story_months.select("story_id", "month", S.tail_prob(F.col("rest"), F.col("rest_per"), True).alias("from_zero"), S.tail_prob(F.col("rest"), F.col("rest_per")).alias("two_sided")))


@query("f3_round_half_even", """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS even, round_even(l_quantity / 4 * 2, 0) / 2 AS half FROM lineitem""")
def _(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", S.round_half_even(F.col("l_quantity") / 2).alias("even"), S.round_to_half(F.col("l_quantity") / 4).alias("half"))


_POLY = C.HABITAT_COEFFICIENTS["torrent_fish"]


@query("f4_polynomial5", with_("flow") + "SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN flow <= 18 OR flow >= 130 THEN 0e0 ELSE " + " + ".join(f"{c!r} * pow(flow, {5 - i})" for i, c in enumerate(_POLY)) + " END, 4) AS wua FROM flow")
def _(t):
    return rounded(text_date(t.flow.select("date", S.polynomial5(F.col("flow"), _POLY, *C.HABITAT_RANGE).alias("wua")), "date"), 4)


@query("f5_actual_et", with_("weather") + "SELECT site, CAST(date AS VARCHAR) AS date, round(least(pet, 0.0073e0 * pet * (150 - tmin * 10)), 6) AS aet FROM weather")
def _(t):
    return rounded(text_date(t.weather.select("site", "date", E.actual_et(F.col("pet"), -F.col("tmin") * 10).alias("aet")), "date"))


@query("f6_penman_pet", with_("weather") + """, w AS (SELECT site, date, tmax AS t, radn AS rad, least(40 + rain * 10, 100e0) AS rh, 1 + pet / 2 AS w10, 101.3e0 AS mslp, 60 * (site + 1) AS elev FROM weather),
x AS (SELECT *, mslp * pow(1 - 0.0065e0 * elev / (t + 273 + 0.0065e0 * elev), 5.257e0) AS ps, w10 * (4.87e0 / ln(67.8e0 * 10 - 5.42e0)) AS wind, 2.501e0 - 0.00236e0 * t AS h, 4098 * (0.6108e0 * exp(17.27e0 * t / (t + 237.3e0))) / pow(t + 237.3e0, 2) AS d, 0.61094e0 * exp(17.625e0 * t / (243.04e0 + t)) AS es FROM w),
y AS (SELECT *, 1.1013e0 * ps / (0.622e0 * h * 1000) AS g FROM x)
SELECT site, CAST(date AS VARCHAR) AS date, round((d * rad / h + g * (900 / (t + 273)) * wind * (es - rh * es / 100)) / (d + g * (1 + 0.34e0 * wind)), 6) AS pet FROM y""")
def _(t):
    c = F.col
    pet = E.penman_pet(c("radn"), c("tmax"), F.least(40 + c("rain") * 10, F.lit(100.0)), wind_10=1 + c("pet") / 2, mslp=F.lit(101.3), elevation=60 * (c("site") + 1))
    return rounded(text_date(t.weather.select("site", "date", pet.alias("pet")), "date"))


@query("f7_reference_et", with_("weather") + """, a AS (SELECT site, date, tmin, tmax, radn, (tmin + tmax) / 2 AS tm, dayofyear(date) AS doy, 50e0 * (site + 1) AS alt, -0.75e0 + site * 0.1e0 AS lat, tmin - 1 AS tdew, 1 + pet / 2 AS wind FROM weather),
b AS (SELECT *, 101.3e0 * pow((293 - 0.0065e0 * alt) / 293, 5.26e0) AS pr, 0.6108e0 * exp(17.27e0 * tmin / (tmin + 237.3e0)) AS s1, 0.6108e0 * exp(17.27e0 * tmax / (tmax + 237.3e0)) AS s2, 0.6108e0 * exp(17.27e0 * tdew / (tdew + 237.3e0)) AS avp,
  0.409e0 * sin(2 * pi() / 365 * doy - 1.39e0) AS dec, 1 + 0.033e0 * cos(2 * pi() / 365 * doy) AS ird, wind * 4.87e0 / ln(67.8e0 * 10 - 5.42e0) AS w2, 4098 * (0.6108e0 * exp(17.27e0 * tm / (tm + 237.3e0))) / pow(tm + 237.3e0, 2) AS ds FROM a),
c AS (SELECT *, acos(least(greatest(-tan(lat) * tan(dec), -1e0), 1e0)) AS sha FROM b),
d AS (SELECT *, 24 * 60 / pi() * 0.082e0 * ird * (sha * sin(lat) * sin(dec) + cos(lat) * cos(dec) * sin(sha)) AS ra FROM c),
e AS (SELECT *, (0.00002e0 * alt + 0.75e0) * ra AS cs FROM d),
f AS (SELECT *, 0.77e0 * radn - 0.000000004903e0 * ((pow(tmax + 273.16e0, 4) + pow(tmin + 273.16e0, 4)) / 2) * (0.34e0 - 0.14e0 * sqrt(avp)) * (1.35e0 * (radn / cs) - 0.35e0) AS rn FROM e)
SELECT site, CAST(date AS VARCHAR) AS date, round(pr, 6) AS pressure, round(ra, 6) AS et_rad, round(24 / pi() * sha, 6) AS daylight, round(rn, 6) AS net_rad, round(0.0023e0 * (tm + 17.8e0) * sqrt(tmax - tmin) * 0.408e0 * ra, 6) AS et_hargreaves,
 round((0.408e0 * rn * ds + 900 * w2 / (tm + 273) * ((s1 + s2) / 2 - avp) * (0.000665e0 * pr)) / (ds + 0.000665e0 * pr * (1 + 0.34e0 * w2)), 6) AS et_fao56 FROM f""")
def _(t):
    c = F.col
    x = t.weather.withColumns({"doy": F.dayofyear("date"), "altitude": 50.0 * (c("site") + 1), "latitude": -0.75 + c("site") * 0.1, "tdew": c("tmin") - 1, "twet": c("tmin"),
                               "rh_min": F.lit(40.0), "rh_max": F.lit(90.0), "wind": 1 + c("pet") / 2, "wind_height": F.lit(10.0), "sunshine_hours": F.lit(6.0),
                               "t_month_prev": c("tmin"), "t_month_next": c("tmax")})
    return rounded(text_date(E.reference_et(x).select("site", "date", "pressure", "et_rad", "daylight", "net_rad", "et_hargreaves", "et_fao56"), "date"))


@query("f8_restriction_from_flow", with_("flow") + "SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN flow >= 63 THEN 0e0 WHEN flow <= 41 THEN 1e0 ELSE (flow * 501.86e0 - 20576) / 1000 / 11.041e0 END, 6) AS f_rest FROM flow")
def _(t):
    return rounded(text_date(P.apply_rule(t.flow, "flow", S.restriction_from_flow, "f_rest").select("date", "f_rest"), "date"))


@query("f9_state_key", with_("stories") + """SELECT story_id, month, temp_class || '-' || precip_class AS state, split_part(temp_class || '-' || precip_class, '-', 2) AS precip, printf('m%02d-%s', month, CASE precip_class WHEN 'D' THEN 'D' ELSE 'ND' END) AS key FROM stories""")
def _(t):
    state = S.state_key(F.col("temp_class"), F.col("precip_class"))
    return t.story_months.select("story_id", "month", state.alias("state"), F.split_part(state, F.lit("-"), F.lit(2)).alias("precip"), S.month_state_key(F.col("month"), F.col("precip_class")).alias("key"))


@query("f10_month_name", "SELECT o_orderkey, strftime(o_orderdate, '%b') AS name, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def _(t):
    name = D.month_name(F.month("o_orderdate"))
    return t.table("orders").select("o_orderkey", name.alias("name"), D.month_number(name).alias("month"))


@query("f11_shift_years", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + to_years(CAST(o_orderkey % 4 AS INTEGER)) AS DATE) AS VARCHAR) AS date FROM orders")
def _(t):
    return t.table("orders").select("o_orderkey", D.shift_years(F.to_date("o_orderdate"), F.col("o_orderkey") % 4).cast("string").alias("date"))


@query("f12_columns_containing", "SELECT l_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS l_shipdate FROM lineitem")
def _(t):
    x = t.table("lineitem").withColumn("l_shipdate", F.to_date("l_shipdate").cast("string"))
    return x.select(*P.columns_containing(x.select("l_orderkey", "l_linenumber", "l_shipdate", "l_tax", "l_discount"), "order", "line", "ship"))


@query("f13_water_temp", with_("weather") + """, m AS (SELECT site, regr_slope(tmin, tmax) AS s, regr_intercept(tmin, tmax) AS i FROM weather GROUP BY 1)
SELECT w.site, CAST(date AS VARCHAR) AS date, round(tmax * s + i, 6) AS water FROM weather w JOIN m ON m.site = w.site""")
def _(t):
    fit = M.linear_fit(t.weather, "tmax", "tmin", ["site"])
    return rounded(text_date(t.weather.join(fit, "site").select("site", "date", S.water_temp(F.col("tmax"), F.col("slope"), F.col("intercept")).alias("water")), "date"))


@query("f14_score", with_("flow") + """SELECT CAST(date AS VARCHAR) AS date, round_even(((flow - 40) / (90e0 - 40) * 2 - 1) * 3 * 2, 0) / 2 AS high, round_even(((flow - 40) / (90e0 - 40) * 2 - 1) * -3 * 2, 0) / 2 AS low, 0e0 AS flat FROM flow""")
def _(t):
    v, a, z = F.col("flow"), F.lit(40.0), F.lit(90.0)
    x = t.flow.select("date", S.score(v, a, z, F.lit(True)).alias("high"), S.score(v, a, z, F.lit(False)).alias("low"), S.score(v, a, a, F.lit(True)).alias("flat"))
    return text_date(x, "date")


@query("f15_restriction_tolerance", "SELECT l_orderkey, l_linenumber, round(greatest(0.02e0, 0.1e0 * l_discount * 10), 6) AS tol FROM lineitem")
def _(t):
    return rounded(t.table("lineitem").select("l_orderkey", "l_linenumber", S.restriction_tolerance(F.col("l_discount") * 10).alias("tol")))


@query("f16_max_irrigation", with_("rest") + """SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN dayofyear(date) <= 121 OR dayofyear(date) >= 244 THEN 5 * (1 - f_rest) ELSE 0e0 END, 6) AS max_irr,
 CASE WHEN month(date) IN (12, 1, 2) THEN 0.75e0 ELSE 0.6e0 END AS irr_trig, CASE WHEN month(date) IN (12, 1, 2) THEN 0.9e0 ELSE 0.75e0 END AS irr_targ FROM rest""")
def _(t):
    m = F.month("date")
    x = t.rest.select("date", S.max_irrigation(F.col("f_rest"), F.dayofyear("date")).alias("max_irr"), S.irrigation_trigger(m).alias("irr_trig"), S.irrigation_target(m).alias("irr_targ"))
    return rounded(text_date(x, "date"))


# DuckDB has no erf either: a 400-step midpoint rule of the same integral gives seven digits
@query("f17_z_to_percentile", """WITH z AS (SELECT DISTINCT l_quantity AS q FROM lineitem),
i AS (SELECT q, (q - 25) / 8 AS z, sum(exp(-pow(((k + 0.5e0) / 2000) * (q - 25) / 8, 2) / 2)) / 2000 * (q - 25) / 8 / sqrt(2 * pi()) AS a FROM z, range(0, 2000) t(k) GROUP BY q)
SELECT q, round(0.5e0 + a, 5) AS p FROM i""")
def _(t):
    q = t.table("lineitem").select(F.col("l_quantity").alias("q")).distinct()
    return q.select("q", r(S.z_to_percentile((F.col("q") - 25) / 8), 5).alias("p"))
