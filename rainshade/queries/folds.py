"""Ordered folds (Q1-Q3). The check SQL walks the days with a recursive query."""

from pyspark.sql import functions as F

from rainshade.constants import MONTH_START_DEFICIT
from rainshade.operators import folds as Q
from rainshade.queries.base import query, r, rounded, text_date, values_sql, with_

AET = "least(n.pet, 0.0073e0 * n.pet * {w})"
Q1 = """d AS (SELECT site, date, rain * 0.9997713e0 AS rain, pet * 1.0003171e0 AS pet, row_number() OVER (PARTITION BY site ORDER BY date) AS i FROM weather),
b(site, i, date, w, f, a) AS (SELECT site, CAST(0 AS BIGINT), CAST(NULL AS DATE), 150e0, 0e0, 0e0 FROM weather GROUP BY site
 UNION ALL SELECT n.site, n.i, n.date, least(greatest(b.w + n.rain - least(n.pet, 0.0073e0 * n.pet * b.w), 0e0), 150e0), greatest(b.w + n.rain - least(n.pet, 0.0073e0 * n.pet * b.w), 0e0), least(n.pet, 0.0073e0 * n.pet * b.w)
 FROM b JOIN d n ON n.site = b.site AND n.i = b.i + 1)"""


@query("q1_soil_moisture_deficit", with_("weather", extra=Q1, recursive=True) + "SELECT site, CAST(date AS VARCHAR) AS date, round(w - 150, 6) AS smd, round(f - w, 6) AS drain, round(a, 6) AS aet FROM b WHERE i > 0")
def _(t):
    return rounded(text_date(Q.soil_moisture_deficit(scaled(t), ["site"]).select("site", "date", "smd", "drain", "aet"), "date"))


def _monthly_sql(rain: str, pet: str) -> str:
    return f"""st AS (SELECT * FROM {values_sql([(m, float(v)) for m, v in MONTH_START_DEFICIT.items()], 'v(m, s)')}),
d AS (SELECT site, date, year(date) * 12 + month(date) AS ym, {rain} AS rain, {pet} AS pet, row_number() OVER (PARTITION BY site, year(date), month(date) ORDER BY date) AS i FROM weather),
b(site, ym, i, date, w, f, a) AS (SELECT DISTINCT site, d.ym, CAST(0 AS BIGINT), CAST(NULL AS DATE), 150 + s, 0e0, 0e0 FROM d JOIN st ON st.m = month(d.date)
 UNION ALL SELECT n.site, n.ym, n.i, n.date, least(greatest(b.w + n.rain - least(n.pet, 0.0073e0 * n.pet * b.w), 0e0), 150e0), greatest(b.w + n.rain - least(n.pet, 0.0073e0 * n.pet * b.w), 0e0), least(n.pet, 0.0073e0 * n.pet * b.w)
 FROM b JOIN d n ON n.site = b.site AND n.ym = b.ym AND n.i = b.i + 1),
smd AS (SELECT site, date, w - 150 AS smd, f - w AS drain, a AS aet FROM b WHERE i > 0)"""


Q2 = _monthly_sql("rain", "pet")
Q2_SCALED = _monthly_sql("rain * 0.9997713e0", "pet * 1.0003171e0")


def scaled(t):
    """Weather without short binary fractions, so that no result lies half way between two rounded values."""
    return t.weather.withColumns({"rain": F.col("rain") * 0.9997713, "pet": F.col("pet") * 1.0003171})


@query("q2_soil_moisture_monthly", with_("weather", extra=Q2_SCALED, recursive=True) + "SELECT site, CAST(date AS VARCHAR) AS date, round(smd, 6) AS smd, round(drain, 6) AS drain, round(aet, 6) AS aet FROM smd")
def _(t):
    return rounded(text_date(Q.soil_moisture_deficit_monthly(scaled(t), ["site"]).select("site", "date", "smd", "drain", "aet"), "date"))


NONLEAP = "dayofyear(date) - CASE WHEN dayofyear(last_day(make_date(year(date), 2, 1))) = 60 AND month(date) > 2 THEN 1 ELSE 0 END"


@query("q3_soil_moisture_anomaly", with_("weather", extra=Q2_SCALED, recursive=True) + f""", k AS (SELECT *, {NONLEAP} AS doy FROM smd), m AS (SELECT site, doy, avg(CASE WHEN year(date) BETWEEN 1996 AND 2000 THEN smd END) AS v FROM k GROUP BY 1, 2)
SELECT k.site, CAST(date AS VARCHAR) AS date, round(smd - v, 6) AS sma FROM k JOIN m ON m.site = k.site AND m.doy = k.doy""")
def _(t):
    smd = Q.soil_moisture_deficit_monthly(scaled(t), ["site"])
    return rounded(text_date(Q.soil_moisture_anomaly(smd, ["site"], years=(1996, 2000)).select("site", "date", "sma"), "date"))


@query("q3_ensemble_anomaly", with_("weather", extra=Q2_SCALED, recursive=True) + "SELECT site, CAST(date AS VARCHAR) AS date, round(smd - avg(smd) OVER (PARTITION BY date), 6) AS sma FROM smd")
def _(t):
    smd = Q.soil_moisture_deficit_monthly(scaled(t), ["site"])
    return rounded(text_date(Q.soil_moisture_anomaly(smd, ["site"], over="day").select("site", "date", "sma"), "date"))


@query("q3_doy_mean_table", with_("weather", extra=Q2_SCALED, recursive=True) + f"SELECT site, CAST({NONLEAP} AS INTEGER) AS doy, round(avg(smd), 6) AS smd FROM smd GROUP BY 1, 2")
def _(t):
    return rounded(Q.doy_mean_table(Q.soil_moisture_deficit_monthly(scaled(t), ["site"]), ["site"]))
