"""The soil water bucket by composed functions of water, against a plain loop over the days."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshade.operators import folds as Q

SCHEMA = "site string, date date, rain double, pet double"


def loop(rain, pet, capacity=150.0, start=1.0, a=0.0073, p=1.0):
    w, out = capacity * start, []
    for r, e in zip(rain, pet):
        if w is None or r is None or e is None or math.isnan(r) or math.isnan(e):
            w = None
            out.append((None, None, None))
            continue
        used = min(e, a * e * w * p)
        filled = max(w + r - used, 0.0)
        w = min(filled, capacity)
        out.append((w - capacity, filled - w, used))
    return out


def frame(spark, site, rain, pet, first=dt.date(1998, 5, 3)):
    return spark.createDataFrame([(site, first + dt.timedelta(i), r, e) for i, (r, e) in enumerate(zip(rain, pet))], SCHEMA)


def got(df):
    return [(r["smd"], r["drain"], r["aet"]) for r in df.orderBy("date").collect()]


def close(x, y):
    return len(x) == len(y) and all((u is None) == (v is None) and (u is None or abs(u - v) < 1e-8) for s, t in zip(x, y) for u, v in zip(s, t))


def weather(seed, n, wet, top):
    rng = np.random.default_rng(seed)
    return (rng.exponential(8, n) * (rng.random(n) < wet)).tolist(), rng.uniform(0, top, n).tolist()


@pytest.mark.parametrize("wet, top, kwargs", [(0.3, 7, {}), (0.02, 9, {"start": 0.1}), (0.9, 2, {"start": 0.0}), (0.2, 12, {"capacity": 300.0, "start": 0.5}),
                                              (0.3, 400, {"start": 0.4}), (0.3, 6, {"a": 0.02, "p": 0.8}), (0.3, 6, {"a": 0.0})])
def test_many_years_equal_one_long_fold(spark, wet, top, kwargs):
    rain, pet = weather(7, 1500, wet, top)
    df = Q.soil_moisture_deficit(frame(spark, "a", rain, pet).repartition(5), ["site"], **kwargs)
    assert df.columns == ["site", "date", "rain", "pet", "smd", "drain", "aet"]
    assert close(got(df), loop(rain, pet, **kwargs))


def test_negative_demand_and_hand_made_days(spark):
    rain = [0.0, 200.0, 0.0, 0.0, 5.0] * 200
    pet = [-3.0, 0.0, 160.0, 500.0, 137.0] * 200
    for start in (0.0, 0.91, 1.0):
        assert close(got(Q.soil_moisture_deficit(frame(spark, "a", rain, pet), ["site"], start=start)), loop(rain, pet, start=start))


def test_composed_function_at_every_water(spark):
    rain, pet = weather(3, 90, 0.15, 30)
    days = frame(spark, "a", rain, pet).groupBy("site").agg(F.array_sort(F.collect_list(Q._day("date"))).alias("days"))
    waters = [150 * i / 60 for i in range(61)]
    row = days.select(Q.composed(F.col("days")).alias("f"), *[Q.evaluate(Q.composed(F.col("days")), F.lit(w)).alias(f"v{i}") for i, w in enumerate(waters)]).first()
    for i, w in enumerate(waters):
        assert row[f"v{i}"] == pytest.approx(loop(rain, pet, start=w / 150)[-1][0] + 150, abs=1e-8)
    xs = [k["x"] for k in row["f"]]
    assert xs == sorted(xs) and xs[0] == 0 and xs[-1] == 150


def test_missing_days_null_keys_and_empty_tables(spark):
    rain, pet = weather(5, 800, 0.3, 7)
    holes = list(rain)
    holes[500] = None
    nans = list(pet)
    nans[20] = float("nan")
    df = frame(spark, None, rain, pet).unionByName(frame(spark, "h", holes, pet)).unionByName(frame(spark, "n", rain, nans))
    out = Q.soil_moisture_deficit(df, ["site"])
    assert close(got(out.filter("site is null")), loop(rain, pet))
    assert close(got(out.filter("site = 'h'")), loop(holes, pet)) and close(got(out.filter("site = 'n'")), loop(rain, nans))
    assert Q.soil_moisture_deficit(df.limit(0), ["site"]).count() == 0 and Q.soil_moisture_deficit_monthly(df.limit(0), ["site"]).count() == 0
    assert Q.soil_moisture_deficit_monthly(df, ["site"]).filter("site = 'h' and smd is null").count() == 31 - (dt.date(1998, 5, 3) + dt.timedelta(500)).day + (
        1 if (dt.date(1998, 5, 3) + dt.timedelta(500)).month in (1, 3, 5, 7, 8, 10, 12) else 0)
    with pytest.raises(ValueError):
        Q.soil_moisture_deficit(df, ["site"], start=1.5)


def test_no_python_and_one_task_per_year(spark):
    rain, pet = weather(5, 800, 0.3, 7)
    plan = Q.soil_moisture_deficit(frame(spark, "a", rain, pet).repartition(2), ["site"])._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan
    assert "hashpartitioning(site" in plan and "_y" in plan
