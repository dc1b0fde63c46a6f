"""Operators against brute force on small fixtures, with hot groups, ties and edges."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshade import constants as C
from rainshade.functions import calendar as D
from rainshade.functions import draws as U
from rainshade.functions import evaporation as E
from rainshade.functions import scalars as S
from rainshade.operators import aggregates as A
from rainshade.operators import folds as Q
from rainshade.operators import joins as J
from rainshade.operators import ranking as T
from rainshade.operators import sampling as R
from rainshade.operators import shape as P
from rainshade.operators import statistics as M
from rainshade.operators import windows as W
from rainshade.plans import growth as G
from rainshade.plans import river as RV
from rainshade.plans import stories as ST


def days(n, start=dt.date(2000, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


# ---- quantiles and joins --------------------------------------------------------------------------------

def test_quantiles_match_numpy_with_a_hot_key_and_hot_value(spark):
    rng = np.random.default_rng(1)
    data = {"hot": np.concatenate([rng.normal(size=3000), np.zeros(2000), rng.uniform(-1e6, 1e6, 500)]),
            "cold": rng.exponential(size=37), "one": np.array([4.25]), "two": np.array([-2.0, 9.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, v double").union(
        spark.createDataFrame([("cold", None), ("cold", float("nan"))], "k string, v double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["k"], r["q"]): r["value"] for r in A.quantiles(df, ["k"], "v", probs).collect()}
    assert len(got) == len(data) * len(probs)
    for k, v in data.items():
        for q in probs:
            assert got[k, q] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), (k, q)


def test_interval_lookups_match_numpy(spark):
    rng = np.random.default_rng(2)
    xs, ys = np.sort(rng.uniform(0, 10, 25)), rng.normal(size=25)
    curve = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "cx double, cy double")
    probe = np.concatenate([rng.uniform(-3, 13, 400), xs, [5.0] * 300])
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(probe)], "i int, x double")
    for cells in (1, 7, 1024):
        got = {r["i"]: r["y"] for r in J.interp_join(df, "x", curve, "cx", "cy", "y", extrapolate=False, cells=cells).collect()}
        want = np.interp(probe, xs, ys)
        assert len(got) == len(probe)
        assert all(got[i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(want))
    got = {r["i"]: r["y"] for r in J.interp_join(df, "x", curve, "cx", "cy", "y").collect()}
    left = ys[0] + (-1.0 - xs[0]) * (ys[1] - ys[0]) / (xs[1] - xs[0])
    one = J.interp_join(spark.createDataFrame([(1, -1.0)], "i int, x double"), "x", curve, "cx", "cy", "y").first()["y"]
    assert one == pytest.approx(left) and len(got) == len(probe)


def test_interval_join_without_a_resident_table(spark, monkeypatch):
    monkeypatch.setattr(J, "resident", lambda table, max_rows=0: (table, None))
    table = spark.createDataFrame([(float(i), float(i + 1), i) for i in range(50)], "lo double, hi double, n int")
    df = spark.range(2000).select((F.col("id") % 50 + 0.5).alias("x"), "id")
    out = J.interval_join(df, "x", table, "lo", "hi", cells=16).collect()
    assert len(out) == 2000 and all(r["n"] == int(r["x"]) for r in out)


def test_nearest_row_takes_the_first_row_on_ties(spark):
    keys = [4.0, 1.0, 2.0, 4.0, 8.0]
    table = spark.createDataFrame(list(enumerate(keys)), "row int, key double")
    probe = [-5.0, 1.5, 3.0, 6.0, 4.0, 100.0, 2.9, 3.1]
    df = spark.createDataFrame([(p,) for p in probe], "x double")
    got = {r["x"]: r["row"] for r in J.nearest_row(df, "x", table, "key", "row").collect()}
    assert got == {p: int(np.argmin(np.abs(np.array(keys) - p))) for p in probe}


def test_cdf_value_literal_weights(spark):
    cdf, bins = np.array([0.1, 0.35, 0.4, 0.8, 1.0]), np.array([1.0, 2.0, 4.0, 7.0, 11.0])

    def published(p):
        i = int(np.argmin(np.abs(cdf - p)))
        j = i + 1 if p > cdf[i] and i != len(cdf) - 1 else i - 1 if p < cdf[i] and i != 0 else i
        if i == j:
            return bins[i]
        return abs(cdf[i] - p) / abs(cdf[i] - cdf[j]) * bins[i] + abs(cdf[j] - p) / abs(cdf[i] - cdf[j]) * bins[j]
    ps = [0.0, 0.05, 0.1, 0.2, 0.3, 0.37, 0.5, 0.75, 0.9, 1.0]
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(cdf, bins)], "p double, x double")
    df = spark.createDataFrame([(p,) for p in ps], "u double")
    got = {r["u"]: r["v"] for r in J.cdf_value(df, "u", table, "p", "x", "v", literal_weights=True).collect()}
    assert all(got[p] == pytest.approx(published(p)) for p in ps)


def test_inverse_cdf_join_is_weighted_stable_and_complete(spark):
    items = spark.createDataFrame([(i, 1 / 3 if i == 0 else 2 / 3 / 299) for i in range(300)] + [(999, 0.0)], "id int, w double")
    draws = spark.range(9000).select("id", U.hash_uniform(5, F.col("id")).alias("u")).withColumnRenamed("id", "draw")
    a = {r["draw"]: r["id"] for r in J.inverse_cdf_join(draws, "u", items, "w", "id").collect()}
    b = {r["draw"]: r["id"] for r in J.inverse_cdf_join(draws.repartition(11), "u", items.repartition(5), "w", "id").collect()}
    assert a == b and len(a) == 9000 and 999 not in a.values()
    assert abs(Counter(a.values())[0] / 9000 - 1 / 3) < 0.02


def test_strict_lookup_fails_and_replace_keeps_the_key(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    table = spark.createDataFrame([(1, 10)], "k int, v int")
    assert {r["o"] for r in J.replace_lookup(df, table, "k", "v", "o").collect()} == {10, 2}
    with pytest.raises(Exception, match="no v for"):
        J.strict_lookup(df, table, ["k"], "v").collect()


def test_date_report_finds_missing_duplicate_and_extra(spark):
    ds = days(62)
    rows = [(d,) for d in ds if d != ds[5]] + [(ds[9],)]
    got = {(r["date"], r["problem"]) for r in J.date_report(spark.createDataFrame(rows, "date date"), leap=False).collect()}
    assert got == {(ds[5], "missing"), (ds[9], "duplicate"), (dt.date(2000, 2, 29), "extra")}


def test_circular_window(spark):
    df = spark.createDataFrame([(1,), (363,)], "doy int")
    got = {(r["doy"], r["target_doy"]) for r in J.circular_window_join(df).collect()}
    assert {t for d, t in got if d == 1} == {361, 362, 363, 364, 365, 1, 2, 3, 4, 5, 6}
    assert {t for d, t in got if d == 363} == {358, 359, 360, 361, 362, 363, 364, 365, 1, 2, 3}


# ---- scalars ---------------------------------------------------------------------------------------------

def test_erf_and_percentile(spark):
    zs = [-9.0, -6.4, -3.0, -2.0, -1.9999, -0.5, 0.0, 1e-8, 0.3, 1.99, 2.0, 2.01, 4.4, 7.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", S.erf(F.col("z")).alias("e"), S.z_to_percentile(F.col("z")).alias("p"))
    for r in df.collect():
        assert r["e"] == pytest.approx(math.erf(r["z"]), abs=1e-12)
        assert r["p"] == pytest.approx(0.5 * (math.erf(r["z"] / math.sqrt(2)) + 1), abs=1e-12)


def test_score_rounds_half_even_and_flips(spark):
    df = spark.createDataFrame([(5.0,), (0.0,), (10.0,), (7.5,)], "v double")
    got = df.select(S.score(F.col("v"), F.lit(0.0), F.lit(10.0), F.lit(True)).alias("h"), S.score(F.col("v"), F.lit(0.0), F.lit(10.0), F.lit(False)).alias("l"),
                    S.score(F.col("v"), F.lit(1.0), F.lit(1.0), F.lit(True)).alias("z")).collect()
    assert [r["h"] for r in got] == [0.0, -3.0, 3.0, 1.5]
    assert [r["l"] for r in got] == [0.0, 3.0, -3.0, -1.5]
    assert [r["z"] for r in got] == [0.0] * 4


def test_class_codes_and_keys(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (None,)], "c int")
    got = df.select(S.recode_temp(F.col("c")).alias("t"), S.recode_precip(F.col("c")).alias("p")).collect()
    assert [r["t"] for r in got] == ["C", "AT", "H", None] and [r["p"] for r in got] == ["W", "AP", "D", None]
    one = spark.range(1).select(S.combo_key(F.lit("W"), F.lit("D")).alias("k"), S.month_state_key(F.lit(3), F.lit("A")).alias("m"),
                                S.regime_index(F.lit("H"), F.lit("D")).alias("r")).first()
    assert (one["k"], one["m"], one["r"]) == ("ND-D", "m03-ND", 9)


def test_fao_textbook_values(spark):
    # Worked examples of the FAO-56 paper (altitude 1800 m; 20 S on 3 September; 30.1 C).
    r = spark.range(1).select(E.air_pressure(F.lit(1800.0)).alias("p"), E.saturation_vp(F.lit(24.5)).alias("svp"),
                              E.solar_declination(F.lit(246)).alias("dec"), E.inverse_sun_distance(F.lit(246)).alias("dr"),
                              E.wind_at_2m(F.lit(3.2), F.lit(10.0)).alias("u2")).first()
    assert r["p"] == pytest.approx(81.8, abs=0.05) and r["svp"] == pytest.approx(3.075, abs=0.005)
    assert r["dec"] == pytest.approx(0.120, abs=0.001) and r["dr"] == pytest.approx(0.985, abs=0.001) and r["u2"] == pytest.approx(2.4, abs=0.05)
    lat = F.lit(math.radians(-20))
    ra = spark.range(1).select(E.extraterrestrial_radiation(lat, F.lit(0.120), E.sunset_angle(lat, F.lit(0.120)), F.lit(0.985)).alias("ra")).first()["ra"]
    assert ra == pytest.approx(32.2, abs=0.1)


def test_calendar(spark):
    rows = [(dt.date(2024, 2, 29),), (dt.date(2024, 3, 1),), (dt.date(2023, 3, 1),), (dt.date(2024, 12, 31),), (dt.date(2024, 6, 30),), (dt.date(2024, 7, 1),)]
    df = spark.createDataFrame(rows, "d date")
    got = df.select("d", D.nonleap_doy(F.col("d")).alias("n"), D.water_year(F.col("d")).alias("s"), D.water_year(F.col("d"), "end").alias("e")).collect()
    assert [r["n"] for r in got][1:4] == [60, 60, 365]
    assert [(r["s"], r["e"]) for r in got][-2:] == [(2023, 2024), (2024, 2025)]
    assert D.drop_leap_day(df, "d").count() == 5


# ---- windows and folds -----------------------------------------------------------------------------------

def test_streaks_and_persistence(spark):
    dry = [True, True, False, False, False, True, False, True, True, True]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(dry)], "k int, t int, dry boolean")
    got = [r["streak"] for r in W.streak_index(df, ["k"], "t", "dry").orderBy("t").collect()]
    assert got == [0, 1, 0, 1, 2, 0, 0, 0, 1, 2]
    lengths = [(r["state"], r["length"]) for r in W.streak_lengths(df, ["k"], "t", "dry").orderBy("spell").collect()]
    assert lengths == [(True, 2), (False, 3), (True, 1), (False, 1)]
    p = {(r["dry"], r["streak"]): r["p"] for r in W.persistence_by_streak(W.streak_index(df, ["k"], "t", "dry"), ["k"], "dry").collect()}
    assert p == {(True, 0): pytest.approx(2 / 3), (False, 0): 0.5}


def test_soil_bucket_matches_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rain, pet = rng.exponential(4, 120) * (rng.random(120) < 0.4), rng.uniform(0, 7, 120)
    ds = days(120, dt.date(2001, 1, 10))
    df = spark.createDataFrame([("a", d, float(r), float(e)) for d, r, e in zip(ds, rain, pet)], "site string, date date, rain double, pet double")

    def loop(restart):
        w, out = None, []
        for d, r, e in zip(ds, rain, pet):
            if w is None or (restart and d.day == 1):
                w = 150 + C.MONTH_START_DEFICIT[d.month] if restart else 150.0
            a = min(e, 0.0073 * e * w)
            f = max(w + r - a, 0)
            w = min(f, 150.0)
            out.append((w - 150, f - w, a))
        return out
    for op, restart in ((Q.soil_moisture_deficit, False), (Q.soil_moisture_deficit_monthly, True)):
        got = [(r["smd"], r["drain"], r["aet"]) for r in op(df, ["site"]).orderBy("date").collect()]
        assert np.allclose(got, loop(restart), atol=1e-9)


def test_runs_break_at_month_edges_and_ignore_single_days(spark):
    ds = days(20, dt.date(2001, 1, 25))
    df = D.date_parts(spark.createDataFrame([(d, 1.0 if i not in (2, 4) else 0.0) for i, d in enumerate(ds)], "date date, v double"))
    spells = W.runs(df, [], "date", F.col("v") > 0, ["year", "month"]).orderBy("first").collect()
    assert [r["length"] for r in spells] == [2, 1, 2, 13]
    assert W.spell_counts(W.runs(df, [], "date", F.col("v") > 0, ["year", "month"]), ["month"], (7,), longer_than=1).where("month = 1").first()["lengths"] == [2, 2]


def test_flow_duration_average_ranks(spark):
    v = [3.0, 1.0, 1.0, 7.0, 5.0, 5.0, 5.0]
    got = W.flow_duration(spark.createDataFrame([(1, x) for x in v], "k int, v double"), ["k"], "v").orderBy("order").collect()
    ranks = [7, 5, 5, 5, 3, 1.5, 1.5]
    assert [r["exceedance"] for r in got] == pytest.approx([100 * x / 8 for x in ranks]) and [r["v"] for r in got] == sorted(v)


def test_rolling_nyears_fill_and_interpolation(spark):
    df = spark.createDataFrame([(1, y, float(y)) for y in range(1, 8)], "k int, year int, v double")
    assert [r["v_3yr"] for r in W.nyear_sequential(df, ["k"], "year", "v", 3).orderBy("year").collect()] == [6, 9, 12, 15, 18]
    assert [r["v_3yr"] for r in W.nyear_chunks(df, ["k"], "year", "v", 3).orderBy("chunk").collect()] == [6, 15]
    gaps = spark.createDataFrame([(1, i, x) for i, x in enumerate([None, 2.0, None, None, 8.0, None])], "k int, t int, v double")
    assert [r["v"] for r in W.interpolate_linear(gaps, ["k"], "t", "v").orderBy("t").collect()] == [None, 2, 4, 6, 8, None]
    assert [r["v"] for r in W.fill(gaps, ["k"], "t", "v", "bfill").orderBy("t").collect()] == [2, 2, 8, 8, 8, None]


def test_annual_to_daily(spark):
    a = spark.createDataFrame([(1971 + i, float(i * i)) for i in range(6)], "year int, v double")
    got = [r["v"] for r in W.annual_to_daily(a, "year", "v", 1971, 1976, 50).orderBy("day_no").collect()]
    want = np.interp(np.linspace(1972, 1976 - 1 / 365, 50), np.arange(1971, 1977) + 0.5, [i * i for i in range(6)])
    assert np.allclose(got, want)


def test_story_ids_are_dense(spark):
    ids = sorted(r["ID"] for r in W.story_ids(spark.range(500), "id").collect())
    assert ids == [f"mrsl-{i:06d}" for i in range(500)]


# ---- sampling --------------------------------------------------------------------------------------------

def test_uniforms(spark):
    df = spark.range(20000).select(U.hash_uniform(1, F.col("id")).alias("h"), U.md5_uniform(1, F.col("id")).alias("m"))
    r = df.agg(F.avg("h").alias("h"), F.avg("m").alias("m"), F.min("h").alias("a"), F.max("m").alias("z")).first()
    assert abs(r["h"] - 0.5) < 0.01 and abs(r["m"] - 0.5) < 0.01 and 0 <= r["a"] and r["z"] < 1


def test_block_bootstrap_blocks_are_consecutive(spark):
    arrays = spark.createDataFrame([("a", [float(i) for i in range(40)])], "key string, record array<double>")
    sims = spark.range(3000).select(F.lit("a").alias("key"), F.col("id").alias("sim"))
    rows = R.moving_block_bootstrap(arrays, sims, "single", 6, 20, seed=2).collect()
    starts = Counter()
    for r in rows:
        assert len(r["values"]) == 20
        for i in range(0, 20, 6):
            block = r["values"][i:i + 6]
            assert block == [block[0] + j for j in range(len(block))]
            starts[block[0]] += 1
    # the last legal start (34) is left out by default
    assert set(starts) <= set(range(34)) and len(starts) == 34
    with pytest.raises(Exception, match="longer than the record"):
        R.moving_block_bootstrap(arrays, sims, "single", 60, 20).collect()


def test_truncated_normal_block_sizes(spark):
    df = spark.range(40000).select(R.block_size("truncnormal", (7.0, 3.0, 2.0, 12.0), U.hash_uniform(4, F.col("id"))).alias("b"))
    got = {r["b"]: r["count"] / 40000 for r in df.groupBy("b").count().collect()}

    def cdf(x):
        return 0.5 * (1 + math.erf((x - 7) / 3 / math.sqrt(2)))
    total = cdf(12) - cdf(2)
    for b in range(2, 13):
        want = (cdf(min(b + 0.5, 12)) - cdf(max(b - 0.5, 2))) / total
        assert got[b] == pytest.approx(want, abs=0.01)
    assert {r["b"] for r in spark.range(200).select(R.block_size("list", [3, 9], U.hash_uniform(4, F.col("id"))).alias("b")).collect()} == {3, 9}


def test_pull_sims_picks_only_suitable_sims_even_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    stat = np.concatenate([np.zeros(700), rng.uniform(0, 1, 1300)])
    sims = spark.createDataFrame([("a", i, float(s)) for i, s in enumerate(stat)] + [("b", 1, 0.9)], "key string, sim long, mean double")
    req = spark.createDataFrame([(1, "a", 50, 0.0, 0.02), (2, "a", 400, 0.5, 0.1), (3, "a", 5, 0.0, 0.0), (4, "b", 2, 0.9, 0.01)],
                                "request int, key string, n int, target double, tol double")
    rows = R.pull_sims(sims, req, seed=6).collect()
    by = {}
    for r in rows:
        by.setdefault(r["request"], []).append(r)
    for i, target, tol, n in ((1, 0.0, 0.02, 50), (2, 0.5, 0.1, 400), (3, 0.0, 0.0, 5)):
        suitable = {j for j, s in enumerate(stat) if target - tol <= s <= target + tol}
        assert len(by[i]) == n and {r["sim"] for r in by[i]} <= suitable and by[i][0]["available"] == len(suitable)
    assert by[2][0]["short"] is (by[2][0]["available"] <= 0.9 * 400) and by[4][0]["short"] is True
    bounds = req.selectExpr("request", "key", "n", "target - tol as low", "target + tol as high")
    assert {(r["request"], r["draw"], r["sim"]) for r in R.pull_sims(sims, bounds, seed=6, selection="bounds").collect()} == {(r["request"], r["draw"], r["sim"]) for r in rows}
    everyone = R.pull_sims(sims, req.where("request = 2"), seed=6, selection="any").first()
    assert everyone["available"] == 2000
    with pytest.raises(Exception, match="no simulations"):
        R.pull_sims(sims, spark.createDataFrame([(9, "a", 5, 3.0, 0.1)], req.schema)).collect()
    with pytest.raises(Exception, match="too few"):
        R.pull_sims(sims, req.where("request = 4"), under_level="raise").collect()


def test_sample_without_replacement(spark):
    got = R.sample_without_replacement(spark.range(100), 30, "id", seed=2)
    assert got.distinct().count() == 30
    with pytest.raises(ValueError):
        R.sample_without_replacement(spark.range(10), 30, "id")


# ---- statistics ------------------------------------------------------------------------------------------

def test_detrend_matches_least_squares(spark):
    n = 900
    rng = np.random.default_rng(7)
    d, t = np.arange(n, dtype=float), np.linspace(0, 1.3, n) + 0.05 * np.sin(np.arange(n) / 40)
    y = np.abs(2 + 0.8 * t + np.sin(2 * np.pi * d / 365.25) + 0.3 * rng.normal(size=n))
    y[::7] = 0
    df = spark.createDataFrame([("s", int(a), float(b), float(c)) for a, b, c in zip(d, t, y)], "site string, day long, t double, v double")
    use = y != 0
    x = np.column_stack([np.ones(n), t] + [f(2 * np.pi * k * d / 365.25) for k in (1, 2, 3) for f in (np.sin, np.cos)])[use]
    coef = np.linalg.lstsq(x, y[use], rcond=None)[0]
    want = y.copy()
    want[use] = np.abs(y[use] + coef[1] * (t[use][-1] - t[use]))
    got = [r["v"] for r in M.detrend_harmonic(df, ["site"], "v", "t", "day").orderBy("day").collect()]
    assert np.allclose(got, want, atol=1e-7)
    capped = [r["v"] for r in M.detrend_harmonic(df, ["site"], "v", "t", "day", cap=1.0).collect()]
    assert max(capped) == 1.0


def test_pca_and_clusters(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9]])
    x = np.concatenate([c + rng.normal(scale=0.3, size=(40, 3)) for c in centres])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    comps, explained = M.pca(df, ["a", "b", "c"], 3)
    var = np.linalg.svd(x - x.mean(0))[1] ** 2
    assert [r["ratio"] for r in explained.orderBy("component").collect()] == pytest.approx((var / var.sum()).tolist())
    for clusters in (M.kmeans(comps, 4), M.hierarchical_clusters(comps, 4)):
        label = {r["id"]: r["cluster"] for r in clusters.collect()}
        groups = [{label[i] for i in range(40 * g, 40 * g + 40)} for g in range(4)]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


def test_lag_model_matches_numpy(spark):
    rng = np.random.default_rng(9)
    n = 300
    z = np.zeros((n, 2))
    for i in range(1, n):
        z[i] = 0.6 * z[i - 1] + rng.normal(size=2)
    ds = days(n)
    df = spark.createDataFrame([("s", d, float(a), float(b)) for d, (a, b) in zip(ds, z)], "site string, date date, u double, v double")
    got = M.lag_correlation_matrices(W.last_day_flag(df, ["site"]), ["site"], "date", ["u", "v"]).first()
    keep = [i for i in range(n - 1) if ds[i].month == ds[i + 1].month]
    m0 = np.corrcoef(z.T)
    m1 = np.array([[np.corrcoef(z[[i + 1 for i in keep], r], z[keep, c])[0, 1] for c in range(2)] for r in range(2)])
    a = m1 @ np.linalg.inv(m0)
    assert np.allclose(got["m1"], m1.ravel()) and np.allclose(got["a"], a.ravel())
    assert np.allclose(got["b"], np.linalg.cholesky(m0 - a @ m1.T).ravel())


# ---- curves, rules and plans -----------------------------------------------------------------------------

def test_exceedance_is_monotone_and_inverts(spark):
    rng = np.random.default_rng(10)
    v = rng.gamma(9, 1.2, 4000)
    df = spark.createDataFrame([("s", float(x)) for x in v], "k string, v double")
    curve = A.exceedance_curve(df, ["k"], "v", 0.1)
    rows = curve.orderBy("bin").collect()
    probs = [r["prob"] for r in rows]
    assert probs[0] == pytest.approx(1.0) and all(a >= b - 1e-12 for a, b in zip(probs, probs[1:]))
    for r in rows[::9]:
        assert r["prob"] == pytest.approx((v >= r["pg"] - 0.025).mean(), abs=1e-9)
    at = A.exceedance_at(curve.drop("bin"), ["k"], [0.1, 0.5, 0.9]).collect()
    assert all(abs((v >= r["pg"]).mean() - r["prob"]) < 0.02 for r in at)
    with pytest.raises(Exception, match="outside the curve"):
        A.exceedance_at(curve.where("prob > 0.5").drop("bin"), ["k"], [0.1]).collect()


def test_restriction_cdf_loses_exact_edges(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 0.1, 0.25, 0.3, 0.6, 0.9, 1.0)] + [("b", 0.5)], "k string, v double")
    got = {(r["k"], r["i"]): r["share"] for r in A.restriction_cdf(df, ["k"], "v").collect()}
    assert [got["a", i] for i in range(7)] == pytest.approx([1, 5 / 6, 4 / 6, 3 / 6, 2 / 6, 1 / 6, 0])
    assert [got["b", i] for i in range(7)] == [0] * 7


def test_bounds_and_states(spark):
    rows = [(s, "oxford", "irrigated", p, v) for s, p, v in ((1, "yr1", 10.0), (1, "m01", 2.0), (2, "yr1", 10.0), (2, "m01", 9.0), (3, "yr1", None), (3, "m01", 2.0))]
    df = spark.createDataFrame(rows, "story_id int, site string, mode string, period string, value double")
    b = spark.createDataFrame([("oxford", "irrigated", "yr1", 10.0, None), ("oxford", "irrigated", "m01", None, 2.0)], "site string, mode string, period string, low double, high double")
    kept = P.bounded_suite(df, b)
    assert [r["story_id"] for r in kept.collect()] == [1]
    with pytest.raises(ValueError):
        P.require_rows(kept.where("story_id = 5"))


def test_scenario_tolerance_floor(spark):
    df = spark.createDataFrame([("oxford", "irrigated", 1, 1000.0), ("oxford", "irrigated", 2, 20.0), ("oxford", "irrigated", 7, 9.0), ("oxford", "dryland", 1, 5.0)],
                               "site string, mode string, month int, pg double")
    got = {r["period"]: (r["low"], r["high"]) for r in ST.scenario_limits(df, 0.1).collect()}
    assert got == {"m01": (900.0, 1100.0), "m02": (-280.0, 320.0)}


def test_regime_rules_and_hydro_years(spark):
    df = D.date_parts(spark.createDataFrame([(dt.date(2000, 1, 5), 50.0, 0.0), (dt.date(2000, 7, 5), 50.0, 0.0), (dt.date(2000, 1, 6), 70.0, 0.0), (dt.date(2000, 1, 7), 30.0, 0.0)],
                                            "date date, flow double, take double"))
    got = {(r["date"].isoformat(), r["regime"]): r["f_rest"] for r in RV.restriction_scenario(RV.naturalise_flow(df)).collect()}
    assert got["2000-01-05", "current"] == pytest.approx(1 - 9 / 41) and got["2000-07-05", "current"] == 1.0
    assert got["2000-01-06", "current"] == 0.0 and got["2000-01-07", "farmer_both"] == 1.0
    short = spark.createDataFrame([("a", d, 60.0, 10.0) for d in days(200, dt.date(2000, 7, 1))], "scenario string, date date, flow double, temp double")
    with pytest.raises(Exception, match="365 or 366"):
        RV.hydro_year_stats(short).collect()


def test_model_input_reports_a_missing_day(spark):
    ds = days(40)
    rows = [(d, d.year, d.timetuple().tm_yday, d.month, 1.0, 2.0, 3.0, 4.0, 5.0) for d in ds if d != ds[7]]
    weather = spark.createDataFrame(rows, "date date, year int, doy int, month int, radn double, tmin double, tmax double, rain double, pet double")
    rest = spark.createDataFrame([(d, 0.5) for d in ds], "date date, f_rest double")
    with pytest.raises(Exception, match="missing day"):
        G.model_input(weather, rest, "irrigated").collect()
    ok = G.model_input(weather.where(F.col("date") > ds[7]), rest, "irrigated").first()
    assert ok["max_irr"] == 2.5 and ok["irr_trig"] == 0.75
    with pytest.raises(ValueError):
        G.model_input(weather, rest, "dryland")


def test_harvest_calendar_moves_leap_day(spark):
    # the sixth day plus k x 15 days falls on 29 February 2000 when the series starts on 25 January
    df = spark.createDataFrame([(d,) for d in days(60, dt.date(2000, 1, 25))], "date date")
    hits = [r["date"].isoformat() for r in G.harvest_calendar(df, "irrigated", "oxford").where("harv_trig > 0").orderBy("date").collect()]
    assert hits == ["2000-01-30", "2000-02-14", "2000-02-28", "2000-03-15", "2000-03-24"]


def test_intersections_and_compare(spark):
    ev = spark.createDataFrame([(1, 2000, "hot"), (1, 2000, "dry"), (2, 2000, "hot"), (1, 2001, "dry")], "month int, year int, event string")
    assert [(r["month"], r["year"]) for r in T.intersect_months(ev, ["hot"], ["dry"]).collect()] == [(1, 2000)]
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "k int, v double")
    assert {r["k"]: r["v_changed"] for r in T.compare_tables(a, b, ["k"], ["v"]).collect()} == {1: False, 2: False, 3: True}


def test_task_functions_run_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle
    (tmp_path / "f.bin").write_bytes(cloudpickle.dumps((M._model_matrices, M._solve)))
    code = "import pickle, pandas as pd, numpy as np; m, s = pickle.load(open('f.bin', 'rb')); print(m(pd.Series([[2.0]]), pd.Series([[1.0]]))['a'][0], s(pd.Series([[1.0]]), pd.Series([[3.0]]))[0])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.returncode == 0 and "[0.5] [3.]" in out.stdout, out.stderr
