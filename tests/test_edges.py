"""Rows that must not vanish, checks that must not be pruned away, and hard distributions."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rainshade.operators import aggregates as A
from rainshade.operators import joins as J
from rainshade.operators import ranking as T
from rainshade.operators import sampling as R
from rainshade.operators import shape as P
from rainshade.operators import windows as W
from rainshade.plans import events as EV
from rainshade.plans import river as RV
from rainshade.queries import base
from rainshade.sources import readers

NAN = float("nan")


def curve_of(spark, xs, ys, key="a"):
    return spark.createDataFrame([(key, float(x), float(y), i) for i, (x, y) in enumerate(zip(xs, ys))], "k string, cx double, cy double, row int")


def test_flat_curves_as_numpy_has_them(spark):
    xs, ys = [1e-8, 1e-8, 1e-8, 0.2, 0.2, 0.9], [0.01, 0.02, 0.6, 0.7, 0.8, 0.95]
    probe = [-1.0, 0.0, 1e-8, 0.1, 0.2, 0.5, 0.9, 2.0]
    df = spark.createDataFrame([("a", x) for x in probe] + [("a", None), ("a", NAN)], "k string, x double")
    got = J.interp_join(df, "x", curve_of(spark, xs, ys), "cx", "cy", "y", ["k"], extrapolate=False, order="row").collect()
    assert len(got) == len(probe) + 2
    by_x = {r["x"]: r["y"] for r in got if r["x"] is not None and not np.isnan(r["x"])}
    assert [by_x[x] for x in probe] == pytest.approx(np.interp(probe, xs, ys))
    assert [r["y"] for r in got if r["x"] is None] == [None] and np.isnan([r["y"] for r in got if r["x"] is not None and np.isnan(r["x"])][0])


def test_one_knot_and_missing_keys(spark):
    one = curve_of(spark, [2.0], [5.0])
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "k string, x double")
    assert sorted(r["y"] for r in J.interp_join(df, "x", one, "cx", "cy", "y", ["k"], extrapolate=False).collect()) == [5.0, 5.0, 5.0]
    assert {r["x"]: r["y"] for r in J.interp_join(df, "x", one, "cx", "cy", "y", ["k"]).collect()} == {1.0: None, 2.0: 5.0, 3.0: None}
    stray = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, x double")
    with pytest.raises(Exception, match="no interval for"):
        J.interp_join(stray, "x", one, "cx", "cy", "y", ["k"], extrapolate=False).select("k").count()


def test_exceedance_at_a_flat_stretch(spark):
    curve = spark.createDataFrame([("s", 0.0, 1.0), ("s", 1.0, 0.5), ("s", 2.0, 0.5), ("s", 3.0, 0.0)], "site string, pg double, prob double")
    got = {r["prob"]: r["pg"] for r in A.exceedance_at(curve, ["site"], [0.75, 0.5, 0.25]).collect()}
    assert got == pytest.approx({0.75: 1.0, 0.5: 1.0, 0.25: 2.0})


def test_draws_when_a_few_items_hold_nearly_all_weight(spark):
    n = 20_000
    rng = np.random.default_rng(1)
    weight = np.where(np.arange(n) < 10, 1e6, rng.random(n))
    items = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weight)], "id long, w double")
    us = np.concatenate([rng.random(300), np.linspace(0.99, 0.9999999, 200)])
    draws = spark.createDataFrame([(float(u),) for u in us], "u double")
    table = J.cumulative_intervals(items, "w", "id")
    got = {r["u"]: r["id"] for r in J.inverse_cdf_join(draws, "u", items, "w", "id").collect()}
    bounds = sorted((r["_lo"], r["_hi"], r["id"]) for r in table.collect())
    lows = np.array([b[0] for b in bounds])
    assert len(got) == len(set(us)) and all(got[u] == bounds[int(np.searchsorted(lows, u, "right")) - 1][2] for u in us)


@pytest.mark.parametrize("values", [np.random.default_rng(2).random(3000) * 2e-4, 101_325 + np.random.default_rng(3).random(3000) * 20,
                                    np.where(np.random.default_rng(4).random(3000) < 0.6, 0.0, np.random.default_rng(5).normal(size=3000))])
def test_quantiles_of_narrow_and_tied_values(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["q"]: r["value"] for r in A.quantiles(df, ["k"], "v", probs).collect()}
    assert [got[q] for q in probs] == pytest.approx(np.quantile(values, probs), rel=1e-12)
    rows = W.flow_duration(df, ["k"], "v").orderBy("order").collect()
    assert [r["v"] for r in rows] == sorted(values.tolist())


def test_values_that_lie_close_share_no_part(spark):
    # the parts of one bin split what the bins cannot
    df = spark.createDataFrame([("a", 101_325 + i * 1e-3) for i in range(4000)], "k string, v double")
    assert df.select(A.value_bin(F.col("v"))).distinct().count() <= 2
    plan = A.ranked_counts(df, ["k"], "v")
    assert plan.count() == 4000 and plan.filter("_hi - _lo <> 1").count() == 0


def test_half_a_year_is_not_scored(spark):
    days = spark.sql("SELECT explode(sequence(date'2000-07-01', date'2000-12-31', interval 1 day)) AS date").selectExpr("'s' AS scenario", "date", "50.0D AS flow", "12.0D AS temp")
    with pytest.raises(Exception, match="365 or 366"):
        RV.eco_scores(RV.hydro_year_stats(days)).select("score").collect()


def test_simulations_and_months_without_a_record_fail(spark):
    arrays = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "key string, record array<double>")
    sims = spark.createDataFrame([(1, "a"), (2, "b")], "sim long, key string")
    with pytest.raises(Exception, match="no record for"):
        R.moving_block_bootstrap(arrays, sims, "single", 2, 4).count()
    stories = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b")], "story_id long, seq int, month int, key string")
    pools = spark.createDataFrame([("a", 0, 1, [0.5] * 31)], "key string, member long, n long, values array<double>")
    with pytest.raises(Exception, match="no simulations for"):
        R.stitch_months(stories, pools, 1, dry_months=()).count()


def test_too_few_simulations_fail_in_any_selection(spark):
    sims = spark.createDataFrame([(i, "a", float(i)) for i in range(3)], "sim long, key string, mean double")
    asked = spark.createDataFrame([(1, "a", 50, 1.0, 1.5)], "request long, key string, n int, target double, tol double")
    with pytest.raises(Exception, match="too few unique"):
        R.pull_sims(sims, asked, under_level="raise").select("sim").collect()


def test_first_step_with_many_ends(spark):
    ends = 1500
    table = spark.createDataFrame([(7, "s", f"e{i:04d}", 1.0 / ends) for i in range(ends)], "month int, from_state string, to_state string, p double")
    got = R.markov_paths(spark.range(6000).withColumnRenamed("id", "sim"), table, "s", months=(7,), unique=False)
    assert got.select(F.col("states")[1]).distinct().count() > 1400
    with pytest.raises(ValueError, match="no transition"):
        R.markov_paths(spark.range(2).withColumnRenamed("id", "sim"), table, "t", months=(7,))


def test_bounds_that_ask_nothing(spark):
    df = spark.createDataFrame([(1, "x", "m", "yr1", 5.0), (2, "x", "m", "yr1", None)], "story_id long, site string, mode string, period string, value double")
    schema = "site string, mode string, period string, low double, high double"
    none = spark.createDataFrame([("x", "m", "yr1", None, None)], schema)
    assert {r["story_id"] for r in P.bounded_suite(df, none).collect()} == {1, 2}
    assert {r["story_id"] for r in P.bounded_suite(df, spark.createDataFrame([], schema)).collect()} == {1, 2}
    assert {r["story_id"] for r in P.bounded_suite(df, spark.createDataFrame([("x", "m", "yr1", 1.0, None)], schema)).collect()} == {1}


def test_story_ids_rise_with_the_order(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 3).alias("k")).repartition(7)
    ids = [r["ID"] for r in W.story_ids(df, "k").orderBy("k").collect()]
    assert ids == [f"mrsl-{i:06d}" for i in range(len(ids))]
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)], "k string")
    assert [r["ID"] for r in W.story_ids(names, "k", blocks=8).orderBy("k").collect()] == [f"mrsl-{i:06d}" for i in range(50)]


def test_spread_extremes_of_named_groups(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in (("a", (1, 1)), ("b", (0, 10)), ("c", (0, 10)), ("d", (0, 6))) for v in vs], "g string, v double")
    got = T.spread_extremes(df, "g", "v").first()
    assert (got["least"], got["greatest"], got["middle"]) == ("a", "b", "d")


def test_story_files_by_name(spark, tmp_path):
    (tmp_path / "rsl-000001good.csv").write_text("date,precip_class,temp_class,rest,year,month,rest_per\n2024-07-01,A,C,0,2024,7,0.5\n")
    (tmp_path / "rsl-000002bad.csv").write_text(",date,precip_class,temp_class,rest,rest_per,year,month,precip_class_prev\n0,2025-07-01,A,H,0.25,,2025,7,A\n")
    got = {r["story_id"]: (r["date"], r["temp_class"], r["rest"], r["year"], r["month"], r["rest_per"], r["irr_type"]) for r in readers.read_story_dir(spark, str(tmp_path)).collect()}
    assert got == {"rsl-000001good": ("2024-07-01", "C", 0.0, 2024, 7, 0.5, "good"), "rsl-000002bad": ("2025-07-01", "H", 0.25, 2025, 7, None, "bad")}
    (tmp_path / "rsl-000003.csv").write_text("date,rest\n2024-07-01,1\n")
    with pytest.raises(Exception, match="no column"):
        readers.read_story_dir(spark, str(tmp_path)).collect()


def test_scratch_needs_a_shared_folder(spark):
    class Unset:
        class conf:
            get = staticmethod(lambda name, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        base.scratch(Unset)
    assert base.scratch(spark).startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_published_rain_limits():
    limits = EV.rolling_rain_limits()
    assert set(limits) == {"first", "first-3", "first-5", "first-7", "first-10", "zero", "one"}
    assert limits["first-10"] == {4: 5, 5: 0, 8: -5, 9: 0} and limits["one"] == {4: 1, 5: 1, 8: 1, 9: 1}
