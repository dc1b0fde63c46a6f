"""Refined quantiles, user aggregates, banner files in splits and draws by mode."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainshade.operators import aggregates as A
from rainshade.operators import sampling as R
from rainshade.operators import windows as W
from rainshade.sources import readers


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("ties", 0.0 if rng.random() < 0.6 else float(rng.normal())) for _ in range(20_000)]
    rows += [("narrow", float(v)) for v in rng.random(20_000) * 2e-4]
    rows += [("wide", float(v)) for v in np.exp(rng.normal(size=20_000) * 8) * rng.choice([-1, 1], 20_000)]
    rows += [("one", 5.0), ("nan", float("nan")), ("nan", None), ("few", -0.0), ("few", 0.0), ("few", 1.0)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(6).cache()


PROBS = [0.0, 0.01, 0.25, 0.5, 0.599, 0.75, 0.99, 1.0]


def test_refined_quantiles_are_exact(skewed):
    rows, df = skewed
    got = {(r["k"], r["q"]): r["value"] for r in A.quantiles(df, ["k"], "v", PROBS, refine=True).collect()}
    for k in ("ties", "narrow", "wide", "one", "few"):
        v = np.array([x for n, x in rows if n == k])
        for q in PROBS:
            assert got[(k, q)] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-15), (k, q)
    assert not any(k == "nan" for k, _ in got)
    plain = {(r["k"], r["q"]): r["value"] for r in A.quantiles(df, ["k"], "v", PROBS).collect()}
    assert plain == got
    assert A.quantiles(df.limit(0), ["k"], "v", PROBS, refine=True).count() == 0
    whole = A.quantiles(df.where("k = 'wide'"), [], "v", [0.5], refine=True).first()["value"]
    assert whole == pytest.approx(np.quantile([x for n, x in rows if n == "wide"], 0.5))


def test_other_rows_reach_no_exchange(skewed):
    rows, df = skewed

    def median(start, end, n):
        return (F.floor((n - 1) / 2) < end) & (F.ceil((n - 1) / 2) >= start)
    near = A.refined_counts(df, ["k"], "v", median)
    plan = near._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    # from the top: the last pass ends in two joins with broadcast tables over the scan, and rows are exchanged only above them
    joins = plan.index("BroadcastHashJoin")
    assert plan.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" in plan[:joins] and "Exchange hashpartitioning" not in plan[joins:]
    assert near.agg(F.count(F.lit(1))).first()[0] < len(rows) / 100


def test_many_small_keys_fall_back(spark, monkeypatch):
    monkeypatch.setattr(A, "resident", lambda table: (table, None))
    df = spark.createDataFrame([(i % 50, float(i * i % 97)) for i in range(500)], "k int, v double")
    got = {r["k"]: r["median"] for r in A.median_by(df, ["k"], "v", refine=True).collect()}
    assert got == {k: np.median([i * i % 97 for i in range(500) if i % 50 == k]) for k in range(50)}


def test_percentile_of_score_by_one_aggregation(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k in range(30) for v in rng.integers(0, 12, rng.integers(1, 9))] + [(99, float("nan")), (1, None), (100, 5.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    for t in (-1.0, 0.0, 5.0, 5.5, 11.0, 40.0):
        out = W.percentile_of_score(df, ["k"], "v", t)
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange") == 1 and "Window" not in plan
        for r in out.collect():
            v = np.sort([x for k, x in rows if k == r["k"] and x is not None and not math.isnan(x)])
            pct = ((v < t).sum() + (v <= t).sum() + (t in v)) * 50 / len(v)
            assert r["percentile"] == pytest.approx(pct) and r["error"] == pytest.approx(abs(t - np.quantile(v, pct / 100)), abs=1e-9), (r, t)


def test_user_aggregate(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.exponential(5, 400) + 0.1] + [("a", None), ("b", float("nan")), ("none", None), ("zero", 0.0), ("zero", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r["value"] for r in A.user_aggregate(df, ["k"], "v", A.GEOMETRIC_MEAN).collect()}
    for k in ("a", "b", None):
        v = [x for n, x in rows if n == k and x is not None and not math.isnan(x)]
        assert got[k] == pytest.approx(math.exp(np.mean(np.log(v))))
    assert got["none"] is None and got["zero"] is None
    # a mean without the upper and lower twentieth of a known range, from counts and sums of its parts: one pass
    def take(s, v):
        at = np.clip((v / 50 * 20).astype(int), 0, 19)
        return [a + b for a, b in zip(s, np.concatenate([np.bincount(at, minlength=20), np.bincount(at, weights=v, minlength=20)]).tolist())]
    trimmed = A.UserAggregate(lambda: [0.0] * 40, take, lambda a, b: [x + y for x, y in zip(a, b)], lambda s: sum(s[21:39]) / sum(s[1:19]) if sum(s[1:19]) else None)
    out = A.user_aggregate(df, [], "v", trimmed, "mean")
    v = np.array([x for _, x in rows if x is not None and not math.isnan(x)])
    assert out.columns == ["mean"] and out.first()["mean"] == pytest.approx(v[(v >= 2.5) & (v < 47.5)].mean())
    plan = A.user_aggregate(df, ["k"], "v", A.GEOMETRIC_MEAN)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") > plan.index("Exchange hashpartitioning(k")  # states, not values, are shuffled
    assert A.user_aggregate(df.limit(0), ["k"], "v", A.GEOMETRIC_MEAN).count() == 0


def test_banner_files_in_splits(spark, tmp_path):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])
    body = [f"{i},{i / 4}" for i in range(30_000)]
    (tmp_path / "big.csv").write_text("free text, with a comma\nsecond line\n\n,v\n" + "\n".join(body) + "\n")
    (tmp_path / "small.csv").write_text("a\r\nb\r\nc\r\n,v\r\n-1,0.5\r\n")
    (tmp_path / "short.csv").write_text("a\nb\n")
    (tmp_path / "empty.csv").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        df = readers.read_banner_csv(spark, str(tmp_path), schema, skip=3)
        assert df.rdd.getNumPartitions() > 10
        got = sorted(map(tuple, df.collect()))
        assert got == [(-1, 0.5)] + [(i, i / 4) for i in range(30_000)]
        long = tmp_path / "long"
        long.mkdir()
        (long / "x.csv").write_text("word " * 10_000 + "\nb\nc\n,v\n1,2\n")
        with pytest.raises(Exception, match="first split"):
            readers.read_banner_csv(spark, str(long), schema, skip=3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_draws_by_mode(spark):
    rows = [(s, "x", m, -float(s), -float(6 - s), float(s)) for s in range(1, 6) for m in ("dryland", "irrigated", "store400")]
    rows += [(9, "x", "dryland", None, 0.0, 9.0), (10, "x", "irrigated", 0.0, float("-inf"), 10.0)]
    suite = spark.createDataFrame(rows, "story_id long, site string, mode string, log10_prob_dryland double, log10_prob_irrigated double, pg double")
    draws = spark.range(3000).withColumnRenamed("id", "draw")
    got = R.nyear_suite_by_mode(draws, suite, 2, seed=4).collect()
    assert len(got) == 9000 and {r["mode"] for r in got} == {"dryland", "irrigated", "store400"}
    mean = {m: np.mean([r["pg"] for r in got if r["mode"] == m]) / 2 for m in ("dryland", "irrigated", "store400")}
    # dry draws favour story 1, the others story 5
    w = 10.0 ** -np.arange(1, 6)
    assert mean["dryland"] == pytest.approx((w * np.arange(1, 6)).sum() / w.sum(), abs=0.03)
    assert mean["irrigated"] == pytest.approx(6 - mean["dryland"], abs=0.05) and mean["store400"] == mean["irrigated"]
    assert all(r["log10_prob_irrigated"] == pytest.approx(-12 - r["log10_prob_dryland"]) for r in got)
    assert R.nyear_suite_by_mode(draws, suite.limit(0), 2).count() == 0
