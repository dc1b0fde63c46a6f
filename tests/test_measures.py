"""Neighbour information, Ward clusters, Student's t, correlation bands and month paths against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshade.functions import special as SP
from rainshade.operators import sampling as R
from rainshade.operators import statistics as M
from rainshade.operators import windows as W


def digamma(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, int(n)))


def pairwise_information(x, y, k=3):
    """First estimator of Kraskov and others by all pairs of rows."""
    def whole(v):
        v = np.asarray(v, float)
        return np.round((v - v.mean()) / v.std() * 2 ** 32).astype(np.int64) if v.std() > 0 else np.zeros(len(v), np.int64)
    x, y = whole(x), whole(y)
    dx, dy = abs(x[:, None] - x), abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, 2 ** 62)
    e = np.sort(d, axis=1)[:, k - 1][:, None]
    near = [np.where(e > 0, v < e, v == 0).sum(axis=1) for v in (dx, dy)]
    return max(0.0, digamma(len(x)) + digamma(k) - sum(np.mean([digamma(c) for c in v]) for v in near))


def test_neighbour_information(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    shapes = {"a": 400, "b": 250, None: 60, "tiny": 3, "four": 4}
    for g, n in shapes.items():
        x = rng.normal(size=n)
        y = x + rng.normal(size=n) * 0.4
        # ties, a dense heap beside far points, and a column without any spread
        tied = np.round(rng.exponential(size=n), 1)
        heap = np.where(rng.random(n) < 0.5, rng.normal(size=n) * 1e-7, rng.normal(size=n) * 50)
        rows += [(g, float(a), float(b), float(c), 1.0, float(d)) for a, b, c, d in zip(x, tied, heap, y)]
        for name, v in (("x", x), ("tied", tied), ("heap", heap), ("flat", np.ones(n))):
            want[(g, name)] = pairwise_information(v, y) if n > 3 else None
    rows += [("a", None, None, None, None, 1.0), ("a", 1.0, 1.0, 1.0, 1.0, None), ("b", float("nan"), float("nan"), float("nan"), float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, tied double, heap double, flat double, y double").repartition(4)
    got = {(r["g"], r["feature"]): r["mi"] for r in M.mutual_info_neighbours(df, ["x", "tied", "heap", "flat"], "y", ["g"]).collect()}
    assert set(got) == set(want)
    for key, v in want.items():
        assert got[key] is None if v is None else got[key] == pytest.approx(v, abs=1e-9), key
    assert M.mutual_info_neighbours(df.limit(0), ["x"], "y", ["g"]).count() == 0
    whole = M.mutual_info_neighbours(df.where("g = 'a'"), ["x"], "y").collect()
    assert [r["feature"] for r in whole] == ["x"] and whole[0]["mi"] == pytest.approx(want[("a", "x")])


def test_neighbours_meet_few_others(spark):
    # a heap of half the rows beside one far row in each direction: the far rows must not meet the heap many times
    rng = np.random.default_rng(2)
    points = [(int(v), int(w), 1) for v, w in rng.integers(0, 2 ** 20, (3000, 2))] + [(2 ** 45, 0, 1), (-2 ** 45, 5, 1), (7, 2 ** 40, 1)]
    df = spark.createDataFrame(points, "x long, y long, c long").groupBy("x", "y").agg(F.sum("c").alias("c"))
    got = {(r["x"], r["y"]): r["eps"] for r in M.neighbour_distances(df, [], 3).collect()}
    p = np.array(sorted(got))
    d = np.abs(p[:, None, :] - p[None]).max(axis=2)
    np.fill_diagonal(d, 2 ** 60)
    want = np.sort(d, axis=1)[:, 2]
    assert all(got[tuple(q)] == w for q, w in zip(p.tolist(), want.tolist()))
    plan = M.neighbour_distances(df, [], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("tile, size", [(20, 16), (300, 40)])
def test_neighbours_across_tiles_and_bins(spark, monkeypatch, tile, size):
    # tiles and bins of a few points, so that circles and ranges reach into others, also from tiles of fewer points than neighbours
    monkeypatch.setattr(M, "TILE", tile)
    monkeypatch.setattr(M, "BIN", size)
    monkeypatch.setattr(M, "LEAF", 8)
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g, n in {"a": 700, None: 150, "few": 2}.items():
        y = np.round(rng.normal(size=n), 2)
        shapes = {"x": y + rng.normal(size=n), "tied": np.where(rng.random(n) < 0.6, 1.0, rng.exponential(size=n).round(1)), "far": rng.normal(size=n) ** 9, "flat": np.ones(n)}
        rows += [(g, *map(float, v)) for v in zip(*shapes.values(), y)]
        for name, v in shapes.items():
            want[(g, name)] = pairwise_information(v, y) if n > 3 else None
    df = spark.createDataFrame(rows, "g string, x double, tied double, far double, flat double, y double").repartition(3)
    got = {(r["g"], r["feature"]): r["mi"] for r in M.mutual_info_neighbours(df, ["x", "tied", "far", "flat"], "y", ["g"]).collect()}
    assert set(got) == set(want)
    for key, v in want.items():
        assert got[key] is None if v is None else got[key] == pytest.approx(v, abs=1e-9), key


def test_points_of_neighbours_are_not_repeated(spark, monkeypatch):
    # a point is held a few times however many sizes of squares the plane has
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(3000, 2))], "x double, y double")
    points, grouped, plain = M._long_pairs(df, ["x"], "y", []), [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: grouped.append(self) or plain(self, *c))
    found = M.neighbour_distances(points, ["feature"], 3)
    monkeypatch.undo()
    assert found.count() == 3000 and grouped and max(g.count() for g in grouped) <= 3000


def plain_ward(x, k):
    """Labels by trying all pairs before every merge."""
    groups = [[i] for i in range(len(x))]
    centre, n = x.astype(float).copy(), np.ones(len(x))
    alive = np.ones(len(x), bool)
    while alive.sum() > k:
        c = (n[:, None] * n) / (n[:, None] + n) * ((centre[:, None] - centre[None]) ** 2).sum(axis=2)
        c[~alive] = c[:, ~alive] = np.inf
        np.fill_diagonal(c, np.inf)
        a, b = np.unravel_index(c.argmin(), c.shape)
        centre[a] = (n[a] * centre[a] + n[b] * centre[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
        groups[a] += groups[b]
    return {frozenset(g) for g, live in zip(groups, alive) if live}


def test_ward_equals_merging_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(60, 3)) + 4 * rng.normal(size=3) for _ in range(4)])
    for k in (1, 4, 9):
        labels = M.ward_labels(np.ones(len(x)), x, k)
        assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)} == plain_ward(x, k)
    sizes = [int((labels == c).sum()) for c in range(9)]
    assert sizes == sorted(sizes, reverse=True)
    # 260 rows, some equal; equal rows are one weighted point and stay together
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, pcs array<double>")
    got = M.hierarchical_clusters(df, 5)
    assert got.columns == ["id", "pcs", "cluster"]
    found = {r["id"]: r["cluster"] for r in got.collect()}
    every = np.concatenate([x, x[:20]])
    want = plain_ward(every, 5)
    ids = [i for i, _ in rows]
    assert {frozenset(i for i, d in enumerate(ids) if found[d] == c) for c in range(5)} == want
    assert M.condensed_share(df) == 0.0


def test_ward_over_condensed_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 2)) * 40
    x = np.concatenate([rng.normal(size=(200, 2)) + c for c in centres])
    df = spark.createDataFrame([(i, i // 200, v.tolist()) for i, v in enumerate(x)], "id long, own long, pcs array<double>")
    got = M.hierarchical_clusters(df, 4, max_leaves=60).groupBy("own", "cluster").count().collect()
    assert len(got) == 4 and {r["count"] for r in got} == {200}
    assert 0 < M.condensed_share(df, max_leaves=60) < 0.01


# two-sided probabilities from published tables of Student's t: t, degrees of freedom, p
KNOWN = [(12.706204736432095, 1, 0.05), (4.302652729911275, 2, 0.05), (2.228138851964939, 10, 0.05), (3.169272672616950, 10, 0.01), (2.042272456301238, 30, 0.05),
         (1.959966356810, 10 ** 6, 0.05), (0.0, 5, 1.0), (1.0, 1, 0.5), (-1.0, 1, 0.5), (2 ** 0.5, 2, 1 - 2 ** 0.5 / 2)]


def test_student_probabilities(spark):
    df = spark.createDataFrame([(t, n) for t, n, _ in KNOWN] + [(None, 3), (float("nan"), 3), (1.0, 0)], "t double, n int")
    got = [r["p"] for r in df.select(SP.student_t_p(F.col("t"), F.col("n")).alias("p")).collect()]
    for p, (t, n, want) in zip(got, KNOWN):
        assert p == pytest.approx(want, abs=1e-9), (t, n)
    assert got[-3:] == [None, None, None]
    # t = sqrt(n) tan(h) has p = 1 - 2 h / pi - sin(2 h) / pi for three degrees of freedom
    for h in (0.01, 0.5, 1.2, 1.57):
        t = math.sqrt(3) * math.tan(h)
        row = spark.range(1).select(SP.student_t_p(F.lit(t), F.lit(3)).alias("p")).first()
        assert row["p"] == pytest.approx(1 - (2 * h + math.sin(2 * h)) / math.pi, abs=1e-10)


def test_gamma_functions(spark):
    xs = [1e-3, 0.3, 0.5, 1.0, 2.0, 7.7, 40.0, 1e5, 1e9]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", SP.log_gamma(F.col("x")).alias("g"), SP.digamma(F.col("x")).alias("d")).collect()
    for r in rows:
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-12)
        h = 1e-4 * max(r["x"], 0.01)
        assert r["d"] == pytest.approx((math.lgamma(r["x"] + h) - math.lgamma(r["x"] - h)) / (2 * h), rel=1e-5, abs=1e-6)
    assert spark.range(1).select(SP.digamma(F.lit(1)).alias("d")).first()["d"] == pytest.approx(digamma(1), abs=1e-13)


def test_t_test_edges(spark):
    def run(a, b):
        df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
        return M.t_test(df, "v", "g", "a", "b").first()
    row = run([1, 2, 3, 4], [2, 4, 6, 9])
    # means 2.5 and 5.25, pooled variance (3 * 5 / 3 + 3 * 107 / 12) / 6; six degrees of freedom have a finite sum
    t = -2.75 / math.sqrt((5 + 26.75) / 6 / 2)
    h = math.atan(abs(t) / math.sqrt(6))
    p = 1 - math.sin(h) * (1 + math.cos(h) ** 2 / 2 + 3 / 8 * math.cos(h) ** 4)
    assert row["t"] == pytest.approx(t) and row["df"] == 6 and row["p"] == pytest.approx(p, abs=1e-12)
    same, apart = run([1, 1], [1, 1]), run([1, 1], [2, 2])
    assert same["t"] is None and same["p"] is None and apart["p"] == 0.0 and apart["t"] == -math.inf
    assert run([1], [2])["p"] is None


def test_correlation_bands(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for key in ("a", "b"):
        rs = []
        for _ in range(40):
            v = np.cumsum(rng.normal(size=30))
            rows.append((key, v.tolist()))
            rs.append([np.corrcoef(v[:30 - i], v[i:])[0, 1] for i in range(5)])
        rows += [(key, [2.5] * 30), (key, []), (key, None), (key, [1.0])]
        for i in range(5):
            for q in (0.05, 0.5, 0.95):
                want[(key, i, q)] = np.quantile([r[i] for r in rs], q)
    rows.append(("a", [1.0, None, float("nan")]))
    df = spark.createDataFrame(rows, "key string, v array<double>")
    got = {(r["key"], r["lag"], r["q"]): r["r"] for r in W.autocorrelation_bands(df, ["key"], "v", 5, (0.05, 0.5, 0.95)).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert W.autocorrelation_bands(df.limit(0), ["key"], "v", 5).count() == 0


def test_lag_correlations_are_not_interpreted_value_by_value(spark):
    df = spark.range(1000).select(F.lit("a").alias("key"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.sin(i * (F.col("id") + 1))).alias("v"))
    bands = W.autocorrelation_bands(df, ["key"], "v", 6, (0.5,))
    plan = bands._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
    v = np.sin(np.arange(1, 31) * np.arange(1, 1001)[:, None])
    want = [np.median([np.corrcoef(x[:30 - i], x[i:])[0, 1] for x in v]) for i in range(6)]
    assert [r["r"] for r in bands.orderBy("lag").collect()] == pytest.approx(want, abs=1e-9)


def test_paths_have_no_join(spark):
    rng = random.Random(1)
    states = ["A-A", "A-D", "H-D", "C-W"]
    rows = []
    for m in range(1, 13):
        for a in states:
            w = [rng.random() for _ in states]
            rows += [(m, a, b, x) for b, x in zip(states, w)]
    trans = spark.createDataFrame(rows, "month int, from_state string, to_state string, p double")
    sims = spark.range(20_000).withColumnRenamed("id", "sim")
    paths = R.markov_paths(sims, trans, seed=5, unique=False)
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
    p = {(m, a): {b: x for n, c, b, x in rows if n == m and c == a} for m, a, _, _ in rows}
    got = [r["states"] for r in paths.collect()]
    for i, m in enumerate((7, 8, 12)):
        at = (7, 8, 9, 10, 11, 12).index(m)
        frm = [s for s in got if s[at] == "A-A"]
        for b in states:
            share = p[(m, "A-A")][b] / sum(p[(m, "A-A")].values())
            assert abs(sum(s[at + 1] == b for s in frm) / len(frm) - share) < 4 * math.sqrt(share * (1 - share) / len(frm)) + 1e-9
    dead = trans.where("not (month = 9 and from_state = 'H-D')")
    with pytest.raises(Exception, match="no transition in its month"):
        R.markov_paths(sims, dead, seed=5, unique=False).collect()


def test_event_classes_read_the_weather_once(spark):
    from rainshade.plans import events as EV
    from rainshade.queries.base import Tables
    import os
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    df = EV.classify_months(Tables(spark, folder).weather)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan
    assert len(tracker.getJobIdsForGroup()) <= before + 1  # the schema of the file, and nothing else


def test_subclusters_compute_the_stories_once(spark):
    # what follows the features reads them: neither the choice of stories nor their classes are computed again for components, leaves and clusters
    from rainshade.plans import stories as ST
    rng = np.random.default_rng(5)
    stories = spark.createDataFrame([(i, m, *rng.choice(["W", "A", "D"], 1).tolist(), *rng.choice(["C", "A", "H"], 1).tolist(), float(rng.random()), "oxford", "irrigated", 100.0 if i < 60 else 10.0)
                                     for i in range(80) for m in range(1, 13)], "story_id long, month int, precip_class string, temp_class string, rest double, site string, mode string, pg double")
    probs = stories.select("story_id", F.lit(-2.0).alias("log10_prob")).distinct()
    bounds = spark.createDataFrame([("oxford", "irrigated", "yr1", 1000.0, None)], "site string, mode string, period string, low double, high double")
    out = ST.storyline_subclusters(stories, stories.select("story_id", "site", "mode", "month", "pg"), probs, bounds, None, 3)
    assert {r["story_id"] for r in out["clusters"].collect()} == set(range(60)) and sum(r["size"] for r in out["mass"].collect()) == 60
    assert "precip_class" not in out["clusters"]._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="empty"):
        ST.storyline_subclusters(stories, stories.select("story_id", "site", "mode", "month", "pg"), probs, bounds.withColumn("low", F.lit(1e9)), None, 3)
