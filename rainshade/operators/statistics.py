"""Regression, components, clusters and information measures from grouped sums."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainshade.functions.special import digamma, student_t_p

YEAR_LENGTH = 365.25


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder of spark.checkpoint.dir and read it back, so that what follows reads it and does not compute it again."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{base.rstrip('/')}/rainshade-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def harmonic_features(t: Column, day: Column) -> list[Column]:
    """1, driver, and three pairs of sine and cosine of the year."""
    out = [F.lit(1.0), t]
    for k in (1, 2, 3):
        angle = 2 * math.pi * k / YEAR_LENGTH * day
        out += [F.sin(angle), F.cos(angle)]
    return out


DOUBLES = T.ArrayType(T.DoubleType())


def _solve(gram: pd.Series, rhs: pd.Series) -> pd.Series:
    def one(g, b):
        n = len(b)
        return np.linalg.lstsq(np.asarray(g, float).reshape(n, n), np.asarray(b, float), rcond=None)[0]
    return pd.Series([one(g, b) for g, b in zip(gram, rhs)])


def harmonic_fit(df: DataFrame, keys: Sequence[str], value: str, driver: str, day: str, exclude_zero: bool = True) -> DataFrame:
    """Least squares coefficients per key: sums of products (8 x 8) combine map-side, one small solve per key."""
    rows = df.where((F.col(value) != 0) & F.col(value).isNotNull()) if exclude_zero else df.where(F.col(value).isNotNull())
    x = harmonic_features(F.col(driver).cast("double"), F.col(day).cast("double"))
    named = rows.select(*keys, F.col(value).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(8) for j in range(8)]
    rhs = [F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(8)]
    total = named.groupBy(*keys).agg(F.array(*sums).alias("_g"), F.array(*rhs).alias("_b"))
    solve = F.pandas_udf(_solve, DOUBLES)
    return total.select(*keys, solve("_g", "_b").alias("coefficients"))


def detrend_harmonic(df: DataFrame, keys: Sequence[str], value: str, driver: str, day: str, exclude_zero: bool = True,
                     cap: float | None = None, out: str | None = None) -> DataFrame:
    """|y + line(last) - line(t)| with the driver's slope from the harmonic fit; zeros stay 0."""
    fit = harmonic_fit(df, keys, value, driver, day, exclude_zero)
    used = F.when(F.col(value) != 0, F.struct(day, driver)) if exclude_zero else F.struct(day, driver)
    last = df.groupBy(*keys).agg(F.max(used).getField(driver).alias("_end"))
    joined = df.join(fit.join(last, list(keys)), list(keys))
    moved = F.abs(F.col(value) + F.col("coefficients")[1] * (F.col("_end") - F.col(driver)))
    if cap is not None:
        moved = F.when(moved > cap, F.lit(float(cap))).otherwise(moved)
    result = F.when(F.col(value) == 0, 0.0).otherwise(moved) if exclude_zero else moved
    return joined.withColumn(out or value, result).drop("coefficients", "_end")


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares slope, intercept and R2 after dropping rows with a null, overall or per key."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                   F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def story_features(stories: DataFrame, story: str = "story_id") -> DataFrame:
    """36 numbers per story: rain class, temperature class and restriction of each month."""
    precip = F.when(F.col("precip_class") == "W", 0).when(F.col("precip_class") == "D", 2).otherwise(1)
    temp = F.when(F.col("temp_class") == "C", 0).when(F.col("temp_class") == "H", 2).otherwise(1)
    cells = {"p": precip, "t": temp, "r": F.col("rest")}
    aggs = [F.max(F.when(F.col("month") == m, c)).cast("double").alias(f"{n}{m:02d}") for n, c in cells.items() for m in range(1, 13)]
    return stories.groupBy(story).agg(*aggs).na.fill(0.0)


def pca(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Centred, unscaled components: (rows with an array `pcs`, explained variance ratio and its running sum)."""
    assembled = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(df).persist()
    # both fits read the assembled rows; later stages recompute them, nothing stays pinned
    centred = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False).fit(assembled).transform(assembled)
    model = PCA(k=min(k, len(columns)), inputCol="_centred", outputCol="_pcs").fit(centred)
    assembled.unpersist()
    ratio = [float(v) for v in model.explainedVariance]
    rows = [(i + 1, r, float(sum(ratio[:i + 1]))) for i, r in enumerate(ratio)]
    explained = df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")
    return model.transform(centred).withColumn("pcs", vector_to_array("_pcs")).drop("_raw", "_centred"), explained


def kmeans(components: DataFrame, k: int, n_pcs: int = 3, seed: int = 1) -> DataFrame:
    """k-means clusters on the first components."""
    vec = _component_vectors(components, n_pcs).persist()
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vec)
    vec.unpersist()
    return model.transform(vec).drop("_v")


def _component_vectors(components: DataFrame, n_pcs: int, offset: float = 0.0) -> DataFrame:
    cols = [f"_p{i}" for i in range(n_pcs)]
    wide = components.withColumns({c: F.col("pcs")[i] + offset for i, c in enumerate(cols)})
    return VectorAssembler(inputCols=cols, outputCol="_v").transform(wide).drop(*cols)


def kmeans_sweep(components: DataFrame, ks: Sequence[int] = range(5, 15), n_pcs: int = 3, seed: int = 1) -> DataFrame:
    """Training cost of each k; the assembled components are read once and kept for all fits."""
    vec = _component_vectors(components, n_pcs).select("_v").persist()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_v").fit(vec)
        rows.append((k, float(model.summary.trainingCost)))
    vec.unpersist()
    return components.sparkSession.createDataFrame(rows, "k int, cost double")


def bisecting_clusters(components: DataFrame, k: int, n_pcs: int = 15, seed: int = 1) -> DataFrame:
    """Divisive clusters on up to 15 components: linear in rows.

    Components are centred on 0, and Spark splits a cluster by a step proportional to its centre's length,
    so all are moved by the same constant first; distances do not change.
    """
    width = len(components.select("pcs").first()["pcs"])
    vec = _component_vectors(components, min(n_pcs, width), 1.0).persist()
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vec)
    vec.unpersist()
    return model.transform(vec).drop("_v")


MAX_LEAVES = 2000


def ward_tree(n: np.ndarray, centre: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (cost, a, b) of Ward's method over weighted points, cheapest first; a cluster goes by its smallest point. Quadratic in the points.

    The cost of a merge is the growth of the sum of squares, n_a n_b / (n_a + n_b) |c_a - c_b|^2; merged costs follow by Lance and Williams. A chain of nearest
    neighbours ends in a pair that are each other's nearest, which any order of merging would merge too.
    """
    m, weight = len(n), n.astype(float).copy()
    cost = np.empty((m, m))
    for i in range(m):
        cost[i] = weight[i] * weight / (weight[i] + weight) * ((centre - centre[i]) ** 2).sum(axis=1)
    np.fill_diagonal(cost, np.inf)
    alive, chain, merges = np.ones(m, bool), [], []
    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = cost[a]
            b = int(row.argmin())
            # of equal costs the one before in the chain, so that it ends
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        merges.append((float(cost[a, b]), min(a, b), max(a, b)))
        keep, gone = merges[-1][1:]
        others = alive.copy()
        others[[keep, gone]] = False
        w, wa, wb = weight[others], weight[keep], weight[gone]
        new = ((wa + w) * cost[keep, others] + (wb + w) * cost[gone, others] - w * cost[keep, gone]) / (wa + wb + w)
        cost[keep, others] = cost[others, keep] = new
        cost[gone, :] = cost[:, gone] = np.inf
        weight[keep], alive[gone] = wa + wb, False
    return sorted(merges, key=lambda x: x[0])


def ward_labels(n: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Cluster number of every weighted point after all but k - 1 merges; numbers follow falling weight, then the first coordinates of the centre."""
    up = np.arange(len(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)
    for _, a, b in ward_tree(n, centre)[:max(len(n) - k, 0)]:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    group = np.array([root(i) for i in range(len(n))])
    order = sorted(set(group.tolist()), key=lambda g: (-n[group == g].sum(), (n[group == g, None] * centre[group == g]).sum(axis=0).tolist()))
    number = {g: i for i, g in enumerate(order)}
    return np.array([number[g] for g in group.tolist()])


def hierarchical_clusters(components: DataFrame, k: int, n_pcs: int = 15, seed: int = 1, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """Ward's agglomerative clusters on up to 15 components: components with a `cluster`, 0 the largest.

    Up to max_leaves distinct rows the result is Ward's own. Beyond, rows are first condensed to cluster features (number, sum) of max_leaves k-means
    centres, combined map-side, and Ward's method merges those, weighted by their rows: rows of one feature stay together, and what that can cost is
    `condensed_share`, the share of the sum of squares that lies inside the features. The tree is made by one task of max_leaves rows at most.
    """
    width = min(n_pcs, len(components.select("pcs").first()["pcs"]))
    point = F.transform(F.slice("pcs", 1, width), lambda x: x + F.lit(0.0))
    rows = components.withColumn("_p", point)
    if components.select(point.alias("_p")).distinct().limit(max_leaves + 1).count() <= max_leaves:
        keyed = rows.withColumn("_leaf", F.to_json(F.struct("_p")))
    else:
        vec = _component_vectors(rows, width)
        leaf = KMeans(k=max_leaves, seed=seed, featuresCol="_v", predictionCol="_at", maxIter=10, initSteps=2).fit(vec).transform(vec)
        # read twice, for the features and for the result; a row is compared with max_leaves centres only once
        keyed = stored(leaf.withColumn("_leaf", F.col("_at").cast("string")).drop("_at", "_v"))
    features = keyed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("_p")[i]) for i in range(width)]).alias("centre"))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_leaf", ignore_index=True)
        return pd.DataFrame({"_leaf": pdf["_leaf"], "cluster": ward_labels(pdf["n"].to_numpy(), np.array(pdf["centre"].tolist()), k)})
    # at most max_leaves rows
    labels = features.groupBy().applyInPandas(tree, "_leaf string, cluster int")
    return keyed.join(F.broadcast(labels), "_leaf").drop("_leaf", "_p")


def condensed_share(components: DataFrame, n_pcs: int = 15, seed: int = 1, max_leaves: int = MAX_LEAVES) -> float:
    """Share of the sum of squares that hierarchical_clusters cannot split: 0 up to max_leaves distinct rows."""
    width = min(n_pcs, len(components.select("pcs").first()["pcs"]))
    if components.select(F.slice("pcs", 1, width)).distinct().limit(max_leaves + 1).count() <= max_leaves:
        return 0.0
    vec = _component_vectors(components, width)
    model = KMeans(k=max_leaves, seed=seed, featuresCol="_v", maxIter=10, initSteps=2).fit(vec)
    total = components.agg(*[(F.var_pop(F.col("pcs")[i]) * F.count(F.lit(1))).alias(f"v{i}") for i in range(width)]).first()
    return float(model.summary.trainingCost) / (sum(total) or 1.0)


def mutual_info_discrete(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (),
                         fold_negative: bool = False) -> DataFrame:
    """Mutual information in nats of each discrete feature with the target, overall or per key.

    Pair counts combine map-side; the rest works on the few distinct pairs.
    """
    def cell(c: str) -> Column:
        return F.when(F.col(c) < 0, 0).otherwise(F.col(c)) if fold_negative else F.col(c)
    long = df.select(*keys, cell(target).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), cell(f).cast("string").alias("x")) for f in features])).alias("_s"))
    pairs = (long.select(*keys, "_s.feature", "_s.x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
             .groupBy(*keys, "feature", "x", "y").agg(F.count(F.lit(1)).alias("_c")))
    g = [*keys, "feature"]
    n = F.sum("_c").over(Window.partitionBy(*g))
    cx = F.sum("_c").over(Window.partitionBy(*g, "x"))
    cy = F.sum("_c").over(Window.partitionBy(*g, "y"))
    term = F.col("_c") / n * F.log(F.col("_c") * n / (cx * cy))
    return pairs.withColumn("_t", term).groupBy(*g).agg(F.sum("_t").alias("mi"))


def mutual_info_continuous(df: DataFrame, features: Sequence[str], target: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Binned mutual information of continuous features with a discrete target."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("a", F.min), ("z", F.max))]).first()
    binned = {}
    for c in features:
        a, z = row[f"a_{c}"], row[f"z_{c}"]
        width = (z - a) / bins if a is not None and z > a else 1.0
        binned[c] = F.when(F.col(c).isNotNull(), F.least(F.floor((F.col(c) - F.lit(a)) / F.lit(width)), F.lit(bins - 1)))
    return mutual_info_discrete(df.withColumns(binned), features, target, keys)


NEIGHBOURS = 3
UNIT = 2 ** 32  # whole numbers to a standard deviation: differences and comparisons of them are exact


def _long_pairs(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, x, y, c): distinct pairs in units of each column's own standard deviation, with their number."""
    rows = df.select(*keys, F.col(target).cast("double").alias("_t"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("_s")).select(*keys, "_s.feature", "_s.v", "_t")
    rows = rows.where(F.col("v").isNotNull() & F.col("_t").isNotNull() & ~F.isnan("v") & ~F.isnan("_t"))
    group = [*keys, "feature"]
    sizes = rows.groupBy(*group).agg(F.stddev_pop("v").alias("_sv"), F.stddev_pop("_t").alias("_st"), F.avg("v").alias("_mv"), F.avg("_t").alias("_mt"))

    def whole(x: str, mean: str, spread: str) -> Column:
        return F.when(F.col(spread) > 0, F.round((F.col(x) - F.col(mean)) / F.col(spread) * UNIT)).otherwise(0.0).cast("long")
    scaled = null_safe_join(rows, sizes, group).select(*group, whole("v", "_mv", "_sv").alias("x"), whole("_t", "_mt", "_st").alias("y"))
    return scaled.groupBy(*group, "x", "y").agg(F.count(F.lit(1)).alias("c"))


def null_safe_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where a null equals a null; the columns come from a."""
    right = b.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in b.columns if c not in on])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)])
    return a.join(right, same, how).drop(*[f"_on{i}" for i in range(len(on))])


TILE = 2 ** 14  # points of a tile, about
LEAF = 64  # points that search together
BIN = 2 ** 17  # values of a bin, about
QUANTILES = 1024
FAR = 2 ** 62


def _cuts(df: DataFrame, group: Sequence[str], value: str, parts: Callable[[Column], Column], out: str) -> DataFrame:
    """(group, out): ascending approximate quantiles that cut a group's values in parts(number of rows); groups of one part have no row."""
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    n = F.least(F.ceil(parts(F.col("_n"))).cast("int"), F.lit(QUANTILES))
    found = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, shares).alias("_q")).withColumn("_p", n).where("_p > 1")
    steps = F.transform(F.sequence(F.lit(1), F.col("_p") - 1), lambda i: F.get("_q", F.floor(i * QUANTILES / F.col("_p")).cast("int") - 1))
    return stored(found.select(*group, F.array_distinct(steps).alias(out)))


def _placed(df: DataFrame, cuts: DataFrame, group: Sequence[str], value: str, by: str, out: str) -> DataFrame:
    """df with `out`: the number of its group's cuts that are not above the value."""
    # one row per group of several parts
    return null_safe_join(df, F.broadcast(cuts), group, "left").withColumn(out, F.coalesce(F.size(F.filter(by, lambda q: q <= F.col(value))), F.lit(0))).drop(by)


def _nearest(x: np.ndarray, y: np.ndarray, c: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int) -> np.ndarray:
    """Distances to the k nearest other points, c repeats each, one row per asking point; FAR where there are fewer. Points differ, so one at distance 0 is the asking one."""
    d = np.maximum(np.abs(x - qx[:, None]), np.abs(y - qy[:, None]))
    w = np.broadcast_to(c, d.shape)
    if d.shape[1] > k + 1:
        at = np.argpartition(d, k, axis=1)[:, :k + 1]
        d, w = np.take_along_axis(d, at, 1), c[at]
    order = np.argsort(d, axis=1)
    d = np.take_along_axis(d, order, 1)
    upto = np.cumsum(np.take_along_axis(w, order, 1) - (d == 0), axis=1)
    out = np.full((len(qx), k), FAR, np.int64)
    for j in range(k):
        has = upto[:, -1] > j
        out[has, j] = d[has, (upto[has] > j).argmax(axis=1)]
    return out


def _leaves(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Numbers of the points in runs of up to LEAF that lie close together."""
    n = len(x)
    strips = math.ceil(math.sqrt(n / LEAF))
    strip = np.empty(n, np.int64)
    strip[np.lexsort((y, x))] = np.arange(n) * strips // max(n, 1)
    order = np.lexsort((y, strip))
    ends = np.searchsorted(strip[order], np.arange(strips + 1))
    return [order[i:min(i + LEAF, b)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()) for i in range(a, b, LEAF)]


def _searched(x: np.ndarray, y: np.ndarray, c: np.ndarray, qx: np.ndarray, qy: np.ndarray, far: np.ndarray | None, k: int) -> np.ndarray:
    """_nearest for many asking points, of which only the points within `far` are met; without it the points ask themselves."""
    out = np.full((len(qx), k), FAR, np.int64)
    for leaf in _leaves(qx, qy):
        ax, ay = qx[leaf], qy[leaf]
        r = int((_nearest(x[leaf], y[leaf], c[leaf], ax, ay, k)[:, k - 1] if far is None else far[leaf]).max())
        met = (x >= ax.min() - r) & (x <= ax.max() + r) & (y >= ay.min() - r) & (y <= ay.max() + r)
        if met.any():
            out[leaf] = _nearest(x[met], y[met], c[met], ax, ay, k)
    return out


def neighbour_distances(points: DataFrame, keys: Sequence[str], k: int = NEIGHBOURS) -> DataFrame:
    """points (keys, x, y, c) with `eps`: the distance to the k-th nearest other point in the larger of the two differences, exact; null where a key has no more than k.

    x and y are whole numbers of less than 2^51, c repeats of a point. Quantiles of x cut a key's plane into strips, quantiles of y each strip into tiles of about TILE
    points; they decide which task does what and not the result. A point searches its own tile; where that circle reaches beyond the tile it is sent to every
    tile with points inside it. So a point is held once per pass, and only points beside an edge are sent on.
    """
    group = list(keys) or ["_one"]
    held = stored(points.select(*([] if keys else [F.lit(0).alias("_one")]), *keys, "x", "y", "c"))
    strips = _cuts(held, group, "x", lambda n: F.sqrt(n / TILE), "_xc")
    held = _placed(held, strips, group, "x", "_xc", "_i")
    rows = _cuts(held, [*group, "_i"], "y", lambda n: n / TILE, "_yc")
    held = _placed(held, rows, [*group, "_i"], "y", "_yc", "_j")
    tile = [*group, "_i", "_j"]

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def alone(t: pa.Table) -> pa.Table:
        x, y, c = (column(t, n) for n in "xyc")
        d = _searched(x, y, c, x, y, None, k)[:, k - 1]
        return t.append_column("d", pa.array(d, mask=d == FAR))

    own = stored(held.groupBy(*tile).applyInArrow(alone, T.StructType(held.schema.fields + [T.StructField("d", T.LongType())])))
    boxes = own.groupBy(*tile).agg(*[f(v).alias(f"{n}_{v}") for v in "xy" for n, f in (("a", F.min), ("z", F.max))])
    boxes = boxes.groupBy(*group).agg(F.collect_list(F.struct("_i", "_j", "a_x", "z_x", "a_y", "z_y")).alias("_boxes")).where(F.size("_boxes") > 1)
    x, y, d = F.col("x"), F.col("y"), F.coalesce("d", F.lit(FAR))
    # a tile's edges are half open: values from the lower one up to below the upper one
    beyond = [d > v - F.get(cuts, F.col(no) - 1) + 1 for v, cuts, no in ((x, "_xc", "_i"), (y, "_yc", "_j"))] + [d > F.get(cuts, F.col(no)) - v for v, cuts, no in ((x, "_xc", "_i"), (y, "_yc", "_j"))]
    beyond = reduce(lambda a, b: a | b, [F.coalesce(b, F.lit(False)) for b in beyond])
    inside = F.filter("_boxes", lambda b: F.greatest(b["a_x"] - x, x - b["z_x"], b["a_y"] - y, y - b["z_y"], F.lit(0)) < d)
    # cuts and boxes are a few values per tile
    edged = null_safe_join(null_safe_join(own, F.broadcast(strips), group, "left"), F.broadcast(rows), [*group, "_i"], "left")
    edged = null_safe_join(edged, F.broadcast(boxes), group, "left").withColumn("_met", F.when(beyond, inside))
    sent = F.coalesce(F.size("_met") > 1, F.lit(False))
    asked = edged.where(sent).select(*group, "x", "y", "c", "d", F.explode("_met").alias("_b")).select(*group, "_b._i", "_b._j", "x", "y", "c", "d")

    def beside(asking: pa.Table, t: pa.Table) -> pa.Table:
        far = asking.column("d").fill_null(FAR).to_numpy()
        found = _searched(*(column(t, n) for n in "xyc"), column(asking, "x"), column(asking, "y"), far, k)
        near = pa.array([[v for v in r if v < FAR] for r in found.tolist()], pa.list_(pa.int64()))
        return asking.select([*group, "x", "y", "c"]).append_column("near", near)

    schema = T.StructType([own.schema[n] for n in (*group, "x", "y", "c")] + [T.StructField("near", T.ArrayType(T.LongType()))])
    there = own.select(*[F.col(n).alias(n) for n in (*tile, "x", "y", "c")])  # named anew: both sides come from one frame
    found = asked.groupBy(*tile).cogroup(there.groupBy(*tile)).applyInArrow(beside, schema)
    settled = found.groupBy(*group, "x", "y").agg(F.max("c").alias("c"), F.get(F.array_sort(F.flatten(F.collect_list("near"))), F.lit(k - 1)).alias("eps"))
    return edged.where(~sent).select(*keys, "x", "y", "c", F.col("d").alias("eps")).unionByName(settled.select(*keys, "x", "y", "c", "eps"))


def mutual_info_neighbours(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), k: int = NEIGHBOURS) -> DataFrame:
    """Mutual information in nats of continuous features with a continuous target by k nearest neighbours (Kraskov and others, 2004, first estimator).

    One row (keys, feature, mi): digamma(n) + digamma(k) less the means of digamma(a + 1) and digamma(b + 1), where a and b count the other rows that lie nearer than the
    k-th neighbour along the feature and along the target (equal to the row itself where that distance is 0); at least 0. Columns are in standard deviations, rounded to
    2^-32, and no noise is added to ties. Rows with a null or not-a-number are left out; groups of no more than k rows have a null mi.

    Neighbours are found in tiles (`neighbour_distances`), the counts inside bins of values (`counts_around`); no row is paired with the rows it counts.
    """
    group = [*keys, "feature"]
    points = stored(neighbour_distances(_long_pairs(df, features, target, keys), group, k))
    # the row itself is among them, so a + 1 is the count
    psi = counts_around(points, group).select(*group, (F.col("c") * digamma(F.col("m"))).alias("psi"))
    sizes = points.groupBy(*group).agg(F.sum("c").alias("_n"))
    mi = digamma(F.col("_n")) + digamma(F.lit(k)) - F.col("_m") / F.col("_n")
    means = psi.groupBy(*group).agg(F.sum("psi").alias("_m"))
    return null_safe_join(sizes, means, group, "left").select(*group, F.when(F.col("_m").isNotNull(), F.greatest(mi, F.lit(0.0))).alias("mi"))


def counts_around(points: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, m, c): for points (group, x, y, c, eps) and either axis the numbers m of values nearer than eps, equal ones at distance 0, with the number c of points that have so many.

    Values lie in bins of about BIN by quantiles. Most ranges lie inside one bin, where a sorted column tells both ranks; of a range that reaches into another bin each end
    is ranked in its own bin, on top of the number of values in the bins before. A bin that one value makes large is dealt out in parts, each with the bin's distinct values.
    """
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(v).alias("v")) for i, v in enumerate("xy")])).alias("_a")
    # values above v - w and below v + w
    held = points.select(*group, "c", F.greatest("eps", F.lit(1)).alias("w"), F.col("eps").isNotNull().alias("asks"), axes).select(*group, "_a.axis", "_a.v", "w", "c", "asks")
    line = [*group, "axis"]
    held = _placed(held, _cuts(held, line, "v", lambda n: n / BIN, "_vc"), line, "v", "_vc", "bin")
    over = Window.partitionBy(*line).orderBy("bin")
    bins = held.groupBy(*line, "bin").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("c").alias("_s"), F.count(F.lit(1)).alias("_n"))
    bins = stored(bins.select(*line, "bin", "least", F.lag("most").over(over).alias("under"), F.lead("least").over(over).alias("above"),
                               F.coalesce(F.sum("_s").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"),
                               F.when(F.col("_n") > 2 * BIN, F.ceil(F.col("_n") / BIN)).otherwise(1).cast("int").alias("parts")))
    several = bins.where("under is not null or above is not null or parts > 1")
    home = null_safe_join(held, F.broadcast(several), [*line, "bin"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    low, high = F.col("v") - F.col("w"), F.col("v") + F.col("w") - 1
    within = F.coalesce(low >= F.col("under"), F.lit(True)) & F.coalesce(high < F.col("above"), F.lit(True))
    # what a row is in its bin: 1 a value, 2 a range, 4 and 8 the lower and the upper end of a range
    role = F.when(F.col("parts") == 1, 1).otherwise(0) + F.when(F.col("asks") & within, 2).otherwise(0)
    cols = [*line, "bin", "part", "v", "w", "c", "role"]
    rows = home.select(*line, "bin", F.pmod(F.xxhash64("w", "c"), F.col("parts")).cast("int").alias("part"), "v", "w", "c", role.alias("role")).where("role > 0")
    shared = home.where("parts > 1").groupBy(*line, "bin", "v").agg(F.sum("c").alias("c"), F.max("parts").alias("parts"))
    shared = shared.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).cast("long").alias("w"), F.lit(1).alias("role"))
    lists = several.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("bin", "least"))).alias("_bins"))
    across = null_safe_join(home.where(F.col("asks") & ~within).groupBy(*line, "v", "w").agg(F.sum("c").alias("c")), F.broadcast(lists), line)

    def end(at: Column, kind: int) -> Column:
        last = F.try_element_at(F.filter("_bins", lambda b: b["least"] <= at), F.lit(-1))
        return F.struct(last["bin"].alias("bin"), F.lit(kind).alias("role"))
    # below the least value of all nothing is counted
    across = across.select(*line, "v", "w", "c", F.explode(F.array(end(low, 4), end(high, 8))).alias("_e")).select(
        *line, "_e.bin", F.lit(0).alias("part"), "v", "w", "c", "_e.role").where("bin is not null")

    def ranked(t: pa.Table) -> pa.Table:
        v, c, w, role = (t.column(n).to_numpy() for n in ("v", "c", "w", "role"))
        value, asks = (role & 1) > 0, (role & 2) > 0
        order = np.argsort(v[value])
        values, upto = v[value][order], np.concatenate(([0], np.cumsum(c[value][order])))

        def below(x: np.ndarray) -> np.ndarray:
            return upto[np.searchsorted(values, x, side="right")]
        m, at = np.unique(below(v[asks] + w[asks] - 1) - below(v[asks] - w[asks]), return_inverse=True)
        number = np.zeros(len(m), np.int64)
        np.add.at(number, at, c[asks])
        ends = role >= 4
        rank = below(np.where(role == 4, v - w, v + w - 1)[ends])
        out = {"v": np.concatenate((np.zeros(len(m), np.int64), v[ends])), "w": np.concatenate((np.zeros(len(m), np.int64), w[ends])),
               "m": np.concatenate((m, rank)), "c": np.concatenate((number, c[ends])), "role": np.concatenate((np.full(len(m), 2, np.int32), role[ends]))}
        return pa.table({**{n: pa.repeat(t.column(n)[0], len(out["m"])) for n in [*line, "bin"]}, **{n: pa.array(x) for n, x in out.items()}})

    long, whole = T.LongType(), T.IntegerType()
    schema = T.StructType([held.schema[n] for n in [*line, "bin"]] + [T.StructField(n, t) for n, t in (("v", long), ("w", long), ("m", long), ("c", long), ("role", whole))])
    dealt = rows.select(*cols).unionByName(shared.select(*cols)).unionByName(across.select(*cols))
    found = stored(dealt.groupBy(*line, "bin", "part").applyInArrow(ranked, schema))
    both = null_safe_join(found.where("role >= 4"), F.broadcast(several.select(*line, "bin", "off")), [*line, "bin"])
    sign = F.when(F.col("role") == 8, 1).otherwise(-1)
    both = both.groupBy(*line, "v", "w").agg(F.sum(sign * (F.col("m") + F.col("off"))).alias("m"), F.max("c").alias("c"))
    return found.where("role = 2").groupBy(*group, "m").agg(F.sum("c").alias("c")).unionByName(both.select(*group, "m", "c"))


def t_test(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Two-sample t with pooled variance: t, degrees of freedom, the two-sided probability p, and both means.

    Fewer than three values, or no spread and equal means, give null t and p; other means without any spread give p = 0.
    """
    def side(v, f) -> Column:
        return f(F.when(F.col(group) == v, F.col(value)))
    s = df.agg(side(a, F.avg).alias("mean_a"), side(b, F.avg).alias("mean_b"), side(a, F.var_samp).alias("_va"),
               side(b, F.var_samp).alias("_vb"), side(a, F.count).alias("_na"), side(b, F.count).alias("_nb"))
    dof = F.col("_na") + F.col("_nb") - 2
    pooled = ((F.col("_na") - 1) * F.coalesce("_va", F.lit(0.0)) + (F.col("_nb") - 1) * F.coalesce("_vb", F.lit(0.0))) / F.when(dof > 0, dof)
    spread = F.sqrt(pooled * (1 / F.col("_na") + 1 / F.col("_nb")))
    gap = F.col("mean_a") - F.col("mean_b")
    t = F.when(spread > 0, gap / spread).when((spread == 0) & (gap != 0), F.signum(gap) * float("inf"))
    out = s.select(t.alias("t"), dof.alias("df"), "mean_a", "mean_b")
    p = F.when(F.abs("t") == float("inf"), 0.0).otherwise(student_t_p(F.col("t"), F.col("df")))
    return out.select("t", "df", p.alias("p"), "mean_a", "mean_b")


def _model_matrices(m0: pd.Series, m1: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(m0, m1):
        n = round(len(x) ** 0.5)
        c0, c1 = np.asarray(x, float).reshape(n, n), np.asarray(y, float).reshape(n, n)
        if not (np.isfinite(c0).all() and np.isfinite(c1).all()):
            rows.append((None, None))
            continue
        a = c1 @ np.linalg.pinv(c0)
        try:
            b = np.linalg.cholesky(c0 - a @ c1.T).ravel().tolist()
        except np.linalg.LinAlgError:
            b = None
        rows.append((a.ravel().tolist(), b))
    return pd.DataFrame(rows, columns=["a", "b"])


def lag_correlation_matrices(df: DataFrame, keys: Sequence[str], order: str, variables: Sequence[str], month_end: str = "last_day") -> DataFrame:
    """Lag-0 and lag-1 correlations per key and A = M1 M0^-1, B = chol(M0 - A M1^T), row major.

    Correlations do not change with z-scores, so the raw values are used. Month-end rows are not paired
    with the next month. Sums combine map-side; the 4 x 4 algebra runs once per key.
    """
    solve = F.pandas_udf(_model_matrices, T.StructType([T.StructField("a", DOUBLES), T.StructField("b", DOUBLES)]))
    w = Window.partitionBy(*keys).orderBy(order)
    led = df.withColumns({f"_n{i}": F.when(~F.col(month_end), F.lead(v).over(w)) for i, v in enumerate(variables)})
    paired = ~F.col(month_end) & F.col("_n0").isNotNull()
    m0 = [F.corr(v, u) for v in variables for u in variables]
    m1 = [F.corr(F.when(paired, F.col(f"_n{i}")), F.when(paired, F.col(u))) for i in range(len(variables)) for u in variables]
    sums = led.groupBy(*keys).agg(F.array(*m0).alias("m0"), F.array(*m1).alias("m1"))
    solved = sums.withColumn("_s", solve("m0", "m1"))
    return solved.select(*keys, "m0", "m1", F.col("_s.a").alias("a"), F.col("_s.b").alias("b"))
