"""Statistics and ML (M1-M9)."""

from pyspark.sql import functions as F

from rainshade.functions.calendar import date_parts
from rainshade.operators import statistics as M
from rainshade.operators import windows as W
from rainshade.queries.base import query, r, rounded, text_date, with_


@query("m1_detrend_harmonic")
def _(t):
    from pyspark.sql import Window
    x = date_parts(t.weather.select("site", "date", "rain", "tmax"))
    driver = x.groupBy("site", "year").agg(F.avg("tmax").alias("driver"))
    # the day number of a series is bounded by the calendar
    w = Window.partitionBy("site").orderBy("date")
    y = x.join(driver, ["site", "year"]).withColumn("day_no", F.row_number().over(w) - 1)
    return rounded(text_date(M.detrend_harmonic(y, ["site"], "rain", "driver", "day_no").select("site", "date", "rain"), "date"))


@query("m1_normal_equations", with_("weather") + "SELECT DISTINCT site, CAST(i AS INTEGER) AS feature, 0e0 AS product FROM weather, range(0, 8) t(i)")
def _(t):
    """Residuals of the harmonic fit are orthogonal to each of its eight features."""
    from pyspark.sql import Window
    x = date_parts(t.weather.select("site", "date", "rain", "tmax"))
    driver = x.groupBy("site", "year").agg(F.avg("tmax").alias("driver"))
    y = x.join(driver, ["site", "year"]).withColumn("day_no", F.row_number().over(Window.partitionBy("site").orderBy("date")) - 1)
    fit = M.harmonic_fit(y, ["site"], "rain", "driver", "day_no")
    features = F.array(*M.harmonic_features(F.col("driver").cast("double"), F.col("day_no").cast("double")))
    rows = y.where("rain <> 0").join(F.broadcast(fit), "site").withColumn("_x", features)
    fitted = F.aggregate(F.zip_with("_x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    long = rows.withColumn("_e", F.col("rain") - fitted).select("site", "rain", "_e", F.posexplode("_x").alias("feature", "v"))
    product = F.sum(F.col("v") * F.col("_e")) / F.sum(F.abs(F.col("v") * F.col("rain")))
    # a rounded zero may be a negative zero
    return long.groupBy("site", "feature").agg((F.round(product, 5) + F.lit(0.0)).alias("product"))


@query("m2_linear_fit", with_("weather") + """SELECT site, CAST(month(date) AS INTEGER) AS month, round(regr_slope(tmin, tmax), 6) AS slope, round(regr_intercept(tmin, tmax), 6) AS intercept, round(regr_r2(tmin, tmax), 6) AS r2, count(*) AS n FROM weather GROUP BY 1, 2""")
def _(t):
    return rounded(M.linear_fit(date_parts(t.weather), "tmax", "tmin", ["site", "month"]))


@query("m2_linear_fit_overall", with_("weather") + "SELECT round(regr_slope(radn, pet), 6) AS slope, round(regr_intercept(radn, pet), 6) AS intercept, round(regr_r2(radn, pet), 6) AS r2, count(*) AS n FROM weather")
def _(t):
    return rounded(M.linear_fit(t.weather, "pet", "radn"))


def _vectors(t):
    e = t.table("embeddings")
    width = len(e.select("embedding").first()["embedding"])
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(width)]), [f"x{i}" for i in range(width)]


@query("m3_pca_explained")
def _(t):
    df, cols = _vectors(t)
    return rounded(M.pca(df, cols, 5)[1])


@query("m3_pca_stories")
def _(t):
    f = M.story_features(t.story_months)
    comps, _ = M.pca(f, [c for c in f.columns if c != "story_id"], 6)
    return comps.select("story_id", F.posexplode("pcs").alias("component", "score")).select("story_id", "component", r(F.abs("score"), 4).alias("score"))


@query("m3_pca_total_variance", """WITH v AS (SELECT i, var_samp(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, max(len(embedding)) + 1)) AS i FROM embeddings) GROUP BY i)
SELECT CAST(count(*) AS BIGINT) AS components, round(sum(v), 4) AS variance, 1e0 AS explained FROM v""")
def _(t):
    """All components together carry the variance of the vectors."""
    df, cols = _vectors(t)
    comps, explained = M.pca(df, cols, len(cols))
    scores = comps.select(F.posexplode("pcs").alias("c", "score")).groupBy("c").agg(F.var_samp("score").alias("v"))
    total = scores.agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("v"), 4).alias("variance"))
    return total.withColumn("explained", F.lit(round(explained.agg(F.max("cumulative")).first()[0], 6)))


def _clustered(rows, n_pcs):
    """Rows, clusters, and rows that lie nearer to another cluster's mean than to their own by over a tenth of the distance."""
    dims = [F.col("pcs")[i] for i in range(n_pcs)]
    x = rows.select("cluster", *[d.alias(f"d{i}") for i, d in enumerate(dims)])
    means = x.groupBy("cluster").agg(F.array(*[F.avg(f"d{i}") for i in range(n_pcs)]).alias("m"))
    # one row per cluster
    centres = F.broadcast(means.agg(F.collect_list(F.struct("cluster", "m")).alias("cs")).withColumn("_one", F.lit(1)))
    point = F.array(*[f"d{i}" for i in range(n_pcs)])

    def distance(m):
        return F.sqrt(F.aggregate(F.zip_with(point, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    y = x.withColumn("_one", F.lit(1)).join(centres, "_one").withColumn("ds", F.transform("cs", lambda c: F.struct(c["cluster"].alias("c"), distance(c["m"]).alias("d"))))
    own = F.filter("ds", lambda d: d["c"] == F.col("cluster"))[0]["d"]
    best = F.array_min(F.transform("ds", lambda d: d["d"]))
    return y.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(own > best * 1.1 + 1e-9).alias("misplaced"))


@query("m4_kmeans_nearest", "SELECT count(*) AS n, CAST(5 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced FROM embeddings")
def _(t):
    df, cols = _vectors(t)
    return _clustered(M.kmeans(M.pca(df, cols, 3)[0], 5), 3)


@query("m5_hierarchical_totals", "SELECT count(*) AS n, CAST(6 AS BIGINT) AS clusters FROM embeddings")
def _(t):
    df, cols = _vectors(t)
    return _clustered(M.hierarchical_clusters(M.pca(df, cols, 8)[0], 6), 8).select("n", "clusters")


@query("m4_kmeans")
def _(t):
    df, cols = _vectors(t)
    return M.kmeans(M.pca(df, cols, 3)[0], 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("m4_kmeans_sweep")
def _(t):
    df, cols = _vectors(t)
    return M.kmeans_sweep(M.pca(df, cols, 3)[0], range(5, 8))


@query("m5_hierarchical_clusters")
def _(t):
    df, cols = _vectors(t)
    return M.hierarchical_clusters(M.pca(df, cols, 8)[0], 6).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _mi_sql(features, y: str, source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f"{keys}, feature" if keys else "feature"
    return f""", l AS ({' UNION ALL '.join(f"SELECT {k}'{f}' AS feature, CAST({e} AS VARCHAR) AS x, {y} AS y FROM {source}" for f, e in features)}),
pc AS (SELECT {k}feature, x, y, CAST(count(*) AS DOUBLE) AS c FROM l GROUP BY ALL), tm AS (SELECT {k}feature, c / sum(c) OVER (PARTITION BY {g}) * ln(c * sum(c) OVER (PARTITION BY {g}) / (sum(c) OVER (PARTITION BY {g}, x) * sum(c) OVER (PARTITION BY {g}, y))) AS v FROM pc)
SELECT {k}feature, round(sum(v), 6) AS mi FROM tm GROUP BY ALL"""


@query("m6_mutual_info_discrete", with_("stories") + _mi_sql([("precip_class", "precip_class"), ("irr_type", "irr_type"), ("prev", "grp % 3")], "temp_class", "stories", "month"))
def _(t):
    x = t.story_months.withColumn("prev", F.col("grp") % 3).select("month", "precip_class", "irr_type", F.col("prev").cast("string").alias("prev"), "temp_class")
    # class names stay text, so there is nothing negative to fold
    return rounded(M.mutual_info_discrete(x, ["precip_class", "irr_type", "prev"], "temp_class", ["month"]))


@query("m6_mutual_info_folded", """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 - 1 < 0 THEN 0 ELSE o_orderkey % 3 - 1 END AS y, CASE WHEN o_custkey % 5 - 2 < 0 THEN 0 ELSE o_custkey % 5 - 2 END AS a FROM orders)""" + _mi_sql([("a", "a")], "y", "c"))
def _(t):
    x = t.table("orders").select((F.col("o_orderkey") % 3 - 1).alias("y"), (F.col("o_custkey") % 5 - 2).alias("a"))
    return rounded(M.mutual_info_discrete(x, ["a"], "y", fold_negative=True))


@query("m7_mutual_info_continuous", """WITH b AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem), c AS (SELECT l_returnflag AS y, least(floor((l_extendedprice - a) / ((z - a) / 10)), 9) AS p FROM lineitem, b)""" + _mi_sql([("l_extendedprice", "p")], "y", "c"))
def _(t):
    return rounded(M.mutual_info_continuous(t.table("lineitem").select("l_extendedprice", "l_returnflag"), ["l_extendedprice"], "l_returnflag"))


def _neighbours_sql(source: str, features, y: str, keys: str, k: int = 3) -> str:
    """All pairs of a group: the k-th smallest larger difference of a row, and the rows nearer than it along each axis."""
    long = " UNION ALL ".join(f"SELECT {keys} AS g, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, CAST({y} AS DOUBLE) AS t FROM {source}" for f in features)
    psi = ("ln({n} + 8) - 0.5e0 / ({n} + 8) - 1e0 / 12 / pow({n} + 8, 2) + 1e0 / 120 / pow({n} + 8, 4) - 1e0 / 252 / pow({n} + 8, 6) + 1e0 / 240 / pow({n} + 8, 8)"
           " - list_sum(list_transform(range(0, 8), lambda i: 1e0 / ({n} + i)))")
    return f"""lg AS ({long}), st AS (SELECT g, feature, avg(v) AS mv, avg(t) AS mt, stddev_pop(v) AS sv, stddev_pop(t) AS st FROM lg GROUP BY 1, 2),
pt AS (SELECT row_number() OVER () AS i, l.g, l.feature, CAST(round((v - mv) / sv * 4294967296) AS BIGINT) AS x, CAST(round((t - mt) / st * 4294967296) AS BIGINT) AS y FROM lg l JOIN st s ON l.g = s.g AND l.feature = s.feature),
ds AS (SELECT a.i, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {k}) AS d FROM pt a JOIN pt b ON a.g = b.g AND a.feature = b.feature AND a.i <> b.i GROUP BY 1),
ep AS (SELECT pt.*, d[{k}] AS e FROM pt JOIN ds USING (i)),
nr AS (SELECT a.i, a.g, a.feature, count(*) FILTER (CASE WHEN a.e > 0 THEN abs(a.x - b.x) < a.e ELSE a.x = b.x END) AS nx, count(*) FILTER (CASE WHEN a.e > 0 THEN abs(a.y - b.y) < a.e ELSE a.y = b.y END) AS ny
  FROM ep a JOIN pt b ON a.g = b.g AND a.feature = b.feature GROUP BY 1, 2, 3),
tt AS (SELECT g, feature, count(*) AS n, avg({psi.format(n='nx')}) + avg({psi.format(n='ny')}) AS m FROM nr GROUP BY 1, 2)
SELECT g AS {keys.split(' ')[-1]}, feature, round(greatest({psi.format(n='n')} + {psi.format(n=str(k))} - m, 0e0), 6) AS mi FROM tt"""


@query("m7_mutual_info_neighbours", with_("months", extra=_neighbours_sql("months", ["tmean", "rain"], "pet", "site")))
def _(t):
    return rounded(M.mutual_info_neighbours(t.months, ["tmean", "rain"], "pet", ["site"]))


@query("m7_neighbours_by_month", "WITH oo AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, o_totalprice AS price, day(o_orderdate) AS day, o_orderkey % 997 + o_totalprice / 1000 AS score FROM orders),\n"
       + _neighbours_sql("oo", ["price", "day"], "score", "month"))
def _(t):
    o = t.table("orders").select(F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("price"), F.dayofmonth("o_orderdate").alias("day"),
                                 (F.col("o_orderkey") % 997 + F.col("o_totalprice") / 1000).alias("score"))
    return rounded(M.mutual_info_neighbours(o, ["price", "day"], "score", ["month"]))


@query("m8_t_test", with_("weather") + """, a AS (SELECT site, year(date) AS y, sum(rain) AS v FROM weather GROUP BY 1, 2), s AS (SELECT avg(v) FILTER (site = 0) AS ma, avg(v) FILTER (site = 1) AS mb, var_samp(v) FILTER (site = 0) AS va, var_samp(v) FILTER (site = 1) AS vb, count(*) FILTER (site = 0) AS na, count(*) FILTER (site = 1) AS nb FROM a),
q AS (SELECT (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS t, na + nb - 2 AS df, ma, mb FROM s),
-- for whole degrees of freedom the probability is a finite sum over powers of the cosine
h AS (SELECT *, atan(t / sqrt(df)) AS h FROM q), j AS (SELECT unnest(range(0, (df - df % 2) // 2)) AS j, df % 2 AS odd, h FROM h),
c AS (SELECT j, odd, h, exp(sum(CASE WHEN j = 0 THEN 0e0 WHEN odd = 1 THEN ln(2e0 * j / (2 * j + 1)) ELSE ln((2e0 * j - 1) / (2 * j)) END) OVER (ORDER BY j)) AS c FROM j),
a2 AS (SELECT sum(CASE WHEN odd = 1 THEN 2 / pi() * sin(h) * c * pow(cos(h), 2 * j + 1) ELSE sin(h) * c * pow(cos(h), 2 * j) END) AS v FROM c)
SELECT round(t, 6) AS t, df, round(1 - abs(v + CASE WHEN df % 2 = 1 THEN 2 / pi() * h ELSE 0e0 END), 9) AS p, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b FROM h, a2""")
def _(t):
    a = t.weather.groupBy("site", F.year("date").alias("year")).agg(F.sum("rain").alias("v"))
    return M.t_test(a, "v", "site", 0, 1).select(r("t").alias("t"), "df", r("p", 9).alias("p"), r("mean_a").alias("mean_a"), r("mean_b").alias("mean_b"))


VARS = ("tmax", "tmin", "radn", "pet")


def _matrices(t):
    x = W.last_day_flag(t.weather, ["site"])
    return M.lag_correlation_matrices(x, ["site"], "date", VARS)


_END = "lead(month(date)) OVER (PARTITION BY site ORDER BY date) IS DISTINCT FROM month(date)"


@query("m9_lag_correlations", with_("weather") + ", x AS (SELECT site, " + ", ".join(VARS) + "".join(f", CASE WHEN NOT {_END} THEN lead({v}) OVER (PARTITION BY site ORDER BY date) END AS n_{v}" for v in VARS)
       + f", NOT {_END} AS pair FROM weather) SELECT site, " + ", ".join(f"round(corr({a}, {b}), 6) AS m0_{i}{j}, round(corr(n_{a}, {b}) FILTER (pair), 6) AS m1_{i}{j}" for i, a in enumerate(VARS) for j, b in enumerate(VARS)) + " FROM x GROUP BY 1")
def _(t):
    m = _matrices(t)
    cells = [r(F.col(f"m{k}")[4 * i + j]).alias(f"m{k}_{i}{j}") for k in (0, 1) for i in range(4) for j in range(4)]
    return m.select("site", *cells)


@query("m9_lag_model")
def _(t):
    return _matrices(t).select("site", F.posexplode("a").alias("cell", "a")).withColumn("a", F.round("a", 5))
