"""Stand-in climate tables over the given tables, as Spark frames and as the same SQL for the check.

Every frame is one partial aggregation over a large table; what follows works on series that are bounded
by the calendar, or on stories whose number grows with the customers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshade.functions import scalars as S
from rainshade.functions.calendar import season_order, season_year

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function of `Tables` under a name, with its check SQL where one exists."""
    def wrap(fn: Callable[["Tables"], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def binary(x: Column) -> Column:
    """Nearest multiple of 1/1024: sums of such values are exact, so no sum depends on row order."""
    return F.round(x * 1024, 0) / 1024


def text_date(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/rainshade-{uuid.uuid4().hex}"


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def dealt(self, name: str, *columns: str) -> DataFrame:
        """A few columns of a table, dealt out by the first: for work that is dear per row, when a small file is one split."""
        return self.table(name).select(*columns).repartition(self.spark.sparkContext.defaultParallelism, columns[0])

    @cached_property
    def flow(self) -> DataFrame:
        """Daily river flow: (date, flow, n)."""
        o = self.table("orders")
        return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
            binary(F.avg("o_totalprice") / 4001.7).alias("flow"), F.count(F.lit(1)).alias("n"))

    @cached_property
    def weather(self) -> DataFrame:
        """Daily weather per site 0..2."""
        return self._daily_weather((F.col("l_suppkey") % 3).cast("int").alias("site"))

    @cached_property
    def record(self) -> DataFrame:
        """Daily weather of the whole area as one record."""
        return self._daily_weather()

    def _daily_weather(self, *keys: Column) -> DataFrame:
        x = self.table("lineitem")
        return x.groupBy(*keys, F.to_date("l_shipdate").alias("date")).agg(
            binary(F.greatest(F.avg("l_quantity") - 25.03, F.lit(0.0)) * 1.7013197).alias("rain"),
            binary(F.avg("l_discount") * 61.7301937).alias("pet"),
            binary(F.max("l_extendedprice") / 7001.3 + 11.3).alias("tmax"),
            binary(F.min("l_extendedprice") / 3001.7).alias("tmin"),
            binary(F.avg("l_extendedprice") / 3007.3).alias("radn"))

    @cached_property
    def rest(self) -> DataFrame:
        """Daily restriction fraction: (date, f_rest)."""
        x = self.table("lineitem")
        return x.groupBy(F.to_date("l_shipdate").alias("date")).agg(binary(F.avg("l_discount") * 9.9731123).alias("f_rest"))

    @cached_property
    def months(self) -> DataFrame:
        """Monthly means per site: (site, year, month, tmean, rain, pet)."""
        w = self.weather
        return w.groupBy("site", F.year("date").alias("year"), F.month("date").alias("month")).agg(
            binary(F.avg((F.col("tmax") + F.col("tmin")) / 2)).alias("tmean"), binary(F.avg("rain")).alias("rain"),
            binary(F.avg("pet")).alias("pet"))

    @cached_property
    def story_months(self) -> DataFrame:
        """Storylines: a group of 15 customers and a July-June season, twelve months each; a month without an order is an average one."""
        o = self.table("orders")
        y, m = F.year("o_orderdate"), F.month("o_orderdate")
        g = o.groupBy((F.floor(F.col("o_custkey") / 15)).alias("grp"), season_year(y, m).alias("season"), m.alias("month")).agg(
            binary(F.avg("o_totalprice") / 1000.7).alias("_t"), binary(F.avg(F.col("o_orderkey") % 997)).alias("_p"),
            (F.min("o_orderkey") % 99 + 1).alias("_q"), (F.round(F.avg("o_totalprice") / 201.7 * 4, 0) / 4).alias("pg"))
        found = F.map_from_entries(F.collect_list(F.struct("month", F.struct("_t", "_p", "_q", "pg").alias("v"))))
        whole = g.groupBy("grp", "season").agg(found.alias("_f")).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
        whole = whole.withColumn("_v", F.col("_f")[F.col("month")])
        s = whole.select("grp", "season", "month", (F.col("season") + (F.col("month") < 7).cast("int")).alias("year"), "_v._t", "_v._p",
                         F.coalesce("_v._q", (F.col("grp") * 7 + F.col("season") * 3 + F.col("month") * 13) % 99 + 1).alias("_q"), F.coalesce("_v.pg", F.lit(900.0)).alias("pg"))
        temp = F.when(F.col("_t") >= 310, "H").when(F.col("_t") <= 190, "C").otherwise("A")
        precip = F.when(F.col("_p") >= 620, "W").when(F.col("_p") <= 380, "D").otherwise("A")
        rest_per = F.col("_q") / 100
        return s.select((F.col("grp") * 10000 + F.col("season")).alias("story_id"), "grp", "year", "month",
                        season_order(F.col("month")).alias("seq"), temp.alias("temp_class"), precip.alias("precip_class"),
                        F.concat_ws("-", temp, precip).alias("state"), rest_per.alias("rest_per"),
                        F.when(F.col("month").isin(5, 6, 7, 8), 0.0).otherwise(rest_per / 2).alias("rest"), "pg",
                        F.when(F.pmod("grp", F.lit(2)) == 0, "good").otherwise("bad").alias("irr_type"),
                        F.when(F.pmod(F.col("grp"), F.lit(3)) == 0, "eyrewell").otherwise("oxford").alias("site"),
                        F.when(F.pmod(F.col("grp"), F.lit(3)) == 1, "dryland").otherwise("irrigated").alias("mode"))

    @cached_property
    def transitions(self) -> DataFrame:
        """(month, from_state, to_state, p) counted from consecutive story months."""
        from pyspark.sql import Window
        w = Window.partitionBy("story_id").orderBy("seq")
        s = self.story_months.withColumn("_n", F.lead("state").over(w)).where(F.col("_n").isNotNull())
        c = s.groupBy("month", F.col("state").alias("from_state"), F.col("_n").alias("to_state")).agg(F.count(F.lit(1)).alias("_c"))
        return c.select("month", "from_state", "to_state", (F.col("_c") / F.sum("_c").over(
            Window.partitionBy("month", "from_state"))).alias("p"))

    @cached_property
    def initial(self) -> DataFrame:
        from pyspark.sql import Window
        c = self.story_months.groupBy("month", "state").agg(F.count(F.lit(1)).alias("_c"))
        return c.select("month", "state", (F.col("_c") / F.sum("_c").over(Window.partitionBy("month"))).alias("p"))

    @cached_property
    def mapper(self) -> DataFrame:
        """(combo, q, month, rest): a smooth restriction table per month and class pair, from the daily record."""
        top = (self.rest.where(F.month("date").isin(9, 10, 11, 12, 1, 2, 3, 4)).groupBy(F.month("date").alias("month"))
               .agg(F.max("f_rest").alias("_m")))
        combos = F.explode(F.array(*[F.struct(F.lit(c).alias("combo"), F.lit(k).alias("k")) for c, k in
                                     (("D-D", 1.0), ("D-ND", 0.75), ("ND-D", 0.5), ("ND-ND", 0.25))]))
        rows = top.withColumn("_c", combos).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(99))))
        return rows.select("_c.combo", (F.col("i") / 100).alias("q"), "month",
                           (F.col("_m") * F.col("_c.k") * F.col("i") / 100).alias("rest"))

    @cached_property
    def impact(self) -> DataFrame:
        """One row per story of twelve months: log-probability and annual growth."""
        s = self.story_months
        return s.groupBy("story_id", "irr_type", "site", "mode").agg(
            F.round(-F.sum(F.lit(0.3) + F.col("rest_per") / 10), 6).alias("log10_prob"), F.sum("pg").alias("pg"),
            F.count(F.lit(1)).alias("n_months"))

    @cached_property
    def rest_classes(self) -> DataFrame:
        """(year, month, temp_class, precip_class, precip_class_prev, regime): thirds of each calendar month by rank.

        Ranks stay apart however close the means of a large table lie, so every calendar month of two years or more has a dry
        month and another.
        """
        from pyspark.sql import Window
        m = self.record.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
            binary(F.avg((F.col("tmax") + F.col("tmin")) / 2)).alias("tmean"), binary(F.avg("rain")).alias("rain"))
        calendar = Window.partitionBy("month")

        def third(value: str, low: str, high: str) -> Column:
            rank, n = F.row_number().over(calendar.orderBy(value, "year")) - 1, F.count(F.lit(1)).over(calendar)
            return F.when(3 * rank < n, low).when(3 * rank >= 2 * n, high).otherwise("A")
        out = m.withColumns({"precip_class": third("rain", "D", "W"), "temp_class": third("tmean", "C", "H")})
        # one row per month of one record
        w = Window.partitionBy(F.lit(1)).orderBy("year", "month")
        return out.select("year", "month", "temp_class", "precip_class", F.lag("precip_class", 1, "A").over(w).alias("precip_class_prev"),
                          S.regime_index(F.col("temp_class"), F.col("precip_class")).alias("regime"))


CTES = {
    "flow": """flow AS (SELECT CAST(o_orderdate AS DATE) AS date, round((avg(o_totalprice) / 4001.7e0) * 1024, 0) / 1024e0 AS flow, count(*) AS n
  FROM orders GROUP BY 1)""",
    "weather": """weather AS (SELECT CAST(l_suppkey % 3 AS INTEGER) AS site, CAST(l_shipdate AS DATE) AS date,
  round((greatest(avg(l_quantity) - 25.03e0, 0e0) * 1.7013197e0) * 1024, 0) / 1024e0 AS rain, round((avg(l_discount) * 61.7301937e0) * 1024, 0) / 1024e0 AS pet,
  round((max(l_extendedprice) / 7001.3e0 + 11.3e0) * 1024, 0) / 1024e0 AS tmax, round((min(l_extendedprice) / 3001.7e0) * 1024, 0) / 1024e0 AS tmin,
  round((avg(l_extendedprice) / 3007.3e0) * 1024, 0) / 1024e0 AS radn FROM lineitem GROUP BY 1, 2)""",
    "record": """record AS (SELECT CAST(l_shipdate AS DATE) AS date,
  round((greatest(avg(l_quantity) - 25.03e0, 0e0) * 1.7013197e0) * 1024, 0) / 1024e0 AS rain, round((avg(l_discount) * 61.7301937e0) * 1024, 0) / 1024e0 AS pet,
  round((max(l_extendedprice) / 7001.3e0 + 11.3e0) * 1024, 0) / 1024e0 AS tmax, round((min(l_extendedprice) / 3001.7e0) * 1024, 0) / 1024e0 AS tmin,
  round((avg(l_extendedprice) / 3007.3e0) * 1024, 0) / 1024e0 AS radn FROM lineitem GROUP BY 1)""",
    "rmonths": """rmonths AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  round((avg((tmax + tmin) / 2)) * 1024, 0) / 1024e0 AS tmean, round((avg(rain)) * 1024, 0) / 1024e0 AS rain FROM record GROUP BY 1, 2)""",
    "rest": """rest AS (SELECT CAST(l_shipdate AS DATE) AS date, round((avg(l_discount) * 9.9731123e0) * 1024, 0) / 1024e0 AS f_rest
  FROM lineitem GROUP BY 1)""",
    "months": """months AS (SELECT site, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  round((avg((tmax + tmin) / 2)) * 1024, 0) / 1024e0 AS tmean, round((avg(rain)) * 1024, 0) / 1024e0 AS rain, round((avg(pet)) * 1024, 0) / 1024e0 AS pet FROM weather GROUP BY 1, 2, 3)""",
    "stories": """story_agg AS (SELECT o_custkey // 15 AS grp, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS season, month(o_orderdate) AS month,
  round((avg(o_totalprice) / 1000.7e0) * 1024, 0) / 1024e0 AS t, round((avg(o_orderkey % 997)) * 1024, 0) / 1024e0 AS p, min(o_orderkey) % 99 + 1 AS q,
  round(avg(o_totalprice) / 201.7e0 * 4, 0) / 4e0 AS pg FROM orders GROUP BY 1, 2, 3),
stories_c AS (SELECT k.grp, CAST(k.season AS INTEGER) AS season, CAST(m AS INTEGER) AS month, CAST(k.season + CASE WHEN m < 7 THEN 1 ELSE 0 END AS INTEGER) AS year,
  coalesce(a.q, (k.grp * 7 + k.season * 3 + m * 13) % 99 + 1) AS q, coalesce(a.pg, 900e0) AS pg,
  CASE WHEN t >= 310 THEN 'H' WHEN t <= 190 THEN 'C' ELSE 'A' END AS temp_class,
  CASE WHEN p >= 620 THEN 'W' WHEN p <= 380 THEN 'D' ELSE 'A' END AS precip_class
  FROM (SELECT DISTINCT grp, season FROM story_agg) k CROSS JOIN range(1, 13) r(m) LEFT JOIN story_agg a ON a.grp = k.grp AND a.season = k.season AND a.month = m),
stories AS (SELECT grp * 10000 + season AS story_id, grp, year, month, (month + 5) % 12 AS seq, temp_class, precip_class,
  temp_class || '-' || precip_class AS state, CAST(q AS DOUBLE) / 100e0 AS rest_per,
  CASE WHEN month IN (5,6,7,8) THEN 0e0 ELSE CAST(q AS DOUBLE) / 100e0 / 2e0 END AS rest, pg,
  CASE WHEN grp % 2 = 0 THEN 'good' ELSE 'bad' END AS irr_type, CASE WHEN grp % 3 = 0 THEN 'eyrewell' ELSE 'oxford' END AS site,
  CASE WHEN grp % 3 = 1 THEN 'dryland' ELSE 'irrigated' END AS mode FROM stories_c)""",
    "transitions": """tr_steps AS (SELECT month, state, lead(state) OVER (PARTITION BY story_id ORDER BY seq) AS nxt FROM stories),
tr_c AS (SELECT month, state AS from_state, nxt AS to_state, count(*) AS c FROM tr_steps WHERE nxt IS NOT NULL GROUP BY 1, 2, 3),
transitions AS (SELECT month, from_state, to_state, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY month, from_state) AS DOUBLE) AS p FROM tr_c)""",
    "initial": """in_c AS (SELECT month, state, count(*) AS c FROM stories GROUP BY 1, 2),
initial AS (SELECT month, state, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY month) AS DOUBLE) AS p FROM in_c)""",
    "mapper": """map_top AS (SELECT CAST(month(date) AS INTEGER) AS month, max(f_rest) AS m FROM rest
  WHERE month(date) IN (9,10,11,12,1,2,3,4) GROUP BY 1),
mapper AS (SELECT combo, CAST(i AS DOUBLE) / 100e0 AS q, month, m * k * CAST(i AS DOUBLE) / 100e0 AS rest FROM map_top,
  (VALUES ('D-D', 1e0), ('D-ND', 0.75e0), ('ND-D', 0.5e0), ('ND-ND', 0.25e0)) c(combo, k), range(1, 100) t(i))""",
    "impact": """impact AS (SELECT story_id, irr_type, site, mode, round(-sum(0.3e0 + rest_per / 10e0), 6) AS log10_prob,
  sum(pg) AS pg, count(*) AS n_months FROM stories GROUP BY 1, 2, 3, 4)""",
    "classes": """cl_rel AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY rain, year) - 1 AS rr, row_number() OVER (PARTITION BY month ORDER BY tmean, year) - 1 AS tr,
  count(*) OVER (PARTITION BY month) AS n FROM rmonths),
cl_base AS (SELECT *, CASE WHEN 3 * rr < n THEN 'D' WHEN 3 * rr >= 2 * n THEN 'W' ELSE 'A' END AS precip_class,
  CASE WHEN 3 * tr < n THEN 'C' WHEN 3 * tr >= 2 * n THEN 'H' ELSE 'A' END AS temp_class FROM cl_rel),
classes AS (SELECT year, month, temp_class, precip_class, lag(precip_class, 1, 'A') OVER (ORDER BY year, month) AS precip_class_prev,
  CASE temp_class WHEN 'C' THEN 0 WHEN 'A' THEN 3 ELSE 6 END + CASE precip_class WHEN 'W' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS regime FROM cl_base)""",
}
NEEDS = {"months": ("weather",), "transitions": ("stories",), "initial": ("stories",), "mapper": ("rest",), "impact": ("stories",),
         "classes": ("rmonths",), "rmonths": ("record",)}


def with_(*names: str, extra: str = "", recursive: bool = False) -> str:
    """WITH clause holding the named stand-in tables and what they need, then `extra` clauses."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, ()):
            add(d)
        if n not in ordered:
            ordered.append(n)
    for n in names:
        add(n)
    parts = [CTES[n] for n in ordered] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def values_sql(rows: list[tuple], alias: str) -> str:
    """(VALUES ...) alias with text quoted and floats as doubles."""
    def one(v) -> str:
        return f"'{v}'" if isinstance(v, str) else (f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v))
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows) + f") {alias}"
