"""URL rules by a sort-merge range join.

A host is written with its labels reversed and a dot after each, so the hosts below a rule's host are one interval of keys, as are the
paths that start with a rule's path. The ends of nested intervals cut the sorted keys into ranges, each with the innermost rule
that is open there: the top of the stack that a sweep over the sorted rules holds. A point takes the top set by the last end before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade.llm.common import stored

BLOCK = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first :// up to /, ?, # or the end, A-Z lower-cased; path from there up to ? or #. Else both are empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot: www.example.com becomes com.example.www. with the prefixes com. and com.example."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """(grp, pos, top): where a rule's interval starts or ends, and the innermost rule of the group that is open from there on (null: none).

    rules has distinct (grp, key); a rule's interval holds all keys that start with its own. The running sum of starts and ends is
    the height of the stack. A rule's parent is the last start one level lower.
    """
    start, end = F.encode("key", "utf-8"), F.concat(F.encode("key", "utf-8"), F.lit(bytearray(b"\xff")))
    # no byte of UTF-8 is 255, so an end follows all keys of its interval and none beyond
    events = rules.select("grp", "key", F.inline(F.array(F.struct(start.alias("pos"), F.lit(1).alias("step")), F.struct(end.alias("pos"), F.lit(-1).alias("step")))))
    height = F.sum("step").over(Window.partitionBy("grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = events.withColumn("height", height).filter("step = 1")
    asked = starts.select("grp", "key", "pos", F.inline(F.array(F.struct(F.col("height").alias("level"), F.col("key").alias("own")),
                                                               F.struct((F.col("height") - 1).alias("level"), F.lit(None).cast("string").alias("own")))))
    before = Window.partitionBy("grp", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parents = asked.withColumn("parent", F.last("own", ignorenulls=True).over(before)).filter("own is null")
    return parents.select("grp", F.inline(F.array(F.struct(start.alias("pos"), F.col("key").alias("top")), F.struct(end.alias("pos"), F.col("parent").alias("top")))))


def innermost(points: DataFrame, rules: DataFrame, block: int = BLOCK) -> DataFrame:
    """(grp, key, top): for every point inside a rule of its group the longest rule that the point's key starts with.

    points and rules have distinct (grp, key). A group of many points is dealt out to tasks of about `block` points, or as many points as the group
    has rules if those are more; each of these tasks takes the group's ends, so the ends are never more than the points.
    """
    counts = rules.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rules")).join(points.groupBy("grp").agg(F.count(F.lit(1)).alias("n_points")), "grp")
    dealt = counts.select("grp", F.ceil(F.col("n_points") / F.greatest(F.col("n_rules"), F.lit(block))).cast("int").alias("parts"))
    at = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    own = points.join(dealt, "grp").select("grp", at.alias("part"), F.encode("key", "utf-8").alias("pos"), F.lit(1).alias("kind"), "key", F.lit(None).cast("struct<top:string>").alias("edge"))
    ends = boundaries(rules).join(dealt, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pos", F.lit(0).alias("kind"),
                                                       F.lit(None).cast("string").alias("key"), F.struct("top").alias("edge"))
    sweep = Window.partitionBy("grp", "part").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = own.unionByName(ends).withColumn("last", F.last("edge", ignorenulls=True).over(sweep))
    return swept.filter("kind = 1 and last.top is not null").select("grp", "key", F.col("last.top").alias("top"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, block: int = BLOCK) -> DataFrame:
    """One row per input row: the id, host, path, rule (host and path of the longest rule that fits, else null) and verdict (the rule's, else `default`).

    rules is (host, path, verdict). A rule fits its host and all hosts below it where the url's path starts with the rule's path; a null path is empty and
    fits every path. The longest rule is the one whose host and path together have the most characters, of equal ones that with the longer host.
    Where one host and path has several verdicts, the last in alphabetical order holds (block before allow). Rules without a host are ignored.
    A null url, or one without ://, has an empty host and path, and no rule fits it; its row is returned like every other, and
    so are repeated rows and rows without an id. Empty pages give no rows, empty rules the default; other columns are ignored.
    """
    host, path = url_parts(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"))
    known = stored(rules.select(F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "verdict")
                   .filter("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", host_key(F.col("host"))))
    ruled = known.select("host_key").distinct()
    # the host sweep: all keys of one last label are a group
    group = F.substring_index("host_key", ".", 1)
    urls = stored(rows.filter("host <> ''").select("host", "path").distinct().withColumn("host_key", host_key(F.col("host"))))
    inner = innermost(urls.select(group.alias("grp"), F.col("host_key").alias("key")).distinct(), ruled.select(group.alias("grp"), F.col("host_key").alias("key")), block)
    # what is on the stack below a ruled host: the prefixes of its key, at the dots, that are ruled too
    labels = F.size(F.split("top", r"\.")) - 1
    stack = (ruled.select(F.col("host_key").alias("top")).withColumn("n", F.explode(F.sequence(F.lit(1), labels)))
             .select("top", F.concat(F.concat_ws(".", F.slice(F.split("top", r"\."), F.lit(1), F.col("n"))), F.lit(".")).alias("host_key")).join(ruled, "host_key"))
    open_rules = inner.select(F.col("key").alias("host_key"), "top").join(stack.select("top", F.col("host_key").alias("grp")), "top").select("host_key", "grp")
    # the path sweep: a group is a ruled host with the paths of all hosts that it covers
    covered = urls.join(open_rules, "host_key").select("host", "path", "grp")
    inside = innermost(covered.select("grp", F.col("path").alias("key")).distinct(), known.select(F.col("host_key").alias("grp"), F.col("path").alias("key")), block)
    fits = (covered.join(inside.select("grp", F.col("key").alias("path"), F.col("top").alias("rule_path")), ["grp", "path"])
            .join(known.select(F.col("host_key").alias("grp"), F.col("path").alias("rule_path"), F.col("host").alias("rule_host"), "verdict"), ["grp", "rule_path"]))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), "verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                                                           F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
