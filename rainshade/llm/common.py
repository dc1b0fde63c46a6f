"""Helpers shared by the text operators: row keys, white space, tables in the shared scratch folder, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
BROADCAST_ROWS = 250_000


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir; without that setting the job fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/rainshade-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and safe against lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, n: int | None = None) -> DataFrame:
    """A stored table as a side of joins: above BROADCAST_ROWS rows it is sorted and never broadcast, as Spark sizes it by its compressed files."""
    return df.hint("merge") if (df.count() if n is None else n) > BROADCAST_ROWS else df


def version(text: Column) -> Column:
    """With the id this names a document: rows equal in id and text are one document, returned once."""
    return F.xxhash64(text)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, text): the two columns an operator needs, null text as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), version(text).alias("version"), text.alias("text"))


def without_white(text: Column) -> Column:
    """Text without the characters [\\x20\\x09-\\x0D]."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def same_document(a: str, b: str) -> Column:
    """Join condition on the document key; a null id equals a null id."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.version") == F.col(f"{b}.version"))


def spare_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not have, however its case is read: the wanted ones with underscores in front."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def keep_documents(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose (doc_id, version) is in keep, each document once, with the columns of docs whatever their names."""
    key = version(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    own, other, at = spare_names(docs, "_version", "_keep_version", "_keep_id")
    left = docs.withColumn(own, key)
    right = keep.select(F.col("doc_id").alias(at), F.col("version").alias(other)).distinct()
    on = left[f"`{id_col}`"].eqNullSafe(right[at]) & (left[own] == right[other])
    return left.join(right, on, "left_semi").dropDuplicates([id_col, own]).drop(own)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges: root is the smallest node it is connected with.

    Each round takes the smallest label among the neighbours and follows the label's own label, so the number of
    rounds grows with the logarithm of the longest chain. Only minima per node are kept; no neighbour list is built. Then an edge goes on
    between the labels of its ends, and a label that was given up keeps an edge to the one taken for it: edges inside a group fall
    together after the first round, however many there are.
    """
    pairs = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
                   .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def both() -> DataFrame:
        return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))

    label = stored(both().groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    n = label.count()
    label = bounded(label, n)
    while True:
        to = both()
        near = (to.join(label, to["v"] == label["node"]).groupBy(F.col("u").alias("n")).agg(F.min("root").alias("m")))
        step = label.join(near, label["node"] == near["n"], "left").select("node", "root", F.least("root", "m").alias("next"))
        up = label.select(F.col("node").alias("p"), F.col("root").alias("pr"))
        new = stored(step.join(up, step["next"] == up["p"], "left")
                     .select("node", F.coalesce(F.least("next", "pr"), "next").alias("root"), F.col("root").alias("old")))
        label = bounded(new.select("node", "root"), n)
        if new.filter("root <> old").isEmpty():
            return label
        ends = [label.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("u", "v")]
        moved = pairs.join(ends[0], "u").join(ends[1], "v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
        pairs = stored(moved.unionByName(new.select(F.col("root").alias("u"), F.col("old").alias("v"))).filter("u <> v").distinct())
