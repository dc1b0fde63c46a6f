"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Documents are summed into cells (source, lang, topic). Raking scales the cells until every marginal has its target share; the
probability of a cell is its raked share over its own tokens, scaled so that the expected tokens are the asked part of all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade.functions.draws import md5_uniform
from rainshade.llm.common import WHITE, spare_names, stored

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
PASSES = 20
KEEP = 0.8
SEED = 7


def token_count(text: Column) -> Column:
    """Words between white space."""
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " "), "")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic by the form of a text: legal, contact, tabular, brief, long or prose."""
    lower = F.lower(text)
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (F.when(F.contains(lower, F.lit("licens")) | F.contains(lower, F.lit("copyright")), "legal").when(F.contains(text, F.lit("@")), "contact")
            .when(bars * 10 > tokens, "tabular").when(tokens < 50, "brief").when(tokens > 1000, "long").otherwise("prose"))


def tempered(cells: DataFrame, temper: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Target shares per dimension: the shares of tokens raised to a power below 1 and made to sum to 1 again."""
    out = {}
    for d, power in (temper or TEMPER).items():
        mass = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("mass"))
        # one row per value of a dimension
        out[d] = mass.select(F.col(d).alias("value"), (F.col("mass") / F.sum("mass").over(Window.partitionBy())).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], passes: int = PASSES, every: int = 5) -> DataFrame:
    """Cells with `weight`: token weights raked to the targets, one row per cell, summing to about 1.

    cells has one row per combination with `tokens`. A value without a target gets share 0. Where no weights can meet all targets
    (missing combinations), the last pass decides: it ends on the last dimension. Cells without tokens keep weight 0.
    """
    held = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, target in targets.items():
        shares = target.select(F.col("value").alias(d), F.col("share").alias(f"_to_{d}"))
        held = held.join(shares, d, "left").fillna(0.0, [f"_to_{d}"])
    held = stored(held)
    for i in range(passes):
        for d in targets:
            # a window holds the cells of one value: bounded by the other dimensions, not by rows
            total = F.sum("weight").over(Window.partitionBy(d))
            held = held.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"_to_{d}") / total).otherwise(F.lit(0.0)))
        if (i + 1) % every == 0 or i == passes - 1:
            held = stored(held)
    return held.drop(*[f"_to_{d}" for d in targets])


def calibrated(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """Cells with `probability` = min(1, lambda * weight / tokens), lambda such that the expected tokens are keep * all tokens."""
    raked = raked.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)))
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    scale, full = 0.0, -1.0
    # cells that a scale fills wholly are set aside and the rest is scaled anew; each round fills more, so it ends
    while full < 0 or scale > full:
        full = scale
        s = raked.agg(F.sum(F.when(F.col("rate") * full >= 1, F.col("tokens"))).alias("whole"), F.sum(F.when(F.col("rate") * full < 1, F.col("weight"))).alias("rest")).first()
        scale = (keep * total - (s["whole"] or 0)) / s["rest"] if s["rest"] else full
        if scale <= full * (1 + 1e-12):
            break
    scale = max(scale, full)
    return raked.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("rate") * scale)).otherwise(F.lit(1.0)))


def with_cells(docs: DataFrame, text_col: str = "text", topic: Column | None = None, source_col: str = "source", lang_col: str = "lang", cell: str = "_cell", tokens: str = "_tokens") -> DataFrame:
    """docs with a struct `cell` of source, lang and topic (null as empty) and a column `tokens`."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    counted = docs.withColumn(tokens, token_count(text))
    return counted.withColumn(cell, F.struct(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
                                             F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
                                             F.coalesce(topic if topic is not None else topic_of(text, F.col(tokens)), F.lit("")).alias("topic")))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
        topic: Column | None = None, passes: int = PASSES, dimensions: Sequence[str] = DIMENSIONS, name: str = "_mix") -> DataFrame:
    """docs with a struct column `name`: source, lang, topic, n_tokens, probability, sampled. No row is dropped here.

    targets maps source, lang and topic to (value, share); by default shares are tempered. Whether a row is sampled depends only on
    (seed, id), so repeated rows share their fate. Null text counts as empty, and documents without tokens in cells without any stay;
    null source or language is the value ''. An empty table gives no rows; columns of docs are kept whatever
    their names, and `name` must be a new one.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has a column {name}")
    cell, tokens, of, share = spare_names(docs, "_cell", "_tokens", "_of", "_share")
    celled = with_cells(docs, text_col, topic, cell=cell, tokens=tokens)
    cells = stored(celled.groupBy(*[F.col(f"{cell}.{d}").alias(d) for d in dimensions]).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("documents")))
    done = stored(calibrated(rake(cells, targets or tempered(cells), passes), keep)).select(F.struct(*dimensions).alias(of), F.col("probability").alias(share))
    # the optimizer broadcasts the cells only while their files are small
    joined = celled.join(done, F.col(cell) == F.col(of))
    sampled = md5_uniform(seed, F.col(f"`{id_col}`")) < F.col(share)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(f"{cell}.*", F.col(tokens).alias("n_tokens"), F.col(share).alias("probability"), sampled.alias("sampled")).alias(name))
