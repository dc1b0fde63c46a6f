"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are lower-case words weighted by their count. For sample k of a term of weight w, with r and c from Gamma(2, 1) and
beta from U(0, 1), all fixed by a hash of (term, k): t = floor(ln w / r + beta) and ln a = ln c - r * (t - beta + 1).
The pair (term, t) of the smallest a is the sample; two documents agree in it with the probability
sum(min) / sum(max) of their weights, the generalised Jaccard similarity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshade.llm.common import WHITE, keyed_texts, stored

SAMPLES = 32
EMPTY = 2 ** 63 - 1


def words(text: Column) -> Column:
    """Lower-case words between white space; an empty string stands where two white-space characters meet."""
    text = F.lower(text)
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ")


def _uniform(h: Column, shift: int) -> Column:
    """21 of the hash's bits as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0x1FFFFF)) + F.lit(0.5)) * F.lit(2.0 ** -21)


def _sample(term: Column, log_weight: Column, k: int) -> Column:
    """ln a in the high half and a hash of (term, t) in the low half of one long, so that min() picks the sample.

    Two hashes of (term, k) give five uniforms; Gamma(2, 1) is the negative logarithm of the product of two.
    """
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(_uniform(h, 0) * _uniform(h, 21))
    log_c = F.log(-F.log(_uniform(g, 0) * _uniform(g, 21)))
    beta = _uniform(h, 42)
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta + 1)
    # fixed point in steps of 2^-24: ln a stays inside +-127 for weights up to e^60
    return F.shiftleft((log_a * F.lit(2.0 ** 24)).cast("long"), 32) + term.bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF))


def _minima(counted: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """keys + s0..s{n-1}: the smallest sample of every (keys) group over rows of (_term, _weight)."""
    # the logarithm of weight 0 is null, which min() passes over
    logged = counted.withColumn("_lw", F.log(F.col("_weight").cast("double")))
    return logged.groupBy(*keys).agg(*[F.min(_sample(F.col("_term"), F.col("_lw"), k)).alias(f"s{k}") for k in range(samples)])


def fingerprint_text(samples: list[Column]) -> Column:
    """The low halves of the samples as 8 lower-case hex digits each; a document without words has the halves of EMPTY."""
    low = [F.coalesce(s, F.lit(EMPTY)).bitwiseAND(F.lit(0xFFFFFFFF)) for s in samples]
    return F.lower(F.concat(*[F.lpad(F.hex(x), 8, "0") for x in low]))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree, an unbiased estimate of the generalised Jaccard similarity."""
    same = [(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples)]
    return reduce(lambda x, y: x + y, same) / F.lit(float(samples))


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """keyed_texts with _id, a text form of the id that is never null, to deal rows out by."""
    return keyed_texts(docs, id_col, text_col).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per document: doc_id, version, fingerprint.

    Null text counts as empty; texts without words share one fingerprint. Rows equal in id and text are one document, rows with
    one id and other texts are separate. Equal texts have equal fingerprints. An empty table gives no rows; other columns are ignored.
    """
    keys = ["_id", "version"]
    dealt = _row_keys(docs, id_col, text_col).repartition(*keys).dropDuplicates(keys)
    terms = dealt.select(*keys, "doc_id", F.explode(words(F.col("text"))).alias("_word")).select(
        *keys, "doc_id", F.xxhash64("_word").alias("_term"), (F.col("_word") != "").cast("int").alias("n"))
    counted = terms.groupBy(*keys, "doc_id", "_term").agg(F.sum("n").alias("_weight"))
    signed = _minima(counted, [*keys, "doc_id"], samples)
    return signed.select("doc_id", "version", fingerprint_text([F.col(f"s{k}") for k in range(samples)]).alias("fingerprint"))


def next_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_no, _id, version, doc_id, n_chars, next_no): documents numbered in ascending id; after the last comes the first.

    Only keys are sorted: ranges are numbered within themselves and then shifted by the sizes of the ranges before.
    """
    texts = _row_keys(docs, id_col, text_col)
    keys = texts.groupBy("_id", "version", "doc_id").agg(F.min(F.char_length("text").cast("long")).alias("n_chars"))
    spread = stored(keys.repartitionByRange("doc_id", "version").withColumn("part", F.spark_partition_id()))
    # one row per range, so one task is enough
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "version")) - 1
    row_no = (F.col("rank") + F.col("before")).cast("long")
    return (spread.withColumn("rank", rank).join(F.broadcast(sizes), "part")
            .select(row_no.alias("row_no"), "_id", "version", "doc_id", "n_chars", F.pmod(row_no + 1, F.col("total")).alias("next_no")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by the start of the next document.

    One row per document: doc_id, version, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The last
    floor(n_chars / 4) code points give way to the first as many (or all) of the next document in ascending (id, version); after
    the last comes the first. Null text counts as empty; a table of one document is its own next. Repeated rows are one document.
    near_edited and near_next are means over the samples, with a standard error of sqrt(p (1 - p) / samples): up to 0.09 with 32 samples.
    """
    keys = ["_id", "version"]
    numbered = stored(next_documents(docs, id_col, text_col))
    asked = numbered.select(F.col("next_no").alias("row_no"), F.col("_id").alias("for_id"), F.col("version").alias("for_version"),
                            F.floor(F.col("n_chars") / 4).cast("int").alias("need"))
    # repeated rows end here, in the exchange that the joins need anyway
    texts = _row_keys(docs, id_col, text_col).select(*keys, "text").repartition(*keys).dropDuplicates(keys)
    starts = (texts.join(numbered.join(asked, "row_no"), keys)
              .select(F.col("for_id").alias("_id"), F.col("for_version").alias("version"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("start")))
    own = texts.join(numbered.select(*keys, "n_chars"), keys)
    q = F.floor(F.col("n_chars") / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - q)
    both = own.join(starts, keys).select(*keys, "text", head.alias("head"),
                                         F.concat(head, F.col("start")).alias("edited"))
    # words wholly before the cut are in both texts, so they are listed once
    listed = both.select(*keys, F.unhex(F.sha2("edited", 256)).alias("sha"), words(F.col("text")).alias("w"), words(F.col("edited")).alias("e"),
                         F.greatest(F.size(words(F.col("head"))) - 1, F.lit(0)).alias("c"))
    tail = lambda a: F.slice(F.col(a), F.col("c") + 1, F.greatest(F.size(a) - F.col("c"), F.lit(0)))
    parts = F.array(F.struct(F.lit(3).alias("side"), F.slice("w", F.lit(1), F.col("c")).alias("words")),
                    F.struct(F.lit(1).alias("side"), tail("w").alias("words")), F.struct(F.lit(2).alias("side"), tail("e").alias("words")))
    terms = (listed.select(*keys, "sha", F.inline(parts)).select(*keys, "sha", "side", F.explode("words").alias("_word"))
             .select(*keys, "sha", "side", F.xxhash64("_word").alias("_term"), (F.col("_word") != "").cast("int").alias("n")))
    counted = terms.groupBy(*keys, "sha", "_term").agg(F.sum(F.col("n") * F.col("side").bitwiseAND(F.lit(1))).alias("n1"),
                                                       F.sum(F.col("n") * F.shiftright("side", 1)).alias("n2"))
    # a term of equal weight in both texts is sampled once for both
    sided = F.when(F.col("n1") == F.col("n2"), F.array(F.struct(F.lit(3).alias("side"), F.col("n1").alias("_weight")))).otherwise(
        F.array(F.struct(F.lit(1).alias("side"), F.col("n1").alias("_weight")), F.struct(F.lit(2).alias("side"), F.col("n2").alias("_weight"))))
    weighted = counted.select(*keys, "sha", "_term", F.inline(sided))
    minima = _minima(weighted, [*keys, "sha", "side"], samples)
    of = lambda side, k: F.min(F.when(F.col("side").bitwiseAND(F.lit(side)) != 0, F.col(f"s{k}")))
    gathered = minima.groupBy(*keys, "sha").agg(*[of(1, k).alias(f"a{k}") for k in range(samples)], *[of(2, k).alias(f"b{k}") for k in range(samples)])
    printed = gathered.select(*keys, F.lower(F.hex("sha")).alias("edited_sha256"), fingerprint_text([F.col(f"a{k}") for k in range(samples)]).alias("fingerprint"),
                              fingerprint_text([F.col(f"b{k}") for k in range(samples)]).alias("edited_fingerprint"))
    signed = stored(printed.join(numbered, keys).select("row_no", "next_no", "doc_id", "version", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"))
    after = signed.select(F.col("row_no").alias("next_no"), F.col("fingerprint").alias("next_fingerprint"))
    return signed.join(after, "next_no").select(
        "doc_id", "version", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"))
