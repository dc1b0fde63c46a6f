"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing the texts chunk by chunk.

The fingerprint of a byte string b is its value as a base-256 number modulo a prime. Chunks are hashed in parallel;
(h1, s1) followed by (h2, s2) has the fingerprint (h1 * s2 + h2, s1 * s2), where s is 256 to the chunk's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshade.llm.common import keyed_texts, same_document, stored, without_white

# 2^62 - 57 is prime and 256 has an order above 2^60 modulo it
PRIME = 2 ** 62 - 57
CHUNK_BYTES = 1 << 20
COMPARE_BYTES = 1 << 16
COPIES_PER_LEADER = 256


def _hash_pieces(batches: Iterator[pa.RecordBatch], prime: int = PRIME) -> Iterator[pa.RecordBatch]:
    """Normalise each piece and give its length, its value modulo the prime, and the shift it needs on its left."""
    for batch in batches:
        sizes, hashes, shifts = [], [], []
        for piece in batch.column("piece").to_pylist():
            b = piece.translate(None, b" \t\n\x0b\x0c\r")
            sizes.append(len(b))
            hashes.append(int.from_bytes(b, "big") % prime)
            shifts.append(pow(256, len(b), prime))
        rest = [batch.column(c) for c in ("doc_id", "version", "n_chars", "no")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64()), pa.array(shifts, pa.int64())],
                                         names=["doc_id", "version", "n_chars", "no", "n_bytes", "hash", "shift"])


def cut(content: Column, size: int) -> Column:
    """Array of (no, piece): the binary content in pieces of a fixed size; one empty piece for empty content."""
    last = F.greatest(F.ceil(F.octet_length(content) / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), F.substring(content, i * size + 1, F.lit(size)).alias("piece")))


def fingerprints(texts: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, version, n_chars, n_bytes, fingerprint) of the text without white space, one row per document.

    Pieces of texts over one chunk are dealt out to other tasks and combined by length-shifted arithmetic.
    """
    raw = texts.select("doc_id", "version", F.char_length("text").cast("long").alias("n_chars"), F.encode("text", "utf-8").alias("content"))
    short = raw.filter(F.octet_length("content") <= chunk_bytes).select("doc_id", "version", "n_chars", F.lit(0).alias("no"), F.col("content").alias("piece"))
    long = (raw.filter(F.octet_length("content") > chunk_bytes).select("doc_id", "version", "n_chars", F.inline(cut(F.col("content"), chunk_bytes)))
            .repartition("doc_id", "version", "no"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, version long, n_chars long, no int, n_bytes long, hash long, shift long"
    hashed = short.mapInArrow(_hash_pieces, schema).unionByName(long.mapInArrow(_hash_pieces, schema))
    # a set: rows that repeat one document give the same pieces
    pieces = hashed.groupBy("doc_id", "version", "n_chars").agg(F.array_sort(F.collect_set(F.struct("no", "hash", "shift", "n_bytes"))).alias("pieces"))
    wide = "decimal(38,0)"
    combined = F.aggregate("pieces", F.lit(0).cast(wide),
                           lambda acc, p: ((acc * p["shift"].cast("decimal(19,0)") + p["hash"]) % F.lit(PRIME).cast("decimal(19,0)")).cast(wide))
    return pieces.select("doc_id", "version", "n_chars", F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["n_bytes"]).alias("n_bytes"),
                         F.when(F.size("pieces") == 1, F.element_at("pieces", 1)["hash"]).otherwise(combined.cast("long")).alias("fingerprint"))


def _confirmed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, version, leader, same) for documents that share a fingerprint: compared with the group's leader, chunk by chunk.

    Leaders are repeated once for every COPIES_PER_LEADER members, so a group of any size is spread over many tasks.
    """
    groups = found.groupBy("fingerprint", "n_bytes").agg(F.min(F.struct("doc_id", "version")).alias("leader"), F.count(F.lit(1)).alias("members"))
    wanted = found.join(groups.filter("members > 1"), ["fingerprint", "n_bytes"]).select(
        "doc_id", "version", "leader", F.ceil(F.col("members") / COPIES_PER_LEADER).cast("int").alias("salts"))
    content = texts.alias("t").join(wanted.alias("w"), same_document("t", "w")).select(
        F.col("t.doc_id"), F.col("t.version"), "leader", "salts", F.encode(without_white(F.col("text")), "utf-8").alias("content"))
    pieces = content.select("doc_id", "version", "leader", "salts", F.inline(cut(F.col("content"), COMPARE_BYTES)))
    own = F.struct("doc_id", "version")
    first = (pieces.filter(own == F.col("leader")).dropDuplicates(["doc_id", "version", "no"])
             .select("leader", "no", F.col("piece").alias("first"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    members = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "version"), F.col("salts")).cast("int"))
    on = members["leader"].eqNullSafe(first["leader"]) & (members["no"] == first["no"]) & (members["salt"] == first["salt"])
    return (members.join(first, on, "left").select("doc_id", "version", members["leader"], F.coalesce(F.col("piece") == F.col("first"), F.lit(False)).alias("same"))
            .groupBy("doc_id", "version", "leader").agg(F.min("same").alias("same")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, version, n_chars, n_bytes, fingerprint, keep_id, keep_version, group_size, kept.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; the row with most code points, then the smallest id, stays.
    Null text counts as empty, a null id is the smallest id. Rows equal in id and text are one document; rows with one id and
    different texts are separate documents (version tells them apart). An empty table gives no rows; other columns are ignored.
    """
    texts = keyed_texts(docs, id_col, text_col)
    prints = stored(fingerprints(texts, chunk_bytes))
    pending, parts = prints.select("doc_id", "version", "fingerprint", "n_bytes"), []
    # a round more only where texts differ in spite of equal fingerprints
    while True:
        compared = stored(_confirmed(texts, pending))
        parts.append(compared.filter("same").select("doc_id", "version", "leader"))
        rest = compared.filter("not same")
        if rest.isEmpty():
            break
        pending = pending.alias("p").join(rest.alias("r"), same_document("p", "r"), "left_semi")
    classes = reduce(DataFrame.unionByName, parts)
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id"), F.col("version"))
    grouped = prints.alias("p").join(classes.alias("c"), same_document("p", "c")).select("p.*", "leader")
    best = grouped.groupBy("leader").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    in_group = grouped.join(best, grouped["leader"].eqNullSafe(best["leader"])).select(
        *prints.columns, F.col("best.doc_id").alias("keep_id"), F.col("best.version").alias("keep_version"), "group_size")
    alone = prints.alias("p").join(classes.alias("c"), same_document("p", "c"), "left_anti").select(
        *prints.columns, F.col("doc_id").alias("keep_id"), F.col("version").alias("keep_version"), F.lit(1).cast("long").alias("group_size"))
    return in_group.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("version") == F.col("keep_version")))
