"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of the last WINDOW lines makes most lines anchors. A chunk goes from one anchor to the next and holds both, so
its bounds depend on nothing outside it, and neighbouring chunks share a line: a passage that two texts share has the same chunks in both wherever it stands. Chunks of
several lines that occur more than once are compared byte by byte with their first occurrence, which stays; the lines of the others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainshade.llm.common import keyed_texts, same_document, stored

WINDOW = 1
# a passage is found from its first anchor to its last one: at 31/32 two shared lines are found with a probability of 0.94
ANCHOR_SHARE = 31 / 32
MIN_LINES = 2
COPIES_PER_FIRST = 256
# bits of the filter that keeps texts without repeated chunks from being dealt out for the comparison
FILTER_BITS = 1 << 24
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def cut_lines(content: bytes, window: int = WINDOW, share: float = ANCHOR_SHARE, min_lines: int = MIN_LINES) -> list[tuple[int, int, int]]:
    """(start, n_bytes, n_lines) of the chunks of min_lines or more lines of a text; line ends belong to their lines.

    The ends of the text are bounds too. A share of 1 makes every line an anchor and every two neighbours a chunk.
    """
    lines = [x + b"\n" for x in content.split(b"\n")]
    lines[-1] = lines[-1][:-1]
    if not lines[-1]:
        lines.pop()
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line))
    out, hashes, rolling, first, limit = [], [], 0, 0, int(share * (1 << 32))
    # the leaving line's factor in the rolling hash
    leave = pow(_BASE, window, 1 << 64)
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line.rstrip(b"\n"))
        hashes.append(h)
        rolling = (rolling * _BASE + h - (hashes[-1 - window] * leave if len(hashes) > window else 0)) & _MASK
        anchor = i >= window - 1 and rolling >> 32 < limit
        if (anchor or i == len(lines) - 1) and i + 1 - first >= min_lines:
            out.append((at[first], at[i + 1] - at[first], i + 1 - first))
        if anchor:
            first = i - window + 1
    return out


def chunks(texts: DataFrame, window: int = WINDOW, share: float = ANCHOR_SHARE, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, version, start, n_bytes, hash) of every chunk; the hash leaves out a line end at the chunk's end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, content in enumerate(b.column("content").to_pylist()):
                for s, size, _ in cut_lines(content, window, share, min_lines):
                    rows.append(i)
                    found.append((s, size, xxhash.xxh64_intdigest(content[s:s + size].removesuffix(b"\n")) - (1 << 63)))
            take = pa.array(rows, pa.int32())
            cols = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("version").take(take), *cols], names=["doc_id", "version", "start", "n_bytes", "hash"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    content = texts.select("doc_id", "version", F.encode("text", "utf-8").alias("content"))
    return content.mapInArrow(run, f"doc_id {kind}, version long, start long, n_bytes long, hash long")


def _listed(texts: DataFrame, lists: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Texts whose document may be in lists: a filter of fixed size over hashes of the keys, so it lets all of them pass and, while they are few, hardly any other.

    It only spares an exchange; the join that follows decides.
    """
    at = F.pmod(F.xxhash64("doc_id", "version"), F.lit(bits))
    # rows of 4 KiB, bits / 32,768 of them at most; buckets and their bits count from 1
    rows = lists.select((at + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    words = np.zeros(bits // 64, np.int64)
    for r in rows:
        first = (r["bucket"] - 1) * 512
        words[first:first + 512] = np.frombuffer(bytes(r["bits"]), "<i8")
    table = F.from_json(F.lit("[" + ",".join(map(str, words.tolist())) + "]"), "array<bigint>")
    word = F.get(table, F.shiftright(at, 6).cast("int"))
    return texts.filter(F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)


def _compared(texts: DataFrame, members: DataFrame) -> DataFrame:
    """members (doc_id, version, start, n_bytes, hash) with `first`, the smallest (doc_id, version, start) of the hash, and `same`.

    A document's chunks are cut out of it in one place, by a shuffled join at every size of the lists; first occurrences are repeated once for every COPIES_PER_FIRST members.
    """
    # hashes that occur once end here; what follows is dealt out by the hash already
    repeated = members.join(members.groupBy("hash").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "hash")
    groups = repeated.groupBy("hash").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"))
    wanted = repeated.join(groups, "hash").select("doc_id", "version", F.struct("start", "n_bytes", "hash", "first", F.ceil(F.col("members") / COPIES_PER_FIRST).cast("int").alias("salts")).alias("c"))
    lists = stored(wanted.groupBy("doc_id", "version").agg(F.collect_set("c").alias("cs")))
    held = _listed(texts, lists).alias("t").join(lists.hint("merge").alias("l"), same_document("t", "l")).select(F.col("t.doc_id"), F.col("t.version"), F.encode("text", "utf-8").alias("content"), "cs")
    pieces = held.select("doc_id", "version", F.inline(F.transform("cs", lambda c: F.struct(
        c["start"].alias("start"), c["n_bytes"].alias("n_bytes"), c["hash"].alias("hash"), c["first"].alias("first"), c["salts"].alias("salts"),
        F.substring(F.col("content"), c["start"].cast("int") + 1, c["n_bytes"].cast("int")).alias("piece")))))
    # a chunk at the end of a text has no line end
    pieces = pieces.withColumn("piece", F.when(F.substring("piece", -1, 1) == F.lit(b"\n"), F.substring(F.col("piece"), F.lit(1), F.octet_length("piece") - 1)).otherwise(F.col("piece")))
    own = F.struct("doc_id", "version", "start")
    first = pieces.filter(own == F.col("first")).select("hash", F.col("piece").alias("first_piece"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).dropDuplicates(["hash", "salt"])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "version", "start"), F.col("salts")).cast("int"))
    return salted.join(first, ["hash", "salt"]).select("doc_id", "version", "start", "n_bytes", "hash", "first", F.octet_length("piece").alias("body"), (F.col("piece") == F.col("first_piece")).alias("same"))


def repeated_chunks(texts: DataFrame, cut: DataFrame) -> DataFrame:
    """(doc_id, version, start, n_bytes) of the chunks that repeat an earlier one, byte for byte; of one that begins inside its first occurrence only what follows that."""
    pending, parts = cut.select("doc_id", "version", "start", "n_bytes", "hash"), []
    # a round more only where chunks differ in spite of equal hashes
    while True:
        compared = stored(_compared(texts, pending))
        own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
        begin = F.when(own, F.greatest("start", F.col("first.start") + F.col("body") + 1)).otherwise(F.col("start"))
        repeats = compared.filter("same").filter(~(own & (F.col("start") == F.col("first.start")))).withColumn("begin", begin)
        parts.append(repeats.select("doc_id", "version", F.col("begin").alias("start"), (F.col("start") + F.col("n_bytes") - F.col("begin")).alias("n_bytes")).filter("n_bytes > 0"))
        rest = compared.filter("not same").select("doc_id", "version", "start", "n_bytes", "hash")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        pending = rest


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: float = ANCHOR_SHARE,
                          min_lines: int = MIN_LINES) -> DataFrame:
    """One row per row: doc_id, version, text (what stays), n_lines, n_removed_lines, n_removed_chunks (maximal removed runs), n_removed_bytes.

    Lines end at \\n. The occurrence that comes first by (id, version, place) stays; a null id comes first of all. Null text counts as empty and
    has no lines. Rows equal in id and text are one document that is given back as often as it comes; rows with one id and other texts
    are separate, and so may repeat each other. An empty table gives no rows; other columns are ignored.
    """
    texts = keyed_texts(docs, id_col, text_col)
    cut = stored(chunks(texts, window, share, min_lines))
    gone = repeated_chunks(texts, cut)
    lists = gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("start", "n_bytes"))).alias("gone"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, counts = [], []
            for content, spans in zip(b.column("content").to_pylist(), b.column("gone").to_pylist()):
                parts, runs, at = [], [], 0
                for s in spans or ():
                    start, end = s["start"], s["start"] + s["n_bytes"]
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(end, runs[-1][1])
                    else:
                        runs.append([start, end])
                for start, end in runs:
                    parts.append(content[at:start])
                    at = end
                parts.append(content[at:])
                lost = [content[start:end] for start, end in runs]
                lines = [x.count(b"\n") + (not x.endswith(b"\n") and x != b"") for x in (content, *lost)]
                kept.append(b"".join(parts).decode())
                counts.append((lines[0], sum(lines[1:]), len(lost), sum(map(len, lost))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(kept, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4))],
                                             names=["doc_id", "version", "text", "n_lines", "n_removed_lines", "n_removed_chunks", "n_removed_bytes"])

    held = (texts.alias("t").join(lists.hint("merge").alias("l"), same_document("t", "l"), "left")
            .select(F.col("t.doc_id").alias("doc_id"), F.col("t.version").alias("version"), F.encode("text", "utf-8").alias("content"), "gone"))
    return held.mapInArrow(run, f"doc_id {kind}, version long, text string, n_lines long, n_removed_lines long, n_removed_chunks long, n_removed_bytes long")
