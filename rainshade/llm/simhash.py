"""SimHash near duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a code phi(i) in {1 .. 2^(r+1) - 1}. Table v keeps the bits whose code has an odd number of
bits in common with v. Any r codes leave some v orthogonal to all of them, so two fingerprints that differ in at most r
bits agree on all kept bits of that table: every pair within the radius meets in some table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainshade.llm.common import components, keyed_texts, stored

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BLOCK = 2048


def _fingerprint(text: bytes, n_words: int, seed: int) -> int:
    """SimHash of the n-word shingles of a text, as an unsigned 64-bit number; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= n_words:
        hashes = [hash_of(joined, seed)]
    else:
        # each word starts one byte after the end of the word before
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [hash_of(joined[a:b], seed) for a, b in zip(starts[:len(words) - n_words + 1].tolist(), ends[n_words - 1:].tolist())]
    counts, n = np.zeros(64, np.int64), len(hashes)
    h = np.array(hashes, np.uint64)
    for i in range(0, n, 8192):
        bits = np.unpackbits(h[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(texts: DataFrame, n_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, version, fingerprint): the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([_fingerprint(t, n_words, seed) for t in b.column("content").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(prints)], names=["doc_id", "version", "fingerprint"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    content = texts.select("doc_id", "version", F.encode("text", "utf-8").alias("content"))
    return content.mapInArrow(run, f"doc_id {id_type}, version long, fingerprint long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One bit mask per table; bit i has the code 1 + i mod (2^(r+1) - 1), so codes are spread evenly."""
    size = 2 ** (radius + 1) - 1
    codes = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, size + 1)]


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within the radius connect, without listing all of them.

    Of one block (b is None) a search that compares a reached print only with the prints not reached yet; of two blocks
    each print is linked with every print of the other side that no earlier print of this side has reached.
    """
    u, v = [], []
    if b is None:
        rest = a
        while len(rest) > 1:
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                x = frontier.pop()
                near = np.bitwise_count(rest ^ x) <= radius
                hit = rest[near]
                if len(hit):
                    u.append(np.full(len(hit), x))
                    v.append(hit)
                    frontier.extend(hit)
                    rest = rest[~near]
    else:
        # components across two blocks: a search that alternates between the sides
        left, right = a, b
        while len(left) and len(right):
            frontier, left = [(0, left[0])], left[1:]
            while frontier and (len(left) or len(right)):
                side, x = frontier.pop()
                pool = right if side == 0 else left
                near = np.bitwise_count(pool ^ x) <= radius
                hit = pool[near]
                if len(hit):
                    u.append(np.full(len(hit), x))
                    v.append(hit)
                    frontier.extend((1 - side, h) for h in hit)
                    if side == 0:
                        right = right[~near]
                    else:
                        left = left[~near]
    if not u:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(u), np.concatenate(v)


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of one sorted partition. A bucket is a run of equal (key, left, right); a row's side tells its block."""
    held: pa.Table | None = None

    def links(t: pa.Table) -> pa.RecordBatch:
        names = ["table", "key", "one", "two"]
        cols = [t.column(c).to_numpy() for c in names]
        prints, side = t.column("fingerprint").to_numpy().view(np.uint64), t.column("side").to_numpy()
        new = np.zeros(len(prints), bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(prints))
        sizes = ends - starts
        us, vs = [], []
        # runs of two are the most common, so they are compared at once
        two = starts[sizes == 2]
        ok = np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius
        us.append(prints[two[ok]])
        vs.append(prints[two[ok] + 1])
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            p, d = prints[s:e], side[s:e]
            a, b = _forest(p[d == 0], p[d == 1], radius) if cols[2][s] != cols[3][s] else _forest(p, None, radius)
            us.append(a)
            vs.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        # the last run may go on in the next batch
        last = [held.column(c)[held.num_rows - 1].as_py() for c in ("table", "key", "one", "two")] if held.num_rows else None
        if last is None:
            continue
        same = np.ones(held.num_rows, bool)
        for c, x in zip(("table", "key", "one", "two"), last):
            same &= held.column(c).to_numpy() == x
        cut = held.num_rows - int(same.sum())
        if cut:
            yield links(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield links(held.combine_chunks())


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): distinct fingerprints within the radius, enough links to connect all that such links connect.

    prints has one row per distinct fingerprint. A bucket of over `block` fingerprints is cut into blocks, and every pair of its
    blocks becomes a bucket of its own, so no bucket is held by one task and no pair is lost.
    """
    masks = F.array(*[F.lit(m - 2 ** 64 if m >= 2 ** 63 else m) for m in covering_masks(radius)])
    rows = prints.select("fingerprint", F.posexplode(masks).alias("table", "mask")).select(
        "fingerprint", "table", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"))
    sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark takes the rows exploded over the masks for as small as the prints and would broadcast them
    met = stored(rows.join(sizes.hint("merge"), ["table", "key"]))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    small = met.filter(F.col("n") <= block).select("fingerprint", "table", "key", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side"))
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda o: F.struct(F.least(o, F.col("own")).alias("one"), F.greatest(o, F.col("own")).alias("two"), (F.col("own") > o).cast("int").alias("side")))
    large = (met.filter(F.col("n") > block).select("fingerprint", "table", "key", blocks.alias("blocks"), own.alias("own"))
             .select("fingerprint", "table", "key", F.inline(spread)))
    keys = ["table", "key", "one", "two"]
    dealt = small.unionByName(large).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _bucket_links(batches, radius)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS, radius: int = RADIUS,
                    seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, version, fingerprint (16 hex digits), component_id, component_version.

    Fingerprints within `radius` bits are linked; component_id is the smallest id reachable over links. Null text counts as empty;
    a text without words has the fingerprint 0 and is linked like any other. A null id comes before all others. Rows equal in id
    and text are one document; rows with one id and other texts are separate. An empty table gives no rows; other columns are ignored.
    """
    own = stored(fingerprints(keyed_texts(docs, id_col, text_col), n_words, seed)).distinct()
    prints = stored(own.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "version")).alias("first")))
    roots = components(links(prints.select("fingerprint"), radius, block))
    rooted = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    by_print = rooted.join(least, "root").select("fingerprint", "least")
    return own.join(by_print, "fingerprint").select(
        "doc_id", "version", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"), F.col("least.version").alias("component_version"))
