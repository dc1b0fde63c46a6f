"""Near duplicates by word shingles: every pair of texts whose shingle sets have a Jaccard similarity of at least the threshold.

SimHash fingerprints meet under the bit masks of a covering code, which finds every pair within its radius. A cover of
bits for all pairs of similarity 0.8 needs 2^(r+1) - 1 tables with r around a fifth of all bits, which no table
of texts can pay. So for the pairs beyond the masks' radius a second cover is laid over the shingles: two sets of similarity s or more share one of the
first n - ceil(s n) + 1 elements in any common order, so every such pair meets under one of these. Texts that meet there
are told near by SimHash fingerprints of 256 bits in a wide radius. The links of both covers are joined to clusters, and inside a cluster a
link is made only where the exact similarity confirms it. Pairs that meet beyond that radius are counted: sets of similarity s share a least number
of their first elements, and a pair that shares as many is compared by its texts too, so no pair is left to the fingerprints' chance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainshade.llm.common import bounded, components, keyed_texts, same_document, stored
from rainshade.llm.simhash import links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# sets of similarity 0.8 differ in 15 % of the bits, tiny sets in 19 % (48 of 256, standard error 6.2); unrelated ones in half
RADIUS = 88
WORDS = 4
SEED = 42
BLOCK = 2048
EXACT_BLOCK = 512
ROWS = 1 << 16
SAMPLE = 8000
COMMON_SHARE = 0.001
COMMON_LIMIT = 50_000


def shingles(text: bytes, n_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, also one without words."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= n_words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(joined[a:b], seed) for a, b in zip(starts[:len(words) - n_words + 1].tolist(), ends[n_words - 1:].tolist())], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return both / (len(a) + len(b) - both)


def _prints(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 64 * WORDS bits of a set of hashes."""
    out = []
    for k in range(WORDS):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 8192):
            h = hashes[i:i + 8192] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first n - ceil(least n) + 1 elements of a sorted set; common shingles come after all others, the rarest first."""
    n = len(hashes)
    take = n - math.ceil(least * n - 1e-9) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = np.where(common[at] == hashes, rank[at] + 1, 0)
        hashes = hashes[np.argsort(late, kind="stable")]
    return hashes[:take]


def least_shared(sizes: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """How many of their first elements (prefix) two sets of these sizes and a similarity of `least` or more share at least; 0 where sizes exclude it.

    The common elements up to the end of the prefix that ends first lie in both prefixes, and that set has size - len(prefix) elements more.
    """
    short, long = np.minimum(sizes, others), np.maximum(sizes, others)
    both = np.ceil(least / (1 + least) * (short + long) - 1e-9).astype(np.int64)
    rest = np.ceil(least * long - 1e-9).astype(np.int64) - 1
    return np.where(short / long >= least, np.maximum(both - rest, 1), 0)


def _common(texts: DataFrame, n_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts of a sample, sorted, and their ranks. They set only the order of the elements, and any order gives the same pairs."""
    n = texts.count()
    part = min(1.0, SAMPLE / n) if n else 1.0
    sample = texts.filter(F.pmod(F.xxhash64("doc_id", "version"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("content").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, n_words, seed).view(np.int64))], names=["shingle"])

    rows = (sample.select(F.encode("text", "utf-8").alias("content")).mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= max(8, int(COMMON_SHARE * part * n))).orderBy(F.desc("n"), "shingle").limit(COMMON_LIMIT).collect())
    found = np.array([r["shingle"] for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], order


def _sketches(texts: DataFrame, common: np.ndarray, rank: np.ndarray, least: float, n_words: int, seed: int) -> DataFrame:
    """(doc_id, version, size, prints, prefix) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, n_words, seed) for t in b.column("content").to_pylist()]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array([len(s) for s in sets], pa.int32()),
                                              pa.array([_prints(s).view(np.int64) for s in sets], kind),
                                              pa.array([prefix(s, common, rank, least).view(np.int64) for s in sets], kind)],
                                             names=["doc_id", "version", "size", "prints", "prefix"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    content = texts.select("doc_id", "version", F.encode("text", "utf-8").alias("content"))
    return content.mapInArrow(run, f"doc_id {kind}, version long, size int, prints array<long>, prefix array<long>")


def _linked(items: list, near: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray, crossed: bool) -> list[tuple]:
    """Links of one bucket that connect what its near pairs connect, each from the first item of its group, so that buckets of the same items give the same links; of two
    blocks only pairs across them are compared."""
    out, rest = [], np.arange(len(items))
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        frontier = [first]
        while frontier and len(rest):
            x = frontier.pop()
            pool = rest[side[rest] != side[x]] if crossed else rest
            hit = pool[near(x, pool)] if len(pool) else pool
            if len(hit):
                out.extend((items[first], items[int(y)]) for y in hit)
                frontier.extend(hit.tolist())
                rest = rest[~np.isin(rest, hit)]
    return out


def _apart(items: list, found: list[tuple], need: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray, crossed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first items, second items, need) of the pairs of one bucket that its links do not connect, where need is over 0."""
    # each link takes one item into a group
    if len(found) == len(items) - 1:
        return
    nodes, at = np.array(items), {x: i for i, x in enumerate(items)}
    group = np.arange(len(items))
    for a, b in found:
        group[at[b]] = at[a]
    for x in range(len(items) - 1):
        pool = x + 1 + np.flatnonzero((group[x + 1:] != group[x]) & ((side[x + 1:] != side[x]) if crossed else True))
        wanted = need(x, pool)
        pool, wanted = pool[wanted > 0], wanted[wanted > 0]
        if len(pool):
            yield np.full(len(pool), nodes[x]), nodes[pool], wanted


def _buckets(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], list]) -> Iterator[list[tuple]]:
    """Runs of equal (key, one, two) of a sorted partition, each as (node, side, data, (key, one, two))."""
    held: list[tuple] = []
    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in ("key", "one", "two")))
        for row in zip(b.column("node").to_pylist(), b.column("side").to_pylist(), read(b), keys):
            if held and held[-1][3] != row[3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows (key, node, ...) of keys with several rows, with (one, two, side): a key of over `block` rows is cut into blocks, and each pair of blocks is a bucket."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda o: F.struct(F.least(o, F.col("own")).alias("one"), F.greatest(o, F.col("own")).alias("two"), (F.col("own") > o).cast("int").alias("side")))
    return met.select(*rows.columns, F.inline(spread))


def _links(dealt: DataFrame, read: Callable, near: Callable, need: Callable | None = None) -> DataFrame:
    """(a, b, need): links inside the buckets, with need 0; near(data of the bucket) gives the test of one item against some others.

    need(data of the bucket) adds the pairs that a bucket's links do not connect, with their numbers above 0.
    """
    keys, names = ["key", "one", "two"], ["a", "b", "need"]

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in parts]), pa.int64()) for k in range(3)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buckets(batches, read):
            if len(held) < 2:
                continue
            items, data, side, crossed = [r[0] for r in held], [r[2] for r in held], np.array([r[1] for r in held]), held[0][3][1] != held[0][3][2]
            found = _linked(items, near(data), side, crossed)
            parts, n = [(*np.array(found, np.int64).T, np.zeros(len(found), np.int64))] if found else [], len(found)
            for part in _apart(items, found, need(data), side, crossed) if need else ():
                parts.append(part)
                n += len(part[0])
                if n > ROWS:
                    yield batch(parts)
                    parts, n = [], 0
            if parts:
                yield batch(parts)

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long, need long")


def masked_links(sketches: DataFrame) -> DataFrame:
    """(a, b): nodes of (node, prints) whose first 64 bits differ in no more bits than the covering masks allow, enough links to connect all such."""
    own = sketches.select("node", F.col("prints")[0].alias("fingerprint"))
    first = bounded(stored(own.groupBy("fingerprint").agg(F.min("node").alias("first"))))
    name = {c: first.select(F.col("fingerprint").alias(c), F.col("first").alias(f"_{c}")) for c in ("a", "b")}
    near = links(first.select("fingerprint")).join(name["a"], "a").join(name["b"], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return near.unionByName(own.join(first, "fingerprint").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS, least: float = SIMILARITY,
                      seed: int = SEED, block: int = BLOCK, exact_block: int = EXACT_BLOCK) -> DataFrame:
    """One row per row: doc_id, version, component_id, component_version.

    Texts with a Jaccard similarity of `least` or more over their n-word shingles (lower case, white space between words counts as one blank) are
    linked; component_id is the smallest id reachable over links. Null text counts as empty; texts without words are linked with each other. A null id
    comes before all others. Rows with one id and other texts are separate. An empty table gives no rows; other columns are ignored.
    """
    texts = keyed_texts(docs, id_col, text_col)
    common, rank = _common(texts, n_words, seed)
    # the numbers are fixed once they are written
    sketches = stored(_sketches(texts, common, rank, least, n_words, seed).withColumn("node", F.monotonically_increasing_id()))
    rows = sketches.select(F.explode("prefix").alias("key"), "node")
    met = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key").hint("merge"), "key")
    dealt = _dealt(met.join(sketches.select("node", "size", "prints"), "node").select("key", "node", "size", "prints"), block)

    def read_prints(b: pa.RecordBatch) -> list:
        return list(zip(b.column("size").to_pylist(), b.column("prints").to_pylist()))

    def near_prints(data: list) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes, prints = np.array([d[0] for d in data]), np.array([d[1] for d in data], np.int64).view(np.uint64)

        def near(x: int, pool: np.ndarray) -> np.ndarray:
            short, long = np.minimum(sizes[x], sizes[pool]), np.maximum(sizes[x], sizes[pool])
            return (short / long >= least) & (np.bitwise_count(prints[pool] ^ prints[x]).sum(axis=1) <= RADIUS)
        return near

    def needed(data: list) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes = np.array([d[0] for d in data])
        return lambda x, pool: least_shared(sizes[x], sizes[pool], least)

    found = stored(_links(dealt, read_prints, near_prints, needed))
    clusters = components(masked_links(sketches).unionByName(found.filter("need = 0").select("a", "b")))
    # a pair is counted once for each shared element, but where a bucket's links connect it, and then one cluster holds it
    apart = bounded(stored(found.filter("need > 0").groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("n")).filter("n >= need")
                           .select("a", "b", (-1 - F.monotonically_increasing_id()).alias("root"))))
    ends = apart.select("root", F.explode(F.array("a", "b")).alias("node"))
    inside = bounded(stored(sketches.select("node", "doc_id", "version").join(bounded(clusters.unionByName(ends)), "node")))
    held = (texts.alias("t").join(inside.alias("i"), same_document("t", "i")).select(F.col("i.root").alias("key"), F.col("i.node").alias("node"), F.encode("t.text", "utf-8").alias("content"))
            .dropDuplicates(["key", "node"]))

    def read_texts(b: pa.RecordBatch) -> list:
        return [shingles(t, n_words, seed) for t in b.column("content").to_pylist()]

    def near_texts(sets: list) -> Callable[[int, np.ndarray], np.ndarray]:
        def near(x: int, pool: np.ndarray) -> np.ndarray:
            return np.array([similarity(sets[x], sets[y]) >= least for y in pool.tolist()], bool)
        return near

    roots = components(_links(_dealt(stored(held), exact_block), read_texts, near_texts).select("a", "b"))
    rooted = sketches.select("node", "doc_id", "version").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("least"))
    return rooted.join(first, "root").select("doc_id", "version", F.col("least.doc_id").alias("component_id"), F.col("least.version").alias("component_version"))
