"""The pipeline's near-duplicate stage beside brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from rainshade.llm import common, similar
from texts import words


def near_rows():
    """Texts and copies with 0 to 12 changed words of 60 to 300, so similarities lie on both sides of 0.8; chains, short and empty texts."""
    rng, out = random.Random(5), []
    for i in range(40):
        base = words(3000 + i, rng.choice([60, 120, 300])).split()
        out.append(" ".join(base))
        for n in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 13)):
                copy[rng.randrange(len(copy))] = f"changed{rng.randrange(10**6)}"
            out.append(" ".join(copy))
            base = copy if n else base
    out += ["", None, "a b c", "a b  c", "A B C d", "one two three four five six seven eight nine", "one two three four five six seven eight nine ten"]
    return [(1000 - 7 * i, t) for i, t in enumerate(out)]


def brute(rows):
    sets = {d: set(similar.shingles((t or "").encode()).tolist()) for d, t in rows}
    root = {d: d for d in sets}
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in sets}


@pytest.mark.parametrize("blocks", [(2048, 512), (3, 2)])
def test_similar_documents_equal_brute_force(spark, blocks):
    rows, want = near_rows(), brute(near_rows())
    assert 10 < sum(d == r for d, r in want.items()) < len(want) - 10
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df, block=blocks[0], exact_block=blocks[1]).collect()}
    assert got == want


def test_near_stage_keeps_one_of_each_group(spark):
    rows, want = near_rows(), brute(near_rows())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, "").collect()}
    assert kept == {d for d, r in want.items() if d == r}


def test_near_stage_takes_the_covering_masks(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = rng.getrandbits(64)
        rows += [base, base] if i % 3 == 0 else [base, base ^ sum(1 << b for b in rng.sample(range(64), 1 + i % 6))]
    table = [(i, [v - (1 << 64) if v >> 63 else v, 0, 0, 0]) for i, v in enumerate(rows)]
    sketches = spark.createDataFrame(table, "node long, prints array<long>")
    found = {(r["node"], r["root"]) for r in similar.components(similar.masked_links(sketches)).collect()}
    pairs = [(i, i + 1) for i in range(0, 120, 2) if (rows[i] ^ rows[i + 1]).bit_count() <= 4]
    assert found == {(x, p[0]) for p in pairs for x in p} and 20 < len(pairs) < 60
    asked = []
    monkeypatch.setattr(similar, "links", lambda prints, plain=similar.links: asked.append(prints.columns) or plain(prints))
    df = spark.createDataFrame(near_rows()[:20], "doc_id long, text string")
    assert corpus_pipeline.near_stage(spark, df, "").count() and asked == [["fingerprint"]]


# two texts of similarity 0.8 whose fingerprints differ in 91 of 256 bits
FAR = "w72889 w6053 w30398 w72192 w378 w937 w618 w83723 w164262"


def test_similar_texts_with_far_fingerprints_are_linked(spark):
    a, b = (similar.shingles(t.encode()) for t in (FAR, FAR.rsplit(" ", 1)[0]))
    assert similar.similarity(a, b) == 0.8 and np.bitwise_count(similar._prints(a) ^ similar._prints(b)).sum() > similar.RADIUS
    df = spark.createDataFrame([(7, FAR), (3, FAR.rsplit(" ", 1)[0]), (5, FAR.split(" ", 1)[1] + " more words at the end")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, "").collect()} == {3, 5}


@pytest.mark.parametrize("blocks, radius", [((2048, 512), -1), ((3, 2), -1), ((3, 2), 30)])
def test_every_pair_is_found_whatever_the_fingerprints_say(spark, monkeypatch, blocks, radius):
    monkeypatch.setattr(similar, "RADIUS", radius)
    rows, want = near_rows(), brute(near_rows())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df, block=blocks[0], exact_block=blocks[1]).collect()}
    assert got == want


def test_least_shared_is_a_bound():
    rng, tight = np.random.default_rng(9), 0
    for _ in range(2000):
        n, gone, new = int(rng.integers(1, 120)), int(rng.integers(0, 12)), int(rng.integers(0, 12))
        both = rng.integers(0, 1 << 62, n).astype(np.uint64)
        a, b = np.unique(both), np.unique(np.concatenate((both[gone:], rng.integers(0, 1 << 62, new).astype(np.uint64))))
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(b) and similar.similarity(a, b) >= 0.8:
            need, shared = int(similar.least_shared(np.array(len(a)), np.array(len(b)), 0.8)), len(np.intersect1d(similar.prefix(a, *none, 0.8), similar.prefix(b, *none, 0.8)))
            assert 1 <= need <= shared
            tight += need == shared
    assert tight and similar.least_shared(np.array([5, 4, 3, 300]), np.array([3, 5, 3, 300]), 0.8).tolist() == [0, 1, 1, 28]


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, int(rng.integers(0, 5))).astype(np.uint64))))
        common = np.sort(rng.choice(a, len(a) // 2, replace=False))
        rank = rng.permutation(len(common))
        if len(b) and similar.similarity(a, b) >= 0.8:
            assert set(similar.prefix(a, common, rank, 0.8).tolist()) & set(similar.prefix(b, common, rank, 0.8).tolist())


def test_empty_table(spark, empty):
    assert similar.similar_documents(empty).count() == 0


def test_edges_inside_a_group_fall_together(spark, monkeypatch):
    # a group of 200 nodes with 3,000 edges, a chain in mixed order, and pairs
    rng, edges = random.Random(8), []
    edges += [tuple(rng.sample(range(200), 2)) for _ in range(3000)]
    chain = [1000 + (7 * i) % 97 for i in range(97)]
    edges += list(zip(chain, chain[1:])) + [(2000 + i, 3000 + i) for i in range(50)] + [(5, 5), (4000, 4000)]
    written, plain = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df: written.append(plain(df)) or written[-1])
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: 0 if x < 200 else 1000 if x < 2000 else 2000 + x % 1000 for x in touched}
    kept = [w.count() for w in written if w.columns == ["u", "v"]]
    assert kept[0] > 2500 and kept[2] < 400 and len(kept) > 2


def test_links_of_a_bucket_start_at_the_first_of_a_group():
    # whatever the pairs are that a bucket finds near first, buckets of the same items give the same links
    found = similar._linked([3, 4, 5, 6, 7, 8], lambda x, pool: np.abs(pool - x) <= 2, np.zeros(6, int), False)
    assert sorted(found) == [(3, y) for y in range(4, 9)]
