"""Ranked search against scores of every document."""

import math
import random
import re

import numpy as np

from rainshade.llm import search
from texts import words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    """(item, rank, doc, score) by scoring every document for every item."""
    split = [(d, terms(t)) for d, t in docs]
    split = [(d, t, {x: t.count(x) for x in set(t)}) for d, t in split if t]
    n_all, l_all = len(split), sum(len(t) for _, t, _ in split)
    out = []
    for item, text in items:
        scored = []
        asked = terms(text)
        weight = {x: math.floor(1000 * math.log((2 * n_all + 2) / (2 * sum(x in c for _, _, c in split) + 1))) for x in set(asked)}
        for d, t, c in split:
            m = 100 - 75 + 75 * len(t) * n_all // l_all
            score = sum(weight[x] * (10 ** 9 * c[x] // (1000 * c[x] + 8 * m)) for x in asked if x in c)
            if score > 0:
                scored.append((-score, (d is not None, d), d))
        scored.sort(key=lambda x: x[:2])
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:top])]
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = words(1, 120).split() + ["Äpfel", "äpfel", "日本", "x1", "42"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))) for i in range(300)]
    copied = docs[17][1] + " " + docs[18][1]
    docs += [(1000 + i, copied.upper() if i % 2 else copied) for i in range(40)]  # equal scores over many documents
    docs += [(17, docs[17][1]), (None, docs[18][1]), (None, docs[18][1]), (500, None), (501, ""), (502, " \n.,;"), (503, " ".join(rng.choices(vocabulary, k=30_000)))]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(25)]
    items += [(100, copied), (101, None), (102, ""), (103, "nowhere"), (104, vocabulary[0] + " " + (vocabulary[1] + ", ") * 50), (3, "twice"), (3, vocabulary[2]), (None, vocabulary[3])]
    return docs, items


def test_every_document_scored(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], "doc_id long, text string, rank long, term string, score long").repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    want = sorted(plain(docs, items), key=repr)
    for kwargs in ({}, {"block_documents": 7}, {"block_postings": 50, "item_chars": 1500}):
        got = search.search(frame, asked, **kwargs)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.search(docs, items).collect()] == [(1, 1, 1)]


def test_sparse_table_of_maxima():
    rng = np.random.default_rng(2)
    term, doc = np.repeat(np.arange(6), [1, 2, 3, 50, 64, 7]), np.concatenate([np.arange(n) for n in [1, 2, 3, 50, 64, 7]])
    block = search.Block(term, doc, rng.integers(0, 20, len(term)), 64)
    start = np.searchsorted(block.term, np.arange(6))
    for t, n in enumerate([1, 2, 3, 50, 64, 7]):
        lo, hi = np.triu_indices(n + 1)
        place = block.maxima(start[t] + lo, start[t] + hi)
        for a, b, p in zip(start[t] + lo, start[t] + hi, place):
            assert p == -1 if a == b else a <= p < b and block.impact[p] == block.impact[a:b].max()


def test_most_documents_are_not_scored(spark):
    # the split documents are few against all: intervals without a chance are dropped
    rng = np.random.default_rng(1)
    n, t = 4000, 6
    term, doc = np.repeat(np.arange(t), n), np.tile(np.arange(n), t)
    block = search.Block(term, doc, rng.integers(1, 1000, n * t) ** 3, n)
    calls = []
    best = search.Best(10)
    add = best.add
    best.add = lambda rows: (calls.append(len(rows)), add(rows))
    search.search_block(block, [(True, i) for i in range(n)], np.arange(2), np.ones(2, np.int64), best)
    total = block.impact.reshape(t, n)[:2].sum(axis=0)
    assert [(s, d[1]) for s, d in best.rows] == sorted(((int(s), i) for i, s in enumerate(total)), key=lambda x: (-x[0], x[1]))[:10]
    assert sum(calls) < n / 3
