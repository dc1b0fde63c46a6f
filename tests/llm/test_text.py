"""Packing, page text and weighted-sampling fingerprints."""

import array
import collections
import itertools
import math
import random
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rainshade.llm import fingerprints, html, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(pieces, ids_of, capacity=4096):
    """pieces: (document, start, length, crc, tokens, sequence, offset); every id once, sequences gapless and full or a power of two."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append(p)
    for d, ids in ids_of.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p[1]):
            assert p[1] == at and p[4] == len(ids) and p[3] == zlib.crc32(array.array("I", ids[at:at + p[2]]).tobytes())
            at += p[2]
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_packing(spark, rows, empty):
    whole = Tokenizer.from_file(PATH)
    texts = [t for _, t in rows] + ["İstanbul ΟΔΟΣ don't we'll a<|endoftext|>b ½ ﬁ é x́.", "A.B,C. ., word,", "Straße, ÀÉ."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    for group in (1 << 20, 5000):
        got = packing.pack(docs, PATH, group_tokens=group).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
        check_pieces([tuple(r) for r in got], ids)
    with_ids = packing.pack(docs, PATH, with_ids=True).collect()
    assert all(zlib.crc32(array.array("I", r["ids"]).tobytes()) == r["ids_crc32"] for r in with_ids)
    assert packing.pack(empty, PATH).collect() == []


def test_ids_of_odd_words_equal_the_tokenizer():
    whole, fast = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH, cache_words=200)
    rng = random.Random(4)
    letters = "abcdefghijABCDEFéÉàñßŸœÆıIİ"
    marks = packing.MARKS + "'<>|" + "0123456789½²日本х́\u0301\u200b\u00a0\x1c\t\r\x0b"
    for n in range(4000):
        words = []
        for _ in range(rng.randint(1, 6)):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))
            kind = rng.randrange(5)
            tail = "".join(rng.choice(packing.MARKS if kind < 3 else marks) for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 20])))
            words.append(w + tail + ("".join(rng.choice(letters) for _ in range(3)) if kind == 4 else ""))
        text = "".join(w + rng.choice([" ", "  ", "\n", " "]) for w in words) + rng.choice(["", "don't", "we'll.", "<|endoftext|>", "a<|startoftext|>b"])
        assert array.array("I", fast.encode(text)).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_repeated_rows_and_null_ids(docs, rows):
    got = packing.pack(docs, PATH)
    assert {r["doc_id"] for r in got.collect()} == {d for d, _ in rows}
    assert sum(r["start"] == 0 for r in got.filter("doc_id = 50").collect()) == 2


def test_places_balance_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 400).tolist() + [9000, 4096]
    out = packing.place(lengths)
    check_pieces([(i, s, n, zlib.crc32(array.array("I", [i] * n).tobytes()), lengths[i], b, o) for i, s, n, b, o in out], {i: [i] * n for i, n in enumerate(lengths)})
    cost = collections.Counter()
    size = collections.Counter()
    for _, _, n, b, _ in out:
        cost[b] += n + n * n / 4096
        size[b] += n
    full = [cost[b] for b in cost if size[b] == 4096 and cost[b] < 8000]
    assert max(full) / min(full) < 1.35
    assert packing.place([]) == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/">Home {i}</a></li></ul></nav>
<!-- ad --><div class="ad">Buy {i}</div><article><h1>Title {i} &amp; more</h1><p><b>First {i}<br>part.<p>Second&nbsp;text  {i}</p>{extra}<p>Join our list today.</p><section class="comments"><p>Nice {i}</p></section></article>
<aside>Side {i}</aside><form><p>Mail</p></form><footer>&copy; {i}</footer></body></html>"""


def test_page_text(spark, empty):
    def page(i):
        return PAGE.format(i=i, extra="".join(f"<p>More {i} {j}</p>" for j in range(i % 4)))
    rows = [(i, f"https://news.example.org:443/a/{i}", page(i)) for i in range(12)]
    rows += [(20, "https://other.example.org/x", "<div class=main><h2>Head</h2><p>Only <i>one</i> page.<ul><li>a<li>b</ul></div><div id=sidebar>no</div>"), (21, None, None), (22, "no url", ""),
             (23, "https://other.example.org/y", "<p>cut off <b>tag &am"), (24, "https://other.example.org/z", "<main><p>in main</p><div role=navigation>no</div></main><p>outside</p>"), (3, "https://news.example.org:443/a/3", page(3))]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in html.extract(pages).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    # what stands at one place of most pages of the host is template, in the article too
    want = {i: "\n".join([f"Title {i} & more", f"First {i} part.", f"Second text {i}", *[f"More {i} {j}" for j in range(i % 4)]]) for i in range(12)}
    want |= {20: "Head\nOnly one page.\na\nb", 21: "", 22: "", 23: "cut off tag &am", 24: "in main\noutside"}
    assert {k: v[0] for k, v in got.items()} == want and len(got[3]) == 2
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_tree_matching():
    def tree(page):
        root, _ = html.parse(page)
        html._shapes(root, [0])
        return root

    def labels(node):
        return {node.no: node.label} | {k: v for c in node.children for k, v in labels(c).items()}
    a = tree("<div><h1>x</h1><p>1</p><p>2</p><ul><li>a</li></ul><p>3</p><span></span></div>")
    b = tree("<div><h1>y</h1><p>1</p><ul><li>a<li>b</ul><p>3</p><p>4</p></div>")
    to = html.align(a, b)
    la, lb = labels(a), labels(b)
    assert all(la[x] == lb[y] for x, y in to.items()) and len(set(to.values())) == len(to)
    # root, div, h1, two paragraphs, list and its item
    assert len(to) == 7
    deep = tree("<div>" * 3000 + "x")
    assert len(html.align(deep, tree("<div>" * 2500 + "y"))) == 2501


def test_tree_matching_against_recursion():
    # the published recursion over all pairs of children, without shortcuts for equal ends or runs
    rng = random.Random(6)

    def page(depth):
        tag = rng.choice(["div", "ul", "b", "i"])
        return f"<{tag}>" + "".join(page(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)) + f"</{tag}>"

    def most(a, b):
        if a.label != b.label:
            return 0
        rows = [[0] * (len(b.children) + 1)]
        for x in a.children:
            row = [0]
            for j, y in enumerate(b.children):
                row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + most(x, y)))
            rows.append(row)
        return 1 + rows[-1][-1]
    equal = 0
    for _ in range(300):
        a, b = html.parse(page(3))[0], html.parse(page(3))[0]
        for x in (a, b):
            html._shapes(x, [0])
        got, want = len(html.align(a, b)), most(a, b)
        # neighbours of one shape are matched as one run, which may cost a few elements
        assert got <= want and got >= 0.7 * want
        equal += got == want
    assert equal > 240


def test_long_lists_of_mixed_children():
    rng = random.Random(2)

    def tree(page):
        root = html.parse(page)[0]
        html._shapes(root, [0])
        return root
    kinds = ["<p>x</p>", "<ul><li>a</li></ul>", "<div><i>y</i></div>", "<table><tr><td>z</td></tr></table>", "<div><b>q</b><i>r</i></div>"]
    rows = [rng.choice(kinds) for _ in range(30_000)]
    a, b = tree("<div>" + "".join(rows) + "</div>"), tree("<div>" + "".join(r for r in rows if rng.random() < 0.98) + "</div>")
    start = time.process_time()
    matched = html.align(a, b)
    assert time.process_time() - start < 10
    assert len(matched) > 0.6 * b.size and len(set(matched.values())) == len(matched)


def test_long_lists_are_matched_by_the_whole_table(monkeypatch):
    rng = random.Random(4)

    def tree(rows):
        root = html.parse("<main>" + "".join(rows) + "</main>")[0]
        html._shapes(root, [0])
        return root
    kinds = ["<p>x</p>", "<ul><li>a</li></ul>", "<div><i>y</i></div>", "<div><b>q</b><i>r</i><u>s</u></div>", "<ul><li>a</li><li><b>c</b></li></ul>"]
    rows = [kinds[0]]
    while len(rows) < 700:
        rows.append(rng.choice([k for k in kinds if k != rows[-1]]))
    # the best match of these lists is not one between children of equal shape only
    a, b = tree(rows + [kinds[1]]), tree([kinds[2], *rows[300:], *rows[:300], kinds[3]])
    got = html.align(a, b)
    assert len(set(got.values())) == len(got)

    def runs(node):
        return [list(g) for _, g in itertools.groupby(node.children[0].children, key=lambda c: c.shape)]
    x, y, last = runs(a), runs(b), [0] * (len(runs(b)) + 1)
    assert len(x) * len(y) > 250_000
    weight = {(u[0].shape, v[0].shape): len(html.align(u[0], v[0])) if u[0].label == v[0].label else 0 for u in x for v in y}
    for u in x:
        row = [0]
        for j, v in enumerate(y):
            row.append(max(row[j], last[j + 1], last[j] + weight[u[0].shape, v[0].shape] * min(len(u), len(v))))
        last = row
    # the elements around the lists are the root and the main element
    assert len(got) == 2 + last[-1]
    monkeypatch.setattr(html, "CELLS", 10 ** 9)
    assert html.align(a, b) == got
    monkeypatch.setattr(html, "CELLS", 0)
    monkeypatch.setattr(html, "HELD", 0)
    assert html.align(a, b) == got


def counts(text):
    return collections.Counter(w for w in re.split("[ \t-\r]", (text or "").lower()) if w)


def jaccard(a, b):
    keys = set(a) | set(b)
    total = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / total if total else 1.0


def test_edited_fingerprints(docs, rows, empty):
    got = fingerprints.edited_fingerprints(docs).collect()
    plain = {(r["doc_id"], r["version"]): r["fingerprint"] for r in fingerprints.document_fingerprints(docs).collect()}
    assert plain == {(r["doc_id"], r["version"]): r["fingerprint"] for r in got} and len(got) == len(set(rows))
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["version"]))
    by_length = collections.defaultdict(list)
    for d, t in set(rows):
        by_length[d].append(t or "")
    text = [next(t for t in by_length[r["doc_id"]] if len(t) == r["n_chars"]) for r in order]
    errors = []
    for i, r in enumerate(order):
        own, after = text[i], text[(i + 1) % len(order)]
        q = len(own) // 4
        edited = own[:len(own) - q] + after[:q]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(counts(own), counts(edited)), r["near_next"] - jaccard(counts(own), counts(after))]
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.4
    same = collections.defaultdict(set)
    for r, t in zip(order, text):
        same[t].add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.edited_fingerprints(empty).collect() == []


def test_edited_fingerprints_of_many_repeats(spark):
    # two documents in many rows each: one result a document, the same as without the repeats, and no row meets its copies
    rows = [(1, "one two three four five six"), (2, "two three seven eight " * 4)]
    once = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    many = fingerprints.edited_fingerprints(spark.createDataFrame(rows * 3000, "doc_id long, text string").repartition(6)).collect()
    assert sorted(once) == sorted(many) and len(many) == 2


def test_samples_by_hand(spark):
    # the published draws, term by term in plain Python, from the same uniforms
    weights = {"a": 1, "b": 4, "c": 9, "d": 2}
    text = " ".join(w for w, n in weights.items() for _ in range(n))
    got = fingerprints.document_fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["fingerprint"]
    frame = spark.createDataFrame([(w, n, k) for w, n in weights.items() for k in range(fingerprints.SAMPLES)], "w string, n int, k int")
    term = F.xxhash64("w")
    hashes = frame.select("w", "n", "k", term.alias("term"), F.xxhash64(term, 2 * F.col("k")).alias("h"), F.xxhash64(term, 2 * F.col("k") + 1).alias("g")).collect()
    best = {}
    for r in hashes:
        def uniform(h, shift):
            return (((h & (2 ** 64 - 1)) >> shift & 0x1FFFFF) + 0.5) / 2 ** 21
        rate, beta = -math.log(uniform(r["h"], 0) * uniform(r["h"], 21)), uniform(r["h"], 42)
        c = -math.log(uniform(r["g"], 0) * uniform(r["g"], 21))
        t = math.floor(math.log(r["n"]) / rate + beta)
        # a = c / (y exp(r)) with y = exp(r (t - beta))
        a = c / (math.exp(rate * (t - beta)) * math.exp(rate))
        best[r["k"]] = min(best.get(r["k"], (math.inf, 0)), (a, (r["term"] ^ t) & 0xFFFFFFFF))
    assert got == "".join(f"{best[k][1]:08x}" for k in range(fingerprints.SAMPLES))


def test_collision_rate_is_the_weighted_similarity(spark):
    rng = np.random.default_rng(8)
    rows, want = [], []
    for i in range(150):
        a = {f"w{j}": int(rng.integers(1, 9)) for j in range(40)}
        b = {w: max(0, n + int(rng.integers(-3, 4))) for w, n in a.items()}
        rows += [(2 * i, " ".join(w for w, n in a.items() for _ in range(n))), (2 * i + 1, " ".join(w for w, n in b.items() for _ in range(n)))]
        want.append(jaccard(collections.Counter(a), collections.Counter(b)))
    docs = spark.createDataFrame([(d, f"p{d // 2} " * 0 + t) for d, t in rows], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.document_fingerprints(docs).collect()}
    near = [np.mean([prints[2 * i][k:k + 8] == prints[2 * i + 1][k:k + 8] for k in range(0, 256, 8)]) for i in range(150)]
    assert np.mean(near) == pytest.approx(np.mean(want), abs=0.02)
