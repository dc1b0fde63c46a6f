"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from rainshade.llm import spelling

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def plain_words(docs, min_length=6, min_count=5):
    total = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += len(run) >= min_length
    return {w: n for w, n in total.items() if n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(count, factor=5):
    out = {}
    for w, n in count.items():
        near = [x for x in count if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        form = min(near, key=lambda x: (-count[x], x)) if near else None
        out[w] = (form if near and count[form] >= factor * n else None, n, len(near))
    rows = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, count[form] if form else None))
    return sorted(rows, key=repr)


def edited(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    return word[:i] + ("" if kind == 1 else rng.choice(letters)) + word[i + 1:]


def vocabulary(seed, n, letters):
    rng = random.Random(seed)
    out = {}
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(n)]
    for w in base:
        out[w] = rng.randint(5, 400)
        for _ in range(rng.randint(0, 6)):
            out.setdefault(edited(rng, w, letters), rng.randint(5, 20))
    return {w: c for w, c in out.items() if len(w) >= 6}


@pytest.mark.parametrize("letters, key_pairs", [("abcdefgh", 4096), ("abcdefgh", 1), ("ab", 4096), ("ab", 1), ("aéÿ", 20)])
def test_all_pairs(spark, letters, key_pairs):
    count = vocabulary(len(letters), 150, letters)
    words = spark.createDataFrame(list(count.items()), "word string, n long").repartition(4)
    got = sorted((r["a"], r["b"], r["an"], r["bn"]) for r in spelling.near_words(words, key_pairs).collect())
    names = sorted(count)
    want = sorted((a, b, count[a], count[b]) for i, a in enumerate(names) for b in names[i + 1:] if abs(len(a) - len(b)) < 2 and one_edit(a, b))
    assert got == want and len(want) > 100


def test_repeated_letters(spark):
    # every bigram is the same one: the prefix must hold places that an edit moves
    names = [c * n for c in "ab" for n in range(4, 30)] + ["a" * i + "b" + "a" * j for i in range(8) for j in range(8) if i + j > 4] + ["x" * 70, "x" * 71, "ab" * 20, "ab" * 10 + "a" + "ab" * 10, "ba" * 20]
    words = spark.createDataFrame([(w, 1) for w in names], "word string, n long")
    got = sorted((r["a"], r["b"]) for r in spelling.near_words(words, 30).collect())
    names.sort()
    assert got == sorted((a, b) for i, a in enumerate(names) for b in names[i + 1:] if abs(len(a) - len(b)) < 2 and one_edit(a, b))


def corpus():
    rng = random.Random(8)
    count = vocabulary(9, 60, "aeinrstà")
    docs = []
    for i in range(60):
        docs.append((i, " ".join(rng.choice([w, w.upper(), w.capitalize()]) + rng.choice(["", ",", " 5", "'s"]) for w in rng.choices(list(count), list(count.values()), k=200))))
    chain = ["lantern"] * 500 + ["lanterns"] * 60 + ["lanternss"] * 10 + ["lantarnss"] * 2
    docs += [(100, " ".join(chain)), (101, "x" * 300_000), (102, None), (103, ""), (104, "×÷×÷×÷ ÀÈÌÒÙÝ àèìòùý 日本語日本語 naïveté"), (105, " ".join(["Straße", "STRASSE"] * 7))]
    docs += [(200, "repeated rows repeated rows"), (200, "repeated rows repeated rows"), (200, "repeated rows repeated"), (None, "repeated"), (None, "nullid nullid nullid nullid nullid nullid")]
    return docs


def test_variants_of_texts(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "w", 3, "r") for d, t in docs], "doc_id long, text string, word string, n long, root string").repartition(4)
    want = plain(plain_words(docs))
    got = spelling.variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    by_word = {r[0]: r for r in want}
    assert by_word["lanternss"][1:3] == ("lanterns", "lantern") and any(r[1] for r in want)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_some_runs_lose_a_character(spark):
    docs = [(i, "misspelling " * 3) for i in range(3000)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {w: r["n"] for w, r in got.items()} == plain_words(docs) and len(got) > 2
    assert all(r["form"] == "misspelling" for w, r in got.items() if len(w) == 10)


def test_long_chains_of_forms(spark):
    names = [f"w{i:03d}" for i in range(40)]
    forms = spark.createDataFrame(list(zip(names, names[1:])), "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {w: names[-1] for w in names[:-1]}


def test_words_must_have_disjoint_bigrams(spark):
    frame = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    with pytest.raises(ValueError):
        spelling.variants(frame, min_length=3)
    with pytest.raises(ValueError):
        spelling.variants(frame, factor=1)
