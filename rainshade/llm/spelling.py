"""Spelling variants by pivotal grams.

Two words one edit apart share a bigram that the edit leaves alone, and then also everything on one side of it. Each word has a prefix, its rarest
bigrams, and two pivots, disjoint bigrams of the prefix. An edit touches one pivot at most, and the other one is found in the other word's prefix or, where
that prefix ends earlier in the order of bigrams, the other word's pivot in this one's prefix. So pivots are joined with prefixes; as the key holds the whole unchanged side,
positions agree too. Pairs that meet are verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshade.llm.common import stored

MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
TYPO_MODULUS = 199
# occurrences of a prefix's last bigram that belong to it: three by order, and two that an edit can set before them
LAST_PLACES = 5
# pairs of pivots and prefixes under one key above which the rest of the word enters the key too
KEY_PAIRS = 4096
HELD_WORDS = 500_000

# a run is made of A-Z, a-z and the characters U+00C0 to U+00FF: one byte each in Latin-1, where all others become a question mark
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(doc_id: str, text: str, min_length: int = MIN_LENGTH, modulus: int = TYPO_MODULUS) -> Counter:
    """Runs of a text in Latin-1 with their counts; a run whose checksum with the id is a multiple of the modulus loses one character."""
    out, base = Counter(), zlib.crc32(f"{doc_id}:".encode())
    runs = Counter(w for w in text.encode("latin-1", "replace").translate(FOLD).split() if len(w) >= min_length)
    for w, n in runs.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), base)
        if h % modulus == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1:]
            if len(w) < min_length:
                continue
        out[w] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, modulus: int = TYPO_MODULUS) -> DataFrame:
    """(word, n): distinct words of at least min_length code points and min_count occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text:
                    total.update(words_of(doc_id, text, min_length, modulus))
                if len(total) > HELD_WORDS:
                    yield flush()
                    total.clear()
        yield flush()

    slim = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def prefix_and_pivots(word: str, rank: dict[str, int], cost: dict[str, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(rank, position) of the prefix and of the pivots of a word of four characters or more.

    The prefix is the first three bigrams by (rank, position) and further places of the last one. The pivots are the two disjoint of the first three
    that are cheapest together; the dynamic program over positions needs one step, as a pivot's best partner is the cheapest that ended before it.
    """
    grams = sorted((rank[word[i:i + 2]], i) for i in range(len(word) - 1))
    three, last = grams[:3], grams[2][0]
    ties = [g for g in grams if g[0] == last][:LAST_PLACES]
    prefix = [g for g in three if g[0] < last] + ties
    by_place = sorted(three, key=lambda g: g[1])
    best = None
    for j, g in enumerate(by_place):
        ended = [x for x in by_place[:j] if x[1] + 2 <= g[1]]
        if ended:
            partner = min(ended, key=lambda x: (cost[word[x[1]:x[1] + 2]], x))
            total = cost[word[g[1]:g[1] + 2]] + cost[word[partner[1]:partner[1] + 2]]
            if best is None or total < best[0]:
                best = (total, [partner, g])
    return prefix, best[1]


def _key(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode()) - 2 ** 63


def _gram_rows(batches: Iterator[pa.RecordBatch], rank: dict[str, int], cost: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(key, pivot, last, side, at, word, n): a row per bigram of the prefix, and per pivot, and unchanged side of the word (0 the left one)."""
    names = ["key", "pivot", "last", "side", "at", "word", "n"]
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    for b in batches:
        rows = []
        for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            prefix, pivots = prefix_and_pivots(word, rank, cost)
            last = max(prefix)[0]
            for is_pivot, grams in ((True, pivots), (False, prefix)):
                for _, i in grams:
                    rows.append((_key(0, word[:i + 2]), is_pivot, last, 0, i, word, n))
                    rows.append((_key(1, word[i:]), is_pivot, last, 1, i, word, n))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of crowded keys with keys of their own: the other side of the word with one character less, or as it is for the longer word's sake.

    A replaced character leaves equal rests at one place; an inserted one leaves the shorter side equal to the longer one's rest.
    """
    names = ["key", "pivot", "last", "word", "n"]
    for b in batches:
        keys, at = [], []
        cols = {c: b.column(c).to_pylist() for c in ("key", "pivot", "side", "at", "word")}
        for row, (key, pivot, side, i, word) in enumerate(zip(*cols.values())):
            other = word[:i] if side else word[i + 2:]
            rests = [other[:j] + other[j + 1:] for j in range(len(other))]
            own = [_key(key, j, x) for j, x in enumerate(rests)]
            # "a": the pivot's word is the longer one, "b": the prefix's word is
            own += [_key(key, "a" if pivot else "b", x) for x in set(rests)]
            own.append(_key(key, "b" if pivot else "a", other))
            keys += own
            at += [row] * len(own)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(b.column(c).take(take) for c in names[1:])], names=names)


def near_words(words: DataFrame, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """(a, an, b, bn): every pair of words (word, n) one edit apart, once, a before b. Words have four characters or more."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2))))
    # bounded by the square of the alphabet, 90 characters
    counts = words.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c")).collect()
    cost = {r["g"]: r["c"] for r in counts}
    rank = {g: i for i, g in enumerate(sorted(cost, key=lambda g: (cost[g], g)))}
    rows = stored(words.mapInArrow(lambda b: _gram_rows(b, rank, cost), "key long, pivot boolean, last int, side int, at int, word string, n long"))
    sizes = rows.groupBy("key").agg(F.count_if("pivot").alias("p"), F.count_if(~F.col("pivot")).alias("q")).filter("p > 0 and q > 1")
    met = stored(rows.join(sizes.select("key", (F.col("p") * F.col("q") > key_pairs).alias("crowded")), "key"))
    few = met.filter("not crowded").select("key", "pivot", "last", "word", "n")
    many = met.filter("crowded").select("key", "pivot", "side", "at", "word", "last", "n").mapInArrow(_variant_rows, "key long, pivot boolean, last int, word string, n long")
    dealt = few.unionByName(many)
    pivots = dealt.filter("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("an"), F.col("last").alias("al"))
    prefixes = dealt.filter("not pivot").select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("last").alias("bl"))
    near = (F.col("bl") >= F.col("al")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    pairs = pivots.join(prefixes, "key").filter(near)
    first = F.col("a") < F.col("b")

    def end(x: str, y: str) -> Column:
        return F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select(end("a", "b").alias("a"), end("an", "bn").alias("an"), end("b", "a").alias("b"), end("bn", "an").alias("bn")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms. A form occurs several times as often as its word, so chains are short and have no circles."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR,
             modulus: int = TYPO_MODULUS, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, one character less where `<id>:<run>` has a checksum (CRC-32) that the modulus
    divides, that have min_length code points and occur min_count times in all texts together. n_near counts the words one inserted, deleted or
    replaced code point away. form is the one of them that occurs most often (of equal ones the first in code-point order) if it occurs factor times as
    often as the word or more, else null, as is form_n then; root is reached by following forms, and the word itself where it has none. Null and empty texts have
    no words; a null id counts as an empty one; repeated rows count each time; an empty table gives no rows; other columns are ignored.
    """
    if min_length < 4:
        raise ValueError("words need four characters or more: two disjoint bigrams among the first three")
    if factor < 2:
        raise ValueError("a form must occur more often than its word, or chains of forms need not end")
    words = stored(vocabulary(docs, id_col, text_col, min_length, min_count, modulus))
    pairs = stored(near_words(words, key_pairs))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("on")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("on")))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("on")).alias("minus"), "other")).alias("top"))
    is_form = -F.col("top.minus") >= factor * F.col("n")
    found = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("top.other")).alias("form"),
                                                          F.when(is_form, -F.col("top.minus")).alias("form_n")))
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
