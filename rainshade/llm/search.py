"""Ranked lexical search by best-first document intervals over range-maximum sparse tables.

Documents are searched in blocks. A block has a posting list per query term with the term's impact in each document, and a sparse table of
maxima over all its lists. For an item an interval of documents is bounded by the sum of its terms' maxima there. The intervals of the highest bounds
are split first, each at the document of the largest impact, which is scored; an interval that can no longer enter the ten best is dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainshade.llm.common import stored

TOP = 10
# a block ends with the document that fills one of these
BLOCK_DOCUMENTS = 4096
BLOCK_POSTINGS = 1 << 20
# characters of the items that one pass over the documents takes: a bound on what tasks and driver hold
ITEM_CHARS = 1 << 24
BATCH = 64

# a term is a run of digits, letters and bytes from 128 on; capitals A-Z become small
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(content: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return content.translate(FOLD).split()


def _term_rows(batches: Iterator[pa.RecordBatch], ids: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    find = ids.get
    for b in batches:
        lengths, terms, counts = [], [], []
        for content in b.column("content").to_pylist():
            words = terms_of(content)
            seen = Counter(map(find, words))
            seen.pop(None, None)
            lengths.append(len(words))
            terms.append(list(seen.keys()))
            counts.append(list(seen.values()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                                         names=["doc_id", "n", "terms", "tfs"])


class Block:
    """Posting lists of a block of documents in one array, sorted by (term, document), with the sparse table of their maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, term))
        self.n_docs, self.doc, self.impact = n_docs, doc[order].astype(np.int64), impact[order]
        self.term = term[order].astype(np.int64)
        self.key = self.term * (n_docs + 1) + self.doc
        # level k holds the place of the maximum of 2^k neighbours
        self.levels = [np.arange(len(order))]
        longest = int(np.bincount(self.term).max()) if len(order) else 0
        while 2 << len(self.levels) - 1 <= longest:
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            a, b = last[:-step], last[step:]
            self.levels.append(np.where(self.impact[a] >= self.impact[b], a, b))

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the maxima of [lo, hi); -1 for an empty range."""
        out = np.full(lo.shape, -1, np.int64)
        size = hi - lo
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(level[size > 0]):
            m = (level == k) & (size > 0)
            a, b = self.levels[k][lo[m]], self.levels[k][hi[m] - (1 << int(k))]
            out[m] = np.where(self.impact[a] >= self.impact[b], a, b)
        return out


class Best:
    """The best (score, document id) pairs of an item so far: high scores first, then small ids."""

    def __init__(self, size: int):
        self.size, self.rows = size, []

    def floor(self) -> tuple[int, tuple] | None:
        return (self.rows[-1][0], self.rows[-1][1]) if len(self.rows) == self.size else None

    def add(self, scored: list[tuple[int, tuple]]) -> None:
        self.rows = sorted([*self.rows, *scored], key=lambda x: (-x[0], x[1]))[:self.size]


def _bounds(block: Block, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the terms' maxima for each interval (rows of lo and hi), and the document of the largest one."""
    place = block.maxima(lo, hi)
    value = np.where(place >= 0, block.impact[place] * weight, 0)
    top = value.argmax(axis=1)
    return value.sum(axis=1), block.doc[place[np.arange(len(place)), top]]


def search_block(block: Block, ids: list[tuple], terms: np.ndarray, weight: np.ndarray, best: Best, batch: int = BATCH) -> None:
    """Add the block's documents that belong to the best of one item. ids are sort keys in the order of the block's documents.

    terms are the item's distinct terms and weight their repeats.
    """
    width = block.n_docs + 1
    lo, hi = (np.searchsorted(block.key, terms * width + x) for x in (0, block.n_docs))
    has = hi > lo
    if not has.any():
        return
    terms, weight, base = terms[has], weight[has], (terms * width)[has]
    lo, hi = lo[has][None, :], hi[has][None, :]
    bound, split = _bounds(block, weight, lo, hi)
    first = np.zeros(1, np.int64)
    while len(bound):
        floor = best.floor()
        if floor is not None:
            # an equal bound matters only if the interval begins before the last of the best
            open_ = bound > floor[0]
            for i in np.flatnonzero(bound == floor[0]):
                open_[i] = ids[first[i]] < floor[1]
            bound, split, lo, hi, first = bound[open_], split[open_], lo[open_], hi[open_], first[open_]
            if not len(bound):
                return
        now = np.argpartition(-bound, batch - 1)[:batch] if len(bound) > batch else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[now] = False
        d, a, z = split[now], lo[now], hi[now]
        at = np.searchsorted(block.key, base[None, :] + d[:, None])
        at_doc = (at < z) & (block.key[np.minimum(at, len(block.key) - 1)] == base[None, :] + d[:, None])
        score = np.where(at_doc, block.impact[np.minimum(at, len(block.key) - 1)] * weight, 0).sum(axis=1)
        best.add([(int(s), ids[i]) for s, i in zip(score.tolist(), d.tolist()) if s > 0])
        new_lo, new_hi = np.concatenate([a, at + at_doc]), np.concatenate([at, z])
        new_first = np.concatenate([first[now], d + 1])
        some = (new_hi > new_lo).any(axis=1)
        new_lo, new_hi, new_first = new_lo[some], new_hi[some], new_first[some]
        new_bound, new_split = _bounds(block, weight, new_lo, new_hi) if len(new_lo) else (np.empty(0, bound.dtype), np.empty(0, split.dtype))
        # impacts of weight 0 score nothing
        some = new_bound > 0
        bound, split = np.concatenate([bound[rest], new_bound[some]]), np.concatenate([split[rest], new_split[some]])
        lo, hi, first = np.concatenate([lo[rest], new_lo[some]]), np.concatenate([hi[rest], new_hi[some]]), np.concatenate([first[rest], new_first[some]])


def _search_rows(batches: Iterator[pa.RecordBatch], items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_all: int, l_all: int, top: int,
                 block_documents: int, block_postings: int) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score): the best documents of this task for every item."""
    best = [Best(top) for _ in items]
    held: list[tuple] = []
    postings, id_type = 0, pa.int64()

    def flush() -> None:
        held.sort(key=lambda x: x[0])
        sizes = np.array([len(x[2]) for x in held])
        doc = np.repeat(np.arange(len(held)), sizes)
        term, tf = (np.concatenate([x[k] for x in held]) for k in (2, 3))
        m = np.repeat(np.array([100 - 75 + 75 * x[1] * n_all // l_all for x in held], np.int64), sizes)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        block, ids = Block(term, doc, impact, len(held)), [x[0] for x in held]
        for (_, t, c), b in zip(items, best):
            search_block(block, ids, t, c, b)

    for b in batches:
        id_type = b.schema.field("doc_id").type
        columns = [b.column(c).to_pylist() for c in ("doc_id", "n")]
        lists = [b.column(c) for c in ("terms", "tfs")]
        starts = lists[0].offsets.to_numpy()
        values = [x.values.to_numpy() for x in lists]
        for i, (doc_id, n) in enumerate(zip(*columns)):
            s, e = starts[i], starts[i + 1]
            if e > s:
                # a null id comes before all others
                held.append(((doc_id is not None, doc_id), n, values[0][s:e].astype(np.int64), values[1][s:e].astype(np.int64)))
                postings += e - s
                if len(held) >= block_documents or postings >= block_postings:
                    flush()
                    held, postings = [], 0
    if held:
        flush()
    rows = [(i, d[1], s) for i, b in enumerate(best) for s, d in b.rows]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())],
                                     names=["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP,
           block_documents: int = BLOCK_DOCUMENTS, block_postings: int = BLOCK_POSTINGS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(item id, rank, doc_id, score): the `top` documents of highest score above 0 for every item; equal scores by ascending id, a null id first.

    With N documents that have a term, L terms in all of them, n in one document, df documents that hold a term and tf its occurrences in the document,
    a term of the item adds weight * (10^9 tf div (1000 tf + 8 m)) where m = 25 + (75 n N div L) and weight = floor(1000 ln((2 N + 2) / (2 df + 1))). Null text has no terms. Each row
    of docs is a document of its own, so repeated rows rank one after the other; each row of items is an item of its own. Items without a term that
    occurs, empty items and empty docs give no rows; other columns are ignored. Items are taken in parts of about `item_chars` characters, each
    of which reads the documents once; a part is all that driver and tasks hold of the items.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.length("text") + 100).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(size / item_chars))
    content = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "utf-8").alias("content"))
    id_type, item_type = content.schema["doc_id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    out = None
    for p in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        found = _search_part(content, [Counter(terms_of(r["text"].encode())) for r in rows], top, block_documents, block_postings, id_type)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {item_type}")
        named = found.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return out


def _search_part(content: DataFrame, items: list[Counter], top: int, block_documents: int, block_postings: int, id_type: str) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in items for t in c}))}
    kept = stored(content.mapInArrow(lambda batches: _term_rows(batches, vocabulary), f"doc_id {id_type}, n long, terms array<int>, tfs array<long>"))
    total = kept.agg(F.count_if(F.col("n") > 0).alias("n_all"), F.sum("n").alias("l_all")).first()
    counts = kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    weights = _weights({r["term"]: r["df"] for r in counts}, len(vocabulary), total["n_all"])
    slim = [(i, np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for i, c in enumerate(items)]
    n_all, l_all = total["n_all"], total["l_all"] or 0
    found = kept.mapInArrow(lambda batches: _search_rows(batches, slim, weights, n_all, l_all, top, block_documents, block_postings), f"item int, doc_id {id_type}, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))))
    return ranked.filter(F.col("rank") <= top)


def _weights(df: dict[int, int], size: int, n_all: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) per term: N documents with a term, df of them with this one."""
    return np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)], np.int64)
