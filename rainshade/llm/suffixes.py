"""Repeated byte strings across documents, found by suffix sorting with a difference cover.

Every string of WIDTH bytes has a minimizer, the least hash of its K-byte parts, and equal strings have equal minimizers. So text is
dealt out by minimizer: only minimizers that occur in several documents are followed, and each travels with the bytes of the
strings it stands for. What meets there is suffix-sorted with the difference cover {1, 2} modulo 3: triples of
eight-byte words are sorted at the covered places and named; names take part in the next sort, which ranks longer prefixes; the places
left over are merged by a byte or two and the rank of the covered place that follows; neighbours with equal prefixes are one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainshade.llm.common import keyed_texts, stored

WIDTH = 50
K = 16
SLICE_BYTES = 1 << 20
# sorting takes about a hundred times a block's bytes, in each of an executor's Python workers
BLOCK_BYTES = 1 << 20
# marks are hashes of 40 bits: fewer bytes to move, and a rare clash only lets strings meet that are not equal
MARK = np.uint64((1 << 40) - 1)
# strings whose owners are looked up at once
BLOCK_STRINGS = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from every place, built from hashes of 1, 2, 4 ... bytes."""
    h, factor, n, out, used = _mixed(b.astype(np.uint64) + np.uint64(1)), 0x9E3779B97F4A7C15, 1, None, 0
    while k:
        if k & 1:
            size = len(b) - used - n + 1
            out = h if out is None else out[:size] * np.uint64(factor) + h[used:used + size]
            used += n
        k >>= 1
        if k:
            h, factor, n = h[:-n] * np.uint64(factor) + h[n:], factor * factor % 2 ** 64, 2 * n
    return _mixed(out)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, n = h, 1
    while 2 * n <= w:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    size = len(h) - w + 1
    return np.minimum(m[:size], m[w - n:w - n + size]) if n < w else m


def _runs(contents: list[bytes], width: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, bytes]]:
    """(document, hash, start, number of strings, first document, joined bytes) for slices of the documents.

    A run is a row of neighbouring strings of one document with one minimizer; starts are places in the joined bytes.
    """
    lo = 0
    while lo < len(contents):
        hi, size = lo, 0
        while hi < len(contents) and (hi == lo or size + len(contents[hi]) <= SLICE_BYTES):
            size += len(contents[hi])
            hi += 1
        joined = b"".join(contents[lo:hi])
        if size >= width:
            minima = _sliding_min(_gram_hashes(np.frombuffer(joined, np.uint8), k), width - k + 1)
            sizes = np.array([len(c) for c in contents[lo:hi]])
            doc = np.repeat(np.arange(hi - lo), sizes)[:len(minima)]
            # a string must end inside its document
            whole = doc == np.repeat(np.arange(hi - lo), sizes)[width - 1:]
            new = np.ones(len(minima), bool)
            new[1:] = (minima[1:] != minima[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(minima)))
            ok = whole[start]
            start, n = start[ok], n[ok]
            yield doc[start] + lo, (minima[start] & MARK).view(np.int64) << 1, start, n, lo, joined
        lo = hi


def _marks(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark): each minimizer of a document once. The lowest bit tells that the batch has it in another document too.

    The first document that has it stands for the batch and keeps the bit clear, unless it is needed no more than the others: so a
    minimizer of a third of all documents comes to its reducer once a batch.
    """
    for b in batches:
        docs, hashes = [], []
        for d, h, *_ in _runs(b.column("content").to_pylist(), width, k):
            docs.append(d)
            hashes.append(h)
        if not docs:
            continue
        d, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((d, h))
        d, h = d[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        d, h = d[new], h[new]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(h | again)], names=["doc_id", "mark"])
        # a minimizer of several documents of the batch: tell the reducer so by a second row of the first document
        first = np.flatnonzero(~again[:-1] & again[1:]) if len(again) > 1 else np.empty(0, np.int64)
        if len(first):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d[first + 1])), pa.array(h[first])], names=["doc_id", "mark"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark) of the marks that several documents have, from rows sorted by mark; the lowest bit is cleared."""
    last_mark, last_doc, told = None, None, False
    for b in batches:
        mark, docs = b.column("mark").to_numpy(), b.column("doc_id")
        if not len(mark):
            continue
        ids = docs.to_numpy(zero_copy_only=False)
        base = mark & ~np.int64(1)
        known = (mark & 1).astype(bool)
        # rows with a clear bit, in runs of one mark
        at = np.flatnonzero(~known)
        keep = known.copy()
        if len(at):
            m, i = base[at], ids[at]
            same = np.zeros(len(at), bool)
            same[1:] = (m[1:] == m[:-1])
            differs = np.zeros(len(at), bool)
            differs[1:] = same[1:] & (i[1:] != i[:-1])
            starts = np.flatnonzero(~same)
            several = np.logical_or.reduceat(differs, starts)
            begin_known = last_mark is not None and m[0] == last_mark
            if begin_known:
                first_run = slice(0, starts[1] if len(starts) > 1 else len(m))
                several[0] = several[0] or told or bool((i[first_run] != last_doc).any())
            keep[at] = np.repeat(several, np.diff(np.append(starts, len(at))))
            if begin_known and several[0] and not told:
                yield pa.RecordBatch.from_arrays([pa.array([last_doc], docs.type), pa.array([last_mark], pa.int64())], names=["doc_id", "mark"])
            last_mark, last_doc, told = m[-1], i[-1], bool(several[-1])
        pick = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([docs.take(pa.array(pick)), pa.array(base[pick])], names=["doc_id", "mark"])


def _contexts(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """(mark, doc_id, place, bytes) of the runs whose mark is in the document's list; place is start << 32 | version's low half."""
    for b in batches:
        lists = b.column("marks")
        offsets, marks = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        contents = b.column("content").to_pylist()
        low = b.column("version").to_numpy() & np.int64(0xFFFFFFFF)
        for d, h, start, n, lo, joined in _runs(contents, width, k):
            begins = np.concatenate(([0], np.cumsum([len(c) for c in contents[lo:d[-1] + 1]]))) if len(d) else np.zeros(1, np.int64)
            keep = np.zeros(len(d), bool)
            edges = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d)) if len(d) else np.zeros(1, np.int64)
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                x = int(d[s])
                keep[s:e] = np.isin(h[s:e], marks[offsets[x] - lists.offsets[0].as_py():offsets[x + 1] - lists.offsets[0].as_py()])
            if not keep.any():
                continue
            d, h, start, n = d[keep], h[keep], start[keep], n[keep]
            place = (start - begins[d - lo]).astype(np.int64) << 32 | low[d]
            cut = [joined[s:s + size] for s, size in zip(start.tolist(), (n + width - 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column("doc_id").take(pa.array(d)), pa.array(place), pa.array(cut, pa.binary())], names=["mark", "doc_id", "place", "bytes"])


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each row of keys (most significant first) by sorting and comparing neighbours; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def least_owner(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For the strings of `width` (50) bytes from each start, the least owner of any equal string.

    text needs no end mark, but every start must have width bytes behind it. Covered places are those that are 1 or 2 modulo 3.
    """
    if width != 2 * 24 + 2:
        raise ValueError("the two rounds of names cover 48 bytes, and a string has two more")
    t = np.concatenate([text, np.zeros(80, np.uint8)]).astype(np.uint64)
    word2 = t[:-1] << np.uint64(8) | t[1:]
    word4 = word2[:-2] << np.uint64(16) | word2[2:]
    word8 = word4[:-4] << np.uint64(32) | word4[4:]
    del word4
    n = len(text)
    need = np.zeros(n + 80, bool)
    for shift in (0, 1, 2, 24, 25, 26):
        need[starts + shift] = True
    covered = np.flatnonzero(need[:n] & (np.arange(n) % 3 != 0))
    # sort the sampled triples and name them
    name = np.zeros(n + 80, np.int64)
    name[covered] = _ranks([word8[covered], word8[covered + 8], word8[covered + 16]])
    # the same on names: two of them stand for 48 bytes
    need[:] = False
    for shift in (0, 1, 2):
        need[starts + shift] = True
    covered = np.flatnonzero(need[:n] & (np.arange(n) % 3 != 0))
    rank = np.zeros(n + 80, np.int64)
    rank[covered] = _ranks([name[covered] << 32 | name[covered + 24]])
    # merge: covered places by rank and two bytes; the others with each residue by the bytes before the next covered place
    out = owner.copy()
    residue = starts % 3
    for pair, key in (((1, 2), lambda s: rank[s] << 16 | word2[s + 48].astype(np.int64)),
                      ((0, 1), lambda s: rank[s + 1] << 16 | (t[s] << np.uint64(8) | t[s + 49]).astype(np.int64)),
                      ((0, 2), lambda s: rank[s + 2] << 16 | word2[s].astype(np.int64))):
        at = np.flatnonzero((residue == pair[0]) | (residue == pair[1]))
        if len(at):
            k = key(starts[at])
            order = np.argsort(k, kind="stable")
            begin = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))
            least = np.minimum.reduceat(owner[at[order]], begin)
            out[at[order]] = np.minimum(out[at[order]], np.repeat(least, np.diff(np.append(begin, len(order)))))
    return out


def _covered(t: pa.Table, width: int, block_strings: int = BLOCK_STRINGS) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, start, end) of the bytes in strings that a smaller document has too, for whole groups of one mark."""
    ids = t.column("doc_id").combine_chunks()
    order_of, doc = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
    place = t.column("place").to_numpy()
    # equal contexts are sorted once, for their least document
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(c, len(number)) for chunk in t.column("bytes").chunks for c in chunk.to_pylist()), np.int64, t.num_rows)
    least = np.full(len(number), len(order_of), np.int64)
    np.minimum.at(least, which, doc)
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    text = np.frombuffer(b"".join(number), np.uint8)
    del number
    n = sizes - width + 1
    first = np.cumsum(n) - n
    inside = np.arange(n.sum()) - np.repeat(first, n)
    starts = np.repeat(np.cumsum(sizes) - sizes, n) + inside
    owner = least_owner(text, starts, np.repeat(least, n), width)
    # the strings of every occurrence, some rows at a time: a passage of many documents has few contexts and many rows
    upto = np.cumsum(n[which])
    lo = 0
    while lo < len(which):
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + block_strings, "right")), lo + 1)
        m = n[which[lo:hi]]
        begin = np.cumsum(m) - m
        j = np.arange(m.sum()) - np.repeat(begin, m)
        hit = owner[np.repeat(first[which[lo:hi]], m) + j] < np.repeat(doc[lo:hi], m)
        row = np.repeat(np.arange(lo, hi), m)
        edge = np.ones(len(hit), bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])
        s = np.flatnonzero(edge)
        e = np.append(s[1:], len(hit)) - 1
        s, e = s[hit[s]], e[hit[s]]
        at = row[s]
        start = (place[at] >> 32) + j[s]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(place[at] & np.int64(0xFFFFFFFF)), pa.array(start), pa.array((place[at] >> 32) + j[e] + width)],
                                         names=["doc_id", "tag", "start", "end"])
        lo = hi


def _repeats(batches: Iterator[pa.RecordBatch], width: int, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs _covered on blocks of whole marks of a partition sorted by mark."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size < block_bytes:
            continue
        t = pa.Table.from_batches(held)
        mark = t.column("mark").to_numpy()
        cut = int(np.searchsorted(mark, mark[-1], "left"))
        if cut:
            yield from _covered(t.slice(0, cut), width)
        rest = t.slice(cut)
        held, size = rest.to_batches(), rest.nbytes if not cut else 0
    if held and sum(b.num_rows for b in held):
        yield from _covered(pa.Table.from_batches(held), width)


def _cut(content: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes removed and the number of maximal removed runs."""
    parts, at, removed, runs = [], 0, 0, 0
    end = -1
    for s, e in sorted(spans):
        runs += s > end
        if e > max(end, 0):
            s = max(s, end, 0)
            parts.append(content[at:s])
            removed += e - s
            at = end = e
    parts.append(content[at:])
    return b"".join(parts), removed, runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """One row per row: doc_id, version, content (the bytes that stay), n_bytes, n_removed, n_spans.

    A byte is removed if a string of `width` bytes that covers it also starts in a document with a smaller id; strings never cross
    documents and are judged on the input. Null text counts as empty. Documents with a null id keep all and take from none; rows
    with one id do not take from each other. An empty table gives no rows; other columns are ignored. A text that equals one with
    a smaller id goes wholly (if it has width bytes) and is not searched.
    """
    texts = keyed_texts(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    content = texts.select("doc_id", "version", F.encode("text", "utf-8").alias("content"))
    owned = content.filter("doc_id is not null")
    same = stored(owned.filter(F.octet_length("content") >= width).select("doc_id", "version", F.sha2("content", 256).alias("digest")).distinct())
    first = same.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = stored(same.join(first, "digest").filter("doc_id > first").select("doc_id", "version"))
    # an id is left out of the search only where all of its texts are copies: shorter texts hold no string
    texts_of = same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_texts"))
    whole = copies.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(texts_of, "doc_id").filter("n = n_texts").select("doc_id")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _marks(batches, width, k)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contexts(batches, width, k)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _repeats(batches, width)

    found = owned.select("doc_id", "content").mapInArrow(marks, f"doc_id {kind}, mark long")
    # rows whose mark is known to be shared need not meet the others
    known = F.col("mark").bitwiseAND(F.lit(1)) == 1
    dealt = found.repartition(F.when(known, F.xxhash64("doc_id", "mark")).otherwise(F.col("mark"))).sortWithinPartitions("mark")
    shared = dealt.mapInArrow(_shared, f"doc_id {kind}, mark long")
    # dealt out first: sets on their way take three times the bytes of their rows
    lists = stored(shared.repartition("doc_id").groupBy("doc_id").agg(F.collect_set("mark").alias("marks")).join(whole, "doc_id", "left_anti"))
    # both joins are left joins that deal the same columns out by id, so they share one exchange of the texts
    asked = content.join(lists.hint("merge"), "doc_id", "left").select("doc_id", "version", "content", "marks")
    met = asked.mapInArrow(contexts, f"mark long, doc_id {kind}, place long, bytes binary").repartition("mark").sortWithinPartitions("mark")
    spans = met.mapInArrow(repeats, f"doc_id {kind}, tag long, start long, end long")
    everything = copies.select("doc_id", F.col("version").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    by_id = spans.unionByName(everything).repartition("doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("tag", "start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v, c, spans in zip(b.column("version").to_pylist(), b.column("content").to_pylist(), b.column("spans").to_pylist()):
                own = [(s["start"], len(c) if s["end"] < 0 else s["end"]) for s in spans or () if s["tag"] == v & 0xFFFFFFFF]
                rows.append((*_cut(c, own), len(c)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (3, 1, 2))],
                                             names=["doc_id", "version", "content", "n_bytes", "n_removed", "n_spans"])

    return (content.join(by_id.hint("merge"), "doc_id", "left").select("doc_id", "version", "content", "spans")
            .mapInArrow(cut, f"doc_id {kind}, version long, content binary, n_bytes long, n_removed long, n_spans long"))


def digest(content: bytes) -> str:
    """SHA-256 of bytes in lower-case hex, as the query gives it."""
    return hashlib.sha256(content).hexdigest()
