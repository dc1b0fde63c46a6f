"""Packing by cost: descending pieces go to the sequence of least attention cost that still has room for them.

Each task packs its own rows in groups of about GROUP_TOKENS, so nothing is shuffled and memory is bounded by a group and one
document. The sequences of a group hold exactly its tokens: full ones, and for the rest one for each power of two in its size.
"""

from __future__ import annotations

import array
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
GROUP_TOKENS = 1 << 20
END_ID = 2
# attention beside the rest of a layer: a token costs 1, and its attention to a full sequence costs as much again
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
CACHE_WORDS = 800_000


# marks that end a word and are cut off before it is looked up; no apostrophe, and no bracket that begins a special token
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class WordTokenizer:
    """Ids of texts by a tokenizer that splits words at white space and lower-cases them; each word is encoded once while it is cached.

    Words of letters go straight to the BPE model in its byte alphabet, and marks after the letters are a piece of their own; all other words take the
    tokenizer's whole path. Words are kept in two generations, so that full caches forget only what has not been used for a while.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model, self.limit = self.whole.model, cache_words
        self.words, self.older = _Words(self._word), {}
        self.bases, self.marks = {}, {}
        # byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _word(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is not None:
            return known
        base = word.rstrip(MARKS)
        # letters below U+0250 are composed and lower-cased alike by every Unicode version
        if base.isalpha() and max(base) < "\u0250":
            lower = base.lower() if base.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", base))
            ids = self.bases.get(lower)
            # one capital there becomes a letter and a mark, which is no letter
            if ids is None and lower.isalpha():
                mapped = lower if lower.isascii() else "".join(map(self.alphabet.__getitem__, lower.encode()))
                ids = self.bases[lower] = array.array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if ids is not None:
                end = word[len(base):]
                return ids + self._marks(end) if end else ids
        return self._whole(word)

    def _marks(self, end: str) -> bytes:
        ids = self.marks.get(end)
        if ids is None:
            ids = self._whole(end)
            # runs of marks are few, but nothing says how long they are
            if len(end) < 16 and len(self.marks) < 10_000:
                self.marks[end] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(self.words) > self.limit // 2:
            self.older, self.words = dict(self.words), _Words(self._word)
        if len(self.bases) > self.limit // 2:
            self.bases.clear()
        # without special tokens and beyond Latin-1 a text may be lower-cased first, which leaves fewer words
        if "<|" not in text and _latin(text):
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words(dict):
    """Ids by word; a word that is not there yet is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


def _tokenizer(path: str) -> WordTokenizer:
    """The worker process's tokenizer for a path; a module of its own keeps it from one task to the next."""
    kept = sys.modules.setdefault("_rainshade_tokenizers", types.ModuleType("_rainshade_tokenizers")).__dict__
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def place(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, bin, offset) for items of any length; bins are filled to the last token.

    Whole capacities are cut off long items first. The rest goes in descending cost to the bin of least cost with room; what has no
    room anywhere is cut to fill the room that is left.
    """
    out, items, n_bins = [], [], 0
    for i, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            out.append((i, start, capacity, n_bins, 0))
            n_bins, start = n_bins + 1, start + capacity
        if n > start:
            items.append((n - start, i, start))
    total = sum(x[0] for x in items)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    room, cost, filled = np.array(sizes, np.int64), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)

    def put(i: int, start: int, n: int, at: int) -> None:
        out.append((i, start, n, n_bins + at, int(filled[at])))
        room[at] -= n
        filled[at] += n
        cost[at] += linear * n + quadratic * n * n

    left = []
    for n, i, start in sorted(items, key=lambda x: (-x[0], x[1])):
        fits = room >= n
        if fits.any():
            put(i, start, n, int(np.where(fits, cost, np.inf).argmin()))
        else:
            left.append((n, i, start))
    for n, i, start in left:
        while n:
            at = int(np.where(room > 0, cost, np.inf).argmin())
            k = min(n, int(room[at]))
            put(i, start, k, at)
            n, start = n - k, start + k
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS,
         end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids (array<int>) where asked for.

    A document is its ids and then end_id; null or empty text is end_id alone. Each row is a document of its own, so repeated rows
    and null ids are packed like any other. sequence_id is the task's number and a count within it. No padding is needed: a sequence is full or
    its length is a power of two. An empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(tokenizer_path).encode, array.array("I", [end_id]).tobytes()
        base, held, tokens = TaskContext.get().partitionId() << 40, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            rows = place([len(ids) // 4 for _, ids in held], capacity, linear, quadratic)
            cut = [held[i][1][4 * s:4 * (s + n)] for i, s, n, _, _ in rows]
            cols = [pa.array([held[r[0]][0] for r in rows], id_type), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array([len(held[r[0]][1]) // 4 for r in rows], pa.int64()),
                    pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
            if with_ids:
                cols.append(pa.array([np.frombuffer(c, np.int32) for c in cut], pa.list_(pa.int32())))
            base += max(r[3] for r in rows) + 1
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                held.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= group_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
