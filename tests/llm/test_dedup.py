"""Exact, line, suffix and SimHash deduplication beside brute force."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rainshade.llm import common, exact, lines, simhash, suffixes
from rainshade.llm.common import stored
from texts import words

STRIP = re.compile(r"[\x20\x09-\x0D]")


def distinct(rows):
    return sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("chunk", [exact.CHUNK_BYTES, 64])
def test_exact_duplicates(docs, rows, chunk):
    got = exact.exact_duplicates(docs, chunk_bytes=chunk).collect()
    groups = {}
    for d, t in distinct(rows):
        groups.setdefault(STRIP.sub("", t or ""), []).append((d, t or ""))
    want = {}
    for members in groups.values():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is not None, m[0] or 0))
        for d, t in members:
            want.setdefault((d, len(t)), []).append((keep[0], len(members), (d, t) == keep))
    have = {}
    for r in got:
        have.setdefault((r["doc_id"], r["n_chars"]), []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert {k: sorted(v, key=str) for k, v in have.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_fingerprints_compose():
    p = exact.PRIME
    data = bytes(range(1, 200)) * 30
    whole = int.from_bytes(data, "big") % p
    h = 0
    for i in range(0, len(data), 77):
        part = data[i:i + 77]
        h = (h * pow(256, len(part), p) + int.from_bytes(part, "big")) % p
    assert h == whole


def test_texts_with_equal_fingerprints_are_told_apart(spark, monkeypatch):
    # modulo 2 nearly all texts of one length collide, so the comparison has to split them
    monkeypatch.setattr(exact._hash_pieces, "__defaults__", (2,))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "cc", "aa", "ee", "cc", "bb", "aa"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(docs).collect()}
    assert got == {0: (0, 3), 2: (0, 3), 6: (0, 3), 1: (1, 2), 4: (1, 2), 3: (3, 1), 5: (5, 1)}


def brute_repeats(rows, width=50):
    content = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, c in content:
        if d is not None:
            for i in range(len(c) - width + 1):
                s = c[i:i + width]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, c in content:
        gone = bytearray(len(c))
        for i in range(len(c) - width + 1 if d is not None else 0):
            if first[c[i:i + width]] < d:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(c, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(c), sum(gone), spans, kept))
    return out


def test_suffix_repeats(docs, rows):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["content"])) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(rows), key=str)
    assert any(x[2] and x[4] for x in got)


def test_suffix_repeats_where_a_copy_shares_its_id(spark):
    a, b = "".join(f"{i:03d}" for i in range(30)), "".join(chr(97 + i * 7 % 26) + str(i) for i in range(40))
    rows = [(1, a), (2, b), (3, a), (3, f"x {b} y"), (4, b), (4, b), (5, a), (5, "short"), (5, None), (6, a + b), (6, a)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["content"])) for r in
           suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got) == sorted(brute_repeats(rows))
    assert sum(r[2] for r in got if r[0] == 3) == len(a) + len(b)


def test_suffix_repeats_in_small_blocks(spark, monkeypatch):
    # strings of two letters repeat everywhere, and slices and blocks end inside groups
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), 200)) for _ in range(30)]
    rows = [(i, texts[i % 30][i % 7:150 + i % 40] + texts[(i * 7) % 30][:60]) for i in range(90)]
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 500)
    monkeypatch.setattr(suffixes._repeats, "__defaults__", (2000,))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["content"])) for r in
           suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got) == sorted(brute_repeats(rows))


def test_difference_cover_owner():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1500:1700] = text[100:300]
    text[2501:2701] = text[100:300]
    starts = np.arange(0, 2950)
    owner = rng.integers(0, 1000, len(starts))
    least = {}
    for s, o in zip(starts, owner):
        k = text[s:s + 50].tobytes()
        least[k] = min(least.get(k, o), o)
    assert suffixes.least_owner(text, starts, owner).tolist() == [least[text[s:s + 50].tobytes()] for s in starts]


def test_suffix_sorting_holds_little_at_once():
    # many marks, and one passage that many documents share
    rng = np.random.default_rng(8)
    n = 60_000
    marks = np.sort(np.concatenate((rng.integers(0, 4000, n), np.full(n, 4000))))
    texts = [rng.integers(97, 123, 64, dtype=np.uint8).tobytes() for _ in range(4000)]
    content = [texts[m] + b"%08d" % i if m < 4000 else b"p" + texts[7] for i, m in enumerate(marks.tolist())]
    whole = pa.RecordBatch.from_arrays([pa.array(marks), pa.array(np.arange(2 * n)), pa.array(np.arange(2 * n) % 100 << 32), pa.array(content, pa.binary())], names=["mark", "doc_id", "place", "bytes"])
    found = 0
    tracemalloc.start()
    for b in suffixes._repeats((whole.slice(i, 5000) for i in range(0, 2 * n, 5000)), 50):
        found += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # every document but the first of a mark repeats the context's common part
    assert found == 2 * n - len(set(marks.tolist())) and peak < 120e6


def brute_lines(rows, chunks_of):
    """(doc, kept text, lines and bytes removed): every later occurrence of a chunk goes, but for lines of a first occurrence in the same text that it begins in."""
    seen, out = {}, []
    for at, (d, t) in enumerate(distinct(rows)):
        text = t or ""
        lines_ = text.split("\n")
        if lines_[-1] == "":
            lines_.pop()
        gone = set()
        for first, last in chunks_of(lines_):
            body = tuple(lines_[first:last + 1])
            if body in seen:
                doc, end = seen[body]
                gone.update(range(max(first, end + 1) if doc == at else first, last + 1))
            else:
                seen[body] = (at, last)
        kept = "".join(x + ("\n" if i < len(lines_) - 1 or text.endswith("\n") else "") for i, x in enumerate(lines_) if i not in gone)
        out.append((d, kept, len(gone), len(text.encode()) - len(kept.encode())))
    return out


def neighbours(lines_):
    return [(i, i + 1) for i in range(len(lines_) - 1)]


def anchored(lines_, window, share):
    """Bounds of chunks by the definition: anchors are windows of lines with a small hash, a chunk goes from the start of one to the end of the next."""
    def value(i):
        total = 0
        for x in lines_[i - window + 1:i + 1]:
            total = (total * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(x.encode())) % 2 ** 64
        return total >> 32
    anchors = [i for i in range(window - 1, len(lines_)) if value(i) < int(share * 2 ** 32)]
    starts = [0] + [i - window + 1 for i in anchors]
    ends = anchors + ([len(lines_) - 1] if lines_ and (not anchors or anchors[-1] != len(lines_) - 1) else [])
    return [(s, e) for s, e in zip(starts, ends) if e > s]


def shared_texts():
    # passages of two to six lines in a third of the texts, lines that repeat one another, and many copies of one text
    rng = np.random.default_rng(6)
    passages = ["\n".join(words(9000 + 10 * i + j, 14) for j in range(2 + i % 5)) for i in range(25)]
    rows = []
    for i in range(150):
        parts = [words(20_000 + 50 * i + j, 8) for j in range(int(rng.integers(1, 8)))]
        if i % 3 == 0:
            parts.insert(int(rng.integers(0, len(parts) + 1)), passages[int(rng.integers(0, 25))])
        rows.append((i, "\n".join(parts) + ("\n" if i % 4 == 0 else "")))
    rows += [(300 + i, passages[3]) for i in range(300)]
    rows += [(700, "x\nx\nx\nx\nx"), (701, "x\nx"), (702, "a\nb\na\nb\na\nb"), (703, "\n\n\n"), (704, "one line"), (705, "b\na"), (706, "x\r\nx\r\n")]
    return rows


@pytest.mark.parametrize("window, share", [(1, 1.0), (1, 31 / 32), (1, 0.5), (2, 0.7), (3, 0.4)])
def test_line_chunks(spark, docs, rows, window, share):
    bounds = neighbours if (window, share) == (1, 1.0) else lambda x: anchored(x, window, share)
    mine = shared_texts()
    for frame, data in ((docs, rows), (spark.createDataFrame(mine, "doc_id long, text string").repartition(5), mine)):
        got = {(r["doc_id"], r["text"], r["n_removed_lines"], r["n_removed_bytes"]) for r in lines.remove_repeated_lines(frame, window=window, share=share).collect()}
        assert got == set(brute_lines(data, bounds)) and (any(r[2] for r in got) or data is rows)


def test_recall_of_shared_lines(spark):
    # against all pairs of neighbouring lines that stand in an earlier place too
    mine = shared_texts()
    want = {r[0]: r[2] for r in brute_lines(mine, neighbours)}
    got = {r["doc_id"]: r["n_removed_lines"] for r in lines.remove_repeated_lines(spark.createDataFrame(mine, "doc_id long, text string")).collect()}
    assert all(got[d] <= want[d] for d in want) and sum(got.values()) >= 0.9 * sum(want.values())


def test_line_chunk_bounds_move_with_the_text():
    body = [f"line {i * i} of the shared part" for i in range(60)]
    a = "\n".join(body).encode()
    b = "\n".join(["something", "put in", "before", *body]).encode()
    cut = lambda c: {c[s:s + n].rstrip(b"\n") for s, n, _ in lines.cut_lines(c, 2, 0.3)}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 2 and len(cut(a)) > 10
    assert lines.cut_lines(b"") == [] and lines.cut_lines(b"one") == [] and lines.cut_lines(b"a\nb") == [(0, 3, 2)]


def brute_simhash(text, n_words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n_words]).encode(), 42) for i in range(max(1, len(w) - n_words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """prints: (key, fingerprint) in order of key; the least key of each component."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [prints[find(i)][0] for i in range(len(prints))]


def test_simhash(docs, rows):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    items = [(d, brute_simhash(t)) for d, t in distinct(rows)]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(items, brute_components(items))), key=str)
    assert got == want


def test_covering_masks_meet_every_pair_within_the_radius():
    masks, rng = simhash.covering_masks(), np.random.default_rng(1)
    assert len(masks) == 31 and len(set(masks)) == 31
    for _ in range(2000):
        flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(not flip & m for m in masks)


@pytest.mark.parametrize("block", [5, 2048])
def test_links_connect_chains_and_dense_groups(spark, block):
    rng = np.random.default_rng(2)
    centres = [int(x) for x in rng.integers(0, 2 ** 63, 4)]
    prints = {c for c in centres}
    for c in centres[:3]:
        prints |= {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for _ in range(40)}
    x = centres[3]
    for i in range(0, 60, 4):
        x ^= 15 << i
        prints.add(x)
    prints = sorted(p & (2 ** 63 - 1) for p in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(frame, block=block)).collect()}
    assert [roots.get(p, p) for p in prints] == brute_components([(p, p) for p in prints])


def test_exploded_prints_and_many_labels_are_not_broadcast(spark, monkeypatch):
    rng, plans = np.random.default_rng(4), {simhash: [], common: []}
    prints = sorted({int(x) ^ b for x in rng.integers(0, 2 ** 62, 200) for b in (0, 1, 6)})
    for module, seen in plans.items():
        monkeypatch.setattr(module, "stored", lambda df, seen=seen: seen.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100, raising=False)
    frame = stored(spark.createDataFrame([(p,) for p in prints], "fingerprint long"))
    found = common.components(simhash.links(frame))
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert [roots.get(p, p) for p in prints] == brute_components([(p, p) for p in prints])
    # the hint of the labels holds for joins of the caller too
    plans[common].append(frame.join(found, frame["fingerprint"] == found["node"], "left")._jdf.queryExecution().executedPlan().toString())
    for seen in plans.values():
        assert any("SortMergeJoin" in p for p in seen) and not any("BroadcastHashJoin" in p for p in seen)


@pytest.mark.parametrize("run", [exact.exact_duplicates, suffixes.remove_repeats, lines.remove_repeated_lines, simhash.near_duplicates])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


def test_keep_documents(docs, rows):
    kept = common.keep_documents(docs, exact.exact_duplicates(docs).filter("kept"))
    assert kept.columns == docs.columns and kept.count() == len({STRIP.sub("", t or "") for _, t in rows})


def test_digest():
    assert suffixes.digest(b"") == hashlib.sha256(b"").hexdigest()
