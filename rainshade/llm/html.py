"""Main text of web pages by wrapper induction.

The pages of a host are aligned with one page of it, the host's exemplar, by simple tree matching. A place of the exemplar at which most of the
host's pages show the same text is template; the places that vary are slots. A page's text is what fills its slots, without menus,
adverts, forms and the like.
"""

from __future__ import annotations

import functools
import html
import math
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainshade.llm.common import stored

CONSTANT_SHARE = 0.6
CONSTANT_PAGES = 5
# pairs of child runs up to which a table is filled cell by cell, beyond by whole rows: the same table; and numbers that one alignment holds to save work
CELLS = 4096
HELD = 20_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
                  "legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCK - {"tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend", "summary"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
OUTSIDE = frozenset("nav footer aside form script style noscript iframe button select option textarea template dialog menu head title svg canvas audio video object input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note status".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
                  "footer footnav masthead topbar sidebar sidebars side rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe "
                  "subscription signup login comment comments commentlist respond reply replies discussion disqus share sharing social related recommended recommendations pagination pager "
                  "toolbar search searchform skip hidden paywall disclaimer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# inside an article a name of several words tells of its surroundings only if all its words do
PARTS = frozenset("area article articles bar block blog body bottom box button buttons card cards container content entry form header icon icons inline inner item items left link links list main "
                  "module more page panel post posts reader right row section site stories story tags text thread title top unit user wrap wrapper".split())
# elements of running text, whose names do not tell of their surroundings inside an article
RUNNING = HEADINGS | frozenset("p blockquote pre dl dt dd table caption thead tbody tfoot tr td th figcaption figure".split())
BESIDE = frozenset("has with no not without".split())
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+')"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:{_VALUE}|[^>=]++|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_TELLING = frozenset("class id role hidden aria-hidden style".split())
_HINT_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element: label (tag and the words of its class and id), children, and whether it lies outside the main text."""
    __slots__ = ("tag", "label", "children", "outside", "chars", "shape", "size", "no", "parent")

    def __init__(self, tag: str, label: str, outside: bool, parent: "Node | None"):
        self.tag, self.label, self.outside, self.parent = tag, label, outside, parent
        self.children: list[Node] = []
        self.chars, self.no = 0, -1


def _within(up: Node | None) -> bool:
    """Whether the element or one around it is an article or main element."""
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None


def _told(words: list[str], inside: bool) -> bool:
    """Whether a name tells that its element is no main text: its first or last word is a hint; in an article the others must fit that."""
    if not words or HINTS.isdisjoint((words[0], words[-1])) or not BESIDE.isdisjoint(words):
        return False
    return not inside or all(w in HINTS or w in PARTS for w in words)


def _open(tag: str, attributes: str, parent: Node) -> Node:
    outside = parent.outside or tag in OUTSIDE
    label = tag
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name not in _TELLING:
                continue
            if name in ("class", "id"):
                names = [[w.lower() for w in _HINT_WORDS.findall(x)] for x in value.split()]
                label += "." + "-".join(w for words in names for w in words)
                # names such as no-sidebar or has-ads tell of something beside the element
                inside = _within(parent)
                told = not (inside and tag in RUNNING) and any(_told(words, inside) for words in names)
                anchor = name == "id" and (tag in HEADINGS or tag == "section" and inside)
                outside = outside or (told and not anchor and tag not in ("body", "html", "article", "main"))
            elif name == "role":
                outside = outside or value.lower() in ROLES
            elif name == "style":
                outside = outside or "display:none" in value.replace(" ", "").lower()
            else:
                outside = outside or name == "hidden" or value.lower() == "true"
    if tag == "header" and not outside:
        outside = not _within(parent)
    return Node(tag, label, outside, parent)


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The element tree and the blocks of text in page order, each with the element it stands in."""
    root = Node("#", "#", False, None)
    at, blocks, parts, pos, n = root, [], [], 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                holder = at
                while holder.tag not in BLOCK and holder.parent is not None:
                    holder = holder.parent
                blocks.append((holder if not at.outside else at, text))

    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            tail = page[pos:]
            cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", tail)
            parts.append(tail[:cut.start()] if cut else tail)
            break
        if m.start() > pos:
            parts.append(page[pos:m.start()])
        pos = m.end()
        if m[1]:
            tag = m[1].lower()
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                if tag in BLOCK or up.outside:
                    flush()
                at = up.parent
            elif tag == "p":
                flush()
            if tag in ("td", "th"):
                parts.append(" ")
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            flush()
            up = at
            while up is not None and up.tag != "p" and up.tag not in ("td", "th", "button", "object"):
                up = up.parent
            if up is not None and up.tag == "p" and tag in CLOSES_P:
                at = up.parent
            if tag in SIBLINGS:
                up = at
                while up is not None and up.tag not in SIBLINGS[tag] and up.tag not in SCOPES[tag]:
                    up = up.parent
                if up is not None and up.tag in SIBLINGS[tag]:
                    while tag == "tr" and up.tag != "tr" and up.parent.tag in ("tr",):
                        up = up.parent
                    at = up.parent
            if tag in ("td", "th"):
                parts.append(" ")
        elif tag in BLOCK:
            flush()
        node = _open(tag, m[3] or "", at)
        if node.outside and not at.outside:
            flush()
        at.children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            at = node
    flush()
    return root, blocks


def _shapes(node: Node, count: list[int]) -> None:
    """Number the elements in page order and give each its size and a hash of its labels, children first."""
    stack = [(node, False)]
    while stack:
        x, done = stack.pop()
        if done:
            x.size = 1 + sum(c.size for c in x.children)
            x.shape = hash((x.label, *[c.shape for c in x.children]))
        else:
            x.no = count[0]
            count[0] += 1
            stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children))


def align(page: Node, exemplar: Node) -> dict[int, int]:
    """Simple tree matching: page element -> exemplar element, the largest match that keeps labels, order and ancestry; lists of any length are matched by their whole table."""
    weights: dict[tuple[int, int], int] = {}
    # a page may nest its elements deeper than Python's default limit
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))

    def middle(a: Node, b: Node) -> tuple[int, int, int]:
        """Length of the equal beginning, and ends of the middle parts of two child lists."""
        x, y = a.children, b.children
        s, n = 0, min(len(x), len(y))
        while s < n and x[s].shape == y[s].shape:
            s += 1
        e = 0
        while e < n - s and x[-1 - e].shape == y[-1 - e].shape:
            e += 1
        return s, len(x) - e, len(y) - e

    def runs(nodes: list[Node]) -> list[list[Node]]:
        """Neighbours of one shape, such as the paragraphs of an article, are matched as one run."""
        out: list[list[Node]] = []
        for x in nodes:
            if out and out[-1][0].shape == x.shape:
                out[-1].append(x)
            else:
                out.append([x])
        return out

    def rows_of(x: list[list[Node]], y: list[list[Node]]) -> tuple[int, int, list[tuple[int, np.ndarray]], Callable]:
        """Last number of the table, gap, every gap-th row and a function for the rows between. A row is its first place and its numbers.

        Only places that a best match can pass are filled: what comes before and after a place is worth no more than the lighter side of
        either, so a place may fall short of the lighter list by no more than the best match does. A first round finds a match, whose
        shortfall bounds that of the best; the numbers on best matches, and so the match, are those of the full table.
        """
        own, other = (np.concatenate(([0], np.cumsum([u[0].size * len(u) for u in z]))) for z in (x, y))
        least = int(min(own[-1], other[-1]))
        number: dict[int, int] = {}
        at = np.array([number.setdefault(v[0].shape, len(number)) for v in y])
        first = {number[v[0].shape]: v[0] for v in reversed(y)}
        kinds, sizes = [first[k] for k in range(len(first))], np.array([len(v) for v in y])
        known: dict[tuple[int, int], np.ndarray] = {}
        gap = math.isqrt(len(x)) + 1

        def gain(u: list[Node]) -> np.ndarray:
            found = known.get((u[0].shape, len(u)))
            if found is None:
                by_kind = np.array([weight(u[0], v) if u[0].label == v.label else 0 for v in kinds])
                found = np.concatenate(([0], by_kind[at] * np.minimum(sizes, len(u))))
                if len(known) * len(y) < HELD:
                    known[u[0].shape, len(u)] = found
            return found

        def row_after(slack: int, i: int, last: tuple[int, np.ndarray], most: int) -> tuple[int, np.ndarray]:
            lo = int(np.searchsorted(other, own[i] - (own[-1] - least) - slack))
            hi = min(int(np.searchsorted(other, own[i] + (other[-1] - least) + slack, "right")) - 1, most)
            if i == 0:
                return lo, np.zeros(hi - lo + 1, np.int64)
            held = np.full(hi - lo + 2, -1 << 60)
            begin, end = max(lo - 1, last[0]), min(hi, last[0] + len(last[1]) - 1)
            if begin <= end:
                held[begin - lo + 1:end - lo + 2] = last[1][begin - last[0]:end - last[0] + 1]
            row = np.maximum(held[1:], held[:-1] + gain(x[i - 1])[lo:hi + 1])
            return lo, np.maximum.accumulate(row, out=row)

        slack = least // 16
        while True:
            last = row_after(slack, 0, None, len(y))
            marks = [last]
            for i in range(1, len(x) + 1):
                last = row_after(slack, i, last, len(y))
                if i % gap == 0:
                    marks.append(last)
            best = int(last[1][-1])
            if least - max(best, 0) <= slack:
                return best, gap, marks, functools.partial(row_after, slack)
            slack = least - max(best, 0)

    def pairs(x: list[list[Node]], y: list[list[Node]]) -> list[tuple[int, int]]:
        """Matched runs of two lists, walked back through their table. Of a large one every gap-th row is held and the rows between are made again."""
        found, j = [], len(y)
        if len(x) * len(y) <= CELLS:
            gap, marks, row_after = len(x), [None], None
        else:
            _, gap, marks, row_after = rows_of(x, y)
        for begin in range((len(x) - 1) // gap * gap, -1, -gap):
            if row_after is None:
                rows = [(0, row) for row in table(x, y)]
            else:
                rows = [marks[begin // gap]]
                for i in range(begin + 1, min(begin + gap, len(x)) + 1):
                    rows.append(row_after(i, rows[-1], j))
            i = len(rows) - 1
            while i and j:
                (lo, row), (lo_above, above) = rows[i], rows[i - 1]
                if lo_above <= j < lo_above + len(above) and row[j - lo] == above[j - lo_above]:
                    i -= 1
                elif j > lo and row[j - lo] == row[j - lo - 1]:
                    j -= 1
                else:
                    found.append((begin + i - 1, j - 1))
                    i, j = i - 1, j - 1
        return found[::-1]

    def total(x: list[list[Node]], y: list[list[Node]]) -> int:
        """The last number of the table."""
        if not x or not y:
            return 0
        return table(x, y)[-1][-1] if len(x) * len(y) <= CELLS else rows_of(x, y)[0]

    def table(x: list[list[Node]], y: list[list[Node]]) -> list[list[int]]:
        rows = [[0] * (len(y) + 1)]
        for u in x:
            last, row = rows[-1], [0]
            for j, v in enumerate(y):
                best = last[j + 1] if last[j + 1] > row[j] else row[j]
                if u[0].label == v[0].label:
                    best = max(best, last[j] + weight(u[0], v[0]) * min(len(u), len(v)))
                row.append(best)
            rows.append(row)
        return rows

    def weight(a: Node, b: Node) -> int:
        if a.shape == b.shape:
            return a.size
        if not a.children or not b.children:
            return 1
        # elements of one shape weigh the same
        key = (a.shape, b.shape)
        found = weights.get(key)
        if found is None:
            s, p, q = middle(a, b)
            inner = total(runs(a.children[s:p]), runs(b.children[s:q]))
            found = 1 + sum(c.size for c in a.children[:s]) + sum(c.size for c in a.children[p:]) + inner
            # a weight that is not held is found again
            if len(weights) > HELD // 10:
                weights.clear()
            weights[key] = found
        return found

    out, todo = {}, [(page, exemplar)]
    while todo:
        a, b = todo.pop()
        out[a.no] = b.no
        s, p, q = middle(a, b)
        todo.extend(zip(a.children[:s], b.children[:s]))
        todo.extend(zip(a.children[p:], b.children[q:]))
        if p > s and q > s:
            x, y = runs(a.children[s:p]), runs(b.children[s:q])
            for i, j in pairs(x, y):
                todo.extend(zip(x[i], y[j]))
    return out


def slots(page: Node, exemplar: Node, matched: dict[int, int]) -> dict[int, int]:
    """Page element -> number of its slot: neighbours of one shape in the exemplar are one repeated slot, named by the first.

    An element that the matching left over takes the slot of a neighbour of its own shape, so a slot repeats as often as a page likes.
    """
    first, by_no, out = {}, {}, {}
    todo = [exemplar]
    while todo:
        x = todo.pop()
        by_no[x.no] = x
        first.setdefault(x.no, x.no)
        for left, right in zip(x.children, x.children[1:]):
            first[right.no] = first.get(left.no, left.no) if left.shape == right.shape else right.no
        todo.extend(x.children)

    def take(a: Node, b: Node) -> None:
        pairs = [(a, b)]
        while pairs:
            u, v = pairs.pop()
            out[u.no] = first[v.no]
            if u.shape == v.shape:
                pairs.extend(zip(u.children, v.children))

    todo = [page]
    while todo:
        x = todo.pop()
        if x.no in matched:
            out[x.no] = first[matched[x.no]]
        row = x.children
        for order in (range(1, len(row)), range(len(row) - 2, -1, -1)):
            step = -1 if order.step > 0 else 1
            for i in order:
                c, near = row[i], row[i + step]
                if c.no not in matched and c.no not in out and c.shape == near.shape and (near.no in matched or near.no in out):
                    take(c, by_no[matched.get(near.no, out.get(near.no))])
        todo.extend(row)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of each page that are not outside, with the number of the exemplar's element they are aligned with (-1: none)."""
    kept_host, kept = None, None
    kind = pa.list_(pa.struct([("node", pa.int32()), ("key", pa.int64()), ("text", pa.string())]))
    for b in batches:
        out = []
        for page, exemplar, host in zip(b.column("html").to_pylist(), b.column("exemplar").to_pylist(), b.column("host").to_pylist()):
            root, blocks = parse(page or "")
            _shapes(root, [0])
            if host != kept_host or kept is None:
                kept_host, kept = host, parse(exemplar or "")[0]
                _shapes(kept, [0])
            to = slots(root, kept, align(root, kept))
            out.append([{"node": to.get(node.no, -1), "key": xxhash.xxh64_intdigest(text) - (1 << 63), "text": text} for node, text in blocks if not node.outside])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, kind)], names=[*names, "blocks"])


def host_of(url):
    """Lower-case host of a URL without port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = CONSTANT_SHARE, least: int = CONSTANT_PAGES) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars, n_template (blocks taken as the host's template).

    White space inside a block becomes one space; blocks are joined by \\n in page order. A block is template if its text stands at its place on
    `share` of the host's pages and on `least` pages or more; pages of a host with equal blocks count once. Null html gives an empty text, pages without a
    host are one host, repeated rows are kept, an empty table gives no rows, and other columns are ignored.
    """
    slim = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    # the exemplar is the page with the smallest hash, so it does not depend on the order of rows
    exemplars = stored(slim.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("exemplar")))
    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    names = ["page_id", "url", "host"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, names)

    # one exemplar per host: the optimizer broadcasts the table only while it is small
    aligned = stored(slim.join(exemplars, "host").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, blocks array<struct<node:int,key:long,text:string>>"))
    places = aligned.select("host", F.array_distinct(F.transform(F.filter("blocks", lambda x: x["node"] >= 0), lambda x: F.struct(x["node"].alias("node"), x["key"].alias("key")))).alias("places"),
                            F.xxhash64(F.transform("blocks", lambda x: x["key"])).alias("page"))
    once = places.groupBy("host", "page").agg(F.first("places").alias("places"))
    n_pages = once.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    seen = once.select("host", F.inline("places")).groupBy("host", "node", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    template = (seen.join(n_pages, "host").filter(F.col("n") >= share * F.col("n_pages")).groupBy("host").agg(F.collect_list(F.struct("node", "key")).alias("template")))
    marked = aligned.join(stored(template), "host", "left")
    constant = lambda x: F.coalesce(F.array_contains(F.col("template"), F.struct(x["node"].alias("node"), x["key"].alias("key"))), F.lit(False))
    varying = marked.select("page_id", "url", F.filter("blocks", lambda x: ~constant(x)).alias("blocks"), F.size(F.filter("blocks", constant)).alias("n_template"))
    return (varying.select("page_id", "url", F.array_join(F.transform("blocks", lambda x: x["text"]), "\n").alias("text"), "n_template")
            .select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template"))
