"""URL rules against a plain loop over all rules."""

import random

from rainshade.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("Net", "/fr/", "block"),
         ("a.net", "", "block"), ("b.a.net", "/x", "allow"), ("b.a.net", "/x/y", "block"), ("a.net", "/x/y/z", "allow"), ("dup.org", "/", "allow"), ("dup.org", "/", "block"),
         ("", "/all", "block"), (None, "/none", "block"), ("null.org", None, "block"), ("c.net", "/x", "allow"), ("net", "/xéé", "block"), ("net", "/x￿", "allow")]


def plain(url):
    """(host, path, rule, verdict) by trying every rule."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3:]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, v))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def addresses(n, seed):
    rng = random.Random(seed)
    hosts = ["com", "example.com", "WWW.Example.com", "m.www.example.com", "net", "x.net", "a.net", "b.a.net", "c.b.a.net", "ba.net", "dup.org", "q.null.org", "other.org", "", "..", "a..net", "é.net",
             "b.a.net:80", "anet", "c.net"]
    paths = ["", "/", "/en/", "/en", "/en/7.html", "/es/", "/fr/x", "/x", "/x/y", "/x/y/z", "/x/yz", "/xéé/1", "/x￿", "/x\U0010ffff", "/all", "/none", "/x\n/y"]
    tails = ["", "?a=/en/", "#t", "?", "/?x://y"]
    return [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(n)]


def test_every_rule_by_hand(spark):
    rows = [(i, u) for i, u in enumerate([*addresses(3000, 1), None, "", "no scheme.com/", "://", "http://com/" + "a/" * 20_000, "http://x.net/x/y/z"])]
    rows += [(7, rows[7][1]), (None, "http://com/"), (None, "http://com/")]
    pages = spark.createDataFrame([(i, u, "rule", 5, "v") for i, u in rows], "page_id long, url string, rule string, grp long, verdict string").repartition(5)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = sorted(((i, *plain(u)) for i, u in rows), key=repr)
    for block in (1 << 16, 5):
        got = urls.judge(pages, rules, block=block)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[4] for r in want} == {"allow", "block"} and len({r[3] for r in want}) > 12


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://com/x"), (2, None)], "page_id long, url string")
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in urls.judge(pages, rules.limit(0), default="block").orderBy("page_id").collect()] == [(1, "com", "/x", None, "block"), (2, "", "", None, "block")]


def test_random_nested_rules(spark):
    rng = random.Random(3)

    def name(n):
        return "".join(rng.choice("ab") for _ in range(rng.randint(0, n)))
    rules = {(g, name(5)) for g in "xyz" for _ in range(25)}
    points = {(g, name(7)) for g in "wxyz" for _ in range(80)}
    got = urls.innermost(spark.createDataFrame(list(points), "grp string, key string"), spark.createDataFrame(list(rules), "grp string, key string"), 3)
    want = {(g, p, max((k for h, k in rules if h == g and p.startswith(k)), key=len)) for g, p in points if any(h == g and p.startswith(k) for h, k in rules)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_main_path_stays_in_the_jvm(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://com/x")], "page_id long, url string")
    plan = urls.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
