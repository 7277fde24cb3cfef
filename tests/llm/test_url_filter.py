from __future__ import annotations

from collections import defaultdict
from math import sqrt

import pytest
from pyspark.sql import functions as F

from webstrata.llm import url_filter as U

URLS = [
    ("http://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://net/", "net", "/", "net/", "block"), ("http://x.net", "x.net", "", None, None), ("https://planet/x", "planet", "/x", None, None),
    ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/x", "notexample.com", "/de/x", None, None), ("http://w.org/fr/a://b", "w.org", "/fr/a:", "org/fr/", "allow"), ("nothing", "", "", None, None), (None, "", "", None, None),
    ("http://u@Ünï.ORG:80/fr/", "u@Ünï.org:80", "/fr/", None, None), ("a://b#/net/", "b", "", None, None),
]


def test_hosts_and_rules(spark):
    df = spark.createDataFrame([(k, u[0], "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in U.filter_urls(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        if "://b" in (URLS[k][0] or "") and host == "w.org":
            path = "/fr/a://b"  # only the first :// matters
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict or "allow"), URLS[k]
    assert U.filter_urls(df.limit(0)).count() == 0


def brute(urls, depth=3, support=5, z=1.96, prior=10.0, purity=0.5):
    """{(host, pattern): (template, verdict)} from rows (host, pattern, bad)."""
    stat = defaultdict(lambda: [0, 0, 0])
    for host, pattern, bad in urls:
        s = stat[host, pattern]
        s[0], s[1], s[2] = s[0] + 1, s[1] + (bad is not None), s[2] + bool(bad)
    template = {k: list(k[1]) for k in stat}
    for level in range(depth):
        n = defaultdict(int)
        for k, t in template.items():
            n[k[0], tuple(t[: level + 1])] += stat[k][0]
        for k, t in template.items():
            if len(t) > level and n[k[0], tuple(t[: level + 1])] < support:
                t[level] = "*"
    for level in reversed(range(depth)):
        up, own = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        parent = {k: tuple("*" if i == level else s for i, s in enumerate(t)) for k, t in template.items()}
        for k, t in template.items():
            for where in (up[k[0], parent[k]], own[k[0], tuple(t)]):
                where[0], where[1] = where[0] + stat[k][1], where[1] + stat[k][2]
        for k, t in list(template.items()):
            an, ab = up[k[0], parent[k]]
            n, b = own[k[0], tuple(t)]
            rate = (ab + 0.5) / (an + 1.0)
            if abs(b - n * rate) / sqrt(rate * (1 - rate) * max(n, 1)) <= z:
                template[k] = list(parent[k])
    total = sum(s[2] for s in stat.values()) / max(sum(s[1] for s in stat.values()), 1)
    n, b = defaultdict(int), defaultdict(int)
    for k, t in template.items():
        n[k[0], tuple(t)] += stat[k][1]
        b[k[0], tuple(t)] += stat[k][2]
    return {k: (tuple(t), "block" if 1 - (b[k[0], tuple(t)] + prior * total) / (n[k[0], tuple(t)] + prior) < purity else "allow") for k, t in template.items()}


def test_tree_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for k in range(3000):
        host = rnd.choice(["a.com", "a.com", "b.com", "c.com"])
        section = rnd.choice(["spam", "news", "blog", f"rare{k}"])
        tail = rnd.choice([[], ["*"], ["x", "*"], ["y", "z", "**"]])
        bad = None if rnd.random() < 0.4 else rnd.random() < (0.9 if section == "spam" and host != "c.com" else 0.1)
        rows.append((host, [section, *tail][:4], bad))
    df = spark.createDataFrame(rows, "host string, pattern array<string>, bad boolean")
    got = {(r.host, tuple(r.pattern)): (tuple(r.template), r.method_verdict) for r in U.template_tree(df).collect()}
    want = brute([(h, tuple(p), b) for h, p, b in rows])
    assert got == want
    blocked = {k for k, v in got.items() if v[1] == "block"}
    assert any(k[1][0] == "spam" for k in blocked) and not any(k[1][0] == "news" for k in blocked)


@pytest.mark.parametrize(("path", "want"), [("/en/123", ["en", "*"]), ("/a/12.html", ["a", "*.html"]), ("/a/b/c/d/e", ["a", "b", "c", "**"]), ("", []), ("//x//", ["x"]), ("/post-20240101", ["*"]), ("/deadbeefdeadbeef", ["*"])])
def test_patterns(spark, path, want):
    assert spark.range(1).select(U.pattern(F.lit(path))).first()[0] == want


def test_native_and_labels(spark):
    pages = spark.createDataFrame([(k, f"http://h.com/bad/{k}") for k in range(60)] + [(k, f"http://h.com/good/{k}") for k in range(60, 120)], "page_id long, url string")
    labels = spark.createDataFrame([(k, k < 60) for k in range(120)] + [(5, None), (None, True)], "label_id long, bad boolean")
    out = U.filter_urls(pages, labels)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r.page_id for r in out.where("verdict = 'block'").collect()} == set(range(60))


def test_deep_paths(spark):
    """Branches that part at the fourth and sixth segment are judged apart."""
    rows = [(k, f"http://h.com/en/blog/all/{'spam' if k < 60 else 'news'}/x/{k}") for k in range(120)]
    rows += [(k, f"http://d.com/a/b/c/d/e/{'bad' if k < 180 else 'good'}/{k}") for k in range(120, 240)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k < 60 or 120 <= k < 180) for k in range(240)], "label_id long, bad boolean")
    out = U.filter_urls(pages, labels, ()).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == {*range(60), *range(120, 180)}
    assert {r.template for r in out if r.page_id < 60} == {"/*/*/*/spam/*/*"}


def test_all_levels_against_brute_force(spark):
    import random

    rnd = random.Random(9)
    rows = []
    for _ in range(4000):
        path = [rnd.choice("ab"), *(rnd.choice("xyz") for _ in range(rnd.randrange(6)))]
        bad = None if rnd.random() < 0.3 else rnd.random() < (0.9 if path[4:5] == ["x"] else 0.1)
        rows.append((rnd.choice(["a.com", "b.com"]), path, bad))
    df = spark.createDataFrame(rows, "host string, pattern array<string>, bad boolean")
    got = {(r.host, tuple(r.pattern)): (tuple(r.template), r.method_verdict) for r in U.template_tree(df, depth=None).collect()}
    assert got == brute([(h, tuple(p), b) for h, p, b in rows], depth=6)


def test_a_bad_branch_among_good_ones(spark):
    """At the default parameters: a spam branch of one host among many hosts' clean pages, few of them labelled; a few bad labels alone block nothing."""
    import random

    rnd = random.Random(3)
    rows = [(k, f"http://h{k % 40}.com/{rnd.choice(['news', 'blog', 'wiki'])}/{k}", rnd.random() < 0.15 if rnd.random() < 0.4 else None) for k in range(4000)]
    rows += [(k, f"http://h7.com/pills/{k}", rnd.random() < 0.95 if rnd.random() < 0.4 else None) for k in range(4000, 4100)]
    pages = spark.createDataFrame([(k, u) for k, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(k, bad) for k, _, bad in rows if bad is not None], "label_id long, bad boolean")
    out = {r.page_id: r for r in U.filter_urls(pages, labels).collect()}
    assert {k for k, r in out.items() if r.verdict == "block"} == set(range(4000, 4100))
