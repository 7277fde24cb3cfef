from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from webstrata.operators import archive, capture, links, pages, selection, workflow

T0 = dt.datetime(2024, 1, 1)


def test_current_view_any_order(spark):
    """Versions 1, 3, 2, again 3 and a tombstone 4, in any order and number of partitions."""
    versions = [("o", "s", "p", v, d, f"t{v}") for v, d in ((1, False), (3, False), (2, False), (3, False))] + [("o", "s", "q", 3, False, "x"), ("o", "s", "q", 4, True, "y")]
    for seed in range(3):
        random.Random(seed).shuffle(versions)
        df = spark.createDataFrame(versions, "owner_id string, scan_id string, page_id string, record_version int, is_deleted boolean, title string").repartition(seed + 1)
        assert rows(pages.current_view(df, pages.PAGE).select("page_id", "title")) == [("p", "t3")]


def test_frontier(spark):
    pages_ = spark.createDataFrame([("s", "p0", 0)], "scan_id string, page_id string, depth int")
    link = "scan_id string, source_page_id string, target_url string, is_internal boolean, is_followable boolean, ordinal int"
    found = spark.createDataFrame([("s", "p0", "https://e.com/a", True, True, 0), ("s", "p0", "https://e.com/a", True, True, 1), ("s", "p0", "https://e.com/b", True, True, 2), ("s", "p0", "https://x.com/", False, True, 3), ("s", "p0", "https://e.com/n", True, False, 4)], link)
    known = spark.createDataFrame([("s", "https://e.com/")], "scan_id string, url string")
    limits = spark.createDataFrame([("s", 4, 2)], "scan_id string, max_pages int, max_depth int")
    first = links.expand_frontier(pages_, found, known, limits)
    assert rows(first.select("url", "depth", "parent_page_id")) == [("https://e.com/a", 1, "p0"), ("https://e.com/b", 1, "p0")]
    known2 = known.unionByName(first.select("scan_id", "url"))
    ring = first.select("scan_id", F.col("url").alias("page_id"), "depth")
    shared = spark.createDataFrame([("s", u, t, True, True, 0) for u in ("https://e.com/a", "https://e.com/b") for t in ("https://e.com/shared?a=1&b=2",)] + [("s", "https://e.com/b", "https://e.com/z", True, True, 1)], link)
    second = links.expand_frontier(ring, shared, known2, limits)
    assert rows(second.select("url", "depth", "parent_page_id")) == [("https://e.com/shared?a=1&b=2", 2, "https://e.com/a")]  # the cap of 4 pages leaves one
    third = links.expand_frontier(second.select("scan_id", F.col("url").alias("page_id"), "depth"), shared, known2, limits)
    assert third.count() == 0


def test_crawl_depths(spark):
    edges = spark.createDataFrame([("s", p, p * 2 + k, k) for p in range(1, 40) for k in (0, 1)] + [("s", 5, 1, 9)], "scan_id string, source long, target long, ordinal int")
    got = {r.node: (r.depth, r.parent) for r in links.crawl_depths(edges, spark.createDataFrame([("s", 1)], "scan_id string, node long"), 3).collect()}
    assert got == {n: (n.bit_length() - 1, None if n == 1 else n // 2) for n in range(1, 16)}


def test_crawl_depths_of_all_edges(spark):
    """The whole edges shape against a search in Python."""
    from collections import defaultdict

    from tests.conftest import SMALL
    from webstrata.plans import catalog

    out, want = defaultdict(lambda: defaultdict(set)), {}
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_partkey").collect():
        out[str(r.l_suppkey % 100)][r.l_orderkey % 500].add(r.l_partkey % 500)
    for scan, near in out.items():
        ring = {min(near)}
        for depth in range(11):
            want |= {(scan, n): depth for n in ring}
            ring = {t for n in ring for t in near.get(n, ()) if (scan, t) not in want}
    found = catalog.queries()["o069_crawl_depths_all"](spark, SMALL).collect()
    assert {(r.scan_id, r.node): r.depth for r in found} == want and len(found) == len(want)
    assert max(want.values()) > 3
    for r in found:
        assert r.parent is None if r.depth == 0 else want[r.scan_id, r.parent] == r.depth - 1 and r.node in out[r.scan_id][r.parent]


def test_filters_same_finding(spark):
    p = spark.createDataFrame([("o", "s", "1", "SUCCESS", 200, "https://e.com/A", True, "text/html"), ("o", "s", "2", "SKIPPED", 0, "https://e.com/b", False, "text/html; charset=utf-8"), ("o", "s", "3", "HTTP_ERROR", 500, "https://e.com/c", False, "")], "owner_id string, scan_id string, page_id string, fetch_outcome string, status_code int, normalized_url string, is_indexable boolean, content_type string")
    f = spark.createDataFrame([("o", "s", "1", "INFO", "A"), ("o", "s", "1", "ERROR", "B")], "owner_id string, scan_id string, page_id string, severity string, finding_code string")
    ids = lambda **kw: [r[2] for r in rows(pages.filter_pages(p, f, **kw))]
    assert ids(severities=("ERROR",), codes=("A",)) == [] and ids(severities=("ERROR",), codes=("B",)) == ["1"]
    assert ids(outcomes=("WARNING", "FAILED")) == ["2", "3"] and ids(query="/a") == ["1"] and ids(content_types=("text/html",)) == ["1"]
    assert [r[2] for r in rows(pages.issue_pages(p, f))] == ["1", "3"]
    summary = pages.scan_summary(p, f).first()
    assert (summary.total_urls, summary.issue_pages, summary.finding_count, summary.status_2xx, summary.status_5xx, summary.no_response) == (3, 2, 2, 1, 1, 1)
    assert pages.scan_summary(p, f.limit(0)).first().finding_count == 0


def test_keyset_pages_all(spark):
    df = spark.createDataFrame([(f"u{k % 3}", str(k)) for k in range(20)], "normalized_url string, page_id string")
    seen, after = [], None
    while True:
        got = [tuple(r) for r in pages.page_keyset(df, after, 6).collect()]
        seen += got[:6]
        if len(got) <= 6:
            break
        after = got[5]
    assert seen == sorted((f"u{k % 3}", str(k)) for k in range(20))
    cursor = pages.next_cursor(pages.page_keyset(df, None, 6), ["normalized_url", "page_id"], 6).first()
    assert cursor.has_more and tuple(cursor.cursor) == seen[5]


def design(spark, data):
    base = {"scan_id": "s", "root_url": "https://e.com/", "budget_limited": False, "final_url": "", "outcome": "success", "status_code": 200, "content_type": "text/html", "canonical_url": "", "html_lang": "", "hreflang": [], "h1": [], "h2": [], "schema_org_types": [], "scripts": 1, "stylesheets": 1}
    schema = "scan_id string, root_url string, budget_limited boolean, id string, url string, final_url string, outcome string, status_code int, content_type string, canonical_url string, html_lang string, hreflang array<struct<language:string,url:string>>, h1 array<string>, h2 array<string>, schema_org_types array<string>, scripts int, stylesheets int"
    names = [c.strip().split()[0] for c in schema.replace("struct<language:string,url:string>", "x").split(",")]
    return spark.createDataFrame([tuple((base | d)[n] for n in names) for d in data], schema)


def test_selection(spark):
    posts = [{"id": f"p{k:03}", "url": f"https://e.com/blog/post-{k:03}"} for k in range(12)]
    got = {r.id: r for r in selection.select_design_pages(design(spark, [{"id": "i", "url": "https://e.com/blog"}, *posts])).collect()}
    assert got["i"].verdict == "SELECTED" and got["i"].role == "BLOG_INDEX"
    assert [k for k, r in got.items() if r.role == "BLOG_DETAIL" and r.verdict == "SELECTED"] == ["p000"]
    assert sum(r.verdict == "SEMANTIC_TEMPLATE_DUPLICATE" for r in got.values()) == 11
    data = [
        {"id": "root", "url": "https://e.com/", "html_lang": "en"}, {"id": "vi", "url": "https://e.com/vi/x"}, {"id": "app", "url": "https://e.com/app"}, {"id": "q", "url": "https://e.com/app?ref=1"},
        {"id": "c", "url": "https://e.com/other", "canonical_url": "/app"}, {"id": "ext", "url": "https://x.com/?k=v"}, {"id": "pdf", "url": "https://e.com/f.pdf"}, {"id": "warn", "url": "https://e.com/w", "outcome": "warning"},
        {"id": "fail", "url": "https://e.com/f", "outcome": "failed", "status_code": 0}, {"id": "e404", "url": "https://e.com/missing", "outcome": "failed", "status_code": 404}, {"id": "api", "url": "https://e.com/api/x"}, {"id": "bad", "url": "http://["},
        {"id": "css", "url": "https://e.com/land", "stylesheets": 4},
    ]
    got = {r.id: r.verdict for r in selection.select_design_pages(design(spark, data)).collect()}
    assert got == {
        "root": "SELECTED", "vi": "ALTERNATE_LOCALE", "app": "SELECTED", "q": "TRACKING_OR_QUERY_VARIANT", "c": "CANONICAL_DUPLICATE", "ext": "EXTERNAL_ORIGIN", "pdf": "NON_HTML", "warn": "ROBOTS_OR_POLICY_BLOCKED",
        "fail": "HTTP_FAILURE", "e404": "SELECTED", "api": "ROBOTS_OR_POLICY_BLOCKED", "bad": "HTTP_FAILURE", "css": "SELECTED",
    }
    limited = selection.select_design_pages(design(spark, [{"id": k, "url": f"https://e.com/{k}", "budget_limited": True} for k in "abc"]))
    assert {r.id: r.verdict for r in limited.collect()}["c"] == "BUDGET_LIMITED"
    jobs = spark.createDataFrame([("s", "job", "https://e.com/"), ("none", "j2", "https://n.com/")], "scan_id string, job_id string, root_url string")
    targets = {r.page_id: r for r in selection.clone_targets(limited, jobs).collect()}
    assert targets["a"].ordinal == 0 and targets["a"].status == "QUEUED" and targets["c"].local_path == "rejected/c.html" and targets["j2"].local_path == "index.html"


def test_locales(spark):
    from webstrata.functions import rules

    names = {"vi": True, "app": False, "faq": False, "go": False, "fil": True, "pt-br": True, "es-419": True, "EN": True, "en-usa": False, "x": False}
    df = spark.createDataFrame(list(names.items()), "t string, want boolean")
    assert df.where(rules.is_locale(F.col("t")) != F.col("want")).collect() == []


def test_captures(spark):
    n = spark.createDataFrame([("o", "c", "r7", 7), ("o", "c", "r8", 8)], "owner_id string, capture_request_id string, request_id string, request_sequence int")
    b = spark.createDataFrame([("o", "c", "x2", 7, 5, "h", False), ("o", "c", "x1", 7, 100, "g", True)], "owner_id string, capture_request_id string, resource_id string, request_sequence int, body_bytes long, body_sha256 string, was_truncated boolean")
    got = {r.request_sequence: (r.body_captured, r.resource_id, r.body_bytes, r.was_truncated) for r in capture.merge_resource_bodies(n, b).collect()}
    assert got == {7: (True, "x1", 100, True), 8: (False, None, 0, False)}
    res = spark.createDataFrame([("c", k, size, skip) for k, (size, skip) in enumerate([(50, None), (None, "BLOCKED"), (80, None), (0, None), (70, None), (10, None)])], "capture_request_id string, request_sequence int, body_length long, skip_reason string")
    got = [(r.kept_bytes, bool(r.truncated), r.skip) for r in capture.body_budget(res, 4, 60, 100).orderBy("request_sequence").collect()]
    assert got == [(50, False, None), (0, False, "BLOCKED"), (50, True, None), (0, False, "CAPTURE_BYTE_BUDGET_EXCEEDED"), (0, False, "CAPTURE_BYTE_BUDGET_EXCEEDED"), (0, False, "RESOURCE_BODY_COUNT_LIMIT")]


def test_clone_plan_and_shards(spark):
    base = {"page_id": "p", "final_url": "https://e.com/", "html_bytes": 10, "resource_type": "image", "mime": "image/png", "body_bytes": 10, "skip_reason": None, "is_visual": True}
    data = [dict(base, ordinal=0, source_url="https://e.com/a.png", body_sha256="1"), dict(base, ordinal=1, source_url="https://e.com/b.png", body_sha256="1"), dict(base, ordinal=2, source_url="https://x.com/s.js", body_sha256="2", is_visual=False),
            dict(base, ordinal=3, source_url="https://e.com/A.png", body_sha256="3"), dict(base, ordinal=4, source_url="https://e.com/big.png", body_sha256="4", body_bytes=1000), dict(base, ordinal=5, source_url="https://e.com/c.png", body_sha256="5"), dict(base, ordinal=6, source_url="https://e.com/d.png", body_sha256="6"), dict(base, ordinal=7, source_url="https://e.com/e.png", body_sha256="7", body_bytes=None)]
    names = ["page_id", "final_url", "html_bytes", "ordinal", "source_url", "resource_type", "mime", "body_bytes", "body_sha256", "skip_reason", "is_visual"]
    df = spark.createDataFrame([tuple(d[n] for n in names) for d in data], "page_id string, final_url string, html_bytes long, ordinal int, source_url string, resource_type string, mime string, body_bytes long, body_sha256 string, skip_reason string, is_visual boolean")
    got = [(r.local_path, r.skip) for r in archive.clone_plan(df, 4, 100).orderBy("ordinal").collect()]
    assert got == [("e.com/a.png", None), ("e.com/a.png", None), (None, "EXTERNAL_ORIGIN"), ("e.com/a_1.png", None), (None, "CLONE_INPUT_BUDGET_EXCEEDED"), ("e.com/c.png", None), (None, "FILE_COUNT_BUDGET_EXCEEDED"), (None, "BODY_UNAVAILABLE")]
    files = spark.createDataFrame([("j", f"f{k}", size, k) for k, size in enumerate([100, 100, 500, 5000])], "job_id string, path string, bytes long, file_no long")
    got = [(r.shard, r.problem) for r in archive.shard_plan(files, 900, 1 << 30).orderBy("path").collect()]
    assert got == [(1, None), (1, None), (2, None), (None, "SITE_FILE_EXCEEDS_SHARD_BUDGET")]


def test_css_aliases(spark):
    css = spark.createDataFrame([("j", "a.css", "https://e.com/a.css", "x{y:url(i.png)}"), ("j", "b.css", "https://e.com/b.css", "x{y:url(i.png)}"), ("j", "c.css", "https://e.com/c.css", "@import 'a.css';"), ("j", "d.css", "https://e.com/d.css", "@import 'b.css';"), ("j", "e.css", "https://e.com/sub/e.css", "x{y:url(i.png)}")], "job_id string, path string, source_url string, body string")
    paths = css.select("job_id", F.col("source_url").alias("url"), "path").unionByName(spark.createDataFrame([("j", "https://e.com/i.png", "i.png")], "job_id string, url string, path string"))
    got = {r.path: r.canonical_path for r in archive.css_alias_closure(css, paths).collect()}
    assert got == {"a.css": "a.css", "b.css": "a.css", "c.css": "c.css", "d.css": "c.css", "e.css": "e.css"}


def test_css_chain_of_imports(spark):
    """Copies of a chain of fifteen imports become one chain; the last links are found to be equal after as many rounds."""
    import webstrata.operators.archive as archive

    css, paths = [], []
    for copy in "ab":
        for k in range(16):
            name = f"{copy}{k:02}.css"
            paths.append(("j", f"https://e.com/{name}", name))
            css.append(("j", name, f"https://e.com/{name}", f'@import "{copy}{k - 1:02}.css#x"; p{{top:{k}px}}' if k else "p{top:0}"))
    got = {r.path: r.canonical_path for r in archive.css_alias_closure(spark.createDataFrame(css, "job_id string, path string, source_url string, body string"), spark.createDataFrame(paths, "job_id string, url string, path string")).collect()}
    assert got == {f"{c}{k:02}.css": f"a{k:02}.css" for c in "ab" for k in range(16)}


def test_plan_site_archive(spark):
    from webstrata.plans.jobs import plan_site_archive

    p = spark.createDataFrame([("j", "1", 0, "u", "index.html", "SUCCEEDED", None, "HOME", "/", "f", True, 0), ("j", "2", 1, "v", "pages/2.html", "SUCCEEDED", None, "HOME", "/", "f", True, 0), ("j", "3", 2, "w", "rejected/3.html", "CANCELLED", "NON_HTML", None, None, None, False, 0)], "job_id string, page_id string, ordinal int, url string, local_path string, status string, reason string, semantic_role string, route_template string, layout_fingerprint string, rendered boolean, resource_gaps int")
    files = spark.createDataFrame([("j", "1", "DOCUMENT", "index.html", None, "text/html", "h1", 10, 0), ("j", "1", "RESOURCE", "a.png", "https://e.com/a.png", "image/png", "h2", 5, 1), ("j", "1", "RESOURCE", "b.png", "https://e.com/b.png", "image/png", "h2", 5, 2), ("j", "2", "DOCUMENT", "pages/2.html", None, "text/html", "h3", 10, 3)], "job_id string, page_id string, kind string, path string, source_url string, content_type string, sha256 string, bytes long, file_no long")
    css = spark.createDataFrame([], "job_id string, path string, source_url string, body string")
    plan = plan_site_archive(p, files, css, 1 << 20, 1 << 30)
    assert rows(plan["files"].select("path", "shard")) == [("a.png", 1), ("index.html", 1)]
    c = plan["counts"].first()
    assert (c.discovered, c.rejected, c.packaged, c.completeness) == (3, 2, 2, "REPRESENTATIVE_COMPLETE")
    assert plan["reasons"].first().reasons == {"LAYOUT_DUPLICATE": 1, "NON_HTML": 1}


def test_dashboard(spark):
    w = spark.createDataFrame([("w1", "o", "ACTIVE"), ("w2", "o", "ARCHIVED"), ("w3", "p", "ACTIVE")], "id string, owner_id string, status string")
    s = spark.createDataFrame([("o", "w1", "COMPLETED", 10, 8, 2, T0), ("o", "w1", "QUEUED", 0, 0, 0, T0), ("o", "w1", "COMPLETED", 4, 4, 0, T0 - dt.timedelta(40)), ("q", "x", "COMPLETED", 1, 1, 0, T0)], "owner_id string, website_id string, status string, processed_count int, succeeded_count int, failed_count int, created_at timestamp")
    got = {r.owner_id: tuple(r)[1:] for r in workflow.dashboard_summary(w, s, F.lit(T0 - dt.timedelta(30))).collect()}
    assert got["o"][:6] == (1, 2, 1, 10, 8, 2) and got["o"][6] == 80 and got["p"][0] == 1 and got["q"][1] == 1
    assert rows(workflow.active_scan_quota(s, 1, 1).select("kind", "id")) == [("user", "o"), ("website", "w1")]


def test_capture_report(spark):
    j = spark.createDataFrame([("o", "c1"), ("o", "c2")], "owner_id string, id string")
    s = spark.createDataFrame([("s1", "c1")], "id string, capture_request_id string")
    r = spark.createDataFrame([("r1", "c1", "PUBLISHED", 2), ("r2", "c2", "PUBLISHED", 1)], "id string, capture_request_id string, status string, lease_generation int")
    a = spark.createDataFrame([("a1", "r1", "STATIC_ARCHIVE", 2, "READY", T0 + dt.timedelta(9)), ("a0", "r1", "STATIC_ARCHIVE", 1, "READY", T0), ("a2", "r2", "STATIC_ARCHIVE", 1, "READY", T0)], "id string, reconstruction_id string, kind string, lease_generation int, status string, delete_after timestamp")
    got = {x.capture_request_id: (x.reconstruction_status, x.download_available, x.artifact_id) for x in capture.capture_report(j, s, r, a, F.lit(T0)).collect()}
    assert got == {"c1": ("PUBLISHED", True, "a1"), "c2": ("EXPIRED", False, "a2")}


@pytest.mark.parametrize("n", [1, 3])
def test_sampling(spark, n):
    seconds = [(1, "QUEUED", 0.0), (2, "RUNNING", 0.0), (3, "RUNNING", 0.1), (4, "RUNNING", 2.0), (5, "CANCEL_REQUESTED", 2.1), (6, "CANCELLED", 2.2), (6, "CANCELLED", 2.2)]
    df = spark.createDataFrame([("s", v, st, T0 + dt.timedelta(seconds=x)) for v, st, x in seconds], "scan_id string, version long, status string, occurred_at timestamp").repartition(n)
    got = workflow.sample_progress(df).orderBy("version").collect()
    assert [(r.version, r.status) for r in got] == [(1, "QUEUED"), (2, "RUNNING"), (4, "RUNNING"), (5, "CANCEL_REQUESTED"), (6, "CANCELLED")]
