from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from webstrata.functions import rules
from webstrata.plans import jobs
from webstrata.sources import fetches


@pytest.mark.parametrize("dummy", [0])
def test_indexability(spark, dummy):
    cases = [
        (200, "", "", "INDEXABLE"), (200, "noindex,follow", "", "META_ROBOTS_NOINDEX"), (200, "", "noindex", "X_ROBOTS_TAG_NOINDEX"), (200, "noindex", "noindex", "META_AND_X_ROBOTS_NOINDEX"),
        (200, "none", "", "META_ROBOTS_NOINDEX"), (200, "", "googlebot: noindex", "INDEXABLE"), (200, "", "noindex, googlebot: nofollow", "X_ROBOTS_TAG_NOINDEX"),
        (200, "", "googlebot: noindex\nnoindex", "X_ROBOTS_TAG_NOINDEX"), (200, "", "x-noindex-test", "INDEXABLE"), (302, "", "", "HTTP_STATUS_NOT_INDEXABLE"), (404, "", "", "HTTP_STATUS_NOT_INDEXABLE"),
        (200, "", "googlebot: all, noindex", "INDEXABLE"), (200, "", "max-snippet: 5, noindex", "X_ROBOTS_TAG_NOINDEX"), (200, None, None, "INDEXABLE"),
    ]
    df = spark.createDataFrame(cases, "status int, meta string, header string, want string")
    bad = df.where(rules.indexability(F.col("status"), F.col("meta"), F.col("header")) != F.col("want"))
    assert bad.collect() == []


def test_uuid5_and_bounds(spark):
    ns = str(uuid.uuid4())
    df = spark.createDataFrame([(ns, "title.missing:2"), (ns, "é"), (ns, "")], "ns string, name string")
    for r in df.select("name", rules.uuid5(F.col("ns"), F.col("name")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.UUID(ns), r.name))
    texts = ["€" * 5, "abc", "a😀b", "é" * 3, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(1, 9):
        got = [r[0] for r in df.select(rules.bounded_utf8(F.col("t"), n)).collect()]
        assert got == [t.encode()[:n].decode("utf-8", "ignore") for t in texts], n


def test_retry(spark):
    cases = [("timeout", 0, 1, True), ("timeout", 0, 3, False), ("ssrf_blocked", 0, 1, False), ("", 503, 2, True), ("", 404, 1, False), ("", 429, 1, True), (None, None, 1, False)]
    df = spark.createDataFrame(cases, "e string, s int, a int, want boolean")
    got = df.select("want", rules.retry_plan(F.col("a"), F.col("e"), F.col("s"), F.lit("ff000000")).alias("p")).collect()
    assert all(r.p.retry == r.want for r in got) and got[0].p.delay_s == 2.0


ROLES = [
    ("https://e.com/", 200, "HOME"), ("https://e.com/vi", 200, "HOME"), ("https://e.com/app", 200, "MARKETING_LANDING"), ("https://e.com/login", 200, "AUTH_LOGIN"), ("https://e.com/dang-ky", 200, "AUTH_REGISTER"),
    ("https://e.com/reset-password/x", 200, "AUTH_FORGOT_PASSWORD"), ("https://e.com/verify-email", 200, "AUTH_VERIFY_OR_STATUS"), ("https://e.com/en/pricing", 200, "PRICING"), ("https://e.com/contact", 200, "CONTACT"),
    ("https://e.com/blog", 200, "BLOG_INDEX"), ("https://e.com/blog/post", 200, "BLOG_DETAIL"), ("https://e.com/products", 200, "PRODUCT_LIST"), ("https://e.com/products/7", 200, "PRODUCT_DETAIL"),
    ("https://e.com/case-studies/acme", 200, "USE_CASE_DETAIL"), ("https://e.com/vs/other", 200, "COMPARISON_DETAIL"), ("https://e.com/privacy", 200, "LEGAL_TEXT"), ("https://e.com/a/b/c", 200, "UNKNOWN"), ("https://e.com/x", 404, "ERROR_4XX"), ("https://e.com/x", 503, "ERROR_5XX"),
]


def test_roles_and_templates(spark):
    df = spark.createDataFrame(ROLES, "u string, s int, want string")
    none = F.array().cast("array<string>")
    role = rules.semantic_role(F.col("u"), F.col("s"), none)
    assert df.where(role != F.col("want")).collect() == []
    got = df.select("u", rules.route_template(F.col("u"), role, F.lit("und")).alias("t")).collect()
    t = {r.u: r.t for r in got if r.u not in ("https://e.com/x",)}
    assert t["https://e.com/products/7"] == "/products/{id}" and t["https://e.com/blog/post"] == "/blog/{slug}" and t["https://e.com/"] == "/"


def page(**kw):
    base = {"page_id": str(uuid.uuid4()), "owner_id": "o", "scan_id": "s", "requested_url": "https://e.com/", "final_url": "https://e.com/", "scope_host": "e.com", "status_code": 200, "content_type": "text/html", "x_robots_tag": "", "body": "<p>x", "body_truncated": False, "error_code": "", "redirects": []}
    return base | kw


def test_findings(spark):
    import json

    hops = [{"url": "https://a/", "status_code": 301}, {"url": "https://b/", "status_code": 302}]
    defects = '<link rel=canonical href="mailto:x"><link rel=canonical href="/other"><meta name=robots content=noindex><link rel=alternate href="/f"><script type="application/ld+json">{</script><title>t</title><meta name=description content=d><h1>h</h1>'
    cases = {
        "404": (page(status_code=404, body="<p>"), {"HTTP_ERROR"}), "cut": (page(body_truncated=True), {"BODY_TRUNCATED"}), "ssrf": (page(error_code="ssrf_blocked"), {"FETCH_BLOCKED_BY_POLICY"}),
        "timeout": (page(error_code="timeout"), {"FETCH_FAILED"}), "bare": (page(body="<img src=x>"), {"TITLE_MISSING", "META_DESCRIPTION_MISSING", "H1_MISSING", "IMAGE_ALT_MISSING"}),
        "seo": (page(body=defects), {"CANONICAL_INVALID", "CANONICAL_MULTIPLE", "CANONICAL_NOINDEX_CONFLICT", "HREFLANG_INVALID", "STRUCTURED_DATA_INVALID"}),
        "302": (page(status_code=302, redirects=hops), {"HTTP_REDIRECT_RESPONSE", "REDIRECT_CHAIN"}), "pdf": (page(content_type="application/pdf"), set()), "empty": (page(body=""), set()),
    }
    path = [dict(p[0], scan_id=k) for k, p in cases.items()]
    df = spark.read.schema(fetches.FETCH).json(spark.sparkContext.parallelize([json.dumps(x) for x in path]))
    facts = jobs.build_page_facts(df).cache()
    got = {r.scan_id: {f.code for f in r.findings} for r in facts.collect()}
    assert got == {k: v[1] for k, v in cases.items()}
    assert facts.where("scan_id = 'cut'").first().links == []
    found = jobs.findings_of(facts).where("scan_id = 'bare' and rule_id = 'title.missing'").first()
    assert found.finding_id == str(uuid.uuid5(uuid.UUID(found.page_id), "title.missing:2"))
    facts.unpersist()
