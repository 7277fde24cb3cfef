from __future__ import annotations

import tracemalloc

import pyarrow as pa

from webstrata.functions import html as H

BASIC = """<html><head><title> Home </title><meta name="description" content="About us"><link rel="canonical" href="/home?utm_source=test"></head>
<body><h1>Hello</h1><img src=a><img src=b alt="B"><a href="/in?utm_medium=x">Inside</a><a rel="nofollow" href="https://other.com/">Out</a><p>one two three</p></body></html>"""


def facts(html, url="https://example.com/home", host="example.com"):
    return H.page_facts(url, html, host)


def test_basic():
    f = facts(BASIC)
    assert (f["title"], f["meta_description"], f["canonical_url"], f["canonical_relation"]) == ("Home", "About us", "https://example.com/home", "SELF")
    assert [(x["target_url"], x["is_internal"], x["is_followable"]) for x in f["links"]] == [("https://example.com/in", True, True), ("https://other.com/", False, False)]
    assert (f["image_count"], f["missing_alt"], f["missing_alt_sample"]) == (2, 1, [1])
    assert f["word_count"] == 3  # texts of neighbouring elements run together, as in the reference


def test_advanced():
    f = facts("""<head><META NAME="Description" CONTENT="d"><meta property="OG:TITLE" content="t"><meta property="og:image" content="/i.png">
      <link rel="alternate" hreflang="vi" href="/vi"><link rel="stylesheet preload" href="s.css">
      <script type="application/ld+json">{"@graph": [{"@type": ["Article", "https://schema.org/NewsArticle"]}, {"@type": "article"}], "author": {"@type": "Person"}}</script>
      <script type="application/ld+json">{bad</script><script>x</script></head><body itemscope itemtype="https://schema.org/Thing">x</body>""")
    assert f["open_graph_title"] == "t" and f["open_graph_image_url"] == "https://example.com/i.png"
    assert f["hreflang"] == [{"language": "vi", "url": "https://example.com/vi"}] and f["hreflang_invalid"] == 0
    assert sorted(f["schema_types"]) == ["Article", "NewsArticle", "Person", "Thing"]
    assert (f["schema_error_count"], f["schema_issue_codes"], f["script_count"], f["stylesheet_count"]) == (1, ["JSON_LD_INVALID"], 3, 1)
    assert f["schema_item_count"] == 3


def test_accessible_names():
    f = facts("""<h1><img alt="Logo text"></h1><img alt=""><img alt=" "><img aria-label="x"><img><img hidden><img role="presentation">
      <div role="heading" aria-level="2" aria-labelledby="a b">no</div><span id=a>First</span><span id=b>Second</span>""")
    assert f["h1"] == ["Logo text"] and f["h2"] == ["First Second"]
    assert (f["missing_alt"], f["missing_alt_sample"]) == (2, [3, 5])


def test_declarations_and_caps():
    f = facts('<meta name=robots content="follow"><meta name=robots content="noindex"><link rel=canonical href="mailto:a@b"><link rel=canonical href="/x"><link rel=alternate href="/feed"><link rel=alternate hreflang=de href="tel:1">')
    assert f["meta_robots"] == "follow, noindex"
    assert (f["canonical_declared"], f["canonical_invalid"], f["hreflang_invalid"], f["canonical_relation"]) == (2, 1, 2, "NON_SELF")
    f = facts("<title>" + "€" * 2000 + "</title>" + "<h3>x</h3>" * 200)
    assert len(f["title"].encode()) <= 2048 and f["title"].endswith("€") and len(f["h3"]) == 150


def test_links_and_text():
    f = facts('<a href="#x">a</a><a href="mailto:x">b</a><a href="JavaScript:1">c</a><area href="q"><a>n</a><a href="http://[bad">z</a>')
    assert [(x["target_url"], x["tag"], x["ordinal"]) for x in f["links"]] == [("https://example.com/q", "area", 0)]
    assert facts("<p>one <p>two <script>three</script>")["word_count"] == 3  # script text counts, as in the reference
    assert facts("")["title"] == "" and facts("")["word_count"] == 0


def test_tree_implied_ends():
    page = H.parse("<ul><li>a<li>b</ul><p>c<div>d</div><table><tr><td>1<td>2<tr><td>3</table>")
    assert [n.text() for n in page.find("li")] == ["a", "b"]
    assert [n.text() for n in page.find("td")] == ["1", "2", "3"] and len(page.find("tr")) == 2
    assert page.find("p")[0].text() == "c"
    assert H.serialize(H.parse("<!doctype html><p title='\"'>a &amp; b<br></p>")) == '<!doctype html><html><head></head><body><p title="&quot;">a &amp; b<br></p></body></html>'


def test_fingerprints_of_known_trees():
    """Hashes of the stream of tags, written out: sorted classes (32 at most), roles, void elements with an end, the tree's order, not the page's."""
    import hashlib

    many = " ".join(f"c{k:02}" for k in range(40, 0, -1))
    cases = {
        '<!doctype html><div class="b  a" id="x" role=" Main ">t<p>x<br></div>': "<html><head></head><body><div.a.b[role=main]><p><br></br></p></div></body></html>",
        "<b>1<p>2</b>3</p>": "<html><head></head><body><b></b><p><b></b></p></body></html>",
        "<table><td>x": "<html><head></head><body><table><tbody><tr><td></td></tr></tbody></table></body></html>",
        "": "<html><head></head><body></body></html>",
        f'<title>t</title><i class="{many}">': "<html><head><title></title></head><body><i." + ".".join(f"c{k:02}" for k in range(1, 33)) + "></i></body></html>",
    }
    for page, stream in cases.items():
        assert H.fingerprint(H.parse(page)) == hashlib.sha256(stream.encode()).hexdigest(), page
    assert H.fingerprint(H.parse("<p></p>" * 3), most=4) == hashlib.sha256(b"<html><head></head><body><p></p></body></html>").hexdigest()


def test_fingerprint_ignores_text_and_ids():
    a = H.fingerprint(H.parse('<div class="b a" id=x>one</div>'))
    assert a == H.fingerprint(H.parse('<div class="a  b" id=y>two</div>'))
    assert a != H.fingerprint(H.parse('<div class="a" id=y>two</div>'))


def test_rewriting():
    paths = {"https://e.com/a.css": "assets/a.css", "https://e.com/i.png": "assets/i.png"}
    out = H.rewrite_page('<base href="/"><link href="/a.css"><img src="i.png" srcset="i.png 1x, /j.png?t=1 2x" style="background:url(/i.png)"><input value=secret checked><textarea>t</textarea><a href="/x">l</a>', "https://e.com/", paths)
    assert "<base" not in out and 'href="assets/a.css"' in out and 'srcset="assets/i.png 1x, https://e.com/j.png?t=%5BREDACTED%5D 2x"' in out
    assert "secret" not in out and "checked" not in out and "<textarea></textarea>" in out and "assets/i.png" in out
    css = H.rewrite_css_text('@import "b.css"; a{b:url(\'../i.png\')} c{d:url(data:x)}', "https://e.com/css/m.css", {"https://e.com/i.png": "assets/i.png", "https://e.com/css/b.css": "assets/b.css"}, "assets/m.css")
    assert '@import "b.css"' in css and 'url("i.png")' in css and "data:x" in css


def test_navigation_and_neutralization():
    import hashlib

    from webstrata.functions import urls

    routes = {hashlib.sha256(urls.route("https://e.com/about").encode()).hexdigest(): "pages/1.html"}
    out = H.rewrite_links('<a href="/about/#team">a</a><a href="/other?k=v">b</a><a href="mailto:x@y">c</a>', "https://e.com/", "index.html", routes)
    assert 'href="pages/1.html#team"' in out and "k=%5BREDACTED%5D" in out and 'href="mailto:x@y"' in out
    safe = H.neutralize('<head><meta http-equiv=refresh content=1><link rel=preload as=script href=x></head><body onload=x><script>alert(1)</script><script type="application/json">{}</script></body>')
    assert "onload" not in safe and "refresh" not in safe and "preload" not in safe and 'type="application/x-inert-script"' in safe and 'type="application/json"' in safe and "Content-Security-Policy" in safe


def test_parse_pages_in_spark(spark):
    df = spark.createDataFrame([(1, "https://e.com/", "<title>T</title>", "e.com"), (2, None, None, None)], "id long, url string, html string, scope_host string")
    got = {r.id: r for r in H.parse_pages(df, keep=["id"]).collect()}
    assert got[1].title == "T" and got[2].title == "" and got[2].links == []
    seen = H.rendered_metadata(df, keep=["id"]).where("id = 1").first()
    assert seen.title == "T" and seen.word_count == 0


def test_rewriting_takes_a_slice_of_a_batch_apart_at_a_time():
    pages = pa.array([f"{k:05d}" * 2000 for k in range(2000)] + [None])  # 20 MB
    tracemalloc.start()
    found = H.in_slices(lambda page: page[:5], pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [f"{k:05d}" for k in range(2000)] + [None]
    assert peak < 6 << 20


def test_a_reference_without_its_semicolon_is_decoded():
    """As HTML and the reference's parser have it: titles that are cut within ``&amp;``."""
    f = facts("<title>a &&amp</title><h1>b &amp</h1>")
    assert f["title"] == "a &&" and f["h1"] == ["b &"]
