from __future__ import annotations

import random

import pytest

from webstrata.functions import html as H
from webstrata.functions.tree import Node, parse, serialize

#: Pages and what the standard's tree construction makes of their bodies.
BODIES = [
    ('<a>one<a>two</a>', '<a>one</a><a>two</a>'),
    ('<h1>A<h2>B</h2>', '<h1>A</h1><h2>B</h2>'),
    ('<p>1<b>2<i>3</b>4</i>5</p>', '<p>1<b>2<i>3</i></b><i>4</i>5</p>'),
    ('<b>1<p>2</b>3</p>', '<b>1</b><p><b>2</b>3</p>'),
    ('<table><b><tr><td>aaa</td></tr>bbb</table>ccc', '<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>'),
    ('<!DOCTYPE html><p><b class=x><b class=x><b><b class=x><b class=x><b>X<p>X<p><b><b class=x><b>X<p></b></b></b></b></b></b>X', '<p><b class="x"><b class="x"><b><b class="x"><b class="x"><b>X</b></b></b></b></b></b></p><p><b class="x"><b><b class="x"><b class="x"><b>X</b></b></b></b></b></p><p><b class="x"><b><b class="x"><b class="x"><b><b><b class="x"><b>X</b></b></b></b></b></b></b></b></p><p>X</p>'),
    ('<a><p>X<a>Y</a>Z</p></a>', '<a></a><p><a>X</a><a>Y</a>Z</p>'),
    ('<a href=a>aa<marquee>aa<a href=b>bb</marquee>aa', '<a href="a">aa<marquee>aa<a href="b">bb</a></marquee>aa</a>'),
    ('<table><a>1<p>2</a>3</p>', '<a>1</a><p><a>2</a>3</p><table></table>'),
    ('<font><p>hello<b>cruel</font>world', '<font></font><p><font>hello<b>cruel</b></font><b>world</b></p>'),
    ('<div><b><i>x</div>y', '<div><b><i>x</i></b></div><b><i>y</i></b>'),
    ('<select><option>a<option>b<div>c</select>d', '<select><option>a</option><option>bc</option></select>d'),
    ('<table>x<tr><td>1<table><tr><td>2</table>3</table>', 'x<table><tbody><tr><td>1<table><tbody><tr><td>2</td></tr></tbody></table>3</td></tr></tbody></table>'),
    ('<svg><circle/><path/></svg><p>x', '<svg><circle></circle><path></path></svg><p>x</p>'),
    ('<ul><li>a<ul><li>b</ul><li>c</ul>', '<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>'),
    ('<!doctype html><p>a<table></table>', '<p>a</p><table></table>'),
    ('<p>a<table></table>', '<p>a<table></table></p>'),
    ('<b><em><foo><foo><aside></b>', '<b><em><foo><foo></foo></foo></em></b><em><aside><b></b></aside></em>'),
    ('<b><em><foo><foo><foo><aside></b>', '<b><em><foo><foo><foo></foo></foo></foo></em></b><aside><b></b></aside>'),
    ('<a><div><style></style><address><a>', '<a></a><div><a><style></style></a><address><a></a><a></a></address></div>'),
    ('<dl><dt>a<dd>b<dt>c</dl>', '<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>'),
    ('</p>x</br>', '<p></p>x<br>'),
    ('<form><div></form>x</div>', '<form><div>x</div></form>'),
    ('<table><tr><p>a</table>b', '<p>a</p><table><tbody><tr></tr></tbody></table>b'),
    ('<table><caption>c<td>d', '<table><caption>c</caption><tbody><tr><td>d</td></tr></tbody></table>'),
    ('<table><col><tbody><tr><th>h</tfoot><td>i', '<table><colgroup><col></colgroup><tbody><tr><th>h</th><td>i</td></tr></tbody></table>'),
    ('<tr><td>x</td></tr>y', 'xy'),
    ('<svg><desc><p>a</desc><b>c', '<svg><desc><p>a<b>c</b></p></desc></svg>'),
    ('<pre>\n\nx</pre>', '<pre>\nx</pre>'),
    ('<button>a<button>b', '<button>a</button><button>b</button>'),
    ('<b><b><b><b>x</b></b></b></b>y', '<b><b><b><b>x</b></b></b></b>y'),
    ('<i>A<b>B<p></i>C</b>D', '<i>A<b>B</b></i><b></b><p><b><i></i>C</b>D</p>'),
    ('<table><input type=hidden><input>', '<input><table><input type="hidden"></table>'),
    ('<ruby>a<rt>b<rt>c</ruby>', '<ruby>a<rt>b</rt><rt>c</rt></ruby>'),
    ('<nobr>a<nobr>b', '<nobr>a</nobr><nobr>b</nobr>'),
]


def body(html):
    text = serialize(parse(html))
    return text[text.index("<body>") + 6 : -len("</body></html>")]


@pytest.mark.parametrize(("html", "want"), BODIES)
def test_tree_as_in_the_standard(html, want):
    assert body(html) == want


def test_facts_of_misnested_pages():
    """A second link or heading ends the first; links that paragraphs split count once for each part."""
    f = H.page_facts("https://example.com/", "<a href=/1>one<a href=/2>two</a><h1>A<h2>B</h2><table><a href=/3>three<tr><td>x</table>", "example.com")
    assert [(x["target_url"], x["anchor_text"]) for x in f["links"]] == [("https://example.com/1", "one"), ("https://example.com/2", "two"), ("https://example.com/3", "three")]
    assert (f["h1"], f["h2"]) == (["A"], ["B"])
    f = H.page_facts("https://example.com/", "<h2><b>x</h2><p>y</b></p><a href=/1><div>d</a>e</div>", "example.com")
    assert f["h2"] == ["x"] and [x["anchor_text"] for x in f["links"]] == ["", "d"]
    f = H.page_facts("https://example.com/", "<select><option>o<a href=/no>p</select><a href=/yes>y</a>", "example.com")
    assert [x["target_url"] for x in f["links"]] == ["https://example.com/yes"]


def test_markup_is_read_as_in_the_standard():
    page = parse("""<a href='x?a=1&copy=2&amp;b=3&lt' title=it's checked data-q="a>b" HREF=y>&lt;b&gt; &copy 3 < 4 <5 &notanentity;</a><!-- <p> --!>i<!---><i>j</i><?php x ?></ bogus><!x>""")
    link = page.find("a")[0]
    assert link.attrs == {"href": "x?a=1&copy=2&b=3<", "title": "it's", "checked": "", "data-q": "a>b"}
    assert link.text() == "<b> © 3 < 4 <5 ¬anentity;" and not page.find("p") and page.find("body")[0].text().endswith("ij")
    assert parse("a\r\nb\rc").text() == "a\nb\nc"
    assert parse("a<b").text() == "a" and parse('a<b title="x>y').text() == "a" and parse("a</b").text() == "a"
    assert parse("<script>if (a < b) '</p>'</script>x").find("script")[0].text() == "if (a < b) '</p>'"
    assert parse("<title>a &amp; <b></title>").find("title")[0].text() == "a & <b>" and parse("<textarea>\nx</TEXTAREA >y").text() == "xy"
    assert parse("<noscript><a href=x></noscript>").find("a") == [] and parse("<style>a{").find("style")[0].text() == "a{"
    assert parse("<svg><![CDATA[a<b]]></svg><![CDATA[c]]>d").text() == "a<bd"
    assert parse("").find("body") and parse("<!DOCTYPE html>\n<html lang=en><head></head>").find("html")[0].get("lang") == "en"


TAGS = "a b i p div table tr td th tbody caption ul li h1 h2 form button svg nobr marquee dd dt font em span section object".split()


@pytest.mark.parametrize("seed", range(6))
def test_any_soup_becomes_a_sound_tree(seed):
    """No text is lost, every child knows its parent, and no element is in two places."""
    draw = random.Random(seed)
    for _ in range(300):
        parts = [draw.choice([f"<{draw.choice(TAGS)}>", f"</{draw.choice(TAGS)}>", chr(0x4E00 + k)]) for k in range(draw.randint(1, 60))]
        page = parse("".join(parts))
        seen = set()
        for node in page.walk():
            assert id(node) not in seen
            seen.add(id(node))
            assert all(c.parent is node for c in node.children if isinstance(c, Node))
        assert sorted(page.text()) == sorted(c for c in parts if len(c) == 1), "".join(parts)


def test_deep_and_misnested_pages_take_linear_time():
    """Tens of thousands of open elements: neither the stack nor the recursion limit is in the way."""
    assert parse("<div>" * 30_000 + "x").text() == "x"
    assert serialize(parse("<b><p>" * 500 + "x" + "</b>" * 500)).count("x") == 1
    assert parse("<table><tr><td>" * 3_000 + "x").text() == "x"
