"""Facts of HTML pages: one tree per page (``tree.py``), from which all facts are read."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webstrata.functions import urls
from webstrata.functions.tree import Node, parse, serialize
from webstrata.sources.tables import spread

WORDS = re.compile(r"[^\W_]+")
# --- facts -----------------------------------------------------------------------------------------------------------

#: Bounds in UTF-8 bytes and in items: fixed values.
CAPS = {"title": 2048, "description": 4096, "keywords": 4096, "robots": 512, "lang": 64, "heading": 2048, "anchor": 2048, "url": 8192, "type": 255}
HEADINGS = {"h1": 50, "h2": 100, "h3": 150, "h4": 100, "h5": 50, "h6": 50}
MOST = {"hreflang": 100, "blocks": 20, "json": 1 << 20, "types": 100, "issues": 20, "ordinals": 10, "links": 2000, "rel": 32}

FACTS = (
    "title string, meta_description string, meta_keywords string, meta_robots string, html_lang string, "
    "canonical_url string, canonical_relation string, canonical_declared int, canonical_invalid int, "
    "h1 array<string>, h2 array<string>, h3 array<string>, h4 array<string>, h5 array<string>, h6 array<string>, "
    "hreflang array<struct<language:string,url:string>>, hreflang_invalid int, "
    "open_graph_title string, open_graph_description string, open_graph_image_url string, "
    "schema_types array<string>, schema_item_count int, schema_valid_count int, schema_error_count int, schema_warning_count int, schema_issue_codes array<string>, "
    "word_count int, image_count int, missing_alt int, missing_alt_sample array<int>, script_count int, stylesheet_count int, "
    "links array<struct<target_url:string,anchor_text:string,tag:string,rel_values:array<string>,is_internal:boolean,is_followable:boolean,ordinal:int>>, "
    "layout_fingerprint string"
)


def cut(value: str, most: int) -> str:
    data = value.encode("utf-8", "replace")
    return value if len(data) <= most else data[:most].decode("utf-8", "ignore")


def clean(value: str) -> str:
    return value.strip()


def tokens(value: str) -> list[str]:
    return value.lower().split()[: MOST["rel"]]


def resolved(base: str, reference: str) -> str | None:
    try:
        return urls.resolve(base, reference)
    except ValueError:
        return None


class Index:
    """A page's elements in document order, and by tag: the tree is walked once for all facts."""

    def __init__(self, page: Node):
        self.page, self.nodes = page, list(page.walk())
        self.by_tag: dict[str, list[Node]] = {}
        for node in self.nodes:
            self.by_tag.setdefault(node.tag, []).append(node)

    def find(self, *tags: str) -> list[Node]:
        if len(tags) == 1:
            return self.by_tag.get(tags[0], [])
        return [n for n in self.nodes if n.tag in tags] if any(t in self.by_tag for t in tags) else []


def metas(page: Index, attribute: str, name: str) -> Iterator[str]:
    for node in page.find("meta"):
        if clean(node.get(attribute)).lower() == name:
            yield clean(node.get("content"))


def name_of(node: Node, labels: dict[str, str]) -> str:
    """Accessible name: labelled-by, label, text, then alternatives of images."""
    named = [v for i in node.get("aria-labelledby").split() if (v := clean(labels.get(i, "")))]
    if named:
        return " ".join(named)
    for value in (node.get("aria-label"), node.text()):
        if clean(value):
            return clean(value)
    if node.tag == "img":
        return clean(node.get("alt")) or clean(node.get("title"))
    found: list[str] = []
    for image in node.find("img"):
        if len(found) >= 10:
            break
        if value := name_of(image, labels):
            found.append(value)
    return " ".join(found)


def headings(page: Index, labels: dict[str, str]) -> dict[str, list[str]]:
    by_role = [n for n in page.nodes if "role" in n.attrs and "heading" in tokens(n.get("role"))]
    out = {}
    for tag, most in HEADINGS.items():
        own = page.find(tag) + [n for n in by_role if clean(n.get("aria-level")) == tag[1] and n.tag != tag]
        values: list[str] = []
        for node in own:
            if len(values) >= most:
                break
            if value := cut(name_of(node, labels), CAPS["heading"]):
                values.append(value)
        out[tag] = values
    return out


def type_name(raw: str) -> str:
    raw = clean(raw)
    try:
        parts = urlsplit(raw)
        if parts.scheme:
            raw = parts.fragment or (parts.path.strip("/").rsplit("/", 1)[-1] if parts.path.strip("/") else raw)
    except ValueError:
        pass
    return cut(raw, CAPS["type"])


class SchemaTypes:
    """Types of JSON-LD and microdata, without repeats in any spelling; counts and issues."""

    def __init__(self) -> None:
        self.types: list[str] = []
        self.seen: set[str] = set()
        self.items = self.valid = self.errors = self.warnings = 0
        self.issues: list[str] = []

    def add(self, raw: str) -> None:
        name = type_name(raw)
        if name and len(self.types) < MOST["types"] and name.lower() not in self.seen:
            self.seen.add(name.lower())
            self.types.append(name)

    def issue(self, code: str) -> None:
        if code not in self.issues and len(self.issues) < MOST["issues"]:
            self.issues.append(code)

    def collect(self, value: object) -> None:
        """Depth first in document order; an item counts if it adds a type."""
        stack = [value]
        while stack:
            item = stack.pop()
            if isinstance(item, list):
                stack.extend(reversed(item))
            elif isinstance(item, dict):
                if "@type" in item:
                    before, kinds = len(self.types), item["@type"]
                    for kind in kinds if isinstance(kinds, list) else [kinds]:
                        if isinstance(kind, str):
                            self.add(kind)
                    self.items += len(self.types) > before
                stack.extend(reversed([v for k, v in item.items() if k != "@type"]))

    def read(self, page: Index) -> None:
        used = blocks = 0
        for script in page.find("script"):
            if blocks >= MOST["blocks"] or used >= MOST["json"]:
                break
            if clean(script.get("type")).lower() != "application/ld+json":
                continue
            blocks += 1
            data = clean(script.text()).encode("utf-8", "replace")
            if len(data) > MOST["json"] - used:
                data = data[: MOST["json"] - used]
                self.warnings += 1
                self.issue("JSON_LD_INPUT_TRUNCATED")
            used += len(data)
            try:
                value = json.loads(data.decode("utf-8"), parse_constant=lambda c: 1 // 0)
            except (ValueError, ZeroDivisionError, RecursionError):
                self.errors += 1
                self.issue("JSON_LD_INVALID")
                continue
            before = self.items
            self.collect(value)
            if self.items == before:
                self.warnings += 1
                self.issue("JSON_LD_TYPE_MISSING")
            else:
                self.valid += 1
        for node in page.nodes:
            if "itemscope" in node.attrs and "itemtype" in node.attrs:
                if len(self.types) >= MOST["types"]:
                    break
                for kind in node.get("itemtype").split():
                    self.add(kind)
                    self.items += 1
                    self.valid += 1


def needs_alternative(image: Node, labels: dict[str, str]) -> bool:
    if "hidden" in image.attrs or clean(image.get("aria-hidden")).lower() == "true" or name_of(image, labels):
        return False
    role = tokens(image.get("role"))
    return not ({"none", "presentation"} & set(role)) and ("alt" not in image.attrs or image.get("alt") != "")


def fingerprint(page: Node, most: int = 50_000) -> str | None:
    """SHA-256 of the elements' tags, sorted classes and roles in document order; texts and ids don't count."""
    out: list[str] = []
    seen = 0
    stack: list[tuple[Node, bool]] = [(page, False)]
    while stack:
        node, done = stack.pop()
        if done:
            out.append(f"</{node.tag}>")
            continue
        if seen >= most:
            continue
        if node.tag != "#document":
            seen += 1
            classes = ".".join(sorted(node.get("class").split())[:32])
            role = clean(node.get("role")).lower()
            out.append(f"<{node.tag}{'.' + classes if classes else ''}{f'[role={role}]' if role else ''}>")
            stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))
    return hashlib.sha256("".join(out).encode()).hexdigest() if seen else None


def page_facts(url: str, html: str, scope_host: str | None) -> dict:
    """All facts of a page in one pass over its tree; see FACTS."""
    page = Index(parse(html))
    first = lambda values: next(iter(values), "")
    title = first(n.text() for n in page.find("title"))
    labels: dict[str, str] = {}
    for node in page.nodes:
        if ident := clean(node.get("id")):
            if value := clean(node.get("aria-label")) or clean(node.text()):
                labels[ident] = cut(value, CAPS["heading"])
    out: dict = {
        "title": cut(clean(title), CAPS["title"]),
        "meta_description": cut(first(metas(page, "name", "description")), CAPS["description"]),
        "meta_keywords": cut(first(metas(page, "name", "keywords")), CAPS["keywords"]),
        "meta_robots": cut(", ".join(filter(None, metas(page, "name", "robots"))), CAPS["robots"]),
        "html_lang": cut(clean(first(n.get("lang") for n in page.find("html"))), CAPS["lang"]),
        "open_graph_title": cut(first(metas(page, "property", "og:title")), CAPS["title"]),
        "open_graph_description": cut(first(metas(page, "property", "og:description")), CAPS["description"]),
        "open_graph_image_url": "",
    }
    if image := first(metas(page, "property", "og:image")):
        out["open_graph_image_url"] = cut(resolved(url, image) or "", CAPS["url"])
    canonical, declared, invalid = "", 0, 0
    alternates: list[dict] = []
    bad_alternates = stylesheets = 0
    for link in page.find("link"):
        rel, href = tokens(link.get("rel")), clean(link.get("href"))
        target = resolved(url, href) if href else None
        good = target is not None and urls.is_http(target)
        stylesheets += "stylesheet" in rel
        if "canonical" in rel:
            declared += 1
            invalid += not good
            canonical = canonical or (cut(target, CAPS["url"]) if good else "")
        if "alternate" in rel and len(alternates) < MOST["hreflang"]:
            language = cut(clean(link.get("hreflang")), CAPS["lang"])
            if language and good:
                alternates.append({"language": language, "url": cut(target, CAPS["url"])})
            else:
                bad_alternates += 1
    relation = "MISSING"
    if canonical:
        try:
            relation = "SELF" if urls.normalize(canonical) == urls.normalize(url) else "NON_SELF"
        except ValueError:
            relation = "NON_SELF"
    out |= {"canonical_url": canonical, "canonical_relation": relation, "canonical_declared": declared, "canonical_invalid": invalid}
    out |= {"hreflang": alternates, "hreflang_invalid": bad_alternates, "stylesheet_count": stylesheets, "script_count": len(page.find("script"))}
    out |= headings(page, labels)
    types = SchemaTypes()
    types.read(page)
    out |= {
        "schema_types": types.types, "schema_item_count": types.items, "schema_valid_count": types.valid,
        "schema_error_count": types.errors, "schema_warning_count": types.warnings, "schema_issue_codes": types.issues,
    }
    images = page.find("img")
    missing = [k for k, image in enumerate(images, 1) if needs_alternative(image, labels)]
    body = next(iter(page.find("body")), None)
    out |= {"image_count": len(images), "missing_alt": len(missing), "missing_alt_sample": missing[: MOST["ordinals"]]}
    out |= {"word_count": len(WORDS.findall(body.text())) if body else 0, "links": page_links(page, url, scope_host), "layout_fingerprint": fingerprint(page.page)}
    return out


def page_links(page: Index, url: str, scope_host: str | None) -> list[dict]:
    out: list[dict] = []
    for node in page.find("a", "area"):
        if len(out) >= MOST["links"]:
            break
        href = clean(node.get("href"))
        if not href or href.lower().startswith(("#", "mailto:", "tel:", "javascript:", "data:")) or (target := resolved(url, href)) is None:
            continue
        rel = tokens(node.get("rel"))
        out.append({
            "target_url": target, "anchor_text": cut(clean(node.text()), CAPS["anchor"]), "tag": node.tag, "rel_values": rel,
            "is_internal": urls.in_scope(target, scope_host), "is_followable": "nofollow" not in rel, "ordinal": len(out),
        })
    return out


def map_pages(df: DataFrame, schema: str, read: Callable[..., dict], columns: list[str], rows: int = 200) -> DataFrame:
    """Adds the fields of ``read(*columns)`` to each row, ``rows`` at a time. One Python pass; other columns go through as they are; a small table is dealt to all cores."""
    found_schema = T.StructType.fromDDL(schema)
    kept = [f for f in df.schema if f.name not in found_schema.names]
    names, place = [*(f.name for f in kept), *found_schema.names], [df.columns.index(f.name) for f in kept]
    inputs, fields = [df.columns.index(c) for c in columns], list(to_arrow_schema(found_schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = [read(*row) for row in zip(*(batch.column(i).to_pylist() for i in inputs), strict=True)]
                facts = [pa.array([f[x.name] for f in found], x.type) for x in fields]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in place), *facts], names=names)

    return spread(df).mapInArrow(run, T.StructType([*kept, *found_schema.fields]))


def parse_pages(df: DataFrame, *, url: str = "url", html: str = "html", scope: str = "scope_host", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but html) and FACTS of each page. A null page is an empty one."""

    def read(u: str | None, h: str | None, s: str | None) -> dict:
        return page_facts(u or "", h or "", s)

    keep = keep if keep is not None else [c for c in df.columns if c != html]
    rows = df.select(*dict.fromkeys([*keep, url, html, scope]))
    out = map_pages(rows, FACTS, read, [url, html, scope])
    return out.select(*keep, *[c for c in out.columns if c not in (*keep, url, html, scope)])


# --- rendered pages --------------------------------------------------------------------------------------------------

RENDERED = (
    "title string, meta_description string, canonical_url string, meta_robots string, h1 array<string>, word_count int, link_count int, "
    "image_count int, missing_alt int, open_graph_title string, open_graph_description string, open_graph_image_url string, schema_types array<string>"
)


def rendered_facts(url: str, html: str) -> dict:
    """The second rule set, for pages after their scripts ran: visible words, first values, h1 by text."""
    page = Index(parse(html))
    first = lambda values: next(iter(values), "")
    canonical = first(clean(n.get("href")) for n in page.find("link") if "canonical" in tokens(n.get("rel")))
    hidden = lambda n: n.tag in ("script", "style", "noscript", "template") or "hidden" in n.attrs
    body = first(page.find("body"))
    types = SchemaTypes()
    types.read(page)
    images = page.find("img")
    return {
        "title": clean(first(n.text() for n in page.find("title"))),
        "meta_description": first(metas(page, "name", "description")),
        "canonical_url": (resolved(url, canonical) or "") if canonical else "",
        "meta_robots": first(metas(page, "name", "robots")),
        "h1": [t for n in page.find("h1") if (t := clean(n.text()))][: HEADINGS["h1"]],
        "word_count": len(WORDS.findall(body.text(hidden))) if body else 0,
        "link_count": sum("href" in n.attrs for n in page.find("a", "area")),
        "image_count": len(images),
        "missing_alt": sum(not clean(n.get("alt")) and "alt" not in n.attrs for n in images),
        "open_graph_title": first(metas(page, "property", "og:title")),
        "open_graph_description": first(metas(page, "property", "og:description")),
        "open_graph_image_url": first(metas(page, "property", "og:image")),
        "schema_types": types.types,
    }


def rendered_metadata(df: DataFrame, *, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    keep = keep if keep is not None else [c for c in df.columns if c != html]
    rows = df.select(*dict.fromkeys([*keep, url, html]))
    return map_pages(rows, RENDERED, lambda u, h: rendered_facts(u or "", h or ""), [url, html]).select(*keep, *[f.split()[0] for f in re.split(r", (?=\w+ )", RENDERED)])


# --- rewriting -------------------------------------------------------------------------------------------------------

URL_IN_CSS = re.compile(r"url\(\s*(?:\"([^\"]*)\"|'([^']*)'|([^)\"'\s]*))\s*\)|(@import)\s+(?:\"([^\"]*)\"|'([^']*)')", re.I)
LINK_TAGS = frozenset(("a", "area"))
REFERENCES = ("src", "href", "poster")
SETS = ("srcset", "imagesrcset")
KEPT_SCHEMES = re.compile(r"(?:data|mailto|tel|javascript|about|blob):|#|$", re.I)
CSP = "default-src 'self' data: blob:; script-src 'none'; object-src 'none'; base-uri 'none'; form-action 'none'"


def reference(raw: str, base: str, paths: dict[str, str], source: str = "") -> str:
    """A local path if the resolved URL has one (relative to ``source``, if given), else the redacted URL."""
    raw = clean(raw)
    if KEPT_SCHEMES.match(raw):
        return raw
    try:
        target = urljoin(base, raw)
        plain, _, fragment = target.partition("#")
        local = paths.get(target) or paths.get(plain)
        if local is None:
            return urls.redact_archived(target)
    except ValueError:
        return ""
    local = urls.relative(source, local) if source else local
    return local + ("#" + fragment if fragment else "")


def rewrite_css_text(css: str, base: str, paths: dict[str, str], source: str = "") -> str:
    def put(m: re.Match) -> str:
        raw = next((g for g in (m[1], m[2], m[3], m[5], m[6]) if g is not None), "")
        found = reference(raw, base, paths, source).replace('"', "%22")
        return f'@import "{found}"' if m[4] else f'url("{found}")'

    return URL_IN_CSS.sub(put, css)


def css_template(css: str, base: str) -> tuple[str, list[tuple[str, str, str, str]]]:
    """A stylesheet as text with places, and for each place what ``rewrite_css_text`` puts there.

    A place has the two URLs that may have a local path (with and without its fragment),
    what follows a local path, and what stands there if neither has one.
    """
    places: list[tuple[str, str, str, str]] = []

    def put(m: re.Match) -> str:
        raw = clean(next((g for g in (m[1], m[2], m[3], m[5], m[6]) if g is not None), ""))
        found = "\0"
        try:
            if KEPT_SCHEMES.match(raw):
                found = raw.replace('"', "%22")
            else:
                target = urljoin(base, raw)
                plain, _, fragment = target.partition("#")
                places.append((target, plain, "#" + fragment if fragment else "", urls.redact_archived(target)))
        except ValueError:
            found = ""
        return f'@import "{found}"' if m[4] else f'url("{found}")'

    return URL_IN_CSS.sub(put, css), places


def rewrite_page(html: str, base: str, paths: dict[str, str]) -> str:
    """References to local paths or redacted; no base element; values a visitor typed are blank."""
    page = parse(html)
    for node in page.walk():
        node.children = [c for c in node.children if isinstance(c, str) or c.tag != "base"]
        for name in REFERENCES:
            if name in node.attrs and not (node.tag in LINK_TAGS and name == "href"):
                node.attrs[name] = reference(node.attrs[name], base, paths)
        for name in SETS:
            if name in node.attrs:
                pieces = [p.split(None, 1) for p in node.attrs[name].split(",") if p.strip()]
                node.attrs[name] = ", ".join(" ".join([reference(p[0], base, paths), *p[1:]]) for p in pieces)
        if "style" in node.attrs:
            node.attrs["style"] = rewrite_css_text(node.attrs["style"], base, paths)
        if node.tag == "style":
            node.children = [rewrite_css_text(node.text(), base, paths)]
        elif node.tag == "input":
            if "value" in node.attrs:
                node.attrs["value"] = ""
            node.attrs.pop("checked", None)
        elif node.tag == "textarea":
            node.children = []
        elif node.tag == "option":
            node.attrs.pop("selected", None)
    return serialize(page)


def rewrite_links(html: str, base: str, source: str, routes: dict[str, str]) -> str:
    """Links to archived pages become relative paths, others redacted URLs; fragments stay."""
    page = parse(html)
    for node in page.find("a", "area"):
        raw = clean(node.get("href"))
        if "href" not in node.attrs or KEPT_SCHEMES.match(raw):
            continue
        try:
            target = urljoin(base, raw)
            fragment = urlsplit(target).fragment
            known = routes.get(hashlib.sha256(urls.route(target).encode()).hexdigest())
        except ValueError:
            node.attrs["href"] = ""
            continue
        place = urls.relative(source, known) if known else urls.redact_archived(target)
        node.attrs["href"] = place + ("#" + fragment if fragment else "")
    return serialize(page)


def neutralize(html: str) -> str:
    """Scripts inert (JSON stays), no event handlers, refreshes or script preloads, and a policy that says so."""
    page = parse(html)
    for node in page.walk():
        node.attrs = {k: v for k, v in node.attrs.items() if not k.startswith("on")}
        kept: list[Node | str] = []
        for child in node.children:
            if isinstance(child, Node):
                if child.tag == "meta" and clean(child.get("http-equiv")).lower() in ("refresh", "content-security-policy"):
                    continue
                rel = tokens(child.get("rel"))
                if child.tag == "link" and ("modulepreload" in rel or {"preload", "prefetch"} & set(rel) and clean(child.get("as")).lower() == "script"):
                    continue
                if child.tag == "script" and not clean(child.get("type")).lower().endswith("json"):
                    child.attrs["type"] = "application/x-inert-script"
            kept.append(child)
        node.children = kept
    head = page.find("head")[0]
    head.children.insert(0, Node("meta", {"http-equiv": "Content-Security-Policy", "content": CSP}, head))
    return serialize(page)


#: Pages of a batch that are Python objects at a time.
SLICE = 200


def in_slices(fn: Callable[..., str | None], *columns: pa.Array) -> pa.Array:
    """``fn`` of each row; only a slice of a batch is taken apart at a time, the rest stays in Arrow."""
    out = [pa.array([], pa.string())]
    for at in range(0, len(columns[0]), SLICE):
        rows = zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)
        out.append(pa.array([None if row[0] is None else fn(*row) for row in rows], pa.string()))
    return pa.concat_arrays(out)


def _html_udf(fn: Callable[..., str | None]):
    def one(a: pa.Array) -> pa.Array:
        return in_slices(fn, a)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return in_slices(fn, a, b, c)

    def four(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return in_slices(fn, a, b, c, d)

    return F.arrow_udf({1: one, 3: three, 4: four}[fn.__code__.co_argcount], T.StringType())


def as_map(pairs) -> dict[str, str]:
    """A map column as it comes from Arrow."""
    return dict(pairs) if pairs is not None else {}


PLACE = T.StructType([T.StructField(name, T.StringType()) for name in ("target", "plain", "suffix", "otherwise")])


@F.pandas_udf(T.StructType([T.StructField("template", T.StringType()), T.StructField("places", T.ArrayType(PLACE))]))
def css_templates(css: pd.Series, base: pd.Series) -> pd.DataFrame:
    """(SHA-256 of the text around the places, places) of each stylesheet; null css is empty."""
    found = [css_template(c or "", b or "") for c, b in zip(css, base, strict=True)]
    hashes = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t, _ in found]
    return pd.DataFrame({"template": hashes, "places": [[dict(zip(PLACE.names, p, strict=True)) for p in places] for _, places in found]})


neutralize_html = _html_udf(neutralize)
layout_fingerprint = _html_udf(lambda html: fingerprint(parse(html)))
#: (html, base url, map<url, local path>)
rewrite_references = _html_udf(lambda html, base, paths: rewrite_page(html, base or "", as_map(paths)))
#: (html, base url, own archive path, map<route hash, archive path>)
rewrite_navigation = _html_udf(lambda html, base, source, routes: rewrite_links(html, base or "", source, as_map(routes)))
#: (css, source url, map<url, local path>)
rewrite_css = _html_udf(lambda css, base, paths: rewrite_css_text(css, base or "", as_map(paths)))
