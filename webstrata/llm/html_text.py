"""Main-text extraction with a suffix array over each host's pages.

A page is cut into text blocks, each with its place in the markup: what is never shown
goes at once; structure that is never the article (menus, headers, footers, sidebars,
notices, adverts, forms, comments) goes unless the article lies inside of it; an article
or main element is the main text. What markup leaves open is decided by what the pages of
a host share.

Shared runs: the pages of a host are dealt in the order of (host, text), so that a host's
pages lie together, and each stretch of up to ``group_pages`` pages is one suffix array
over their concatenated token streams. It finds the runs of tokens that several pages
have, and how many. A run's pages are summed up over all stretches of its host, so that
no result depends on how pages are dealt. Blocks that shared runs cover are boilerplate.

All runs are counted, in two rounds, as most are on one page only. A run's anchor is the
part of it, PLACES - 1 tokens shorter, with the least hash: equal runs have equal anchors, and
a page has fewer anchors than runs. The first round counts anchors over hosts, the second
all runs whose anchor enough pages have. The others can't be on enough pages, so that nothing is lost.

Copies of a page are content: what tells boilerplate is that the pages around it differ,
so pages of a host whose texts are equal count as one. Inside an article or main element
only whole blocks that nearly all pages of the host have are boilerplate.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import wordhash as W
from webstrata.llm.common import ascii_lower, map_batches, materialize
from webstrata.sources.tables import spread

#: Elements whose text is never shown: fixed values.
RAW = "script style noscript template textarea title iframe svg"
#: Structure that is never the article; an article inside the first is a teaser or a comment: fixed values.
NEVER = "nav footer aside button select dialog menu head"
FORM = "form"
BLOCKS = "address article blockquote body br center dd div dl dt fieldset h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section table tbody td tfoot th thead tr ul nav footer aside form figure figcaption details summary dialog"
VOID = "area base br col embed hr img input link meta param source track wbr"
RAW, NEVER, BLOCKS, VOID = (frozenset(x.split()) for x in (RAW, NEVER, BLOCKS, VOID))
#: Elements that names don't take out: whole pages, articles and headings.
NAMELESS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())


def names(words: str) -> re.Pattern:
    """Whole words of a class, id or role; not after "no", "has" or "with"."""
    return re.compile(rf"(?:^|(?<!\bno)(?<!\bhas)(?<!\bwith)[\s_-])(?:{'|'.join(words.split())})(?:$|[\s_-])")


#: Names of the parts that are never the article, by kind: fixed values.
COMMENTS = names("comment comments commentlist respond replies disqus")
PARTS = names(
    "menu nav navbar navigation breadcrumb breadcrumbs masthead footer sidebar side complementary contentinfo notice notices alert cookie cookies consent gdpr banner"
    " ad ads adv advert adverts advertisement sponsor sponsored promo newsletter subscribe login dialog"
)
HEADERS = names("header foot")
#: Names of parts that often are not the article: what the host's pages share decides.
OPEN_PARTS = names("search form share sharing social related recommended widget legal copyright toolbar pagination pager popup modal overlay signup subscription")
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Zones of a block. GONE, PART: not content; an article inside a PART is. OTHER: open. SOME: in an article, but in a part
#: with an open name. INNER, MAIN: in an article or main element, inside a PART, and elsewhere.
GONE, PART, OTHER, SOME, INNER, MAIN = range(6)
#: Of so many parts of a run, one is its anchor.
PLACES = 4
#: Keys of pages that a task remembers, so as not to send their copies on.
REMEMBERED = 1 << 18
#: Rows (8 to 100 bytes each) that are sent to all tasks at most.
SMALL = 100_000
#: Marks (8 bytes) of pages that are sent to all tasks at most.
MOST_MARKS = 1 << 20
SALTS = 64


def part_of(attributes: str) -> str:
    """What class, id and role name: "hidden", "comments", "part", "header", "open" or nothing."""
    low = attributes.lower()
    if "class" not in low and "id" not in low and "role" not in low and "hidden" not in low:
        return ""
    found = set()
    for m in ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name in ("class", "id", "role"):
            for kind, words in (("comments", COMMENTS), ("part", PARTS), ("header", HEADERS), ("open", OPEN_PARTS)):
                if words.search(value):
                    found.add(kind)
    return next((k for k in ("comments", "part", "header", "open") if k in found), "")


def zone_inside(name: str, attributes: str, zone: int) -> int:
    """The zone of an element's text, given its parent's."""
    if zone == GONE:
        return GONE
    if name in NEVER:
        return GONE
    part = "" if name in NAMELESS and "hidden" not in attributes.lower() else part_of(attributes)
    if part in ("hidden", "comments"):
        return GONE
    article = name in ("article", "main") or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes) is not None
    if zone in (MAIN, INNER, SOME):
        if name == FORM or part == "part":
            return GONE
        return SOME if part == "open" and zone == MAIN else zone
    if article:
        return INNER if zone == PART else MAIN
    if name in (FORM, "header") or part in ("part", "header"):
        return PART
    return zone


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each non-empty block, in page order, and of each article's start, with an empty text.

    Character references are decoded after the markup is cut; runs of white space
    become one space. Unclosed elements end with an enclosing one that ends.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside
    text: list[str] = []
    zone, at, skip = OTHER, 0, ""

    def flush() -> None:
        if text and (found := SPACES.sub(" ", entities.unescape("".join(text))).strip(" ")):
            out.append((found, zone))
        text.clear()

    for m in TAG.finditer(page):
        if skip:
            if m[2] is None or not m[1] or m[2].lower() != skip:
                continue
            skip, at = "", m.end()
            continue
        text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        name, closes = m[2].lower(), bool(m[1])
        if name in BLOCKS:
            flush()
        if name in RAW:
            if not closes and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
                skip = name if end else "\0"
        elif name in VOID:
            continue
        elif not closes:
            if name == "p" and stack and stack[-1][0] == "p":
                zone = stack.pop()[1]
            inside = zone_inside(name, m[3], zone)
            if inside != zone:
                flush()
            if name in ("article", "main") and inside in (MAIN, INNER):
                out.append(("", inside))  # an empty article is the page's main text, too
            stack.append((name, zone))
            zone = inside
        else:
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if place >= 0:
                flush() if stack[place][1] != zone else None
                zone = stack[place][1]
                del stack[place:]
    if not skip:
        text.append(page[at:])
    flush()
    return out


def candidates(cut: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The blocks that may be the page's main text: an article's; without one, all that markup leaves open."""
    zones = {z for _, z in cut}
    best = (MAIN, SOME) if MAIN in zones else (INNER,) if INNER in zones else (OTHER,)
    return [(t, z) for t, z in cut if t and z in best]


def digest(texts: list[str], salt: str = "") -> int:
    """One number for texts, as a signed 64-bit integer."""
    return int.from_bytes(hashlib.blake2b(("\n".join(texts) + "\0" + salt).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first ``depth`` tokens, and for each whether it shares them with the one before.

    By prefix doubling; tokens are small positive integers, a separator is a token of its own.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    rank, k, n = rank.astype(np.int64) + 1, 1, len(tokens)
    while k < depth:
        k2 = min(k, depth - k)
        after = np.zeros(n, np.int64)
        after[: max(n - k2, 0)] = rank[k2:]
        pair = rank * (n + 2) + after
        _, rank = np.unique(pair, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        k += k2
    order = np.argsort(rank, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = rank[order][1:] == rank[order][:-1]
    return order, same


def over_runs(start: np.ndarray, length: int) -> np.ndarray:
    """For each token, the largest of the numbers of the runs of ``length`` tokens over it, given by where they start."""
    n, out = len(start), start.copy()
    for k in range(1, min(length, n)):
        out[k:] = np.maximum(out[k:], start[: n - k])
    return out


class Stream:
    """The tokens of some pages (texts of their blocks), each page followed by a separator unlike any other token."""

    def __init__(self, pages: list[list[str]], hosts: np.ndarray):
        self.texts = [b for p in pages for b in p]
        self.page_of_block = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        hashes, self.bound = W.batch_words([b.encode("utf-8", "replace") for b in self.texts], fold=False)
        page = np.repeat(self.page_of_block, np.diff(self.bound))
        hashes = W.mix(hashes ^ hosts[page])  # equal words of two hosts are two tokens
        # no run crosses a separator
        ends = np.searchsorted(page, np.arange(len(pages)), side="right")
        self.tokens = np.insert(hashes, ends, W.mix(np.arange(1, len(pages) + 1, dtype=np.uint64)))
        self.owner = np.insert(page, ends, np.arange(len(pages)))
        self.separators = ends + np.arange(len(pages))

    def runs(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of ``run`` tokens start that lie within a page, and their hashes: all of them."""
        hashes = W.windows(self.tokens, run)
        at = np.arange(len(hashes))
        at = at[at + run <= self.separators[self.owner[: len(hashes)]]]
        return at, hashes[at]

    def anchors(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of these runs, where its anchor starts, and the anchor's hash."""
        size = anchor_size(run)
        at, parts = self.runs(run)[0], W.windows(self.tokens, size)
        if not len(at):
            return at, np.empty(0, np.uint64)
        least = at + np.lib.stride_tricks.sliding_window_view(parts, run - size + 1).argmin(1)[at]
        return least, parts[least]

    def shares(self, shared: np.ndarray) -> np.ndarray:
        """For each block, the share of its tokens that are marked; 0 for a block without tokens."""
        hits = np.concatenate(([0], np.cumsum(np.delete(shared, self.separators))))
        return (hits[self.bound[1:]] - hits[self.bound[:-1]]) / np.maximum(np.diff(self.bound), 1)


def anchor_size(run: int) -> int:
    """Tokens of an anchor."""
    return max(1, run - PLACES + 1)


def run_pages(s: Stream, at: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of runs of ``size`` tokens of a stretch, and the page of each; one row for a run on a page, by the suffix array."""
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    order, same = suffix_array(s.tokens, size)
    group = np.empty(len(s.tokens), np.int64)
    group[order] = np.cumsum(~same)
    pages = len(s.separators)
    rows = np.unique(group[at] * pages + s.owner[at], return_index=True)[1]
    return hashes[rows], s.owner[at][rows]


#: Kinds of marks: a run; a run's anchor; a whole block inside an article, or an open one of few tokens; a whole open block that is shorter than a run; a host.
RUN, ANCHOR, BLOCK, SHORT, HOST = range(5)
#: Tokens of a short block that ``least_pages`` make boilerplate; one of fewer must be on nearly all pages, or have runs around it.
LEAST_SHORT = 4


def block_mark(text: str, zone: int, host: int, run: int) -> tuple[int, int] | None:
    """The kind and mark of a block that is counted as a whole. Open blocks of ``run`` tokens or more are not: pages that have them have all of their runs."""
    if zone in (MAIN, INNER):
        return BLOCK, digest([text], f"block {host}")
    tokens = text.count(" ") + 1
    if tokens >= run:
        return None
    return (SHORT, digest([text], f"short {host}")) if tokens >= LEAST_SHORT else (BLOCK, digest([text], f"few {host}"))


def partial_counts(hosts: np.ndarray, keys: np.ndarray, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each mark of a stretch, with its number of pages and their keys. parts: kind, marks, and the page of each, one row for a mark on a page."""
    mark, page = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    kind = np.repeat(np.array([p[0] for p in parts], np.int32), [len(p[1]) for p in parts])
    order = np.lexsort((mark, kind))
    mark, page, kind = mark[order], page[order], kind[order]
    start = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (kind[1:] != kind[:-1]))[: len(mark)])
    bound = np.append(start, len(mark))
    who = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(keys[page]))
    return pa.RecordBatch.from_arrays([pa.array(mark[start]), pa.array(kind[start]), pa.array(hosts[page[start]]), pa.array(np.diff(bound)), who], names=["mark", "kind", "host", "n", "keys"])


COUNTS = "mark long, kind int, host long, n long, keys array<long>"


def shared_on_hosts(found: DataFrame, least_pages: int, least_main: int, most_share: float) -> DataFrame:
    """(mark, kind) of the runs and blocks (mark, kind, host, n; partial counts of pages) that enough distinct pages of their host have."""
    n = found.groupBy("mark", "kind", "host").agg(F.sum("n").alias("n"))
    sizes = materialize(n.where(F.col("kind") == HOST).select("host", F.col("n").alias("pages")), "hosts")
    runs = n.where(F.col("kind").isin(RUN, ANCHOR, SHORT) & (F.col("n") >= least_pages)).select("mark", "kind")
    whole = n.where((F.col("kind") == BLOCK) & (F.col("n") >= least_main))
    whole = whole.join(F.broadcast(sizes) if sizes.count() <= SMALL else sizes, "host").where(F.col("n") >= F.ceil(F.col("pages") * most_share)).select("mark", "kind")
    return materialize(runs.unionByName(whole), "shared")


def held(found: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, mark, kind): what each page has of it. Few marks go to all tasks, else a mark's rows are dealt over salts."""
    has = found.where(F.col("kind") != HOST).select("mark", "keys")
    if shared.count() <= SMALL:
        has = has.join(F.broadcast(shared), "mark")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        has = has.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(SALTS)).cast("int")).join(salted, ["mark", "salt"])
    return has.select(F.explode("keys").alias("key"), "mark", "kind")


def stretches(batches: Iterator[pa.RecordBatch], group_pages: int) -> Iterator[list]:
    """The columns of up to ``group_pages`` distinct pages (host, key and lists) of rows in the order of host and key: hosts and keys as arrays, the others as lists."""
    last = None
    for batch in batches:
        own, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))[: len(key)]
        if len(key) and last == (own[0], key[0]):
            new[0] = False
        last = (own[-1], key[-1]) if len(key) else last
        batch = batch.filter(pa.array(new))
        for at in range(0, batch.num_rows, group_pages):
            part = batch.slice(at, group_pages)
            yield [c.to_numpy() if i < 2 else c.to_pylist() for i, c in enumerate(part.columns)]


def extract_text(pages: DataFrame, *, group_pages: int = 200, run: int = 8, least_pages: int = 3, least_main: int = 20, most_share: float = 0.9, cover: float = 0.6) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    ``group_pages``: at most so many pages share a suffix array; no group grows with the
    input, and no result depends on the groups. ``run``: tokens in a shared run; all are looked at.
    ``least_pages``: pages of the host with distinct texts that make it boilerplate, where
    ``cover`` of a block's tokens lie in such runs, or all of a block of LEAST_SHORT tokens or
    more, but less than a run, is on so many pages. In an article or main element a block
    is boilerplate if ``most_share`` of the host's distinct pages, and ``least_main`` of
    them, have all of it; so is an open block of less than LEAST_SHORT tokens.

    Null html is an empty page and gives an empty text; pages without a host in their url
    are of one host; repeated rows give equal texts; extra columns are ignored; an empty table gives
    no rows. Whole pages are read, twice. Near copies of a page without an article
    element count as different pages, and what three of them share goes.
    """
    host = ascii_lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = spread(pages.select("page_id", "url", F.xxhash64(host).alias("host"), "html"))

    def marked(kept: list[tuple[str, int]], host: int) -> tuple[int, list[str], list[int], list[int]]:
        """A page's key, the texts of its open blocks, and the marks of its blocks, by kind."""
        marks = {m for t, z in kept if (m := block_mark(t, z, host, run)) is not None}
        return digest([t for t, _ in kept], str(host)), [t for t, z in kept if z not in (MAIN, INNER)], *(sorted(m for kind, m in marks if kind == k) for k in (BLOCK, SHORT))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                key, *rest = marked(candidates(blocks(page or "")), host)
                if key not in seen:
                    out.append((host, key, *rest))
                    seen.add(key)
            if len(seen) > REMEMBERED:
                seen.clear()
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "key", "texts", "whole", "short"])

    distinct = map_batches(rows, cut, "host long, key long, texts array<string>, whole array<long>, short array<long>")
    distinct = materialize(distinct, "blocks")

    def deal(df: DataFrame) -> DataFrame:
        """A host's pages lie together, copies of a page side by side; a large host is dealt over many tasks."""
        return df.repartitionByRange("host", "key").sortWithinPartitions("host", "key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, keys, texts, whole, short in stretches(batches, group_pages):
            s = Stream(texts, hosts.view(np.uint64))
            anchor, page = run_pages(s, *s.anchors(run), anchor_size(run))
            parts = [(ANCHOR, anchor.view(np.int64), page), (HOST, hosts, np.arange(len(keys)))]
            for k, marks in ((BLOCK, whole), (SHORT, short)):
                parts.append((k, np.array([x for m in marks for x in m], np.int64), np.repeat(np.arange(len(keys)), [len(m) for m in marks])))
            yield partial_counts(hosts, keys, parts)

    found = materialize(map_batches(deal(distinct), find, COUNTS), "anchors")
    first = held(found, shared_on_hosts(found, least_pages, least_main, most_share))
    of = lambda *kinds: F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("mark")))
    first = materialize(first.groupBy("key").agg(of(ANCHOR).alias("anchors"), of(BLOCK, SHORT).alias("shared")), "first")

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, keys, texts, anchors in stretches(batches, group_pages):
            s = Stream(texts, hosts.view(np.uint64))
            at, hashes = s.runs(run)
            # an anchor is its host's, so that it need not be told for each page
            ok = np.isin(s.anchors(run)[1].view(np.int64), np.array([a for own in anchors for a in own], np.int64))
            runs, page = run_pages(s, at[ok], hashes[ok], run)
            yield partial_counts(hosts, keys, [(RUN, runs.view(np.int64), page)])

    decided = first.where(F.size("shared") > 0).select("key", "shared")
    anchored = first.where(F.size("anchors") > 0).select("key", "anchors")
    if not anchored.isEmpty():
        # a page has few copies here: a task sends it on once
        found = materialize(map_batches(deal(distinct.join(anchored, "key").select("host", "key", "texts", "anchors")), find_runs, COUNTS), "runs")
        runs = held(found, shared_on_hosts(found, least_pages, least_main, most_share)).groupBy("key").agg(F.collect_set("mark").alias("runs"))
        both = decided.join(runs, "key", "full")
        decided = both.select("key", F.concat(*(F.coalesce(c, F.array().cast("array<long>")) for c in ("shared", "runs"))).alias("shared"))
    decided = materialize(decided, "decided")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, kept, mine in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                kept = list(zip(kept["texts"], kept["zones"], strict=True))
                texts.append("\n".join(main_text(kept, host, mine or [], run, cover)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [candidates(blocks(p or "")) for p in batch.column(3).to_pylist()]
            keys = [digest([t for t, _ in k], str(h)) for k, h in zip(kept, batch.column(2).to_pylist(), strict=True)]
            held = [{"texts": [t for t, _ in k], "zones": [z for _, z in k]} for k in kept]
            kind = pa.struct([("texts", pa.list_(pa.string())), ("zones", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array(held, kind), pa.array(keys, pa.int64())], names=["page_id", "url", "host", "kept", "key"])

    whole = map_batches(rows, again, "page_id long, url string, host long, kept struct<texts: array<string>, zones: array<int>>, key long")
    if (decided.agg(F.sum(F.size("shared") + 2)).first()[0] or 0) <= MOST_MARKS:
        whole = whole.join(F.broadcast(decided), "key", "left")
    else:  # a page may have any number of copies
        salted = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        whole = whole.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    return map_batches(whole.select("page_id", "url", "host", "kept", "shared"), judge, "page_id long, url string, text string, n_chars long")


def main_text(kept: list[tuple[str, int]], host: int, shared: list[int], run: int, cover: float) -> list[str]:
    """The blocks of a page that stay, given what it has of its host's shared runs and blocks."""
    if not shared:
        return [t for t, _ in kept]
    known, open_ = set(shared), [t for t, z in kept if z not in (MAIN, INNER)]
    s = Stream([open_], np.array([host], np.int64).view(np.uint64))
    at, hashes = s.runs(run)
    start = np.zeros(len(s.tokens), np.int64)
    start[at] = np.isin(hashes.view(np.int64), np.array(shared, np.int64))
    share = iter(s.shares(over_runs(start, run)))
    out = []
    for t, z in kept:
        covered = 0.0 if z in (MAIN, INNER) else next(share)
        mark = block_mark(t, z, host, run)
        if (mark is None or mark[1] not in known) and covered < cover:
            out.append(t)
    return out
