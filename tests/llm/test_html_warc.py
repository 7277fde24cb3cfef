from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from webstrata.llm import html_text as H
from webstrata.llm import warc

PAGES = "page_id long, url string, html string, digest string"


@pytest.mark.parametrize(("html", "want"), [
    ("<article><h1>A &amp; B</h1><p>one\n  two<p>three<b>!</b><br>four</article>", "A & B\none two\nthree!\nfour"),
    ("<nav><ul><li>m</ul></nav><header>h</header><main><p>x</p><aside>s</aside><form>f</form></main><footer>c</footer>", "x"),
    ("<body><p>plain</p><div class='cookie-banner'>no</div><div id=comments><p>no</p></div>", "plain"),
    ("<article><p>x</p><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><div class=ad>no</div><section class='reader comments'>no</section>y</article>", "x\ny"),
    ("<article>&lt;p&gt; &eacute;&#128512; &copy</article>", "<p> é😀 ©"), ("", ""), (None, ""), ("   ", ""), ("just text", "just text"), ("<p>a<p hidden>b<p>c", "a\nc"), ("<div class='no-sidebar'>kept</div>", "kept"),
    ("<script>never closed <p>x", ""), ("<article><p>a < b and c > d</p></article>", "a < b and c > d"), ("<article><p title='x>y'>q</p></article>", "q"),
    # an article counts wherever it is, but for comments and teasers; what is in it goes only if it is named by the contract
    ("<form id='aspnetForm'><nav>m</nav><article><p>x</p></article><p>f</p></form>", "x"), ("<div class='page sidebar'><p>no</p><main><p>x</p></main></div>", "x"),
    ("<article><h2 id='legal'>t</h2><p>x</p><section class='search'>y</section></article>", "t\nx\ny"), ("<article><div class='post-header'><h1>t</h1></div>x</article>", "t\nx"),
    ("<main><p>x</p><ol class='comment-list'><li><article>no</article></ol></main>", "x"), ("<aside><article>no</article></aside><p>x", "x"), ("<div class=sidebar><article>no</article></div><article>x</article>", "x"),
    ("<article></article><div>no</div><div class=ad>no</div>", ""), ("<form><label>name</label></form>", ""), ("<header class='site'>no</header><div class='site-header'>no</div>x", "x"),
])
def test_blocks(html, want):
    assert "\n".join(t for t, _ in H.candidates(H.blocks(html or ""))) == want


def test_suffix_array_against_brute_force():
    rnd = np.random.default_rng(5)
    for n in (1, 5, 40, 300):
        tokens = rnd.integers(1, 4, n).astype(np.uint64)
        for length in (1, 2, 3, 8):
            grams = [tuple(tokens[i : i + length].tolist()) for i in range(n)]
            order, same = H.suffix_array(tokens, length)
            assert [grams[i] for i in order] == sorted(grams)
            assert same.tolist() == [k > 0 and grams[order[k]] == grams[order[k - 1]] for k in range(n)]


RUN, COVER = 8, 0.6


def brute(rows):
    """Texts of (host, html), page by page, from the sets of runs of all pages of a host: no hashing of cells, no stretches."""
    cut = [(h, H.candidates(H.blocks(x or ""))) for h, x in rows]
    kinds = {}
    for h, c in cut:
        kinds.setdefault(h, {})[tuple(t for t, _ in c)] = c

    def picks(host, kept):
        """{token place: run} of a page, by the rule: the least hash of each four neighbours, the first and the last."""
        words = [w.encode() for t, z in kept if z < H.INNER for w in t.split(" ")]
        from webstrata.llm import wordhash as W

        key = np.array([H_HOST[host]], np.int64).view(np.uint64)
        tokens = W.mix(np.concatenate([W.words(w, False)[0] for w in words]) ^ key) if words else np.empty(0, np.uint64)
        grams = W.windows(tokens, RUN).tolist()
        at = {min(range(i, i + 4), key=lambda k: grams[k]) for i in range(len(grams) - 3)} | ({0, len(grams) - 1} if grams else set())
        return {k: tuple(words[k : k + RUN]) for k in at}, len(words)

    runs, whole, short = {}, {}, {}
    for h, pages in kinds.items():
        for c in pages.values():
            for r in set(picks(h, c)[0].values()):
                runs[h, r] = runs.get((h, r), 0) + 1
            for t in {t for t, z in c if z >= H.INNER}:
                whole[h, t] = whole.get((h, t), 0) + 1
            for t in {t for t, z in c if z < H.INNER and 4 <= len(t.split(" ")) < RUN}:
                short[h, t] = short.get((h, t), 0) + 1
    out = []
    for h, c in cut:
        found, n = picks(h, c)
        hit = {j for k, r in found.items() if runs[h, r] >= 3 for j in range(k, k + RUN)}
        at, kept = 0, []
        for t, z in c:
            if z >= H.INNER:
                ok = not (whole[h, t] >= 20 and whole[h, t] >= np.ceil(0.9 * len(kinds[h])))
            else:
                size = len(t.split(" "))
                ok = len(hit & set(range(at, at + size))) / size < COVER and short.get((h, t), 0) < 3
                at += size
            kept += [t] if ok else []
        out.append("\n".join(kept))
    return out


H_HOST = {}


def check(spark, rows, **how):
    """rows: (page_id, url, html); the operator's texts in the rows' order, the same for all ways to deal and join."""
    df = spark.createDataFrame([(i, u, x, "") for i, u, x in rows], PAGES)
    hosts = [(u or "").split("://")[-1].split("/")[0] if u else "" for _, u, _ in rows]
    for r in df.sparkSession.createDataFrame([(h,) for h in set(hosts)], "h string").select("h", F.xxhash64("h").alias("x")).collect():
        H_HOST[r.h] = r.x
    want = sorted((i, t, len(t)) for (i, _, _), t in zip(rows, brute(list(zip(hosts, (x for _, _, x in rows), strict=True))), strict=True))
    small = H.SMALL, H.MOST_MARKS
    for parts, size, few in ((3, 200, small), (7, 3, (0, 0))):
        H.SMALL, H.MOST_MARKS = few
        try:
            got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract_text(df.repartition(parts), group_pages=size).collect())
        finally:
            H.SMALL, H.MOST_MARKS = small
        assert got == want
    return {i: t for i, t, _ in want}


def test_boilerplate_without_markup(spark):
    """Pages of plain divs: what several pages of a host share goes, what one has stays; a lone host keeps all."""
    menu, foot = "home about contact help terms jobs press blog more", "all rights reserved by the owner of this site since ever"
    rows = [(k, f"http://h.com/{k}", f"<div>{menu}</div><div>unique text number {k} of page {k}</div><div>{foot}</div>") for k in range(30)]
    rows += [(99, "http://other.com/", f"<div>{menu}</div>"), (98, None, None), (97, "http://h.com/1", "<article>" + "long " * 100_000 + "</article>"), (97, "http://h.com/1", "<article>twice</article>")]
    texts = check(spark, rows)
    assert all(texts[k] == f"unique text number {k} of page {k}" for k in range(30)) and texts[99] == menu and texts[98] == ""
    assert H.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_shared_over_the_whole_host(spark):
    """A notice on 6 of 600 pages goes whatever the groups; with equal words, another host's pages are not counted."""
    notice = "we will be closed on monday for the repair of all our servers and lines until further notice"
    rows = [(k, f"http://hot.com/{k}", f"<div>own words {k}</div>" + (f"<div>{notice}</div>" if k % 100 == 0 else "")) for k in range(600)]
    rows += [(1000 + k, f"http://few{k // 2}.com/{k}", f"<div>{notice}</div><div>{k}</div>") for k in range(4)]
    assert check(spark, rows) == {k: f"own words {k}" for k in range(600)} | {1000 + k: f"{notice}\n{k}" for k in range(4)}


def test_copies_stay(spark):
    """Copies of a page keep their text, with and without an article element; what nearly all differing pages have in their articles goes."""
    menu = "home about contact help terms jobs press blog more"
    story = " ".join(f"story{k}" for k in range(40))
    rows = [(k, f"http://h.com/{k}", f"<div>{menu}</div><div>{f'its own words {k} of page {k} alone' if k >= 5 else story}</div>") for k in range(30)]
    rows += [(100 + k, "http://all.com/", f"<article><p>{story}</p></article>" if k < 60 else f"<article>{k}</article>") for k in range(62)]
    rows += [(200 + k, "http://share.com/", f"<article><p>{story} {k}</p><p>tell your friends</p></article>") for k in range(25)]
    rows += [(300 + k, "http://some.com/", f"<article><p>text {k}</p><div class=social>send this page to all your friends and to theirs</div></article>") for k in range(5)]
    want = {k: f"its own words {k} of page {k} alone" if k >= 5 else story for k in range(30)} | {100 + k: story if k < 60 else str(k) for k in range(62)}
    assert check(spark, rows) == want | {200 + k: f"{story} {k}" for k in range(25)} | {300 + k: f"text {k}" for k in range(5)}


def test_random_pages_against_brute_force(spark):
    rnd = np.random.default_rng(8)
    parts = [" ".join(f"w{x}" for x in rnd.integers(0, 40, n)) for n in rnd.integers(1, 40, 25)]
    html = ["".join(f"<{t}>{parts[k]} </{t}>" for t, k in zip(rnd.choice(["div", "article", "p class=share"], 4, p=[0.8, 0.05, 0.15]), rnd.integers(0, 25, 4), strict=True)) + f"<p>end {i}" for i in range(120)]
    check(spark, [(k, f"http://h{k % 3}.com/{k}", x) for k, x in enumerate(html)])


def all_runs(rows):
    """Texts of (page_id, host, blocks) of pages of plain divs: all runs of RUN tokens of all pages of a host, as words. No hashes, no picks."""
    hosts = {}
    for _, h, b in rows:
        hosts.setdefault(h, set()).add(tuple(b))
    runs, whole, out = {}, {}, {}
    for h, pages in hosts.items():
        for b in pages:
            words = " ".join(b).split(" ")
            for r in {tuple(words[k : k + RUN]) for k in range(len(words) - RUN + 1)}:
                runs[h, r] = runs.get((h, r), 0) + 1
            for t in set(b):
                whole[h, t] = whole.get((h, t), 0) + 1
    for i, h, b in rows:
        words = " ".join(b).split(" ")
        hit = {j for k in range(len(words) - RUN + 1) if runs[h, tuple(words[k : k + RUN])] >= 3 for j in range(k, k + RUN)}
        at, kept = 0, []
        for t in b:
            size = len(t.split(" "))
            pages = 3 if 4 <= size < RUN else max(20, 0.9 * len(hosts[h]))
            if len(hit & set(range(at, at + size))) / size < COVER and not (size < RUN and whole[h, t] >= pages):
                kept.append(t)
            at += size
        out[i] = "\n".join(kept)
    return out


def all_runs_check(spark, rows):
    df = spark.createDataFrame([(i, f"http://{h}/{i}", "".join(f"<div>{t}</div>" for t in b), "") for i, h, b in rows], PAGES)
    want = all_runs(rows)
    for parts, size in ((3, 200), (7, 3)):
        assert {r.page_id: r.text for r in H.extract_text(df.repartition(parts), group_pages=size).collect()} == want
    return want


def test_every_shared_run_counts(spark):
    """Passages of 8 to 10 tokens that three pages share are found each, whatever is around them."""
    passages = [" ".join(f"p{n}x{k}w{j}" for j in range(n)) for n in (8, 9, 10) for k in range(30)]
    rows = [(3 * k + j, "h.com", [f"own{k} before{j} it{j}", p, f"own{k} after{j} it{j}"]) for k, p in enumerate(passages) for j in range(3)]
    want = all_runs_check(spark, rows)
    assert want == {3 * k + j: f"own{k} before{j} it{j}\nown{k} after{j} it{j}" for k in range(90) for j in range(3)}


def test_blocks_of_few_tokens(spark):
    """An open block of few tokens goes if nearly all pages have it, 20 at least."""
    rows = [(k, "h.com", ["Home", f"own words {k}", "See also"] if k < 19 else ["Home", f"own words {k}"]) for k in range(21)] + [(100 + k, "few.com", ["Home", f"{k}"]) for k in range(19)]
    want = all_runs_check(spark, rows)
    assert want == {k: f"own words {k}" + ("\nSee also" if k < 19 else "") for k in range(21)} | {100 + k: f"Home\n{k}" for k in range(19)}


def test_random_runs_against_words(spark):
    """Words of two letters, so that runs and anchors of different passages meet; runs that start and end anywhere."""
    rnd = np.random.default_rng(11)
    rows = []
    for i in range(150):
        base = rnd.integers(0, 2, 60) if i % 5 else np.arange(60) % 7
        cuts = sorted({0, 60, *rnd.integers(1, 60, 6).tolist()})
        rows.append((i, f"h{i % 2}.com", [" ".join(f"v{x}" if j % 9 else f"v{x}n{rnd.integers(0, 6)}" for j, x in enumerate(base[a:b].tolist(), a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
    want = all_runs_check(spark, rows)
    assert 0 < sum(map(len, want.values())) < sum(len("\n".join(b)) for _, _, b in rows)


def test_given_pages(spark):
    """Against the documents that the pages were made from."""
    import re

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    right = n = 0
    for r in H.extract_text(pages).collect():
        if (m := re.search(r"/(\d+)[^/]*/?$", r.url)) and int(m[1]) in docs:
            lines = [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for x in docs[int(m[1])].split("\n")]
            n += 1
            right += r.text.split("\n")[1:] == [x for x in lines if x]  # after the heading
    assert n and right == n


def payloads():
    magic = warc.MAGIC
    fake = f"{magic}WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = ["", None, "same", "same", "same", "é😀", magic, f"x{magic}y{magic}", fake, fake * 3, fake + "tail", "a\r\n\r\n", "\r\n\r\n" + magic, "x" * 200_000, "same", "Content-Length: 9\r\n\r\n"]
    return [(k * 7 % 31, f"http://h/{k}\r\nX: y" if k % 2 else None, t, "clash") for k, t in enumerate(texts)]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize(("compression", "least", "split"), [("gzip", 0, None), ("none", 0, 512), ("none", 5, 4096)])
def test_round_trip(spark, tmp_path, compression, least, split):
    rows = payloads()
    df = spark.createDataFrame(rows, PAGES).repartition(2)
    path = str(tmp_path / "w")
    warc.write_warc(df, path, least_bytes=least, compression=compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == {r[0] for r in rows} and 666 not in got
    for page_id, _, html, _ in rows:
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        first = max(same)
        again = len((html or "").encode()) >= least and page_id != first
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest, r.stated_digest) == (len((html or "").encode()), sha(html), sha(html))
        assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))


def test_splits_that_change_between_reads(spark, tmp_path, monkeypatch):
    """Records with the magic inside come back whole, also if the files are split otherwise when their parts are read again; a part that is gone is an error."""
    df = spark.createDataFrame([(k, None, f"{warc.MAGIC}a{k}{warc.MAGIC}" * (k % 4 + 1), "") for k in range(60)], PAGES).repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(df, path, compression="none")
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    plain = warc.chain

    def later(candidates):
        for n, v in zip(names, ("16", "700", "0"), strict=True):
            spark.conf.set(n, v)
        return plain(candidates)

    monkeypatch.setattr(warc, "chain", later)
    try:
        spark.conf.set(names[0], "4")
        got = {r.page_id: r.payload_digest for r in warc.read_warc(spark, path).collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    assert got == {k: sha(f"{warc.MAGIC}a{k}{warc.MAGIC}" * (k % 4 + 1)) for k in range(60)}

    calls = []

    def other_key():  # as if the bytes had changed in between
        calls.append(1)
        return [F.octet_length("chunk").cast("long").alias("size"), F.xxhash64("chunk").alias("k1"), F.lit(len(calls)).cast("long").alias("k2")]

    monkeypatch.setattr(warc, "chain", plain)
    monkeypatch.setattr(warc, "content_key", other_key)
    with pytest.raises(Exception, match="no longer in"):
        warc.read_warc(spark, path).collect()


def test_many_shared_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 0)
    df = spark.createDataFrame([(k, "http://h/", "" if k % 3 else f"p{k % 30}", "") for k in range(90)], PAGES)
    warc.write_warc(df, str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    last = {("" if k % 3 else f"p{k % 30}"): k for k in range(90)}
    assert got == {k: ("response", None) if (f := last["" if k % 3 else f"p{k % 30}"]) == k else ("revisit", f) for k in range(90)}


def test_chain_alone():
    offset = np.array([0, 10, 25, 40, 41])
    assert warc.reached(offset, np.array([25, 12, 40, 99, 50])).tolist() == [True, False, True, True, False]
    assert warc.reached(np.array([5]), np.array([9])).tolist() == [False] and warc.reached(np.empty(0, int), np.empty(0, int)).tolist() == []
    n = 5000
    assert warc.reached(np.arange(n) * 3, np.arange(n) * 3 + 3).all()


def test_empty_and_digest(spark, tmp_path):
    df = spark.createDataFrame([], PAGES)
    warc.write_warc(df, str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
    assert spark.range(1).select(warc.base32_sha1(F.lit("abc").cast("binary"))).first()[0] == sha("abc")
