from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from webstrata.functions import html as H
from webstrata.operators import archive

CSS, PATHS = "job_id string, path string, source_url string, body string", "job_id string, url string, path string"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def next_fit(files, most_shard, most_total):
    """The fold: files of one job in order."""
    out, shard, filled, total = [], 1, 0, 0
    for job, path, size, _ in files:
        need = size + 256 + 2 * len(path.encode())
        total += size
        if need > most_shard:
            out.append((job, path, None, "SITE_FILE_EXCEEDS_SHARD_BUDGET"))
        elif total > most_total:
            out.append((job, path, None, "SITE_ARCHIVE_BUDGET_EXCEEDED"))
        else:
            if filled and filled + need > most_shard:
                shard, filled = shard + 1, 0
            filled += need
            out.append((job, path, shard, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_are_those_of_the_fold(spark, seed):
    """Random jobs: one large, one of files that fill a shard exactly, one with files too large, one beyond the total, one of a single file."""
    draw = random.Random(seed)
    jobs = {
        "large": [draw.choice([0, 5, 300, 900, 2000, draw.randint(0, 3000)]) for _ in range(1500)], "exact": [4000 - 256 - 8] * 3 + [2000 - 256 - 8] * 6, "over": [10, 9000, 20, 3990, 4000, 30],
        "total": [3000] * 2000, "one": [7], "too large": [5000],
    }
    data, want = [], []
    for job, sizes in jobs.items():
        own = [(job, f"{k:04d}" if k % 7 or job == "exact" else f"{k:03d}é", size, k // 2) for k, size in enumerate(sizes)]
        own.sort(key=lambda x: (x[3], x[1].encode()))
        want += next_fit(own, 4000, 4_000_000)
        data += own
    draw.shuffle(data)
    files = spark.createDataFrame(data, "job_id string, path string, bytes long, file_no long").repartition(5)
    got = archive.shard_plan(files, 4000, 4_000_000)
    assert rows(got) == sorted(want, key=repr)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert archive.shard_plan(files.limit(0), 4000, 4_000_000).count() == 0


def closure(css, paths):
    """Rewriting all stylesheets again and again, until equal texts add no alias."""
    canonical = {c[1]: c[1] for c in css}
    urls: dict = {}
    for job, url, path in sorted(paths):
        urls[job, url] = min(path, urls.get((job, url), path))
    while True:
        texts = {}
        for job, path, source, body in css:
            known = {u: canonical.get(p, p) for (j, u), p in urls.items() if j == job}
            texts[job, path] = H.rewrite_css_text(body, source, known)
        first: dict = {}
        for (job, path), text in sorted(texts.items()):
            first.setdefault((job, text), path)
        new = {path: first[job, text] for (job, path), text in texts.items()}
        if new == canonical:
            return canonical, texts
        canonical = new


@pytest.mark.parametrize("seed", range(3))
def test_alias_classes_are_those_of_rewriting(spark, seed):
    """Random stylesheets that import each other (cycles too), pictures, fragments, unknown and kept references, two jobs."""
    draw = random.Random(seed)
    css, paths = [], []
    for job in "jk":
        names = [f"{job}{k:02}.css" for k in range(24)]
        paths += [(job, f"https://e.com/{n}", n) for n in names] + [(job, "https://e.com/i.png", "i.png"), (job, "https://e.com/q?x=1#f", "q.png")]
        for k, n in enumerate(names):
            refs = [draw.choice([f"{names[draw.randrange(k)] if k else 'i.png'}", names[draw.randrange(24)] if draw.random() < 0.15 else "i.png", "i.png#z", "q?x=1#f", "gone.png?a=2", "data:x", "http://[bad"]) for _ in range(draw.randint(0, 2))]
            css.append((job, n, f"https://e.com/{n}", "".join(draw.choice(["@import '{}';", "a{{b:url({})}}", 'a{{b:url("{}")}}']).format(r) for r in refs) + draw.choice(["", "p{}"])))
    got = archive.css_alias_closure(spark.createDataFrame(css, CSS).repartition(3), spark.createDataFrame(paths, PATHS))
    canonical, texts = closure(css, paths)
    assert {r.path: r.canonical_path for r in got.collect()} == canonical and len(set(canonical.values())) < len(css)
    assert {(r.job_id, r.path): r.body for r in got.collect()} == texts
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_import_cycles_and_odd_stylesheets(spark):
    """A cycle of imports ends, and its copy stays apart; null bodies and empty tables."""
    css = [("j", n, f"https://e.com/{n}", f"@import '{m}';") for n, m in (("a.css", "b.css"), ("b.css", "a.css"), ("c.css", "d.css"), ("d.css", "c.css"), ("s.css", "s.css"))] + [("j", "n.css", "https://e.com/n.css", None), ("j", "o.css", "https://e.com/o.css", "")]
    paths = spark.createDataFrame([("j", c[2], c[1]) for c in css], PATHS)
    df = spark.createDataFrame(css, CSS)
    got = {r.path: r.canonical_path for r in archive.css_alias_closure(df, paths).collect()}
    assert got == {**{c[1]: c[1] for c in css}, "o.css": "n.css"}
    assert archive.css_alias_closure(df.limit(0), paths).count() == 0


def test_alias_chains_and_cycles(spark):
    """A chain of a hundred ends at its last path; a cycle, and what leads to it, is a collision; case does not matter."""
    chain = [("j", f"p{k}", f"P{k + 1}") for k in range(100)]
    cycle = [("j", "x", "y"), ("j", "Y", "z"), ("j", "z", "X"), ("j", "to x", "x"), ("k", "x", "w"), ("j", "self", "SELF")]
    got = {(r.job_id, r.path): (r.canonical_path, r.problem) for r in archive.resolve_aliases(spark.createDataFrame(chain + cycle, "job_id string, path string, to string")).collect()}
    assert all(got["j", f"p{k}"] == ("P100", None) for k in range(100)) and got["k", "x"] == ("w", None) and ("j", "self") not in got
    assert {k for k, v in got.items() if v[1]} == {("j", "x"), ("j", "Y"), ("j", "z"), ("j", "to x")}
    assert archive.resolve_aliases(spark.createDataFrame([], "job_id string, path string, to string")).count() == 0


def test_running_totals_by_range(spark):
    from webstrata.operators import order

    data = [("a", k, k % 5 - 2) for k in range(1000)] + [(None, 1, 4), (None, 2, None), ("b", 1, 7)]
    got = order.running_totals(spark.createDataFrame(data, "k string, n int, v int").repartition(4), ["k"], ["n"], {"upto": "v"})
    want, sums = [], {}
    for k, n, v in data:
        sums[k] = sums.get(k, 0) + (v or 0)
        want.append((k, n, v, sums[k]))
    assert rows(got) == sorted(want, key=repr)
    assert got.select(F.col("upto")).schema["upto"].dataType.simpleString() == "bigint"
