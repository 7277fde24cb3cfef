"""Queries over facts that the given pages lack: each page gets metas, links, JSON-LD, images and headings that its id determines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import html
from webstrata.plans.catalog import long, query


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the pages with a longer head and body; null pages are empty ones with the same."""
    k = F.col("page_id")
    n = k.cast("string")
    robots = F.when(k % 2 == 0, '<meta name="ROBOTS" content="noindex"><meta name="robots" content="follow">').otherwise("")
    target = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, "/other").otherwise("mailto:x@example.com")
    links = F.concat(F.lit('<link rel="canonical" href="'), target, F.lit('"><link rel="alternate" hreflang="de" href="/de"><link rel="stylesheet" href="/s.css">'), F.when(k % 2 == 1, '<link rel="alternate" href="/feed">').otherwise(""),
        F.when(k % 3 == 0, '<link rel="preload STYLESHEET" href="/t.css"><link rel="preload" href="/u.css">').otherwise(""))
    said = F.when(k % 5 == 0, F.concat(F.lit('<meta property="og:description" content=" About '), n, F.lit(' "><meta property="og:description" content="later">'))).otherwise("")
    title = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit('<meta property="OG:TITLE" content="T'), n, F.lit('">')))
    image = F.when(k % 3 == 0, "https://cdn.example/x?b=2&amp;a=1#f").when(k % 3 == 1, F.concat(F.lit("/i"), n, F.lit(".png"))).otherwise("javascript:x")
    graph = F.concat(title, said, F.lit('<meta property="og:image" content="'), image, F.lit('">'))
    data = F.concat(F.lit('<script type="application/ld+json">{"@type": ["Article", "article"], "author": {"@type": "Person"}}</script>'), F.when(k % 3 == 1, F.concat(F.lit('<script type="application/ld+json">{"@type": "https://schema.org/Kind'), (k % 5).cast("string"), F.lit('"}</script>'))).otherwise(""), F.when(k % 4 == 0, '<script type="application/ld+json">{oops</script>').otherwise(""))
    # k % 4 images without an alternative, between others that need none or have one
    bare = F.array_join(F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.when(i > 0, '<img src="/a"><img src="/b" alt="x">').otherwise("")), "")
    named = F.when(k % 2 == 0, '<img src="/d" alt=" "><img src="/e" aria-label="y"><img src="/f" aria-hidden="true">').otherwise('<img src="/g" role="presentation">')
    body = F.concat(F.lit('<body><img src="/c" alt="">'), bare, named, F.lit('<div role="heading" aria-level="6">H'), n, F.lit("</div>"))
    given = F.coalesce("html", F.lit("<html><head></head><body></body></html>"))
    head = F.concat(F.lit("<head>"), robots, links, graph, data)
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("html", F.replace(F.replace(given, F.lit("<head>"), head), F.lit("<body>"), body))
    return html.parse_pages(p.withColumn("scope_host", host(F.col("url"))), keep=["page_id", "url"])


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)


@query("select page_id, case when page_id % 2 = 0 then 'noindex, follow' else '' end as meta_robots from pages")
def o042_page_robots(spark, sf_dir):
    return signalled(spark, sf_dir).select("page_id", "meta_robots")


@query("""select page_id, case page_id % 3 when 0 then 'SELF' when 1 then 'NON_SELF' else 'MISSING' end as relation, 1 as declared, case when page_id % 3 = 2 then 1 else 0 end as invalid from pages""")
def o043_page_canonical(spark, sf_dir):
    return signalled(spark, sf_dir).select("page_id", F.col("canonical_relation").alias("relation"), *(F.col(f"canonical_{x}").cast("int").alias(x) for x in ("declared", "invalid")))


@query("select page_id, concat('H', page_id) as h6, len(regexp_extract_all(html, '<h1[ >]')) as h1_count from pages")
def o044_page_headings(spark, sf_dir):
    return signalled(spark, sf_dir).select("page_id", F.array_join("h6", "|").alias("h6"), F.size("h1").cast("long").alias("h1_count"))


@query("select page_id, concat('de ', regexp_extract(url, '^[a-z]+://[^/?#]+'), '/de') as alternates, page_id % 2 as invalid from pages")
def o045_page_hreflang(spark, sf_dir):
    each = F.transform("hreflang", lambda h: F.concat_ws(" ", h["language"], h["url"]))
    return signalled(spark, sf_dir).select("page_id", F.array_join(each, "|").alias("alternates"), F.col("hreflang_invalid").cast("long").alias("invalid"))


@query("""select page_id, case when page_id % 7 = 0 then '' else concat('T', page_id) end as title, case when page_id % 5 = 0 then concat('About ', page_id) else '' end as description,
  case page_id % 3 when 0 then 'https://cdn.example/x?a=1&b=2' when 1 then concat(regexp_extract(url, '^[a-z]+://[^/?#]+'), '/i', page_id, '.png') else 'javascript:x' end as image_url from pages""")
def o046_page_open_graph(spark, sf_dir):
    return signalled(spark, sf_dir).select("page_id", *(F.col(f"open_graph_{x}").alias(x) for x in ("title", "description", "image_url")))


@query("select page_id, concat('Article|Person', case when page_id % 3 = 1 then concat('|Kind', page_id % 5) else '' end) as types, case when page_id % 4 = 0 then 1 else 0 end as errors from pages")
def o047_page_structured_data(spark, sf_dir):
    return signalled(spark, sf_dir).select("page_id", F.array_join("schema_types", "|").alias("types"), F.col("schema_error_count").cast("int").alias("errors"))


@query(r"""select page_id, len(regexp_extract_all(regexp_replace(regexp_replace(concat('H', page_id, split_part(split_part(html, '<body>', 2), '</body>', 1)), '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '&#?[A-Za-z0-9]+;', ' ', 'g'), '[\p{L}\p{N}]+')) as word_count from pages""")
def o048_word_count(spark, sf_dir):
    return signalled(spark, sf_dir).select("page_id", *long("word_count"))


@query("""select page_id, cast(1 + 2 * (page_id % 4) + case when page_id % 2 = 0 then 3 else 1 end as int) as images, cast(page_id % 4 + case when page_id % 2 = 0 then 1 else 0 end as int) as missing_alt,
  array_to_string(list_concat([2 * i for i in range(1, page_id % 4 + 1)], case when page_id % 2 = 0 then [2 + 2 * (page_id % 4)] else [] end), '|') as ordinals from pages""")
def o049_image_audit(spark, sf_dir):
    return signalled(spark, sf_dir).select("page_id", F.col("image_count").cast("int").alias("images"), F.col("missing_alt").cast("int").alias("missing_alt"), F.array_join(F.col("missing_alt_sample").cast("array<string>"), "|").alias("ordinals"))


@query("select page_id, len(regexp_extract_all(html, '<script[ >]')) + case when page_id % 4 = 0 then 2 else 1 end + case when page_id % 3 = 1 then 1 else 0 end as scripts, cast(case when page_id % 3 = 0 then 2 else 1 end as int) as stylesheets from pages")
def o050_asset_counts(spark, sf_dir):
    return signalled(spark, sf_dir).select("page_id", F.col("script_count").cast("long").alias("scripts"), F.col("stylesheet_count").cast("int").alias("stylesheets"))
