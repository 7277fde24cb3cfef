"""Queries over the functions on URLs, responses and candidates, each applied to a whole table.

What the tables lack is a function of their ids, the same in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import html, rules, urls
from webstrata.operators import selection
from webstrata.plans.catalog import URL_SQL, fetches, query

ORIGIN = r"^[a-z]+://[^/?#]+"
STATUS_SQL = "case page_id % 17 when 0 then 404 when 1 then 503 when 2 then 301 else 200 end"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# --- URLs ------------------------------------------------------------------------------------------------------------


@query(f"select page_id, concat(regexp_extract(url, '{ORIGIN}'), '/a?a=1&b=2') as resolved from pages")
def o009_resolve_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.resolve_url(F.col("url"), F.lit("/x/../a?b=2&a=1#f")).alias("resolved"))


@query("select page_id, sha256(url) as url_hash from pages")
def o010_url_hash(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


@query("select page_id, page_id % 2 = 0 as in_scope from pages")
def o011_is_in_scope(spark, sf_dir):
    """The own host in capitals is in scope, its parent's scope does not hold a subdomain."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)
    scope = F.when(F.col("page_id") % 2 == 0, F.upper(host)).otherwise(F.regexp_replace(host, r"^[^.]+\.", ""))
    return pages(spark, sf_dir).select("page_id", urls.is_in_scope(F.col("url"), scope).alias("in_scope"))


@query("select page_id, page_id % 3 = 0 as http from pages")
def o012_is_http_url(spark, sf_dir):
    k, u = F.col("page_id") % 3, F.col("url")
    raw = F.when(k == 0, u).when(k == 1, F.regexp_replace(u, "://", "://user@")).otherwise(F.regexp_replace(u, "^https?", "ftp"))
    return pages(spark, sf_dir).select("page_id", urls.is_http_url(raw).alias("http"))


@query("select page_id, page_id % 6 <> 5 as non_http from pages")
def o013_is_non_http_ref(spark, sf_dir):
    k = F.col("page_id") % 6
    ref = F.when(k == 0, "#top").when(k == 1, "MailTo:a@b").when(k == 2, "tel:1").when(k == 3, "JAVASCRIPT:x").when(k == 4, "data:,x").otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", urls.is_non_http_ref(ref).alias("non_http"))


@query(URL_SQL + "select page_id, site as canonical_url from w")
def o014_canonicalize_site(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.canonicalize_site(F.col("url")).alias("canonical_url"))


@query(URL_SQL + "select page_id, redacted from w")
def o016_redact_url(spark, sf_dir):
    raw = F.concat("url", F.when(F.col("url").contains("#"), "").otherwise("#f"))
    return pages(spark, sf_dir).select("page_id", urls.redact_url(raw).alias("redacted"))


@query(URL_SQL + "select page_id, design as design_url from w")
def o017_normalize_design_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.normalize_design_url(F.col("url")).alias("design_url"))


@query(URL_SQL + "select page_id, route_hash from w")
def o018_route_hash(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.route_hash(F.col("url")).alias("route_hash"))


@query(URL_SQL + "select page_id, case when page_id % 2 = 0 or path in ('', '/') or path like '%/' or contains(split_part(path, '/', -1), '.') then local_path else regexp_replace(local_path, '[.]html$', '.css') end as local_path from w")
def o019_url_to_local_path(spark, sf_dir):
    mime = F.when(F.col("page_id") % 2 == 0, "text/html").otherwise("text/css")
    return pages(spark, sf_dir).select("page_id", urls.url_to_local_path(F.col("url"), mime).alias("local_path"))


@query(URL_SQL + "select page_id, page_id % 4 <> 0 as path_ok, concat('../../', local_path) as relative from w")
def o020_archive_paths(spark, sf_dir):
    path = urls.url_to_local_path(F.col("url"), F.lit("text/html"))
    tried = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("../"), path)).otherwise(path)
    return pages(spark, sf_dir).select("page_id", urls.is_archive_path(tried).alias("path_ok"), urls.relative_path(F.lit("pages/a/index.html"), path).alias("relative"))


# --- responses -------------------------------------------------------------------------------------------------------


@query(f"""select page_id, case when {STATUS_SQL} <> 200 then 'HTTP_STATUS_NOT_INDEXABLE' when page_id % 29 = 0 and page_id % 5 = 0 then 'META_AND_X_ROBOTS_NOINDEX' when page_id % 29 = 0 then 'X_ROBOTS_TAG_NOINDEX'
  when page_id % 5 = 0 then 'META_ROBOTS_NOINDEX' else 'INDEXABLE' end as reason from pages""")
def o025_indexability(spark, sf_dir):
    meta = F.when(F.col("page_no") % 5 == 0, "NOINDEX, follow").otherwise("index")
    return fetches(spark, sf_dir).select(F.col("page_no").alias("page_id"), rules.indexability(F.col("status_code"), meta, F.col("x_robots_tag")).alias("reason"))


@query("select event_id, event_id % 5 <> 4 and event_id % 5 <> 3 as is_html from events")
def o027_is_html(spark, sf_dir):
    k = F.col("event_id") % 5
    mime = F.when(k == 0, "TEXT/html; charset=utf-8").when(k == 1, "application/xhtml+xml").when(k == 2, "").when(k == 3, "text/plain").otherwise("image/png")
    return events(spark, sf_dir).select("event_id", rules.is_html(mime).alias("is_html"))


@query("select event_id, case when event_id % 3 = 0 then value when event_id % 3 = 1 then 0.0 end as ms from events")
def o030_observed_timing(spark, sf_dir):
    """Zero that was measured stays; what was not observed, or not said to be, is null."""
    k = F.col("event_id") % 3
    observed = F.when(k < 2, True).when(F.col("event_id") % 2 == 0, False)
    return events(spark, sf_dir).select("event_id", rules.observed_timing(observed, F.when(k == 0, F.col("value")).otherwise(F.lit(0.0))).alias("ms"))


@query(f"""select page_id, case when page_id % 37 = 0 then 'SKIPPED' when page_id % 41 = 0 or page_id % 31 = 0 or {STATUS_SQL} >= 400 then 'FAILED' else 'SUCCEEDED' end as status from pages""")
def o033_terminal_status(spark, sf_dir):
    rows = fetches(spark, sf_dir).withColumn("f", rules.fetch_outcome(F.col("error_code"), F.col("body_truncated"), F.col("status_code")))
    return rows.select(F.col("page_no").alias("page_id"), rules.terminal_status(F.col("f.outcome"), F.col("f.error_code"), F.col("status_code")).alias("status"))


@query("select event_id, event_id % 6 in (0, 1) as visual from events")
def o038_is_external_visual(spark, sf_dir):
    k = F.col("event_id") % 6
    url = F.when(k == 2, "http://cdn.example/x").when(k == 3, "https://u@cdn.example/x").otherwise("HTTPS://cdn.example/x")
    kind = F.when(k == 1, "image").otherwise("stylesheet")
    mime = F.when(k == 1, "image/png").when(k == 4, "text/plain").when(k == 5, F.lit(None)).otherwise(" Text/CSS ; charset=utf-8")
    return events(spark, sf_dir).select("event_id", rules.is_external_visual(url, kind, mime).alias("visual"))


# --- page selection --------------------------------------------------------------------------------------------------


@query(f"""select page_id, case {STATUS_SQL} when 404 then 'ERROR_4XX' when 503 then 'ERROR_5XX' else 'MARKETING_LANDING' end as role, split_part(url, '/', 4) as locale,
  case {STATUS_SQL} when 404 then '/{{error-4xx}}' when 503 then '/{{error-5xx}}' else concat('/', split_part(url, '/', 4), '/', case when regexp_matches(url, '^[a-z]+://[^/]+/[a-z]+/[0-9]+([/?#]|$)') then '{{id}}' else lower(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([^/?#]*)', 1)) end) end as template from pages""")
def o035_route_template(spark, sf_dir):
    url, locale = F.col("url"), F.coalesce(selection.path_locale(F.col("url")), F.lit("und"))
    role = rules.semantic_role(url, F.col("status_code"), F.array().cast("array<string>"))
    p = fetches(spark, sf_dir).withColumnRenamed("final_url", "url")
    return p.select(F.col("page_no").alias("page_id"), role.alias("role"), locale.alias("locale"), rules.route_template(url, role, locale).alias("template"))


@query("select page_id, case page_id % 6 when 0 then split_part(url, '/', 4) when 1 then 'pt-br' when 2 then 'fil' when 3 then 'es-419' when 4 then 'und' else 'vi' end as locale from pages")
def o036_page_locale(spark, sf_dir):
    """By path, language of the page, canonical of the same origin, hreflang that names the page itself, or none."""
    k, origin = F.col("page_id") % 6, F.regexp_extract("url", ORIGIN, 0)
    own = F.when(k == 0, F.col("url")).otherwise(F.concat(origin, F.lit("/app/"), F.col("page_id").cast("string")))
    canonical = F.when(k == 2, F.concat(origin, F.lit("/FIL/x"))).when(k == 3, "https://other.example/de/x").when(k == 5, F.concat(origin, F.lit("/en/x"))).otherwise("")
    entry = lambda language, url: F.struct(F.lit(language).alias("language"), url.alias("url"))
    hreflang = F.when(k.isin(3, 5), F.array(entry("x-default", own), entry("de", F.concat(origin, F.lit("/y"))), entry("es_419", F.concat(own, F.lit("?q=1"))))).otherwise(F.array().cast("array<struct<language:string,url:string>>"))
    lang = F.when(k == 1, " PT_br").when(k == 4, "app").when(k == 5, "vi").otherwise("")
    p = pages(spark, sf_dir).select("page_id", own.alias("url"), F.lit("").alias("final_url"), canonical.alias("canonical_url"), lang.alias("html_lang"), hreflang.alias("hreflang"))
    return selection.page_locale(selection.design_urls(p)).select("page_id", F.col("page_locale").alias("locale"))


CANDIDATES = f"""select page_id as id, split_part(split_part(url, '://', 2), '/', 1) as host, url, url like '%?%' as had_query, page_id % 3 = 0 as self,
  case {STATUS_SQL} when 200 then 0 when 301 then 1 when 404 then 2 else 3 end as status_rank, page_id % 50 as identity, page_id % 4 as role from pages"""
FIRST = "had_query, not self, status_rank, length(url), url, cast(id as string)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = fetches(spark, sf_dir), F.col("page_no")
    return p.select(
        F.lit("s").alias("scan_id"), (k % 50).alias("identity"), (k % 4).alias("role"), F.lit("/t").alias("template"), (k % 7).alias("hint"), F.col("final_url").contains("?").alias("had_query"),
        (k % 3 == 0).alias("canonical_self"), "status_code", F.col("final_url").alias("normalized_url"), k.cast("string").alias("id"),
    )


@query(f"select id as page_id, row_number() over (partition by identity order by {FIRST}) = 1 as wins from ({CANDIDATES})")
def o094_canonical_winners(spark, sf_dir):
    return selection.canonical_winners(candidates(spark, sf_dir)).select(F.col("id").cast("long").alias("page_id"), "wins")


@query(f"select id as page_id, row_number() over (partition by role, id % 7 order by {FIRST}) = 1 as wins from ({CANDIDATES})")
def o095_template_winners(spark, sf_dir):
    return selection.template_winners(candidates(spark, sf_dir)).select(F.col("id").cast("long").alias("page_id"), "wins")


# --- references ------------------------------------------------------------------------------------------------------


def planted(spark: SparkSession, sf_dir: str, what: Column) -> DataFrame:
    """The pages with more at the start of their bodies."""
    return pages(spark, sf_dir).withColumn("html", F.replace(F.coalesce("html", F.lit("<body></body>")), F.lit("<body>"), F.concat(F.lit("<body>"), what)))


def found(html_: Column, pattern: str) -> Column:
    """All first groups of a pattern, one after the other."""
    return F.array_join(F.regexp_extract_all(html_, F.lit(pattern), F.lit(1)), " ")


@query(f"""select page_id, concat('assets/x.html', regexp_extract(url, '#.*$'), ' ', regexp_extract(url, '{ORIGIN}'), '/i.png?k=%5BREDACTED%5D data:,x') as sources, concat('assets/x.html', regexp_extract(url, '#.*$'), ' 1x, ', regexp_extract(url, '{ORIGIN}'), '/j.png 2x') as sets,
  '' as typed, len(regexp_extract_all(html, '<a href=')) as links from pages""")
def o056_rewritten_references(spark, sf_dir):
    """References of planted images: to an archived file, to another, and none; what a visitor typed is gone, links stay."""
    n = F.col("page_id").cast("string")
    more = F.concat(F.lit('<img src="'), "url", F.lit('"><img src="/i.png?k='), n, F.lit('#f"><img src="data:,x"><img srcset="'), "url", F.lit(' 1x, /j.png 2x"><input value="'), n, F.lit('"><textarea>'), n, F.lit("</textarea>"))
    out = html.rewrite_references(F.col("html"), F.col("url"), F.create_map("url", F.lit("assets/x.html")))
    p = planted(spark, sf_dir, more).select("page_id", out.alias("html"))
    typed = F.concat(found(F.col("html"), '<input value="([^"]*)"'), found(F.col("html"), "<textarea>([^<]*)<"))
    links = F.size(F.regexp_extract_all("html", F.lit("<a (href)="), F.lit(1))).cast("long")
    return p.select("page_id", found(F.col("html"), '<img src="([^"]*)"').alias("sources"), found(F.col("html"), '<img srcset="([^"]*)"').alias("sets"), typed.alias("typed"), links.alias("links"))


@query(f"""select page_id, concat(case when page_id % 3 = 0 then 'index.html#a' else concat(regexp_extract(url, '{ORIGIN}'), '/other?q=%5BREDACTED%5D#a') end, ' mailto:x') as links from pages""")
def o055_rewritten_navigation(spark, sf_dir):
    """Links of planted anchors: to an archived page or to another one, with their fragments, and one that stays as it is."""
    target = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "#.*$", "")).otherwise("/other?q=1")
    more = F.concat(F.lit('<a class="x" href="'), target, F.lit('#a"></a><a class="x" href="mailto:x"></a>'))
    routes = F.create_map(urls.route_hash(F.col("url")), F.lit("pages/index.html"))
    p = planted(spark, sf_dir, more).select("page_id", html.rewrite_navigation(F.col("html"), F.col("url"), F.lit("pages/x.html"), routes).alias("html"))
    return p.select("page_id", found(F.col("html"), '<a class="x" href="([^"]*)"').alias("links"))


@query("""select page_id, concat('application/x-inert-script', repeat(' application/ld+json', page_id % 3)) as types, 1 as policies, 0 as handlers, case when page_id % 2 = 0 then 'stylesheet' else '' end as rels from pages""")
def o057_neutralized(spark, sf_dir):
    """Scripts are inert but for JSON, event handlers, refreshes and script preloads are gone, one policy is there."""
    k = F.col("page_id")
    json_ = F.array_join(F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.when(i > 0, '<script type="application/ld+json">{}</script>').otherwise("")), "")
    link = F.when(k % 2 == 0, '<link rel="stylesheet" href="/a.css">').otherwise('<link rel="preload" as="script" href="/a.js">')
    more = F.concat(json_, F.lit('<p onclick="x()">a</p><meta http-equiv="refresh" content="1">'), link)
    p = planted(spark, sf_dir, more).select("page_id", html.neutralize_html(F.col("html")).alias("html"))
    count = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).cast("int")
    return p.select(
        "page_id", found(F.col("html"), '<script type="([^"]*)"').alias("types"), count('http-equiv="(Content-Security-Policy|refresh)"').alias("policies"), count("<[^>]* (onclick)=").alias("handlers"), found(F.col("html"), '<link rel="([^"]*)"').alias("rels")
    )


@query()
def o056_rewrite_references(spark, sf_dir):
    paths = F.create_map("url", F.lit("assets/x.html"))
    return pages(spark, sf_dir).select("page_id", F.sha2(html.rewrite_references(F.col("html"), F.col("url"), paths), 256).alias("html_sha256"))


@query(f"""select page_id, concat('@import "assets/base.css"; a {{ background: url("', regexp_extract(url, '{ORIGIN}'), '/css/i.png?k=%5BREDACTED%5D") }}') as css from pages""")
def o058_rewrite_css(spark, sf_dir):
    origin = F.regexp_extract("url", ORIGIN, 0)
    css = F.concat(F.lit("@import \"/base.css\"; a { background: url('i.png?k="), F.col("page_id").cast("string"), F.lit("') }"))
    paths = F.create_map(F.concat(origin, F.lit("/base.css")), F.lit("assets/base.css"))
    return pages(spark, sf_dir).select("page_id", html.rewrite_css(css, F.concat(origin, F.lit("/css/a.css")), paths).alias("css"))
