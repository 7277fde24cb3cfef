"""All queries of the reference's operators by name, and the DuckDB SQL they are compared with.

A query's name starts with its operator's id in the inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import html, rules, urls
from webstrata.operators import archive, capture, links, pages, selection, workflow
from webstrata.plans import jobs
from webstrata.plans.shapes import page_metrics, shape, with_shapes

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
SINCE = "timestamp_ntz'1998-01-01 00:00:00'"
ISSUE_SQL = "upper(severity) in ('ERROR', 'CRITICAL', 'WARNING', 'WARN')"


def query(sql: str | None = None, *, shapes: tuple[str, ...] = (), extra: str | None = None) -> Callable[[Query], Query]:
    """Registers a query. sql: its oracle, after the shapes as common table expressions; extra: the same, beginning with more of them."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql or extra:
            _oracles[f.__name__] = (with_shapes(*shapes).rstrip() if shapes else "") + (extra or f" {sql}")
        return f

    return add


def queries() -> dict[str, Query]:
    from webstrata.plans import scalars, signals, staged  # noqa: F401  these register their queries

    return dict(sorted(_queries.items()))


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracles)


def uuid5_sql(space: str, name: str) -> str:
    """The name-based UUID in SQL: of a namespace (a UUID string) and a name."""
    digest = f"sha1(unhex(replace({space}, '-', '')) || encode({name}))"
    variant = "substr('89ab', cast(ceil(position(substr(d, 17, 1) in '048c159d26ae37bf') / 4.0) as int), 1)"
    return f"(select concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), '5' || substr(d, 14, 3), {variant} || substr(d, 18, 3), substr(d, 21, 12)) from (select {digest} as d))"


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


#: The parts of the given URLs, and the forms made of them, in SQL.
URL_SQL = """with u as (select page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') as origin, split_part(split_part(url, '://', 2), '/', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path,
  [x for x in string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') if x <> ''] as params from pages),
  v as (select *, coalesce(nullif(path, ''), '/') as whole, coalesce(nullif(rtrim(path, '/'), ''), '/') as plain, list_sort([x for x in params if not regexp_matches(x, '^(utm_(source|medium|campaign|term|content)|fbclid|gclid|mc_cid|mc_eid)=')]) as kept,
   list_sort([x for x in params if not regexp_matches(x, '^(utm_[^=]+|ref|from|gclid|fbclid)=')]) as design_kept, list_distinct([concat(split_part(x, '=', 1), '=%5BREDACTED%5D') for x in params]) as hidden from u),
  w as (select *, concat(origin, whole, case when len(kept) > 0 then concat('?', array_to_string(kept, '&')) else '' end) as normalized,
   concat(origin, plain, case when len(design_kept) > 0 then concat('?', array_to_string(design_kept, '&')) else '' end) as design,
   concat(origin, whole, case when len(hidden) > 0 then concat('?', array_to_string([concat(split_part(x, '=', 1), '=%5BREDACTED%5D') for x in params], '&')) else '' end) as redacted,
   case when contains(url, '#') then null else concat(origin, whole, case when len(params) > 0 then concat('?', array_to_string(params, '&')) else '' end) end as site,
   sha256(concat(origin, plain, case when len(params) > 0 then concat('?', array_to_string(params, '&')) else '' end)) as route_hash,
   concat(host, lower(path), case when path = '' then '/index.html' when path like '%/' then 'index.html' when contains(split_part(path, '/', -1), '.') then '' else '.html' end) as local_path,
   concat(origin, regexp_replace(case when path like '%/' then path else regexp_replace(path, '[^/]*$', '') end, '[^/]*/$', ''), 'up?a=2&b=1') as resolved from v) """


# --- stored pages ----------------------------------------------------------------------------------------------------


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as stored responses; what it lacks is a function of page_id."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.col("page_id") % 17
    status = F.when(k == 0, 404).when(k == 1, 503).when(k == 2, 301).otherwise(200)
    ident = F.sha2(F.concat(F.lit("page"), F.col("page_id").cast("string")), 256)
    uuid = F.concat_ws("-", *(F.substring(ident, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    hop = lambda n: F.struct(F.concat(F.lit(f"https://hop{n}.example/"), F.col("page_id").cast("string")).alias("url"), F.lit(302).alias("status_code"))
    none = F.array().cast("array<struct<url:string,status_code:int>>")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)
    return p.select(
        uuid.alias("page_id"), F.col("page_id").alias("page_no"), (F.col("page_id") % 10).cast("string").alias("owner_id"), host.alias("scan_id"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"),
        host.alias("scope_host"), status.alias("status_code"), F.lit("text/html; charset=utf-8").alias("content_type"), F.when(F.col("page_id") % 29 == 0, "noindex").otherwise("").alias("x_robots_tag"),
        F.col("html").alias("body"), F.coalesce(F.col("page_id") % 31 == 0, F.lit(False)).alias("body_truncated"),
        F.when(F.col("page_id") % 37 == 0, "ssrf_blocked").when(F.col("page_id") % 41 == 0, "timeout").otherwise("").alias("error_code"),
        F.when(F.col("page_id") % 13 == 0, F.array(hop(1), hop(2))).otherwise(none).alias("redirects"),
    )


#: The same classification in SQL, for the queries below.
CLASSES = """with f as (select page_id as page_no, cast(page_id % 10 as string) as owner_id, split_part(split_part(url, '://', 2), '/', 1) as scan_id, html,
  case page_id % 17 when 0 then 404 when 1 then 503 when 2 then 301 else 200 end as status_code, page_id % 31 = 0 as cut, page_id % 29 = 0 as header_noindex,
  case when page_id % 37 = 0 then 'ssrf_blocked' when page_id % 41 = 0 then 'timeout' else '' end as error from pages),
  c as (select *, case when error = 'ssrf_blocked' then 'SKIPPED' when error <> '' or cut then 'FAILED' when status_code >= 400 then 'HTTP_ERROR' else 'SUCCESS' end as outcome from f),
  p as (select *, outcome in ('SUCCESS', 'HTTP_ERROR') as parsed, case when outcome in ('SUCCESS', 'HTTP_ERROR') then html else '' end as body from c) """


@query(CLASSES + """
select page_no, outcome as fetch_outcome, case when cut and error = '' then 'BODY_TRUNCATED' else error end as error_code, status_code,
  case when not parsed then '' when status_code not between 200 and 299 then 'HTTP_STATUS_NOT_INDEXABLE' when header_noindex then 'X_ROBOTS_TAG_NOINDEX' else 'INDEXABLE' end as indexability_reason from p""")
def o022_fetch_outcome(spark, sf_dir):
    rows = fetches(spark, sf_dir)
    o = rules.fetch_outcome(F.col("error_code"), F.col("body_truncated"), F.col("status_code"))
    rows = rows.withColumn("o", o)
    reason = rules.indexability(F.col("status_code"), F.lit(""), F.col("x_robots_tag"))
    return rows.select("page_no", F.col("o.outcome").alias("fetch_outcome"), F.col("o.error_code").alias("error_code"), "status_code", F.when(F.col("o.parse"), reason).otherwise("").alias("indexability_reason"))


@query("""
select page_id as page_no, replace(replace(replace(replace(replace(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') as title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) as html_lang, len(regexp_extract_all(html, '<h1[ >]')) as h1_count, len(regexp_extract_all(html, '<script[ >]')) as script_count,
  len(regexp_extract_all(html, '<a href=')) as link_count, 0 as image_count from pages""")
def o041_page_facts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("scope_host", F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    facts = html.parse_pages(p, keep=["page_id"])
    return facts.select(F.col("page_id").alias("page_no"), "title", "html_lang", F.size("h1").cast("long").alias("h1_count"), *long("script_count"), F.size("links").cast("long").alias("link_count"), F.col("image_count").alias("image_count"))


@query()
def o117_build_page_facts(spark, sf_dir):
    facts = jobs.build_page_facts(fetches(spark, sf_dir))
    return facts.select(
        "page_no", "page_id", "fetch_outcome", "indexability_reason", "title", "word_count", "canonical_relation", "layout_fingerprint", "internal_links", "external_links",
        F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("finding_codes"), F.array_join("h1", "\n").alias("h1"),
    )


@query(CLASSES + """, k as (select *, case when error = 'ssrf_blocked' then ['FETCH_BLOCKED_BY_POLICY'] when error <> '' then ['FETCH_FAILED'] when cut then ['BODY_TRUNCATED'] else
    list_concat(list_concat(case when status_code >= 400 then ['HTTP_ERROR'] else [] end, case when status_code between 300 and 399 then ['HTTP_REDIRECT_RESPONSE'] else [] end),
    list_concat(case when page_no % 13 = 0 then ['REDIRECT_CHAIN'] else [] end, case when status_code between 200 and 299 then ['META_DESCRIPTION_MISSING'] else [] end)) end as codes from p),
  n as (select owner_id, scan_id, page_no, status_code, outcome, len(codes) as finding_count, len([x for x in codes if x not in ('FETCH_BLOCKED_BY_POLICY', 'META_DESCRIPTION_MISSING')]) as issue_count from k)
select owner_id, scan_id, count(*) as total_urls, count(*) filter (lower(outcome) not in ('success', 'skipped') or status_code >= 400 or issue_count > 0) as issue_pages, cast(sum(finding_count) as bigint) as finding_count,
  count(*) filter (status_code between 200 and 299) as status_2xx, count(*) filter (status_code between 300 and 399) as status_3xx, count(*) filter (status_code between 400 and 499) as status_4xx,
  count(*) filter (status_code between 500 and 599) as status_5xx, count(*) filter (status_code < 200 or status_code >= 600) as no_response from n group by 1, 2""")
def o078_scan_summary(spark, sf_dir):
    """Flagship: stored pages, parsed, classified, with findings, summed up per scan."""
    facts = jobs.build_page_facts(fetches(spark, sf_dir)).select("owner_id", "scan_id", "page_id", "fetch_outcome", "status_code", "findings")
    summary = pages.scan_summary(facts)
    return summary.select("owner_id", "scan_id", *long("total_urls", "issue_pages", "finding_count", "status_2xx", "status_3xx", "status_4xx", "status_5xx", "no_response"))


#: Page identifiers of the stored responses, and hrefs as URLs write them, in SQL.
PAGE_UUID = "(select concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), substr(d, 13, 4), substr(d, 17, 4), substr(d, 21, 12)) from (select sha256(concat('page', page_no)) as d))"
DECODED = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


@query(CLASSES + f""", l as (select scan_id, {PAGE_UUID} as source_page_id, unnest(regexp_extract_all(body, '<a href="([^"]*)">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(body, '<a href="[^"]*">([^<]*)</a>', 1)) as said,
    unnest(range(len(regexp_extract_all(body, '<a href="[^"]*">[^<]*</a>')))) as ordinal, regexp_extract(body, '^', 0) as none, page_no from p),
  t as (select l.*, concat(regexp_extract(pages.url, '^[a-z]+://[^/?#]+'), array_to_string([case when ascii(c) > 127 then url_encode(c) else c end for c in string_split({DECODED.format('href')}, '')], '')) as target_url from l join pages on pages.page_id = l.page_no)
select scan_id, source_page_id, {uuid5_sql('source_page_id', "concat(ordinal, ':', target_url)")} as edge_id, target_url, sha256(target_url) as target_hash, trim({DECODED.format('said')}) as anchor_text, 'a' as tag, true as is_internal, true as is_followable,
  cast(ordinal as int) as ordinal from t""")
def o051_page_links(spark, sf_dir):
    return jobs.links_of(jobs.build_page_facts(fetches(spark, sf_dir))).drop("owner_id")


@query(CLASSES + f"""select page_no, {PAGE_UUID} as page_id, outcome as fetch_outcome, case when not parsed then '' when status_code not between 200 and 299 then 'HTTP_STATUS_NOT_INDEXABLE' when header_noindex then 'X_ROBOTS_TAG_NOINDEX' else 'INDEXABLE' end as indexability_reason,
  trim({DECODED.format("regexp_extract(body, '(?s)<title>(.*?)</title>', 1)")}) as title, trim({DECODED.format("regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)")}) as h1,
  len(regexp_extract_all(regexp_replace(regexp_replace(split_part(split_part(body, '<body>', 2), '</body>', 1), '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '&#?[A-Za-z0-9]+;', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')) as word_count,
  'MISSING' as canonical_relation, len(regexp_extract_all(body, '<a href=')) as internal_links, cast(0 as bigint) as external_links from p""")
def o117_page_facts(spark, sf_dir):
    """The facts of the next query that SQL can read from the given pages."""
    facts = jobs.build_page_facts(fetches(spark, sf_dir))
    return facts.select("page_no", "page_id", "fetch_outcome", "indexability_reason", "title", F.array_join("h1", "\n").alias("h1"), "canonical_relation", *long("word_count", "internal_links", "external_links"))


@query(CLASSES + f""", k as (select owner_id, scan_id, page_no, error, status_code, unnest(case when error = 'ssrf_blocked' then ['FETCH_BLOCKED_BY_POLICY|fetch.policy-blocked|1|TECHNICAL|INFO'] when error <> '' then ['FETCH_FAILED|fetch.failed|1|TECHNICAL|ERROR'] when cut then ['BODY_TRUNCATED|fetch.body-truncated|1|TECHNICAL|WARNING'] else
    list_concat(list_concat(case when status_code >= 400 then ['HTTP_ERROR|http.error|1|TECHNICAL|ERROR'] else [] end, case when status_code between 300 and 399 then ['HTTP_REDIRECT_RESPONSE|http.redirect-response|1|TECHNICAL|WARNING'] else [] end),
    list_concat(case when page_no % 13 = 0 then ['REDIRECT_CHAIN|redirect.chain|1|SEO|WARNING'] else [] end, case when status_code between 200 and 299 then ['META_DESCRIPTION_MISSING|meta-description.missing|2|CONTENT|INFO'] else [] end)) end) as f from p),
  i as (select owner_id, scan_id, {PAGE_UUID} as page_id, split_part(f, '|', 1) as finding_code, split_part(f, '|', 2) as rule_id, cast(split_part(f, '|', 3) as int) as rule_version, split_part(f, '|', 4) as category, split_part(f, '|', 5) as severity from k)
select *, {uuid5_sql('page_id', "concat(rule_id, ':', rule_version)")} as finding_id from i""")
def o023_page_findings(spark, sf_dir):
    """The findings of all pages, a row each."""
    return jobs.findings_of(jobs.build_page_facts(fetches(spark, sf_dir))).drop("evidence_json")


@query(URL_SQL + "select page_id, normalized, sha256(normalized) as url_hash, design, redacted, site, route_hash, local_path, resolved from w")
def o008_normalize_url(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = F.col("url")
    return p.select(
        "page_id", urls.normalize_url(u).alias("normalized"), urls.url_hash(urls.normalize_url(u)).alias("url_hash"), urls.normalize_design_url(u).alias("design"), urls.redact_url(u).alias("redacted"),
        urls.canonicalize_site(u).alias("site"), urls.route_hash(u).alias("route_hash"), urls.url_to_local_path(u, F.lit("text/html")).alias("local_path"), urls.resolve_url(u, F.lit("../up?b=1&a=2#x")).alias("resolved"),
    )


@query("""select page_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') as path, sha256(url) as url_hash,
  regexp_matches(url, '^https?://[^/?#@\\s:]+(:[0-9]*)?([/?#]|$)') as is_http, split_part(split_part(url, '://', 2), '/', 1) = 'tionsh.example.net' as in_scope from pages""")
def o021_url_path(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = F.col("url")
    return p.select("page_id", urls.url_path(u).alias("path"), urls.url_hash(u).alias("url_hash"), urls.is_http_url(u).alias("is_http"), urls.in_scope_of(u, F.lit("Tionsh.example.net")).alias("in_scope"))


#: Paths that page ids give to pages, each with its role and template; the 11th kind keeps its own.
ROLES = (
    ("/en", "HOME", "/en"), ("/en/pricing", "PRICING", "/en/pricing"), ("/en/Blog", "BLOG_INDEX", "/en/blog"), ("/en/blog/Post-x", "BLOG_DETAIL", "/en/blog/{slug}"), ("/log-in", "AUTH_LOGIN", "/log-in"),
    ("/a/vs/b", "COMPARISON_DETAIL", "/a/vs/{slug}"), ("/products/12", "PRODUCT_DETAIL", "/products/{id}"), ("/en/about", "MARKETING_LANDING", "/en/about"), ("/a/b/c", "UNKNOWN", "/a/b/c"), ("/tin-tuc/", "BLOG_INDEX", "/tin-tuc"),
)


def by_case(n: int) -> str:
    return " ".join(f"when {k} then '{r[n]}'" for k, r in enumerate(ROLES))


@query(f"""select page_id, case when page_id % 13 = 12 then 'ERROR_4XX' else case page_id % 11 {by_case(1)} else 'MARKETING_LANDING' end end as role,
  case when page_id % 13 = 12 then '/{{error-4xx}}' else case page_id % 11 {by_case(2)} else concat('/', split_part(url, '/', 4), '/', case when regexp_matches(url, '^[a-z]+://[^/]+/[a-z]+/[0-9]+([/?#]|$)') then '{{id}}' else lower(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([^/?#]*)', 1)) end) end end as template from pages""")
def o034_semantic_role(spark, sf_dir):
    p, k = spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("page_id")
    url = F.col("url")
    for n, (path, _, _) in enumerate(ROLES):
        url = F.when(k % 11 == n, F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), F.lit(path))).otherwise(url)
    p = p.withColumn("url", url)
    role = rules.semantic_role(F.col("url"), F.when(k % 13 == 12, 410).otherwise(200), F.array().cast("array<string>"))
    return p.select("page_id", role.alias("role"), rules.route_template(F.col("url"), role, F.lit("en")).alias("template"))


@query(f"""select page_id, trim({DECODED.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) as title, trim({DECODED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) as h1,
  cast(len(regexp_extract_all(regexp_replace(regexp_replace(split_part(split_part(html, '<body>', 2), '</body>', 1), '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '&#?[A-Za-z0-9]+;', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')) as int) as word_count,
  cast(len(regexp_extract_all(html, '<a href=')) as int) as link_count, cast(0 as int) as image_count from pages""")
def o053_rendered_metadata(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html.rendered_metadata(p, keep=["page_id"]).select("page_id", "title", "word_count", "link_count", "image_count", F.array_join("h1", "\n").alias("h1"))


@query()
def o057_neutralize_html(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("html", F.coalesce("html", F.lit("")))
    known = F.create_map(F.lit("https://cdn.example/a.css"), F.lit("assets/a.css"))
    safe = html.rewrite_references(html.neutralize_html(F.col("html")), F.col("url"), known)
    return p.select("page_id", F.sha2(safe, 256).alias("html_sha256"), F.length(safe).alias("n_chars"))


#: The choice of pages for a design clone, in SQL.
CHOSEN = URL_SQL.rstrip() + f""", c as (select host as scan_id, {PAGE_UUID} as id, regexp_replace(url, '^http:', 'https:') as raw_url, regexp_replace(design, '^http:', 'https:') as normalized_url, split_part(path, '/', 2) as locale, status_code,
    contains(url, '?') as had_query, case when page_no % 37 = 0 then 'ROBOTS_OR_POLICY_BLOCKED' when page_no % 41 = 0 and status_code not between 400 and 599 then 'HTTP_FAILURE' end as reason,
    case status_code when 404 then 'ERROR_4XX' when 503 then 'ERROR_5XX' else 'MARKETING_LANDING' end as role, case status_code when 404 then '/{{error-4xx}}' when 503 then '/{{error-5xx}}'
     else concat('/', split_part(path, '/', 2), '/', case when regexp_matches(rtrim(path, '/'), '/[0-9]+$') then '{{id}}' else lower(split_part(rtrim(path, '/'), '/', 3)) end) end as template
    from (select *, page_id as page_no, case page_id % 17 when 0 then 404 when 1 then 503 when 2 then 301 else 200 end as status_code from w)),
  d as (select *, row_number() over (partition by scan_id, split_part(normalized_url, '?', 1) order by had_query, status_code // 100, length(normalized_url), normalized_url, id) as first from c where reason is null),
  t as (select *, row_number() over (partition by scan_id, role, template, status_code // 100 order by had_query, status_code // 100, length(normalized_url), normalized_url, id) as best from d where first = 1),
  r as (select scan_id, id, raw_url, normalized_url, locale, role, template, reason as verdict from c where reason is not null union all select scan_id, id, raw_url, normalized_url, locale, role, template, 'TRACKING_OR_QUERY_VARIANT' from d where first > 1
    union all select scan_id, id, raw_url, normalized_url, locale, role, template, case when best = 1 then 'SELECTED' else 'SEMANTIC_TEMPLATE_DUPLICATE' end from t),
  chosen as (select scan_id, id, raw_url, normalized_url, locale, role, template, case when count(*) over (partition by scan_id) > 1 and row_number() over (partition by scan_id order by raw_url desc, id desc) = 1 then 'BUDGET_LIMITED' else verdict end as verdict from r) """


@query(CHOSEN + "select * from chosen")
def o118_select_design_pages(spark, sf_dir):
    rows = fetches(spark, sf_dir)
    empty = F.array().cast("array<string>")
    shaped = rows.select(
        "scan_id", F.concat(F.lit("https://"), "scan_id", F.lit("/")).alias("root_url"), F.lit(True).alias("budget_limited"), F.col("page_id").alias("id"), F.regexp_replace("final_url", "^http:", "https:").alias("url"), F.lit("").alias("final_url"),
        F.when(F.col("error_code") == "ssrf_blocked", "warning").when(F.col("error_code") != "", "failed").otherwise("success").alias("outcome"), "status_code", "content_type", F.lit("").alias("canonical_url"),
        F.lit("").alias("html_lang"), F.array().cast("array<struct<language:string,url:string>>").alias("hreflang"), empty.alias("h1"), empty.alias("h2"), empty.alias("schema_org_types"), F.lit(1).alias("scripts"), F.lit(0).alias("stylesheets"),
    )
    return selection.select_design_pages(shaped)


# --- facts and reports -----------------------------------------------------------------------------------------------


@query("""select owner_id, scan_id, page_id, title, record_version from page_versions where record_version = 3 and not is_deleted group by all""", shapes=("page_versions",))
def o092_current_view(spark, sf_dir):
    rows = page_metrics(spark, sf_dir, "page_versions").select("owner_id", "scan_id", "page_id", "title", "record_version", "is_deleted")
    return pages.current_view(rows, pages.PAGE).drop("is_deleted")


@query(f"""select page_id, normalized_url, status_code from page_metrics p where (upper(fetch_outcome) = 'SUCCESS' and status_code < 400 or upper(fetch_outcome) = 'SKIPPED') and status_code >= 200 and status_code <= 499
  and contains(lower(normalized_url), '.example/p/1') and is_indexable and lower(content_type) in ('text/html', 'application/pdf', 'text/html; charset=utf-8') and exists (select 1 from findings f where f.owner_id = p.owner_id and f.scan_id = p.scan_id and f.page_id = p.page_id
  and upper(severity) in ('ERROR', 'WARNING') and finding_code in ('TITLE_MISSING', 'CLICK', 'VIEW', 'PURCHASE', 'ERROR', 'SIGNUP'))""", shapes=("page_metrics", "findings"))
def o059_filter_pages(spark, sf_dir):
    out = pages.filter_pages(
        page_metrics(spark, sf_dir), shape(spark, sf_dir, "findings"), outcomes=("SUCCESS", "WARNING"), status_min=200, status_max=499, query=".Example/P/1", indexable=True,
        content_types=("text/html", "application/pdf", "text/html; charset=utf-8"), severities=("ERROR", "WARNING"), codes=("TITLE_MISSING", "CLICK", "VIEW", "PURCHASE", "ERROR", "SIGNUP"),
    )
    return out.select("page_id", "normalized_url", "status_code")


@query(f"""select page_id from page_metrics p where lower(fetch_outcome) not in ('success', 'skipped') or status_code >= 400
  or exists (select 1 from findings f where f.owner_id = p.owner_id and f.scan_id = p.scan_id and f.page_id = p.page_id and {ISSUE_SQL})""", shapes=("page_metrics", "findings"))
def o060_issue_pages(spark, sf_dir):
    return pages.issue_pages(page_metrics(spark, sf_dir), shape(spark, sf_dir, "findings")).select("page_id")


@query("""select page_id, title, canonical_url from page_metrics where fetch_outcome = 'SUCCESS' and (title = '' or h1_text = '' or canonical_url = '')""", shapes=("page_metrics",))
def o061_seo_gaps(spark, sf_dir):
    return pages.seo_gaps(page_metrics(spark, sf_dir)).select("page_id", "title", "canonical_url")


@query(f"""select owner_id, scan_id, count(*) as total_urls, count(*) filter (lower(fetch_outcome) not in ('success', 'skipped') or status_code >= 400 or issue_n > 0) as issue_pages, cast(sum(n) as bigint) as finding_count,
  count(*) filter (status_code between 200 and 299) as status_2xx, count(*) filter (status_code < 200 or status_code >= 600) as no_response from
  (select p.*, (select count(*) from findings f where f.owner_id = p.owner_id and f.scan_id = p.scan_id and f.page_id = p.page_id) as n,
   (select count(*) from findings f where f.owner_id = p.owner_id and f.scan_id = p.scan_id and f.page_id = p.page_id and {ISSUE_SQL}) as issue_n from page_metrics p) group by 1, 2""", shapes=("page_metrics", "findings"))
def o078_fact_summary(spark, sf_dir):
    rows = pages.scan_summary(page_metrics(spark, sf_dir), shape(spark, sf_dir, "findings"))
    return rows.select("owner_id", "scan_id", *long("total_urls", "issue_pages", "finding_count", "status_2xx", "no_response"))


@query("""select fetch_outcome, status_code, count(*) as pages, quantile_disc(total_ms, 0.5) as p50_ms, quantile_disc(total_ms, 0.95) as p95_ms, cast(sum(response_bytes) as bigint) as response_bytes
  from page_metrics group by 1, 2""", shapes=("page_metrics",))
def o079_outcome_latency(spark, sf_dir):
    return pages.outcome_latency(page_metrics(spark, sf_dir))


@query("""select severity, category, rule_id, count(*) as findings from findings group by 1, 2, 3""", shapes=("findings",))
def o080_finding_distribution(spark, sf_dir):
    return pages.finding_distribution(shape(spark, sf_dir, "findings"))


@query("""select p.page_id, count(f.finding_id) as n, coalesce(string_agg(f.finding_id, ',' order by f.severity, f.rule_id, f.finding_id), '') as ids
  from page_metrics p left join findings f using (owner_id, scan_id, page_id) group by p.owner_id, p.scan_id, p.page_id""", shapes=("page_metrics", "findings"))
def o067_pages_with_findings(spark, sf_dir):
    found = shape(spark, sf_dir, "findings").withColumn("rule_version", F.lit(1)).withColumn("evidence_json", F.lit("{}"))
    rows = pages.pages_with_findings(page_metrics(spark, sf_dir), found)
    return rows.select("page_id", F.size("findings").cast("long").alias("n"), F.array_join(F.transform("findings", lambda f: f["finding_id"]), ",").alias("ids"))


@query("""select page_id, finding_id, row_number() over (partition by owner_id, scan_id, page_id order by severity, rule_id, finding_id) as position from findings""", shapes=("findings",))
def o103_findings_for_page(spark, sf_dir):
    return pages.findings_for_page(shape(spark, sf_dir, "findings")).select("page_id", "finding_id", F.col("position").cast("long").alias("position"))


@query("""select normalized_url, page_id from page_metrics where (normalized_url, page_id) > ('https://site5.example/p/', '') order by 1, 2 limit 26""", shapes=("page_metrics",))
def o101_page_keyset(spark, sf_dir):
    return pages.page_keyset(page_metrics(spark, sf_dir), ("https://site5.example/p/", ""), 25).select("normalized_url", "page_id")


@query("""select page_id, finding_id from findings where page_id > '2' or page_id = '2' and finding_id > 'a' order by 1, 2 limit 51""", shapes=("findings",))
def o102_finding_keyset(spark, sf_dir):
    return pages.keyset(shape(spark, sf_dir, "findings").select("page_id", "finding_id"), ["page_id", "finding_id"], ("2", "a"), 50)


@query("""select source_page_id, edge_id from edges where source_page_id > '3' or source_page_id = '3' and edge_id > '' order by 1, 2 limit 51""", shapes=("edges",))
def o102_edge_keyset(spark, sf_dir):
    return pages.keyset(shape(spark, sf_dir, "edges").select("source_page_id", "edge_id"), ["source_page_id", "edge_id"], ("3", ""), 50)


@query("""select owner_id, scan_id, 'title' as signal, title as value, count(*) as pages from page_metrics where title <> '' group by 1, 2, 4 having count(*) > 1 union all
  select owner_id, scan_id, 'description', meta_description, count(*) from page_metrics where meta_description <> '' group by 1, 2, 4 having count(*) > 1 union all
  select owner_id, scan_id, 'h1', h1_text, count(*) from page_metrics where h1_text <> '' group by 1, 2, 4 having count(*) > 1 union all
  select owner_id, scan_id, 'canonical', canonical_url, count(*) from page_metrics where canonical_url <> '' group by 1, 2, 4 having count(*) > 1""", shapes=("page_metrics",))
def o121_duplicate_signals(spark, sf_dir):
    return pages.duplicate_signals(page_metrics(spark, sf_dir))


@query("""select page_id, case when upper(fetch_outcome) = 'SUCCESS' and status_code < 400 then 'SUCCESS' when fetch_outcome = 'SKIPPED' then 'WARNING' else 'FAILED' end as outcome,
  case when fetch_outcome = 'SKIPPED' then 'SKIPPED' when status_code >= 400 then 'FAILED' else 'SUCCEEDED' end as terminal, case when total_ms % 2 = 0 then total_ms end as timing from page_metrics""", shapes=("page_metrics",))
def o028_public_outcome(spark, sf_dir):
    o, s = F.col("fetch_outcome"), F.col("status_code")
    return page_metrics(spark, sf_dir).select("page_id", rules.public_outcome(o, s).alias("outcome"), rules.terminal_status(o, F.lit(""), s).alias("terminal"), rules.observed_timing(F.col("total_ms") % 2 == 0, F.col("total_ms")).alias("timing"))


@query("""select finding_id, case when upper(severity) in ('ERROR', 'CRITICAL') then 'critical' when upper(severity) in ('WARNING', 'WARN') then 'warning' else 'info' end as severity from findings""", shapes=("findings",))
def o029_public_severity(spark, sf_dir):
    return shape(spark, sf_dir, "findings").select("finding_id", rules.public_severity(F.col("severity")).alias("severity"))


@query("""select event_id, attempt < 3 and (error in ('timeout', 'dns_failed', 'network_failed', 'body_read_failed') or status in (429, 500, 502, 503, 504)) as retry from
  (select event_id, event_id % 4 + 1 as attempt, case event_id % 6 when 0 then 'timeout' when 1 then 'ssrf_blocked' else '' end as error, case event_id % 7 when 0 then 503 when 1 then 404 when 2 then 429 else 200 end as status from events)""")
def o032_retry_plan(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    error = F.when(k % 6 == 0, "timeout").when(k % 6 == 1, "ssrf_blocked").otherwise("")
    status = F.when(k % 7 == 0, 503).when(k % 7 == 1, 404).when(k % 7 == 2, 429).otherwise(200)
    return e.select("event_id", rules.retry_plan(k % 4 + 1, error, status, F.lpad(F.hex(k % 256), 2, "0"))["retry"].alias("retry"))


@query("""select execution_id, concat('[', concat_ws(', ', case when discovered <> queued + leased + persisting + processed then 'counter_sum' end, case when discovered > 40 then 'pages_over_limit' end,
  case when published > expected then 'published_beyond_expected' end), ']') as problems from (select *, queued + leased + persisting + processed + case when cast(execution_id as int) % 9 = 0 then 1 else 0 end as discovered,
  succeeded as expected, succeeded + case when cast(execution_id as int) % 5 = 0 then 1 else 0 end as published from (select execution_id, count(*) filter (status = 'QUEUED') as queued, count(*) filter (status = 'LEASED') as leased,
  count(*) filter (status = 'PERSISTING') as persisting, count(*) filter (status in ('SUCCEEDED', 'FAILED', 'SKIPPED', 'CANCELLED')) as processed, count(*) filter (status = 'SUCCEEDED') as succeeded from scan_pages group by 1))""", shapes=("scan_pages",))
def o031_constraint_report(spark, sf_dir):
    k = F.col("execution_id").cast("int")
    rows = workflow.execution_counts(shape(spark, sf_dir, "scan_pages")).withColumns({
        "discovered": F.col("queued") + F.col("leased") + F.col("persisting") + F.col("processed") + F.when(k % 9 == 0, 1).otherwise(0), "expected": F.col("succeeded"),
        "published": F.col("succeeded") + F.when(k % 5 == 0, 1).otherwise(0), "status": F.lit("RUNNING"), "finished_at": F.lit(None).cast("timestamp"), "max_pages": F.lit(40),
    })
    return rows.select("execution_id", F.concat(F.lit("["), F.array_join(rules.execution_constraints(), ", "), F.lit("]")).alias("problems"))


# --- links -----------------------------------------------------------------------------------------------------------


@query("""select owner_id, scan_id, source_page_id, count(*) filter (is_internal) as internal_links, count(*) filter (not is_internal) as external_links from edges group by 1, 2, 3""", shapes=("edges",))
def o052_link_counts(spark, sf_dir):
    return links.link_counts(shape(spark, sf_dir, "edges"))


@query("""select e.edge_id, e.owner_id, e.scan_id, t.page_id as target_page_id from edges e left join targets t on t.owner_id = e.owner_id and t.scan_id = e.scan_id and t.url_hash = e.target_hash""", shapes=("edges", "targets"))
def o075_link_report(spark, sf_dir):
    return links.link_report(shape(spark, sf_dir, "edges"), shape(spark, sf_dir, "targets")).select("edge_id", "owner_id", "scan_id", "target_page_id")


@query("""select t.owner_id, t.scan_id, t.page_id, count(e.edge_id) as inlinks from targets t left join edges e on t.owner_id = e.owner_id and t.scan_id = e.scan_id and t.url_hash = e.target_hash group by 1, 2, 3""", shapes=("edges", "targets"))
def o075_inlink_counts(spark, sf_dir):
    return links.inlink_counts(shape(spark, sf_dir, "edges"), shape(spark, sf_dir, "targets"))


@query("""select owner_id, scan_id, source_page_id, target_hash, is_followable from edges where is_internal""", shapes=("edges",))
def o076_pagerank_input(spark, sf_dir):
    return links.pagerank_input(shape(spark, sf_dir, "edges"))


FRONTIER = """, src as (select scan_id, source_page_id, 1 as depth from edges group by 1, 2), known as (select scan_id, concat('https://site.example/', cast(k as string)) as url from (select distinct scan_id from edges), (select unnest(range(0, 500, 7)) as k)),
  found as (select e.scan_id, e.target_url as url, min(struct_pack(source_page_id := e.source_page_id, ordinal := e.ordinal)) as first, min(s.depth + 1) as depth from edges e join src s using (scan_id, source_page_id) where is_internal and is_followable group by 1, 2),
  new as (select * from found anti join known using (scan_id, url)), placed as (select *, row_number() over (partition by scan_id order by url) as place from new) """


@query(extra=FRONTIER + "select scan_id, url, cast(depth as bigint) as depth, first.source_page_id as parent_page_id, place as ordinal from placed where place <= 200 - 72", shapes=("edges",))
def o068_expand_frontier(spark, sf_dir):
    edges = shape(spark, sf_dir, "edges")
    fetched = edges.select("scan_id", F.col("source_page_id").alias("page_id"), F.lit(1).alias("depth")).distinct()
    scans = edges.select("scan_id").distinct()
    known = scans.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(499), F.lit(7)))).select("scan_id", F.concat(F.lit("https://site.example/"), F.col("k").cast("string")).alias("url"))
    limits = scans.select("scan_id", F.lit(200).alias("max_pages"), F.lit(3).alias("max_depth"))
    out = links.expand_frontier(fetched, edges, known, limits)
    return out.select("scan_id", "url", *long("depth"), "parent_page_id", *long("ordinal"))



GRAPH = "with recursive e as (select distinct 's' as scan_id, l_suppkey as source, l_partkey % 1000 as target from lineitem), "


@query(GRAPH + """walk as (select 's' as scan_id, cast(1 as bigint) as node, 0 as depth union select e.scan_id, e.target, w.depth + 1 from walk w join e on e.source = w.node where w.depth < 10)
  select scan_id, node, min(depth) as depth from walk group by 1, 2""")
def o069_crawl_depths(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    edges = l.select(F.lit("s").alias("scan_id"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 1000).alias("target")).distinct().withColumn("ordinal", F.col("target"))
    seeds = spark.createDataFrame([("s", 1)], "scan_id string, node long")
    return links.crawl_depths(edges, seeds, 10).select("scan_id", "node", "depth")


@query()
def o069_crawl_depths_all(spark, sf_dir):
    """All edges of all scans from one seed each; a page is one of the 500 URLs. There is no SQL for it."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long") % 500
    edges = shape(spark, sf_dir, "edges").select("scan_id", number("source_page_id").alias("source"), number("target_url").alias("target"), "ordinal")
    seeds = edges.groupBy("scan_id").agg(F.min("source").alias("node"))
    return links.crawl_depths(edges, seeds, 10).select("scan_id", "node", "depth", "parent")


@query("""select scan_id, count(*) as rows, count(distinct target_url) as distinct_urls, max(ordinal) as max_depth from edges group by 1""", shapes=("edges",))
def o087_frontier_invariants(spark, sf_dir):
    return links.frontier_invariants(shape(spark, sf_dir, "edges").select("scan_id", F.col("target_url").alias("url"), F.col("ordinal").alias("depth")))


# --- captures --------------------------------------------------------------------------------------------------------


@query("""select n.capture_request_id, n.request_id, n.request_sequence, b.resource_id is not null as body_captured, b.resource_id, coalesce(b.body_bytes, 0) as body_bytes, coalesce(b.was_truncated, false) as was_truncated
  from network n left join (select * from bodies qualify row_number() over (partition by owner_id, capture_request_id, request_sequence order by resource_id, body_bytes, body_sha256, was_truncated) = 1) b using (owner_id, capture_request_id, request_sequence)""", shapes=("network", "bodies"))
def o071_merge_resource_bodies(spark, sf_dir):
    out = capture.merge_resource_bodies(shape(spark, sf_dir, "network"), shape(spark, sf_dir, "bodies"))
    return out.select("capture_request_id", "request_id", "request_sequence", "body_captured", "resource_id", "body_bytes", "was_truncated")


@query("""select capture_request_id, request_id, request_sequence from network qualify row_number() over (partition by owner_id, capture_request_id order by request_sequence, request_id) <= 3""", shapes=("network",))
def o104_network_waterfall(spark, sf_dir):
    return capture.network_waterfall(shape(spark, sf_dir, "network"), 3).select("capture_request_id", "request_id", "request_sequence")


@query("""select capture_request_id, request_id, url from network where resource_type = 'image' and contains(lower(url), 'a/1')""", shapes=("network",))
def o066_resource_filter(spark, sf_dir):
    return capture.resource_filter(shape(spark, sf_dir, "network"), "image", "A/1").select("capture_request_id", "request_id", "url")


@query("""select owner_id, scan_id, page_id, id from captures where status in ('COMPLETED', 'PARTIAL_SUCCESS') qualify row_number() over (partition by owner_id, scan_id, page_id order by created_at desc, id desc) = 1""", shapes=("captures",))
def o093_latest_capture(spark, sf_dir):
    return capture.latest_capture(shape(spark, sf_dir, "captures")).select("owner_id", "scan_id", "page_id", "id")


@query(extra=""", g as (select *, skip_reason is null as open, sum(case when skip_reason is null then 1 else 0 end) over (partition by capture_request_id order by request_sequence) as no from budget_rows),
  z as (select *, case when open and no <= 3 then least(coalesce(body_length, 0), 30000) else 0 end as size from g),
  y as (select *, greatest(60000 - coalesce(sum(size) over (partition by capture_request_id order by request_sequence rows between unbounded preceding and 1 preceding), 0), 0) as rest from z),
  x as (select *, case when not open then skip_reason when no > 3 then 'RESOURCE_BODY_COUNT_LIMIT' when rest <= 0 then 'CAPTURE_BYTE_BUDGET_EXCEEDED' when body_length is null then 'BODY_UNAVAILABLE' when body_length = 0 then 'EMPTY_BODY' end as skip from y)
select capture_request_id, cast(request_sequence as bigint) as request_sequence, cast(case when skip is null then least(size, rest) else 0 end as bigint) as kept_bytes, skip is null and body_length > case when skip is null then least(size, rest) else 0 end as truncated, skip from x""", shapes=("budget_rows",))
def o097_body_budget(spark, sf_dir):
    out = capture.body_budget(shape(spark, sf_dir, "budget_rows"), 3, 30_000, 60_000)
    return out.select("capture_request_id", *long("request_sequence"), "kept_bytes", F.coalesce("truncated", F.lit(False)).alias("truncated"), "skip")



@query("""select capture_request_id, cast(arg_max(start_ms, entry_no) filter (kind = 'lcp') as double) as lcp, case when count(*) filter (kind = 'shift') > 0 then cast(coalesce(sum(value) filter (kind = 'shift' and not recent_input), 0) as double) end as cls
  from vital_entries group by 1""", shapes=("vital_entries",))
def o089_web_vitals(spark, sf_dir):
    return capture.web_vitals(shape(spark, sf_dir, "vital_entries")).select("capture_request_id", F.col("lcp.value").alias("lcp"), F.col("cls.value").alias("cls"))


@query("""select s.page_id, s.title <> r.title as title_changed, s.h1_text <> r.h1_text as h1_changed, r.total_ms - s.total_ms as link_delta, s.title <> r.title or s.h1_text <> r.h1_text or s.meta_description <> r.meta_description or r.total_ms <> s.total_ms as content_changed
  from page_metrics s join (select owner_id, scan_id, page_id, case when cast(page_id as bigint) % 2 = 0 then title else 'New' end as title, h1_text, upper(meta_description) as meta_description, case when cast(page_id as bigint) % 3 = 0 then total_ms + 2 else total_ms end as total_ms from page_metrics) r using (owner_id, scan_id, page_id)""", shapes=("page_metrics",))
def o070_static_rendered_diff(spark, sf_dir):
    types = F.array().cast("array<string>")
    static = page_metrics(spark, sf_dir).select(*pages.PAGE, "title", "meta_description", "canonical_url", "h1", F.col("total_ms").alias("link_count"), F.lit(0).alias("image_count"), types.alias("schema_types"))
    k = F.col("page_id").cast("long")
    rendered = static.withColumns({"title": F.when(k % 2 == 0, F.col("title")).otherwise("New"), "meta_description": F.upper("meta_description"), "link_count": F.when(k % 3 == 0, F.col("link_count") + 2).otherwise(F.col("link_count"))})
    return capture.static_rendered_diff(static, rendered).select("page_id", "title_changed", "h1_changed", "link_delta", "content_changed")


# --- archives --------------------------------------------------------------------------------------------------------


@query("""select job_id, path, first(path) over (partition by job_id, sha256, kind2 order by file_no, path) as canonical_path from (select *, coalesce(nullif(lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)), ''), lower(trim(split_part(content_type, ';', 1)))) as kind2 from assets)""", shapes=("assets",))
def o107_asset_dedup(spark, sf_dir):
    return archive.asset_dedup(shape(spark, sf_dir, "assets")).select("job_id", "path", "canonical_path")


@query("""select job_id, min(path) as path, count(*) as n, min(sha256) <> max(sha256) as collision from (select *, lower(case when file_no % 2 = 0 then upper(path) else path end) as p from assets) group by job_id, p""", shapes=("assets",))
def o109_archive_files(spark, sf_dir):
    rows = shape(spark, sf_dir, "assets")
    twice = rows.unionByName(rows.withColumn("path", F.upper("path")).withColumn("file_no", F.col("file_no") + 1_000_000_000))
    out = archive.archive_files(twice)
    return out.select("job_id", "path", F.lit(1).cast("long").alias("n"), "collision")


@query(extra=""", o as (select job_id, path, bytes, bytes + 256 + 2 * octet_length(encode(path)) as need, row_number() over (partition by job_id order by file_no, path) as rn from assets),
  w as (select cast(0 as bigint) as rn, job_id, cast(null as string) as path, 1 as shard, cast(0 as bigint) as filled, cast(0 as bigint) as total, cast(null as string) as problem from (select distinct job_id from assets)
    union all select rn, job_id, path, case when problem is null and closed then shard + 1 else shard end, cast(case when problem is not null then filled when closed then need else filled + need end as bigint), total, problem
    from (select o.rn, o.job_id, o.path, o.need, w.shard, w.filled, cast(w.total + o.bytes as bigint) as total, case when o.need > 20000 then 'SITE_FILE_EXCEEDS_SHARD_BUDGET' when w.total + o.bytes > 300000 then 'SITE_ARCHIVE_BUDGET_EXCEEDED' end as problem, w.filled > 0 and w.filled + o.need > 20000 as closed
      from w join o on o.job_id = w.job_id and o.rn = w.rn + 1))
  select job_id, path, case when problem is null then shard end as shard, problem from w where rn > 0""", shapes=("assets",))
def o099_shard_plan(spark, sf_dir):
    """Shards small enough that files of all kinds are met: those that fit, open a shard, exceed one, or come after the archive is full."""
    return archive.shard_plan(shape(spark, sf_dir, "assets"), 20_000, 300_000)


@query(extra=""", o as (select capture_request_id as page_id, url, request_sequence as ordinal, lower(replace(url, 'https://', '')) || case resource_type when 'image' then '.png' when 'stylesheet' then '.css' else '.js' end as local_path, response_bytes as bytes, resource_type,
    row_number() over (partition by capture_request_id order by request_sequence, url, response_bytes) as rn from network),
  w as (select cast(0 as bigint) as rn, page_id, cast(null as int) as ordinal, cast(null as string) as url, cast(null as string) as local_path, cast(null as string) as skip, cast([] as string[]) as known, cast(1000 as bigint) as size from (select distinct page_id from o)
    union all select rn, page_id, ordinal, url, case when skip is null then local_path end, skip, case when skip is null and not list_contains(known, url) then list_append(known, url) else known end, cast(case when skip is null and not list_contains(known, url) then size + bytes else size end as bigint)
    from (select o.rn, o.page_id, cast(o.ordinal as int) as ordinal, o.url, o.local_path, o.bytes, w.known, w.size, case when list_contains(w.known, o.url) then null when len(w.known) >= 3 then 'FILE_COUNT_BUDGET_EXCEEDED' when w.size + o.bytes > 120000 then 'CLONE_INPUT_BUDGET_EXCEEDED' end as skip
      from w join o on o.page_id = w.page_id and o.rn = w.rn + 1))
  select page_id, ordinal, url as source_url, local_path, skip from w where rn > 0""", shapes=("network",))
def o098_clone_plan(spark, sf_dir):
    n = shape(spark, sf_dir, "network")
    rows = n.select(
        F.col("capture_request_id").alias("page_id"), F.concat(F.lit("https://cdn.example/page/"), "capture_request_id").alias("final_url"), F.lit(1000).alias("html_bytes"), F.col("request_sequence").alias("ordinal"),
        F.col("url").alias("source_url"), "resource_type", F.when(F.col("resource_type") == "image", "image/png").when(F.col("resource_type") == "stylesheet", "text/css").otherwise("text/javascript").alias("mime"),
        F.col("response_bytes").alias("body_bytes"), F.sha2("url", 256).alias("body_sha256"), F.lit(None).cast("string").alias("skip_reason"), (F.col("resource_type") != "script").alias("is_visual"),
    )
    return archive.clone_plan(rows, most_files=4, most_bytes=120_000)


@query("""select job_id, page_id, representative from (select *, row_number() over (partition by job_id, semantic_role, route_template, case when semantic_role is null then page_id end, coalesce(layout_fingerprint, 'FINGERPRINT_UNAVAILABLE') order by ordinal, page_id) = 1 or semantic_role is null as representative from clone_pages)""", shapes=("clone_pages",))
def o096_layout_representatives(spark, sf_dir):
    return archive.layout_representatives(shape(spark, sf_dir, "clone_pages")).select("job_id", "page_id", "representative")


@query("""select job_id, count(*) as candidates, count(*) filter (status in ('SUCCEEDED', 'FAILED')) as processed, count(*) filter (status = 'SUCCEEDED') as succeeded, count(*) filter (status = 'FAILED') as failed,
  cast(coalesce(sum(input_bytes) filter (status = 'SUCCEEDED'), 0) as bigint) as input_bytes, cast(floor(count(*) filter (status in ('SUCCEEDED', 'FAILED')) * 100.0 / count(*)) as bigint) as percent from clone_pages group by 1""", shapes=("clone_pages",))
def o084_clone_counters(spark, sf_dir):
    return archive.clone_counters(shape(spark, sf_dir, "clone_pages")).select("job_id", "candidates", "processed", "succeeded", "failed", "input_bytes", *long("percent"))


@query("""select job_id, string_agg(concat(reason, '=', cast(n as string)), ',' order by reason) as reasons from (select job_id, reason, count(*) as n from clone_pages where reason is not null group by 1, 2) group by 1""", shapes=("clone_pages",))
def o085_reason_counts(spark, sf_dir):
    m = archive.reason_counts(shape(spark, sf_dir, "clone_pages"))
    return m.select("job_id", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("reasons"))


@query(extra=""", r as (select *, row_number() over (partition by job_id, semantic_role, route_template, case when semantic_role is null then page_id end, coalesce(layout_fingerprint, 'FINGERPRINT_UNAVAILABLE') order by ordinal, page_id) = 1 or semantic_role is null as rep from clone_pages)
  select job_id, count(*) as discovered, count(reason) as rejected, count(distinct case when rep then concat(coalesce(semantic_role, 'UNKNOWN'), chr(10), coalesce(route_template, local_path)) end) as grouped, count(*) filter (rendered) as rendered,
  count(*) filter (rep) as packaged, case when bool_or(status = 'FAILED') then 'PARTIAL_RENDER_FAILURE' when bool_or(reason = 'CANCELLED') then 'PARTIAL_CANCELLED' when bool_or(rep and resource_gaps > 0) then 'PARTIAL_RESOURCE_GAPS' else 'REPRESENTATIVE_COMPLETE' end as completeness from r group by 1""", shapes=("clone_pages",))
def o086_archive_counts(spark, sf_dir):
    return archive.archive_counts(archive.layout_representatives(shape(spark, sf_dir, "clone_pages")))



@query("""select ordinal, url from clone_pages where ordinal > 10 and status = 'SUCCEEDED' and contains(lower(url), '/en/') order by ordinal limit 51""", shapes=("clone_pages",))
def o064_clone_page_list(spark, sf_dir):
    return archive.clone_page_list(shape(spark, sf_dir, "clone_pages"), after=10, status="SUCCEEDED", query="/EN/", n=50).select("ordinal", "url")


@query("""select owner_id, sha256, bytes, kind, min(object_id) as object_id, count(*) as copies from objects group by 1, 2, 3, 4""", shapes=("objects",))
def o110_object_dedup(spark, sf_dir):
    return archive.object_dedup(shape(spark, sf_dir, "objects")).select("owner_id", "sha256", "bytes", "kind", "object_id", "copies")


@query("""select object_id from objects where status = 'DELETE_PENDING' and delete_after <= 50 and object_id not in (select object_id from object_references)""", shapes=("objects", "object_references"))
def o073_collectable_objects(spark, sf_dir):
    return archive.collectable_objects(shape(spark, sf_dir, "objects"), shape(spark, sf_dir, "object_references"), F.lit(50)).select("object_id")


# --- workflow --------------------------------------------------------------------------------------------------------


@query("""select id, status, created_at from scans where owner_id = '7' and status in ('COMPLETED', 'RUNNING') and failed_count >= 5 order by created_at desc, id desc limit 20""", shapes=("scans",))
def o062_scan_list(spark, sf_dir):
    return workflow.scan_list(shape(spark, sf_dir, "scans"), owner="7", statuses=("COMPLETED", "RUNNING"), failed_at_least=5).select("id", "status", "created_at")


@query("""select id, display_name from websites where status in ('ACTIVE') and (contains(lower(display_name), '#00000') or contains(lower(hostname), '#00000') or contains(lower(canonical_url), '#00000'))
  and id not in (select website_id from scans where status in ('QUEUED', 'RUNNING', 'CANCEL_REQUESTED')) order by display_name, id limit 20""", shapes=("websites", "scans"))
def o063_website_list(spark, sf_dir):
    return workflow.website_list(shape(spark, sf_dir, "websites"), shape(spark, sf_dir, "scans"), statuses=("ACTIVE",), query="#00000", has_active=False).select("id", "display_name")


@query("""select w.id as website_id, s.id as latest_scan_id, s.status as latest_status, coalesce(s.processed_count, 0) as processed_count, coalesce(s.failed_count, 0) as failed_count from websites w
  left join (select * from scans qualify row_number() over (partition by website_id order by created_at desc, id desc) = 1) s on s.website_id = w.id""", shapes=("websites", "scans"))
def o072_websites_with_latest_scan(spark, sf_dir):
    out = workflow.websites_with_latest_scan(shape(spark, sf_dir, "websites"), shape(spark, sf_dir, "scans"))
    return out.select("website_id", "latest_scan_id", "latest_status", "processed_count", "failed_count")


COUNTS = """select execution_id, count(*) filter (status = 'QUEUED') as queued, count(*) filter (status = 'LEASED') as leased, count(*) filter (status = 'PERSISTING') as persisting, count(*) filter (status = 'SUCCEEDED') as succeeded,
  count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'SKIPPED') as skipped, count(*) filter (status = 'CANCELLED') as cancelled, count(*) filter (status in ('SUCCEEDED', 'FAILED', 'SKIPPED', 'CANCELLED')) as processed from scan_pages group by 1"""


@query(COUNTS, shapes=("scan_pages",))
def o081_execution_counts(spark, sf_dir):
    return workflow.execution_counts(shape(spark, sf_dir, "scan_pages"))


@query(f"""select execution_id, case when queued = 0 and leased = 0 and persisting = 0 then case when cast(execution_id as int) % 6 = 0 then 'CANCELLED' when succeeded > 0 and failed + skipped + cancelled = 0 then 'COMPLETED'
  when succeeded > 0 then 'PARTIAL_SUCCESS' else 'FAILED' end end as final_status from ({COUNTS})""", shapes=("scan_pages",))
def o082_execution_status(spark, sf_dir):
    rows = workflow.execution_counts(shape(spark, sf_dir, "scan_pages"))
    rows = rows.withColumns({"status": F.when(F.col("execution_id").cast("int") % 6 == 0, "CANCEL_REQUESTED").otherwise("RUNNING"), "published": F.lit(1), "expected": F.lit(1)})
    return workflow.execution_status(rows).select("execution_id", "final_status")


@query("""select coalesce(w.owner_id, s.owner_id) as owner_id, coalesce(active_websites, 0) as active_websites, coalesce(scans_since, 0) as scans_since, coalesce(active_scans, 0) as active_scans, coalesce(processed, 0) as processed_count, coalesce(succeeded, 0) as succeeded_count,
  case when processed > 0 then cast(floor(succeeded * 100 / processed + 0.5) as bigint) end as success_rate from (select owner_id, count(*) filter (status = 'ACTIVE') as active_websites from websites group by 1) w full join
  (select owner_id, count(*) filter (created_at >= timestamp '1998-01-01 00:00:00') as scans_since, count(*) filter (status in ('QUEUED', 'RUNNING', 'CANCEL_REQUESTED')) as active_scans,
   cast(coalesce(sum(processed_count) filter (created_at >= timestamp '1998-01-01 00:00:00'), 0) as bigint) as processed, cast(coalesce(sum(succeeded_count) filter (created_at >= timestamp '1998-01-01 00:00:00'), 0) as bigint) as succeeded from scans group by 1) s on w.owner_id = s.owner_id""", shapes=("websites", "scans"))
def o083_dashboard_summary(spark, sf_dir):
    out = workflow.dashboard_summary(shape(spark, sf_dir, "websites"), shape(spark, sf_dir, "scans"), F.expr(SINCE))
    return out.select("owner_id", "active_websites", "scans_since", "active_scans", "processed_count", "succeeded_count", *long("success_rate"))


@query("""select 'user' as kind, owner_id as id, count(*) as active from scans where status in ('QUEUED', 'RUNNING', 'CANCEL_REQUESTED') group by 2 having count(*) >= 3 union all
  select 'website', website_id, count(*) from scans where status in ('QUEUED', 'RUNNING', 'CANCEL_REQUESTED') group by 2 having count(*) >= 1""", shapes=("scans",))
def o091_active_scan_quota(spark, sf_dir):
    return workflow.active_scan_quota(shape(spark, sf_dir, "scans")).select("kind", "id", "active")


@query("""select concat('c', s.id) as clone_id, case when status = 'CANCELLED' then 'SITE_CLONE_FAILED' else 'SITE_CLONE_REQUESTED' end as command, case when status <> 'CANCELLED' then 300 end as max_pages from scans s
  where status in ('COMPLETED', 'PARTIAL_SUCCESS', 'FAILED', 'CANCELLED') and cast(id as bigint) % 2 = 0""", shapes=("scans",))
def o077_clone_ready(spark, sf_dir):
    scans = shape(spark, sf_dir, "scans")
    clones = scans.where(F.col("id").cast("long") % 2 == 0).select(F.concat(F.lit("c"), "id").alias("id"), "owner_id", F.col("id").alias("scan_id"), F.lit("WAITING_FOR_SCAN").alias("status"))
    return workflow.clone_ready(scans, clones, {"max_pages": 300}).select("clone_id", "command", "max_pages")


@query("""select owner_id, aggregate_id, case when coalesce(rb, 0) < coalesce(db, 0) then 'MISSING' when coalesce(rb, 0) > coalesce(db, 0) then 'EXTRA' when coalesce(rr, 0) <> coalesce(fr, 0) then 'MISMATCH' else 'OK' end as state from
  (select owner_id, aggregate_id, count(distinct batch_id) as rb, sum(fact_rows) as rr from receipts group by 1, 2) a full join (select owner_id, aggregate_id, count(distinct batch_id) as db from delivered group by 1, 2) b using (owner_id, aggregate_id)
  full join (select owner_id, aggregate_id, count(*) as fr from fact_rows group by 1, 2) c using (owner_id, aggregate_id)""", shapes=("receipts", "delivered", "fact_rows"))
def o074_reconcile_receipts(spark, sf_dir):
    return workflow.reconcile_receipts(*(shape(spark, sf_dir, n) for n in ("receipts", "delivered", "fact_rows"))).select("owner_id", "aggregate_id", "state")


@query("""select id, created_at from scans where (created_at, id) < (timestamp '1998-06-01 00:00:00', '5') order by created_at desc, id desc limit 31""", shapes=("scans",))
def o105_history_keyset(spark, sf_dir):
    import datetime

    return workflow.history_keyset(shape(spark, sf_dir, "scans").select("id", "created_at"), (datetime.datetime(1998, 6, 1), "5"), 30)


@query("""select id from outbox where created_at > timestamp '2024-07-01 00:00:00' - interval 180 day""", shapes=("outbox",))
def o115_expire(spark, sf_dir):
    return workflow.expire(shape(spark, sf_dir, "outbox"), "facts", F.expr("timestamp_ntz'2024-07-01 00:00:00'"), "created_at").select("id")


@query("""select count(*) filter (status in ('PENDING', 'CLAIMED', 'DEAD')) as waiting, min(created_at) filter (status in ('PENDING', 'CLAIMED', 'DEAD')) as oldest,
  coalesce(min(created_at) filter (status in ('PENDING', 'CLAIMED', 'DEAD')) < timestamp '2024-01-01 00:20:00' - interval 15 minute, false) as backpressured from outbox""", shapes=("outbox",))
def o116_backlog_state(spark, sf_dir):
    return workflow.backlog_state(shape(spark, sf_dir, "outbox"), F.expr("timestamp_ntz'2024-01-01 00:20:00'"))


@query(extra=""", m as (select run_id, instant, sum(d) as step, d from (select run_id, started_at_ms as instant, 1 as d from requests union all select run_id, finished_at_ms, -1 from requests where finished_at_ms is not null) group by 1, 2, 4),
  w as (select run_id, max(n) as max_in_flight from (select run_id, sum(step) over (partition by run_id order by instant, d rows unbounded preceding) as n from m) group by 1)
  select run_id, count(*) as started, count(finished_at_ms) as completed, count(*) filter (finished_at_ms is not null and status between 200 and 399) as succeeded, count(*) filter (finished_at_ms is not null and (status is null or status not between 200 and 399)) as failed,
  count(*) filter (finished_at_ms is not null and status is null and error = 'TIMEOUT') as timed_out, quantile_disc(finished_at_ms - started_at_ms, 0.5) as p50_ms, quantile_disc(finished_at_ms - started_at_ms, 0.95) as p95_ms,
  max(finished_at_ms - started_at_ms) as max_ms, cast(max(max_in_flight) as bigint) as max_in_flight from requests join w using (run_id) group by 1""", shapes=("requests",))
def o090_load_report(spark, sf_dir):
    out = workflow.load_report(shape(spark, sf_dir, "requests"), groups=("run_id",))
    return out.select("run_id", "started", "completed", "succeeded", "failed", "timed_out", "p50_ms", "p95_ms", *long("max_ms", "max_in_flight"))



# --- events ----------------------------------------------------------------------------------------------------------

#: Progress events in the order of arrival, and what a scan, clone or capture makes of them, in SQL: state by state.
ENDED = "('COMPLETED', 'PARTIAL_SUCCESS', 'FAILED', 'CANCELLED')"
OUTCOMES = {
    "scan": f"""case when aggregate_version <= version or state in {ENDED} then 'IGNORED_STALE' when status = 'QUEUED' then 'APPLIED' when status = state or status in {ENDED} or state = 'CANCEL_REQUESTED'
      or state = 'QUEUED' and status = 'RUNNING' or state = 'RUNNING' and status = 'CANCEL_REQUESTED' then 'APPLIED' else 'REJECTED' end""",
    "clone": f"case when aggregate_version <= version or state in {ENDED} or state = 'CANCEL_REQUESTED' and status not in {ENDED} then 'IGNORED_STALE' else 'APPLIED' end",
    "capture": f"case when aggregate_version <= version or state in {ENDED} then 'IGNORED_STALE' else 'APPLIED' end",
}


def projection_sql(kind: str) -> str:
    """A scan's QUEUED event only advances the version; a scan that is asked to end goes on, but says so until it ends."""
    said = "status" if kind != "scan" else f"case when status = 'QUEUED' or state = 'CANCEL_REQUESTED' and status not in {ENDED} then state else status end"
    ready = f"case when {'status <> ' + repr('QUEUED') + ' and ' if kind == 'scan' else ''} ({said}) in {ENDED} then 'READY' when {'status = ' + repr('QUEUED') if kind == 'scan' else 'false'} then analytics else 'PENDING' end"
    return f"""walk_{kind} as (select cast(0 as bigint) as rn, aggregate_id, cast(null as string) as message_id, cast(0 as bigint) as aggregate_version, cast(null as string) as outcome, 'QUEUED' as state, cast(0 as bigint) as version, 'PENDING' as analytics from (select distinct aggregate_id from progress)
      union all select s.rn, s.aggregate_id, s.message_id, s.aggregate_version, s.outcome, case when s.outcome = 'APPLIED' then s.said else s.state end, case when s.outcome = 'APPLIED' then s.aggregate_version else s.version end, case when s.outcome = 'APPLIED' then s.ready else s.analytics end
      from (select o.rn, o.aggregate_id, o.message_id, cast(o.aggregate_version as bigint) as aggregate_version, w.state, w.version, w.analytics, {OUTCOMES[kind].replace('aggregate_version', 'o.aggregate_version')} as outcome, {said} as said, {ready} as ready
        from walk_{kind} w join ordered o on o.aggregate_id = w.aggregate_id and o.rn = w.rn + 1) s)"""


ORDERED = ", ordered as (select *, row_number() over (partition by aggregate_id order by arrival, message_id) as rn from progress)"
PROJECTED = "select aggregate_id, message_id, aggregate_version, outcome, state, version as last_version, analytics"


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as progress of 50 scans, a version each 0.3 s; each fifth state or so is another one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, turn = F.col("event_id"), F.floor(F.col("event_id") / 50)
    status = F.when(turn % 7 == 0, "COMPLETED").when(turn % 5 == 0, "CANCEL_REQUESTED").otherwise("RUNNING")
    return e.select((k % 50).cast("string").alias("scan_id"), k.alias("version"), status.alias("status"), F.timestamp_millis(F.lit(1_700_000_000_000) + k * 6).alias("occurred_at"))


#: What of these is sent on, in SQL.
SENT_SQL = """with recursive e as (select cast(event_id % 50 as string) as scan_id, event_id as version, case when event_id // 50 % 7 = 0 then 'COMPLETED' when event_id // 50 % 5 = 0 then 'CANCEL_REQUESTED' else 'RUNNING' end as status,
    1700000000000 + event_id * 6 as ms, row_number() over (partition by event_id % 50 order by event_id) as rn from events),
  w as (select cast(0 as bigint) as rn, scan_id, cast(0 as bigint) as version, cast('' as string) as status, cast(0 as bigint) as ms, false as sent, cast('' as string) as last_status, cast(0 as bigint) as last_ms from (select distinct scan_id from e)
    union all select rn, scan_id, version, status, ms, sent, case when sent then status else last_status end, case when sent then ms else last_ms end
    from (select e.rn, e.scan_id, e.version, e.status, e.ms, not (e.status <> 'COMPLETED' and e.ms - w.last_ms < 1000 and e.status = w.last_status) as sent, w.last_status, w.last_ms from w join e on e.scan_id = w.scan_id and e.rn = w.rn + 1))
  select scan_id, version, status, ms as occurred_ms from w where sent"""



SCAN_SQL = ORDERED.replace(",", ", ", 1) + ", " + projection_sql("scan") + PROJECTED + " from walk_scan where rn > 0"


@query(extra=SCAN_SQL, shapes=("progress",))
def o111_project_scan_events(spark, sf_dir):
    from webstrata.streaming import events

    rows = shape(spark, sf_dir, "progress")
    long_ = [c for c in events.COUNTERS] + ["aggregate_version"]
    rows = rows.withColumns({c: F.col(c).cast("long") for c in long_}).withColumn("occurred_at", F.timestamp_seconds(F.col("aggregate_version")))
    return events.project_batch(rows)


@query(SENT_SQL)
def o100_sample_progress(spark, sf_dir):
    sent = workflow.sample_progress(progress_events(spark, sf_dir))
    return sent.select("scan_id", "version", "status", F.unix_millis("occurred_at").alias("occurred_ms"))
