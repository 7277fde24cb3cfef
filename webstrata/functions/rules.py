"""Classification of fetches and pages in built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Errors that stand for the crawl's own safety boundary: fixed values.
POLICY_ERRORS = ("ssrf_blocked", "redirect_out_of_scope")
RETRY_ERRORS = ("timeout", "dns_failed", "network_failed", "body_read_failed")
RETRY_STATUS = (429, 500, 502, 503, 504)
ISSUE_SEVERITIES = ("ERROR", "CRITICAL", "WARNING", "WARN")
#: Prefixes of X-Robots directives with a value; any other prefix names an agent: fixed values.
VALUED_DIRECTIVES = ("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def fetch_outcome(error: Column, truncated: Column, status: Column) -> Column:
    """struct<outcome, error_code, parse>: the first rule that fits decides; parse tells whether the body is read."""
    said = text(error)
    return (
        F.when(said.isin(*POLICY_ERRORS), F.struct(F.lit("SKIPPED").alias("outcome"), said.alias("error_code"), F.lit(False).alias("parse")))
        .when(said != "", F.struct(F.lit("FAILED").alias("outcome"), said.alias("error_code"), F.lit(False).alias("parse")))
        .when(flag(truncated), F.struct(F.lit("FAILED").alias("outcome"), F.lit("BODY_TRUNCATED").alias("error_code"), F.lit(False).alias("parse")))
        .when(status >= 400, F.struct(F.lit("HTTP_ERROR").alias("outcome"), F.lit("").alias("error_code"), F.lit(True).alias("parse")))
        .otherwise(F.struct(F.lit("SUCCESS").alias("outcome"), F.lit("").alias("error_code"), F.lit(True).alias("parse")))
    )


def is_html(content_type: Column) -> Column:
    low = F.lower(text(content_type))
    return (low == "") | low.contains("text/html") | low.contains("application/xhtml+xml")


def has_noindex(c: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text(c)), r"[,; \t\r\n]+"), F.array(F.lit("noindex"), F.lit("none")))


def x_robots_noindex(header: Column) -> Column:
    """Whether a header that is not aimed at one agent says noindex.

    Within a line everything from the first agent prefix on is aimed at agents.
    """

    def of_line(line: Column) -> Column:
        parts = F.transform(F.split(line, ","), lambda p: F.trim(p))
        prefix = lambda p: F.lower(F.trim(F.substring_index(p, ":", 1)))
        agent = F.transform(parts, lambda p: p.contains(":") & ~prefix(p).isin(*VALUED_DIRECTIVES))
        first = F.array_position(agent, True)
        general = F.when(first > 0, F.slice(parts, F.lit(1), (first - 1).cast("int"))).otherwise(parts)
        return F.exists(general, has_noindex)

    return F.exists(F.split(text(header), "\n"), of_line)


def indexability(status: Column, meta: Column, header: Column) -> Column:
    """The reason code; a page is indexable if it is INDEXABLE."""
    by_meta, by_header = has_noindex(meta), x_robots_noindex(header)
    return (
        F.when(status.isNull() | (status < 200) | (status >= 300), "HTTP_STATUS_NOT_INDEXABLE")
        .when(by_meta & by_header, "META_AND_X_ROBOTS_NOINDEX")
        .when(by_header, "X_ROBOTS_TAG_NOINDEX")
        .when(by_meta, "META_ROBOTS_NOINDEX")
        .otherwise("INDEXABLE")
    )


def page_findings() -> Column:
    """array<struct<rule_id, rule_version, category, severity, code, evidence>> of a classified, parsed page.

    Columns: fetch_outcome, error_code, body_truncated, status_code, redirects,
    is_html, has_body and the facts of the parser. Rules of content hold for HTML
    with a 2xx status and a body only.
    """
    outcome, status = F.col("fetch_outcome"), F.col("status_code")
    truncated = F.col("error_code") == "BODY_TRUNCATED"
    reached = (outcome != "SKIPPED") & (outcome != "FAILED")
    content = reached & flag(F.col("is_html")) & status.between(200, 299) & flag(F.col("has_body"))
    noindex = F.col("indexability_reason").isin("META_ROBOTS_NOINDEX", "X_ROBOTS_TAG_NOINDEX", "META_AND_X_ROBOTS_NOINDEX")
    said = lambda **kw: F.to_json(F.struct(*(v.alias(k) for k, v in sorted(kw.items()))))
    static = F.lit("static_html")
    #: rule, version, category, severity, code, condition, evidence: fixed values.
    table = (
        ("fetch.policy-blocked", 1, "TECHNICAL", "INFO", "FETCH_BLOCKED_BY_POLICY", outcome == "SKIPPED", said(errorCode=F.col("error_code"))),
        ("fetch.failed", 1, "TECHNICAL", "ERROR", "FETCH_FAILED", (outcome == "FAILED") & ~truncated, said(errorCode=F.col("error_code"))),
        ("fetch.body-truncated", 1, "TECHNICAL", "WARNING", "BODY_TRUNCATED", truncated, said(retainedBytes=F.col("body_bytes"))),
        ("http.error", 1, "TECHNICAL", "ERROR", "HTTP_ERROR", reached & (status >= 400), said(statusCode=status)),
        ("http.redirect-response", 1, "TECHNICAL", "WARNING", "HTTP_REDIRECT_RESPONSE", reached & status.between(300, 399), said(statusCode=status)),
        ("redirect.chain", 1, "SEO", "WARNING", "REDIRECT_CHAIN", reached & (F.col("redirect_count") > 1), said(redirectCount=F.col("redirect_count"))),
        ("title.missing", 2, "CONTENT", "WARNING", "TITLE_MISSING", content & (text(F.col("title")) == ""), said(source=static)),
        ("meta-description.missing", 2, "CONTENT", "INFO", "META_DESCRIPTION_MISSING", content & (text(F.col("meta_description")) == ""), said(source=static)),
        ("h1.missing", 2, "CONTENT", "WARNING", "H1_MISSING", content & (F.coalesce(F.size("h1"), F.lit(0)) <= 0), said(source=static)),
        ("image.alt.missing", 2, "CONTENT", "INFO", "IMAGE_ALT_MISSING", content & (F.col("missing_alt") > 0), said(count=F.col("missing_alt"), sampleOrdinals=F.col("missing_alt_sample"), source=static)),
        ("canonical.invalid", 1, "SEO", "WARNING", "CANONICAL_INVALID", content & (F.col("canonical_invalid") > 0), said(count=F.col("canonical_invalid"), source=static)),
        ("canonical.multiple", 1, "SEO", "WARNING", "CANONICAL_MULTIPLE", content & (F.col("canonical_declared") > 1), said(count=F.col("canonical_declared"), source=static)),
        ("canonical.noindex-conflict", 1, "SEO", "WARNING", "CANONICAL_NOINDEX_CONFLICT", content & (F.col("canonical_relation") == "NON_SELF") & noindex, said(source=static)),
        ("hreflang.invalid", 1, "SEO", "WARNING", "HREFLANG_INVALID", content & (F.col("hreflang_invalid") > 0), said(count=F.col("hreflang_invalid"), source=static)),
        ("structured-data.invalid", 1, "SEO", "WARNING", "STRUCTURED_DATA_INVALID", content & (F.col("schema_error_count") > 0), said(count=F.col("schema_error_count"), issueCodes=F.col("schema_issue_codes"), source=static)),
    )
    rows = [
        F.when(flag(cond), F.struct(F.lit(rule).alias("rule_id"), F.lit(version).alias("rule_version"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), evidence.alias("evidence")))
        for rule, version, category, severity, code, cond, evidence in table
    ]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def uuid5(namespace: Column, name: Column) -> Column:
    """The name-based (SHA-1) UUID; ``namespace`` is a UUID string."""
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), name.cast("binary")))
    variant = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 19, 2)), F.substring(digest, 21, 12),
    )


def public_outcome(outcome: Column, status: Column) -> Column:
    name = F.upper(outcome)
    return F.when((name == "SUCCESS") & (status < 400), "SUCCESS").when(name == "SKIPPED", "WARNING").otherwise("FAILED")


def public_severity(c: Column) -> Column:
    name = F.upper(c)
    return F.when(name.isin("ERROR", "CRITICAL"), "critical").when(name.isin("WARNING", "WARN"), "warning").otherwise("info")


def observed_timing(observed: Column, ms: Column) -> Column:
    return F.when(flag(observed), ms)


def measurement(value: Column, reason: str | Column) -> Column:
    """struct<status, value, reason>: a value that is there, or why it is not."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(
        F.when(value.isNotNull(), "AVAILABLE").otherwise("UNAVAILABLE").alias("status"), value.cast("double").alias("value"), F.when(value.isNull(), why).alias("reason")
    )


def ttfb(response_start: Column, request_start: Column) -> Column:
    gap = response_start - request_start
    return measurement(F.when(gap >= 0, gap), "TTFB_NOT_OBSERVED")


def retry_plan(attempt: Column, error: Column, status: Column, key: Column) -> Column:
    """struct<retry, delay_s>; ``key`` is a UUID string whose first byte spreads the delays."""
    again = (attempt < 3) & (text(error).isin(*RETRY_ERRORS) | F.coalesce(status.isin(*RETRY_STATUS), F.lit(False)))
    base = F.pow(F.lit(2.0), attempt - 1) * 2
    spread = F.conv(F.substring(key, 1, 2), 16, 10).cast("double")
    return F.struct(again.alias("retry"), F.when(again, base / 2 + base / 2 * spread / 255).alias("delay_s"))


def terminal_status(outcome: Column, error: Column, status: Column) -> Column:
    return F.when(outcome == "SKIPPED", "SKIPPED").when((text(error) != "") | (status >= 400), "FAILED").otherwise("SUCCEEDED")


def violations(**rules: Column) -> Column:
    """The sorted names of the rules whose condition of violation holds."""
    return F.array_sort(F.filter(F.array(*(F.when(flag(c), F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull()))


def page_constraints() -> Column:
    """Violated rules of a page-metrics row."""
    flags = [F.col(c) for c in ("is_indexable",)]
    return violations(
        indexable_domain=reduce(lambda a, c: a | c.isNull(), flags, F.lit(False)),
        hreflang_lengths=F.size("hreflang_languages") != F.size("hreflang_urls"),
        redirect_lengths=F.size("redirect_urls") != F.size("redirect_codes"),
        status_range=(F.col("status_code") < 0) | (F.col("status_code") > 65535),
    )


def execution_constraints() -> Column:
    """Violated rules of a crawl execution's counters and state."""
    parts = F.col("queued") + F.col("leased") + F.col("persisting") + F.col("processed")
    ended = F.col("status").isin("COMPLETED", "PARTIAL_SUCCESS", "FAILED", "CANCELLED")
    return violations(
        counter_sum=F.col("discovered") != parts,
        negative=F.least("discovered", "queued", "leased", "persisting", "processed") < 0,
        published_beyond_expected=F.col("published") > F.col("expected"),
        terminal_without_end=ended != F.col("finished_at").isNotNull(),
        pages_over_limit=F.col("discovered") > F.col("max_pages"),
    )


#: MIME types of visual resources by resource type: fixed values.
VISUAL = {
    "stylesheet": ("text/css",),
    "image": tuple(f"image/{x}" for x in ("avif", "bmp", "gif", "jpeg", "png", "svg+xml", "webp", "x-icon", "vnd.microsoft.icon")),
    "font": (
        "font/woff", "font/woff2", "font/ttf", "font/otf", "font/collection",
        "application/font-woff", "application/x-font-ttf", "application/x-font-opentype", "application/vnd.ms-fontobject",
    ),
}


def is_external_visual(url: Column, resource_type: Column, mime: Column) -> Column:
    """An https stylesheet, image or font whose MIME type fits, from a URL without userinfo."""
    base = F.lower(F.trim(F.substring_index(text(mime), ";", 1)))
    fits = reduce(Column.__or__, ((text(resource_type) == kind) & base.isin(*types) for kind, types in VISUAL.items()))
    return flag(text(url).rlike(r"^(?i:https)://[^/?#@]+([/?#]|$)") & fits)


def bounded_utf8(c: Column, n: int) -> Column:
    """Cut at n UTF-8 bytes, never inside a character: the cut goes back over at most three continuation bytes."""
    data = c.cast("binary")
    back = F.lit(0)
    for k in (3, 2, 1):  # the byte after a cut at n - k must not be a continuation byte
        lead = F.conv(F.hex(F.substring(data, n - k + 1, 1)), 16, 10).cast("int")
        back = F.when(lead.bitwiseAND(F.lit(192)) != 128, F.lit(k)).otherwise(back)
    lead = F.conv(F.hex(F.substring(data, n + 1, 1)), 16, 10).cast("int")
    back = F.when(lead.bitwiseAND(F.lit(192)) != 128, F.lit(0)).otherwise(back)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.substring(data, F.lit(1), F.lit(n) - back).cast("string"))


#: Role by path, in order: fixed values.
PATH_ROLES = (
    ("AUTH_LOGIN", r"/(?:login|log-in|sign-in|signin|dang-nhap)(?:/|$)"),
    ("AUTH_REGISTER", r"/(?:register|sign-up|signup|create-account|dang-ky)(?:/|$)"),
    ("AUTH_FORGOT_PASSWORD", r"/(?:forgot|forgot-password|reset-password|recover|quen-mat-khau)(?:/|$)"),
    ("AUTH_VERIFY_OR_STATUS", r"/(?:verify|verify-email|verification|email-verification|activate|confirm-email|auth-status|account-status)(?:/|$)"),
    ("PRICING", r"/(?:pricing|plans|bang-gia)(?:/|$)"),
    ("CONTACT", r"/(?:contact|contact-us|lien-he)(?:/|$)"),
    ("DOWNLOAD", r"/(?:download|downloads|tai-ve)(?:/|$)"),
    ("PARTNER", r"/(?:partners?|doi-tac)(?:/|$)"),
    ("AFFILIATE", r"/(?:affiliate|affiliates)(?:/|$)"),
    ("LEGAL_TEXT", r"/(?:privacy|terms|legal|cookies?|policy|dieu-khoan)(?:/|$)"),
    ("COMPARISON_DETAIL", r"/(?:vs|compare|comparison)/"),
)
#: Sections with an index and details: fixed values.
SECTIONS = (
    ("BLOG_INDEX", "BLOG_DETAIL", ("blog", "blogs", "news", "articles", "tin-tuc")),
    ("USE_CASE_INDEX", "USE_CASE_DETAIL", ("use-case", "use-cases", "case-study", "case-studies")),
    ("PRODUCT_LIST", "PRODUCT_DETAIL", ("product", "products", "san-pham")),
)
DETAIL_ROLES = ("PRODUCT_DETAIL", "BLOG_DETAIL", "USE_CASE_DETAIL", "COMPARISON_DETAIL")
IDENTIFIER = r"(?i)^(?:[0-9]+|[0-9a-f]{16,}|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})$"
#: ISO 639-1 codes, and three-letter codes in use on web pages: fixed values.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv "
    "ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my "
    "na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts "
    "tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu fil haw yue ceb ckb hmn"
).split()
#: One pattern: a list of literals is built and analysed anew for each use.
LOCALE = rf"^(?:{'|'.join(LANGUAGES)})(?:-[a-z]{{2}}|-[0-9]{{3}})?$"


def one_of(names: tuple[str, ...]):
    return lambda s: s.isin(*names)


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_locale(c: Column) -> Column:
    return flag(F.lower(c).rlike(LOCALE))


def semantic_role(url: Column, status: Column, h1: Column) -> Column:
    """One of 22 roles by status, path and heading words, in this order."""
    segments = F.transform(path_segments(url), lambda s: F.lower(s))
    n, path = F.size(segments), F.concat(F.lit("/"), F.concat_ws("/", segments))
    words = F.lower(F.concat_ws(" ", h1))
    out = F.when(status.between(500, 599), "ERROR_5XX").when(status.between(400, 499), "ERROR_4XX")
    out = out.when((n == 0) | (n == 1) & is_locale(segments[0]), "HOME")
    for role, pattern in PATH_ROLES:
        out = out.when(path.rlike(pattern), role)
    for index_role, detail_role, names in SECTIONS:
        # the first segment that is any of the names
        place = F.array_position(F.transform(segments, one_of(names)), True)
        out = out.when((place > 0) & (place == n), index_role).when(place > 0, detail_role)
    out = out.when(words.rlike(r"\b(?:sign in|log in)\b|đăng nhập"), "AUTH_LOGIN").when(words.rlike(r"\b(?:sign up|register)\b|đăng ký"), "AUTH_REGISTER")
    return out.when(n <= F.when(is_locale(segments[0]), 2).otherwise(1), "MARKETING_LANDING").otherwise("UNKNOWN")


def route_template(url: Column, role: Column, locale: Column) -> Column:
    """The path with ids and the names of details as placeholders."""
    segments = path_segments(url)
    start = F.when((locale != "und") & (F.lower(F.get(segments, F.lit(0))) == locale), 1).otherwise(0)
    parts = F.transform(
        segments,
        lambda s, i: F.when(s.rlike(IDENTIFIER), "{id}").when(role.isin(*DETAIL_ROLES) & (i == F.size(segments) - 1) & (i >= start), "{slug}").otherwise(F.lower(s)),
    )
    return F.when(role == "ERROR_4XX", "/{error-4xx}").when(role == "ERROR_5XX", "/{error-5xx}").otherwise(F.concat(F.lit("/"), F.concat_ws("/", parts)))


def layout_hint(status: Column, h1: Column, h2: Column, scripts: Column, stylesheets: Column, types: Column) -> Column:
    return F.concat_ws(
        "|", F.floor(status / 100).cast("string"), F.greatest(F.size(h1), F.lit(0)).cast("string"), F.greatest(F.size(h2), F.lit(0)).cast("string"),
        scripts.cast("string"), stylesheets.cast("string"), F.concat_ws(",", F.array_sort(F.transform(types, lambda t: F.lower(t)))),
    )


def locale_of(value: Column) -> Column:
    """A language tag in its normal form, or null if it is none."""
    tag = F.lower(F.replace(F.trim(value), F.lit("_"), F.lit("-")))
    return F.when(is_locale(tag), tag)


def with_findings(pages: DataFrame) -> DataFrame:
    return pages.withColumn("findings", page_findings())
