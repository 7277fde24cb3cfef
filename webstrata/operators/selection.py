"""Choice of representative pages, and the targets of a site archive."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions import rules, urls
from webstrata.sources.tables import written

#: Paths that are not pages: fixed values.
DOWNLOAD = r"(?i)\.(?:7z|avi|csv|docx?|exe|gz|mp3|mp4|mov|pdf|rar|tar|webm|xlsx?|zip)$"
STATIC = r"(?i)\.(?:avif|bmp|css|gif|ico|jpe?g|js|json|map|png|svg|webp|woff2?|xml)$"
POLICY = r"(?i)/(?:api|feeds?|robots\.txt|sitemaps?)(?:/|\.|$)"


@F.pandas_udf(T.StringType())
def design_join(base: pd.Series, ref: pd.Series) -> pd.Series:
    """The design form of a reference resolved against a base; null if there is none or it is bad."""

    def one(b: str | None, r: str | None) -> str | None:
        if not b or not r or not r.strip():
            return None
        try:
            return urls.design(urljoin(b, r.strip()))
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def path_locale(url: Column) -> Column:
    return rules.locale_of(F.get(rules.path_segments(url), F.lit(0)))


def page_locale(pages: DataFrame) -> DataFrame:
    """Adds ``page_locale``: by path, html lang, same-origin canonical, self-referencing hreflang, else und.

    Needs normalized_url, canonical (design form), html_lang, hreflang with url in design form.
    """
    own = origin(F.col("normalized_url"))
    by_canonical = F.when(origin(F.col("canonical")) == own, path_locale(F.col("canonical")))
    hits = F.filter(
        "hreflang_design",
        lambda h: rules.locale_of(h["language"]).isNotNull() & (origin(h["url"]) == own) & (without_query(h["url"]) == without_query(F.col("normalized_url"))),
    )
    by_hreflang = rules.locale_of(F.get(hits, F.lit(0))["language"])
    found = F.coalesce(path_locale(F.col("normalized_url")), rules.locale_of(F.col("html_lang")), by_canonical, by_hreflang, F.lit("und"))
    return pages.withColumn("page_locale", found)


def design_urls(pages: DataFrame) -> DataFrame:
    """Adds raw_url, normalized_url (null: bad), canonical and hreflang in design form."""
    raw = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))
    rows = pages.withColumn("raw_url", raw).withColumn("normalized_url", urls.normalize_design_url(F.col("raw_url")))
    rows = rows.withColumn("canonical", design_join(F.concat(origin(F.col("normalized_url")), F.lit("/")), F.col("canonical_url")))
    # hreflang entries that are absolute are compared as they are; a page has 100 at most
    trimmed = lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), r"(?<=[^/])/+(?=\?|$)", "")
    empty = F.array().cast("array<struct<language:string,url:string>>")
    absolute = lambda u: F.when(u.startswith("/"), F.concat(origin(F.col("normalized_url")), u)).otherwise(u)
    entries = F.transform(F.coalesce("hreflang", empty), lambda h: F.struct(h["language"].alias("language"), trimmed(absolute(h["url"])).alias("url")))
    return rows.withColumn("hreflang_design", entries)


def status_rank(status: Column) -> Column:
    return F.when(status.between(200, 299), 0).when(status.between(300, 399), 1).when(status.between(400, 499), 2).when(status.between(500, 599), 3).otherwise(4)


def candidate_order() -> Column:
    return F.struct(
        F.col("had_query").cast("int").alias("a"), (~F.col("canonical_self")).cast("int").alias("b"), status_rank(F.col("status_code")).alias("c"),
        F.length("normalized_url").alias("d"), F.col("normalized_url").alias("e"), F.col("id").alias("f"),
    )


def winners(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``wins``: whether the row is first of its group. The least is an aggregate, so a large group costs no sort."""
    least = candidates.groupBy(*keys).agg(F.min(candidate_order()).alias("_least"))
    return candidates.join(least, keys).withColumn("wins", candidate_order() == F.col("_least")).drop("_least")


def canonical_winners(candidates: DataFrame) -> DataFrame:
    return winners(candidates, ["scan_id", "identity"])


def template_winners(candidates: DataFrame) -> DataFrame:
    return winners(candidates, ["scan_id", "role", "template", "hint"])


def root_locales(pages: DataFrame) -> DataFrame:
    """(scan_id, root_origin, root_locale), from each scan's root page where it was fetched, else from the root URL."""
    root = pages.select("scan_id", "root_url").distinct().withColumn("root", urls.normalize_design_url(F.col("root_url")))
    own = pages.join(root.select("scan_id", "root"), "scan_id").where(F.col("normalized_url") == F.col("root"))
    first = page_locale(own).groupBy("scan_id").agg(F.min_by("page_locale", F.struct("raw_url", "id")).alias("found"))
    rows = root.join(first, "scan_id", "left")
    return rows.select("scan_id", origin(F.col("root")).alias("root_origin"), F.coalesce("found", path_locale(F.col("root")), F.lit("und")).alias("root_locale"))


def select_design_pages(pages: DataFrame) -> DataFrame:
    """One row per page: scan_id, id, normalized_url, locale, role, template, verdict (SELECTED or the reason of rejection).

    pages: scan_id, root_url, budget_limited, id, url, final_url, outcome (public form),
    status_code, content_type, canonical_url, html_lang, hreflang, h1, h2,
    schema_org_types, scripts, stylesheets. Order is binary order of URLs and ids.
    """
    rows = written(design_urls(pages))  # parsed once, read several times below
    rows = page_locale(rows).join(root_locales(rows), "scan_id")
    mime = F.lower(F.trim(F.substring_index(rules.text(F.col("content_type")), ";", 1)))
    path = urls.url_path(F.col("normalized_url"))
    is_page = mime.isin("", "text/html", "application/xhtml+xml") & ~path.rlike(DOWNLOAD) & ~path.rlike(STATIC)
    failed = ((F.col("outcome") == "failed") | (F.col("status_code") == 0)) & ~F.col("status_code").between(400, 599)
    other_locale = (F.col("root_locale") != "und") & (F.col("page_locale") != "und") & (F.col("page_locale") != F.col("root_locale"))
    external = ~F.col("normalized_url").rlike(r"^https?://") | (origin(F.col("normalized_url")) != F.col("root_origin"))
    reason = (
        F.when(F.col("normalized_url").isNull(), "HTTP_FAILURE").when(external, "EXTERNAL_ORIGIN").when(~is_page, "NON_HTML")
        .when(F.col("outcome") == "warning", "ROBOTS_OR_POLICY_BLOCKED").when(failed, "HTTP_FAILURE")
        .when(path.rlike(POLICY), "ROBOTS_OR_POLICY_BLOCKED").when(other_locale, "ALTERNATE_LOCALE")
    )
    canonical = F.when(origin(F.col("canonical")) == F.col("root_origin"), F.col("canonical"))
    rows = rows.withColumn("reason", reason).withColumn("own_canonical", canonical)
    role = rules.semantic_role(F.col("normalized_url"), F.col("status_code"), F.col("h1"))
    judged = rows.select(
        "scan_id", "id", "raw_url", "status_code", "reason", "budget_limited", "own_canonical",
        F.when(F.col("reason") == "EXTERNAL_ORIGIN", urls.redact_url(F.col("raw_url"))).otherwise(rules.text(F.col("normalized_url"))).alias("normalized_url"),
        F.when(F.col("page_locale") == "und", F.col("root_locale")).otherwise(F.col("page_locale")).alias("locale"), "root_locale", role.alias("role"),
        rules.layout_hint(F.col("status_code"), F.col("h1"), F.col("h2"), F.col("scripts"), F.col("stylesheets"), F.col("schema_org_types")).alias("hint"),
        without_query(F.coalesce("own_canonical", "normalized_url")).alias("identity"),
        F.regexp_replace(F.substring_index("raw_url", "#", 1), r"^[^?]*\??", "").rlike(".").alias("had_query"),
        F.coalesce(without_query(F.col("own_canonical")) == without_query(F.col("normalized_url")), F.lit(False)).alias("canonical_self"),
    )
    judged = written(judged.withColumn("template", rules.route_template(F.col("normalized_url"), F.col("role"), F.col("root_locale"))))
    out = ["scan_id", "id", "raw_url", "budget_limited", "normalized_url", "locale", "role", "template"]
    first = canonical_winners(judged.where("reason is null"))
    variant = F.when(F.col("own_canonical").isNotNull(), "CANONICAL_DUPLICATE").otherwise("TRACKING_OR_QUERY_VARIANT")
    second = template_winners(first.where("wins").drop("wins"))
    parts = (
        judged.where("reason is not null").select(*out, F.col("reason").alias("verdict")),
        first.where("not wins").select(*out, variant.alias("verdict")),
        second.select(*out, F.when(F.col("wins"), "SELECTED").otherwise("SEMANTIC_TEMPLATE_DUPLICATE").alias("verdict")),
    )
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    last = judged.groupBy("scan_id").agg(F.max(F.struct("raw_url", "id")).alias("last"), F.count(F.lit(1)).alias("n"), F.max("budget_limited").alias("limited"))
    last = last.where("limited and n > 1").select("scan_id", F.col("last.id").alias("id"), F.lit(True).alias("cut"))
    all_ = all_.join(last, ["scan_id", "id"], "left")
    verdict = F.when(F.col("cut"), "BUDGET_LIMITED").otherwise(F.col("verdict"))
    return all_.select("scan_id", "id", "raw_url", "normalized_url", "locale", "role", "template", verdict.alias("verdict"))


def clone_targets(selection: DataFrame, jobs: DataFrame) -> DataFrame:
    """(scan_id, page_id, ordinal, url, local_path, status, reason): selected pages first, then the rejected, cancelled.

    jobs: scan_id, job_id, root_url. Where nothing was selected the root alone is the
    target. Local paths: index.html for the root, else pages/<id>.html and rejected/<id>.html;
    rows of a page that has one already are left out.
    """
    from pyspark.sql.window import Window

    selected = F.col("verdict") == "SELECTED"
    has = selection.groupBy("scan_id").agg(F.max(selected).alias("any"))
    rows = selection.dropDuplicates(["scan_id", "id"]).join(has, "scan_id").where("any").join(jobs.select("scan_id", "root_url"), "scan_id")
    order = Window.partitionBy("scan_id").orderBy(F.when(selected, 0).otherwise(1), "raw_url", "id")
    is_root = F.col("normalized_url") == urls.normalize_design_url(F.col("root_url"))
    path = F.when(~selected, F.concat(F.lit("rejected/"), "id", F.lit(".html"))).when(is_root, "index.html").otherwise(F.concat(F.lit("pages/"), "id", F.lit(".html")))
    listed = rows.select(
        "scan_id", F.col("id").alias("page_id"), (F.row_number().over(order) - 1).alias("ordinal"), F.coalesce(F.nullif(F.col("normalized_url"), F.lit("")), "raw_url").alias("url"),
        path.alias("local_path"), F.when(selected, "QUEUED").otherwise("CANCELLED").alias("status"), F.when(~selected, F.col("verdict")).alias("reason"),
    )
    alone = jobs.join(has.where("any").select("scan_id"), "scan_id", "left_anti").select(
        "scan_id", F.col("job_id").alias("page_id"), F.lit(0).alias("ordinal"), F.col("root_url").alias("url"), F.lit("index.html").alias("local_path"), F.lit("QUEUED").alias("status"), F.lit(None).cast("string").alias("reason")
    )
    return listed.unionByName(alone)
