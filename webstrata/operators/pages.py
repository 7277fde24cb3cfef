"""Filters, reports and page lists over page facts and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.functions import rules
from webstrata.operators import order

PAGE = ["owner_id", "scan_id", "page_id"]


def current_view(df: DataFrame, keys: list[str], version: str = "record_version", tie: str | None = None) -> DataFrame:
    """The newest version of each key; tombstones are dropped after that choice.

    An aggregate of the largest (version, tie, row), so rows of a key are combined
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(version).alias("_v"), *([F.col(tie).alias("_t")] if tie else [])]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*").where(~F.coalesce("is_deleted", F.lit(False))).select(*df.columns)


def outcome_is(name: str) -> Column:
    outcome, status = F.upper("fetch_outcome"), F.col("status_code")
    return {
        "SUCCESS": (outcome == "SUCCESS") & (status < 400),
        "WARNING": outcome == "SKIPPED",
        "FAILED": (outcome != "SKIPPED") & ((outcome != "SUCCESS") | (status >= 400)),
    }.get(name, F.lit(False))


def filter_pages(
    pages: DataFrame, findings: DataFrame, *, outcomes: tuple[str, ...] = (), status_min: int | None = None, status_max: int | None = None, query: str = "",
    indexable: bool | None = None, content_types: tuple[str, ...] = (), severities: tuple[str, ...] = (), codes: tuple[str, ...] = (),
) -> DataFrame:
    """Pages that meet all filters given; severity and code must be those of one finding."""
    conditions: list[Column] = []
    if outcomes:
        conditions.append(reduce(Column.__or__, map(outcome_is, outcomes)))
    if status_min is not None:
        conditions.append(F.col("status_code") >= status_min)
    if status_max is not None:
        conditions.append(F.col("status_code") <= status_max)
    if query:
        conditions.append(F.contains(F.lower("normalized_url"), F.lit(query.lower())))
    if indexable is not None:
        conditions.append(F.col("is_indexable") == indexable)
    if content_types:
        conditions.append(F.lower("content_type").isin(*content_types))
    out = pages.where(reduce(Column.__and__, conditions)) if conditions else pages
    if severities or codes:
        hit = findings
        if severities:
            hit = hit.where(F.upper("severity").isin(*severities))
        if codes:
            hit = hit.where(F.upper("finding_code").isin(*codes))
        out = out.join(hit.select(*PAGE), PAGE, "left_semi")
    return out


def finding_counts(findings: DataFrame) -> DataFrame:
    issue = F.upper("severity").isin(*rules.ISSUE_SEVERITIES)
    return findings.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("finding_count"), F.count_if(issue).alias("issue_finding_count"))


def with_counts(pages: DataFrame, findings: DataFrame) -> DataFrame:
    out = pages.join(finding_counts(findings), PAGE, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("finding_count", "issue_finding_count")})


def is_issue() -> Column:
    return ~F.lower("fetch_outcome").isin("success", "skipped") | (F.col("status_code") >= 400) | (F.col("issue_finding_count") > 0)


def issue_pages(pages: DataFrame, findings: DataFrame) -> DataFrame:
    return with_counts(pages, findings).where(is_issue()).select(*pages.columns)


def seo_gaps(pages: DataFrame) -> DataFrame:
    empty = (rules.text(F.col("title")) == "") | (F.coalesce(F.size("h1"), F.lit(0)) <= 0) | (rules.text(F.col("canonical_url")) == "")
    return pages.where((F.upper("fetch_outcome") == "SUCCESS") & empty)


def scan_summary(pages: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Per scan. Findings are counted per page before the join, which keeps the page key's partitioning;
    without ``findings`` they are those in the pages' own column, and there is no join."""
    status = F.col("status_code")
    within = lambda a: F.count_if((status >= a) & (status < a + 100))
    if findings is None:
        issue = F.filter("findings", lambda f: F.upper(f["severity"]).isin(*rules.ISSUE_SEVERITIES))
        counted = pages.withColumns({"finding_count": F.greatest(F.size("findings"), F.lit(0)).cast("long"), "issue_finding_count": F.greatest(F.size(issue), F.lit(0)).cast("long")})
    else:
        counted = with_counts(pages, findings)
    return counted.groupBy("owner_id", "scan_id").agg(
        F.count(F.lit(1)).alias("total_urls"), F.count_if(is_issue()).alias("issue_pages"), F.sum("finding_count").alias("finding_count"),
        within(200).alias("status_2xx"), within(300).alias("status_3xx"), within(400).alias("status_4xx"), within(500).alias("status_5xx"),
        F.count_if((status < 200) | (status >= 600)).alias("no_response"),
    )


def share(count: Column, total: Column) -> Column:
    return F.floor(count * 100 / F.greatest(total, F.lit(1)) + 0.5).cast("long")


def summary_shares(summary: DataFrame) -> DataFrame:
    buckets = ("status_2xx", "status_3xx", "status_4xx", "status_5xx", "no_response")
    return summary.select("owner_id", "scan_id", *(share(F.col(b), F.col("total_urls")).alias(f"{b}_share") for b in buckets))


def outcome_latency(pages: DataFrame) -> DataFrame:
    """Pages, exact median and 95 % latency, and bytes by outcome and status; a few groups hold all pages."""
    keys = ["fetch_outcome", "status_code"]
    rows = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.sum("response_bytes").alias("response_bytes"))
    latencies = order.quantiles(pages, keys, "total_ms", {"p50_ms": "0.5", "p95_ms": "0.95"})
    return order.same(rows, latencies, keys).select(*keys, "pages", "p50_ms", "p95_ms", "response_bytes").orderBy(F.desc("pages"), *keys)


def finding_distribution(findings: DataFrame) -> DataFrame:
    rows = findings.groupBy("severity", "category", "rule_id").agg(F.count(F.lit(1)).alias("findings"))
    return rows.orderBy(F.desc("findings"), "severity", "category", "rule_id")


def pages_with_findings(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages with their findings, ordered; an empty list where there are none."""
    item = F.struct("severity", "rule_id", "finding_id", "rule_version", "category", "finding_code", "evidence_json")
    listed = findings.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("findings"))
    out = pages.join(listed, PAGE, "left")
    empty = F.array().cast(out.schema["findings"].dataType)
    return out.withColumn("findings", F.transform(F.coalesce("findings", empty), lambda f: f.withField("evidence", F.from_json(f["evidence_json"], "map<string,string>"))))


def findings_for_page(findings: DataFrame, most: int = 5000) -> DataFrame:
    by = Window.partitionBy(*PAGE).orderBy("severity", "rule_id", "finding_id")
    return findings.withColumn("position", F.row_number().over(by)).where(F.col("position") <= most)


def keyset(df: DataFrame, order: list[str], after: tuple | None, n: int, descending: bool = False) -> DataFrame:
    """n + 1 rows after a cursor in the order of unique columns; ``has_more`` tells whether the last is one too many."""
    if after is not None:
        later = F.lit(False)
        for k in range(len(order) - 1, -1, -1):
            past = F.col(order[k]) < F.lit(after[k]) if descending else F.col(order[k]) > F.lit(after[k])
            later = past if k == len(order) - 1 else past | (F.col(order[k]) == F.lit(after[k])) & later
        df = df.where(later)
    return df.orderBy(*(F.desc(c) if descending else F.asc(c) for c in order)).limit(n + 1)


def page_keyset(pages: DataFrame, after: tuple[str, str] | None, n: int) -> DataFrame:
    return keyset(pages, ["normalized_url", "page_id"], after, n)


def next_cursor(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """(has_more, cursor) of a keyset page: the cursor is its n-th row."""
    item = F.struct(*order)
    listed = rows.agg(F.array_sort(F.collect_list(item)).alias("rows"))
    return listed.select((F.size("rows") > n).alias("has_more"), F.when(F.size("rows") > n, F.get("rows", F.lit(n - 1))).alias("cursor"))


def filter_fingerprint(filters: dict) -> str:
    """Binds a cursor to the filters it was made with."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(filters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def seo_performance_filter(
    pages: DataFrame, rendered: DataFrame, *, canonical: str | None = None, reason: str | None = None, has_hreflang: bool | None = None, has_schema: bool | None = None,
    og_missing: bool | None = None, changed: str | None = None, metric: str | None = None, metric_status: str | None = None, at_least: float | None = None,
) -> DataFrame:
    joined = pages.join(rendered, PAGE)
    conditions = [F.lit(True)]
    if canonical is not None:
        conditions.append(F.col("canonical_relation") == canonical)
    if reason is not None:
        conditions.append(F.col("indexability_reason") == reason)
    if has_hreflang is not None:
        conditions.append((F.size("hreflang_languages") > 0) == has_hreflang)
    if has_schema is not None:
        conditions.append((F.size("schema_types") > 0) == has_schema)
    if og_missing is not None:
        conditions.append((rules.text(F.col("open_graph_title")) == "") == og_missing)
    if changed is not None:
        conditions.append(F.col(f"{changed}_changed"))
    if metric is not None and metric_status is not None:
        conditions.append(F.col(f"{metric}_status") == metric_status)
    if metric is not None and at_least is not None:
        conditions.append((F.col(f"{metric}_status") == "AVAILABLE") & (F.col(f"{metric}_value") >= at_least))
    return joined.where(reduce(Column.__and__, conditions))


def duplicate_signals(pages: DataFrame) -> DataFrame:
    """(owner_id, scan_id, signal, value, pages): values that several pages of a scan share; empty ones don't count."""
    signals = F.array(*(F.struct(F.lit(name).alias("signal"), rules.text(c).alias("value")) for name, c in (
        ("title", F.col("title")), ("description", F.col("meta_description")), ("h1", F.get("h1", F.lit(0))), ("canonical", F.col("canonical_url")),
    )))
    rows = pages.select("owner_id", "scan_id", F.explode(signals).alias("s")).where("s.value <> ''")
    return rows.groupBy("owner_id", "scan_id", "s.signal", "s.value").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")


def pages_with_duplicate(pages: DataFrame, signal: str, column: Column) -> DataFrame:
    shared = duplicate_signals(pages).where(F.col("signal") == signal).select("owner_id", "scan_id", F.col("value").alias("_value"))
    return pages.withColumn("_value", column).join(shared, ["owner_id", "scan_id", "_value"], "left_semi").drop("_value")


def report_freshness(executions: DataFrame) -> DataFrame:
    rows = executions.groupBy("owner_id", "scan_id").agg(F.max("expected").alias("expected"), F.max("published").alias("published"), F.max("last_ingested_at").alias("watermark"))
    return rows.withColumn("is_fresh", F.col("expected") == F.col("published"))
