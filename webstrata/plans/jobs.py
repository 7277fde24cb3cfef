"""Composite jobs: stored fetches to page facts, and the plan of a site archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html, rules
from webstrata.operators import archive


def build_page_facts(fetches: DataFrame) -> DataFrame:
    """Classified and parsed pages with indexability and findings; one Python pass over the bodies.

    fetches: page_id, owner_id, scan_id, final_url, requested_url, scope_host, status_code,
    content_type, x_robots_tag, body, body_truncated, error_code, redirects, ...
    """
    outcome = rules.fetch_outcome(F.col("error_code"), F.col("body_truncated"), F.col("status_code"))
    rows = fetches.withColumn("_o", outcome).withColumn("url", F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("requested_url")))
    rows = rows.withColumns({
        "fetch_outcome": F.col("_o.outcome"), "error_code": F.col("_o.error_code"), "is_html": rules.is_html(F.col("content_type")), "has_body": F.octet_length("body") > 0,
        "redirect_count": F.greatest(F.size("redirects"), F.lit(0)), "body_bytes": F.octet_length("body").cast("bigint"),
    })
    read = F.when(F.col("_o.parse") & F.col("is_html"), F.col("body")).otherwise("")
    kept = [c for c in rows.columns if c not in ("body", "_o")]
    facts = html.parse_pages(rows.withColumn("_html", read).drop("body", "_o"), html="_html", keep=kept)
    reason = rules.indexability(F.col("status_code"), F.col("meta_robots"), F.col("x_robots_tag"))
    parsed = (F.col("fetch_outcome").isin("SUCCESS", "HTTP_ERROR")) & F.col("is_html")
    facts = facts.withColumn("indexability_reason", F.when(parsed, reason).otherwise("")).withColumn("is_indexable", F.col("indexability_reason") == "INDEXABLE")
    facts = facts.withColumn("links", F.when(parsed, F.col("links")).otherwise(F.array().cast(facts.schema["links"].dataType)))
    internal = F.size(F.filter("links", lambda x: x["is_internal"]))
    facts = facts.withColumn("internal_links", internal).withColumn("external_links", F.size("links") - internal)
    return facts.withColumn("findings", rules.page_findings())


def findings_of(facts: DataFrame) -> DataFrame:
    rows = facts.select("owner_id", "scan_id", "page_id", F.explode("findings").alias("f"))
    return rows.select(
        "owner_id", "scan_id", "page_id", rules.uuid5(F.col("page_id"), F.concat_ws(":", "f.rule_id", F.col("f.rule_version").cast("string"))).alias("finding_id"),
        "f.rule_id", "f.rule_version", "f.category", "f.severity", F.col("f.code").alias("finding_code"), F.col("f.evidence").alias("evidence_json"),
    )


def links_of(facts: DataFrame) -> DataFrame:
    rows = facts.select("owner_id", "scan_id", F.col("page_id").alias("source_page_id"), F.explode("links").alias("l"))
    return rows.select(
        "owner_id", "scan_id", "source_page_id", rules.uuid5(F.col("source_page_id"), F.concat_ws(":", F.col("l.ordinal").cast("string"), "l.target_url")).alias("edge_id"),
        "l.target_url", F.sha2("l.target_url", 256).alias("target_hash"), "l.anchor_text", "l.tag", "l.is_internal", "l.is_followable", "l.ordinal",
    )


def plan_site_archive(pages: DataFrame, files: DataFrame, css: DataFrame, most_shard: int, most_total: int) -> dict[str, DataFrame]:
    """The plan of each job's archive: representatives, files on their final paths with their shards, counts, reasons, paths whose aliases end nowhere.

    pages: job_id, page_id, ordinal, url, local_path, status, reason, semantic_role,
    route_template, layout_fingerprint, rendered, resource_gaps. files: job_id, page_id,
    kind, path, source_url, content_type, sha256, bytes, file_no. css: job_id, path,
    source_url, body, for stylesheets.
    """
    chosen = archive.layout_representatives(pages)
    own = files.join(chosen.where("representative").select("job_id", "page_id"), ["job_id", "page_id"], "left_semi")
    deduped = archive.asset_dedup(own)
    sheets = archive.css_alias_closure(css, own.select("job_id", F.col("source_url").alias("url"), "path").where("url is not null").distinct())
    aliases = sheets.select("job_id", "path", F.col("canonical_path").alias("to")).unionByName(deduped.select("job_id", "path", F.col("canonical_path").alias("to")))
    ends = archive.resolve_aliases(aliases.distinct())
    there = ends.select("job_id", F.lower("path").alias("_key"), F.col("canonical_path").alias("_end"))
    final = deduped.withColumn("_key", F.lower("path")).join(there, ["job_id", "_key"], "left").withColumn("path", F.coalesce("_end", "path"))
    listed = archive.archive_files(final.select("job_id", "path", "sha256", "bytes", "file_no"))
    judged = chosen.withColumn("reason", F.coalesce(F.when(~F.col("representative"), "LAYOUT_DUPLICATE"), F.col("reason")))
    return {
        "pages": judged, "files": listed.join(archive.shard_plan(listed.where("not collision"), most_shard, most_total), ["job_id", "path"], "left"),
        "css": sheets, "problems": ends.where("problem is not null").select("job_id", "path", "problem"), "counts": archive.archive_counts(judged), "reasons": archive.reason_counts(judged),
    }
