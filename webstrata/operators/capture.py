"""Browser captures: static against rendered pages, network rows with bodies, budgets, vitals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.functions import rules

#: Rows of a capture that are kept: fixed values.
MOST_NETWORK, MOST_BODIES = 500, 100


def changed(a: Column, b: Column) -> Column:
    return rules.text(a) != rules.text(b)


def static_rendered_diff(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """What scripts changed on each page; missing values count as empty, types are compared as lower-case sets in order."""
    key = ["owner_id", "scan_id", "page_id"]
    s, r = static.alias("s"), rendered.alias("r")
    joined = s.join(r, [F.col(f"s.{k}") == F.col(f"r.{k}") for k in key])
    pair = lambda c: (F.col(f"s.{c}"), F.col(f"r.{c}"))
    types = lambda c: F.array_sort(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(t)))
    out = joined.select(
        *(F.col(f"s.{k}").alias(k) for k in key),
        changed(*pair("title")).alias("title_changed"), changed(*pair("meta_description")).alias("description_changed"), changed(*pair("canonical_url")).alias("canonical_changed"),
        changed(F.get("s.h1", F.lit(0)), F.get("r.h1", F.lit(0))).alias("h1_changed"),
        (F.coalesce("r.link_count", F.lit(0)) - F.coalesce("s.link_count", F.lit(0))).alias("link_delta"),
        (F.coalesce("r.image_count", F.lit(0)) - F.coalesce("s.image_count", F.lit(0))).alias("image_delta"),
        (types(F.col("s.schema_types")) != types(F.col("r.schema_types"))).alias("schema_changed"),
    )
    content = F.col("title_changed") | F.col("description_changed") | F.col("h1_changed") | (F.col("link_delta") != 0) | (F.col("image_delta") != 0)
    return out.withColumn("content_changed", content)


def merge_resource_bodies(network: DataFrame, resources: DataFrame, most_network: int = MOST_NETWORK, most_bodies: int = MOST_BODIES) -> DataFrame:
    """Network rows with the first body of their sequence; caps per capture come before the join."""
    key = ["owner_id", "capture_request_id"]
    rows = network_waterfall(network, most_network)
    place = Window.partitionBy(*key).orderBy("request_sequence", "resource_id")
    bodies = resources.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= most_bodies)
    body = F.struct("resource_id", "body_bytes", "body_sha256", "was_truncated")
    first = bodies.groupBy(*key, "request_sequence").agg(F.min(body).alias("body"))
    out = rows.join(first, [*key, "request_sequence"], "left")
    return out.select(
        *rows.columns, F.col("body.resource_id").isNotNull().alias("body_captured"), F.col("body.resource_id").alias("resource_id"),
        F.coalesce("body.body_bytes", F.lit(0)).alias("body_bytes"), F.col("body.body_sha256").alias("body_sha256"), F.coalesce("body.was_truncated", F.lit(False)).alias("was_truncated"),
    )


def network_waterfall(network: DataFrame, most: int = MOST_NETWORK) -> DataFrame:
    place = Window.partitionBy("owner_id", "capture_request_id").orderBy("request_sequence", "request_id")
    return network.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= most).drop("_place")


def resource_filter(resources: DataFrame, kind: str = "all", query: str = "") -> DataFrame:
    out = resources if kind == "all" else resources.where(F.col("resource_type") == kind)
    return out.where(F.contains(F.lower("url"), F.lit(query.lower()))) if query else out


def latest_capture(captures: DataFrame) -> DataFrame:
    done = captures.where(F.col("status").isin("COMPLETED", "PARTIAL_SUCCESS"))
    rest = [c for c in captures.columns if c not in ("owner_id", "scan_id", "page_id")]
    newest = done.groupBy("owner_id", "scan_id", "page_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_row"))
    return newest.select("owner_id", "scan_id", "page_id", "_row.*")


def body_budget(resources: DataFrame, max_bodies: int, max_resource_bytes: int, max_bytes: int) -> DataFrame:
    """Adds kept_bytes, truncated and skip to (capture_request_id, request_sequence, body_length, skip_reason).

    Rows with a reason or without a body cost nothing; of the others the first
    ``max_bodies`` get bodies, each at most max_resource_bytes and what is left of
    max_bytes. As bodies are cut to fit, what is left has a closed form: the budget
    less the sum of earlier lengths, each cut to the resource's bound.
    """
    order = Window.partitionBy("capture_request_id").orderBy("request_sequence")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("skip_reason").isNull()
    rows = resources.withColumn("_open", open_).withColumn("_no", F.sum(open_.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gets = F.col("_open") & (F.col("_no") <= max_bodies)
    size = F.when(gets, F.least(F.coalesce("body_length", F.lit(0)), F.lit(max_resource_bytes))).otherwise(0)
    rows = rows.withColumn("_gets", gets).withColumn("_size", size)
    rows = rows.withColumn("_left", F.greatest(F.lit(max_bytes) - F.coalesce(F.sum("_size").over(before), F.lit(0)), F.lit(0)))
    skip = (
        F.when(~F.col("_open"), F.col("skip_reason")).when(~F.col("_gets"), "RESOURCE_BODY_COUNT_LIMIT").when(F.col("_left") <= 0, "CAPTURE_BYTE_BUDGET_EXCEEDED")
        .when(F.col("body_length").isNull(), "BODY_UNAVAILABLE").when(F.col("body_length") == 0, "EMPTY_BODY")
    )
    kept = F.when(skip.isNull(), F.least("_size", "_left")).otherwise(0)
    return rows.select(*resources.columns, kept.cast("long").alias("kept_bytes"), (skip.isNull() & (F.col("body_length") > kept)).alias("truncated"), skip.alias("skip"))


def web_vitals(entries: DataFrame) -> DataFrame:
    """Per capture: LCP (the last entry's start) and CLS (shifts without recent input) with their status."""
    lcp = F.max_by(F.when(F.col("kind") == "lcp", F.col("start_ms")), F.when(F.col("kind") == "lcp", F.col("entry_no")))
    shift = (F.col("kind") == "shift") & ~F.coalesce("recent_input", F.lit(False))
    seen = F.count_if(F.col("kind") == "shift") > 0
    rows = entries.groupBy("capture_request_id").agg(lcp.alias("_lcp"), F.when(seen, F.sum(F.when(shift, F.col("value")).otherwise(0.0))).alias("_cls"))
    return rows.select("capture_request_id", rules.measurement(F.col("_lcp"), "LCP_NOT_OBSERVED").alias("lcp"), rules.measurement(F.col("_cls"), "CLS_NOT_OBSERVED").alias("cls"))


def capture_report(jobs: DataFrame, snapshots: DataFrame, reconstructions: DataFrame, artifacts: DataFrame, now: Column) -> DataFrame:
    """A capture with its snapshot, reconstruction and the archive of the same lease generation."""
    rows = jobs.alias("j").join(snapshots.alias("s"), F.col("s.capture_request_id") == F.col("j.id"), "left")
    rows = rows.join(reconstructions.alias("r"), F.col("r.capture_request_id") == F.col("j.id"), "left")
    archive = artifacts.where(F.col("kind") == "STATIC_ARCHIVE").alias("a")
    rows = rows.join(archive, (F.col("a.reconstruction_id") == F.col("r.id")) & (F.col("a.lease_generation") == F.col("r.lease_generation")), "left")
    gone = F.col("a.status").isin("DELETE_PENDING", "DELETING", "DELETED") | (F.col("a.delete_after") <= now)
    status = F.when(F.col("r.status").isin("PUBLISHED", "PARTIAL") & F.coalesce(gone, F.lit(False)), "EXPIRED").otherwise(F.col("r.status"))
    return rows.select(
        F.col("j.owner_id").alias("owner_id"), F.col("j.id").alias("capture_request_id"), F.col("s.id").alias("snapshot_id"), status.alias("reconstruction_status"),
        F.coalesce((status == "PUBLISHED") & F.col("a.id").isNotNull(), F.lit(False)).alias("download_available"), F.col("a.id").alias("artifact_id"),
    )
