"""Sources and sinks: stored fetches, staged payloads, fact tables with receipts, manifests."""

from __future__ import annotations

import uuid
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions import rules
from webstrata.sources.tables import laid_down, once

FETCH = (
    "page_id string, owner_id string, scan_id string, requested_url string, final_url string, scope_host string, status_code int, content_type string, "
    "x_robots_tag string, body string, body_truncated boolean, body_bytes bigint, error_code string, redirects array<struct<url:string,status_code:int>>, "
    "dns_ms int, dns_observed boolean, connect_ms int, connect_observed boolean, tls_ms int, tls_observed boolean, ttfb_ms int, ttfb_observed boolean, "
    "total_ms int, accepted_at timestamp, observed_at timestamp"
)
#: The staged payload of a page result: everything that a strict decoder accepts.
PAYLOAD = (
    "owner_id string, scan_id string, page_id string, result_version bigint, accepted_at timestamp, observed_at timestamp, normalized_url string, final_url string, "
    "status_code int, content_type string, fetch_outcome string, error_code string, total_ms int, response_bytes bigint, title string, meta_description string, "
    "canonical_url string, h1 array<string>, hreflang array<struct<language:string,url:string>>, redirects array<struct<url:string,status_code:int>>, "
    "links array<struct<target_url:string,anchor_text:string,tag:string,is_internal:boolean,is_followable:boolean,ordinal:int>>, "
    "findings array<struct<rule_id:string,rule_version:int,category:string,severity:string,code:string,message:string,evidence:map<string,string>>>"
)


def read_fetches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored responses with a fixed schema; columns that a file lacks are null."""
    return spark.read.schema(FETCH).format(fmt).load(path)


def canonical_payload(result: Column) -> Column:
    """The canonical JSON of a decoded payload: fields in schema order, nulls kept, evidence keys sorted."""
    evidence = lambda f: F.map_from_entries(F.array_sort(F.map_entries(f["evidence"])))
    findings = F.transform(result["findings"], lambda f: f.withField("evidence", evidence(f)))
    return F.to_json(result.withField("findings", findings), {"ignoreNullFields": "false"})


def payload_hash(result: Column) -> Column:
    return F.sha2(canonical_payload(result), 256)


def beyond(allowed: Column):
    return lambda item: F.array_except(F.json_object_keys(item), allowed)


def unknown_fields(payload: Column) -> Column:
    """Names that are not in the schema, at the top and in each list of records."""
    schema = T.StructType.fromDDL(PAYLOAD)
    allowed = lambda s: F.array(*(F.lit(f.name) for f in s))
    out = F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), allowed(schema))
    lists = [f for f in schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    items = F.from_json(payload, T.StructType([T.StructField(f.name, T.ArrayType(T.StringType())) for f in lists]), {"mode": "PERMISSIVE"})  # all lists in one go
    names = lambda x: F.filter(F.array(*(F.flatten(F.transform(x[f.name], beyond(allowed(f.dataType.elementType)))) for f in lists)), lambda y: y.isNotNull())
    return F.concat(out, F.flatten(F.flatten(F.transform(F.array(items), names))))


def decode_payloads(staged: DataFrame) -> DataFrame:
    """Adds ``result`` (struct) and ``problem`` (null: good) to staged rows:
    batch_id, owner_id, page_id, result_version, payload, payload_sha256. A payload is parsed once, however often its fields are used."""
    schema = T.StructType.fromDDL(PAYLOAD).add("_corrupt", T.StringType())
    parsed = F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = once(staged, parsed=parsed)
    plain = F.struct(*(F.col(f"parsed.{f.name}").alias(f.name) for f in T.StructType.fromDDL(PAYLOAD)))
    rows = once(rows, result=plain)
    broken = F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull()
    names = lambda f: F.map_keys(f["evidence"])
    twice = F.coalesce(F.exists("result.findings", lambda f: F.size(F.array_distinct(names(f))) < F.size(names(f))), F.lit(False))
    rows = once(rows, canonical=F.when(~broken & ~twice, canonical_payload(F.col("result"))))
    # a payload that reads as it would be written has nothing unknown in it and nothing after it; others are looked through
    other = ~F.col("canonical").eqNullSafe(F.col("payload"))
    envelope = F.col("result.owner_id").eqNullSafe(F.col("owner_id")) & F.col("result.page_id").eqNullSafe(F.col("page_id")) & F.col("result.result_version").eqNullSafe(F.col("result_version"))
    # one object and nothing after it: as the items of a list, what trails makes the list invalid or longer
    whole = F.from_json(F.concat(F.lit("["), "payload", F.lit("]")), "array<string>", {"mode": "PERMISSIVE"})
    trailing = F.coalesce(F.size(whole) != 1, F.lit(True)) | ~F.col("payload").rlike(r"^\s*\{")
    problem = (
        F.when(broken | other & trailing, "INVALID_JSON")
        .when(other & (F.size(unknown_fields(F.col("payload"))) > 0), "UNKNOWN_FIELD")
        .when(~envelope, "ENVELOPE_MISMATCH")
        .when(F.col("canonical").isNull(), "INVALID_JSON")  # a name twice in a finding's evidence
        .when(F.sha2("canonical", 256) != F.lower("payload_sha256"), "CHECKSUM_MISMATCH")
    )
    return once(rows, problem=problem).drop("parsed", "canonical")


def decoded(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine)."""
    return parted(decode_payloads(staged))


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) of decoded rows."""
    return rows.where("problem is null").drop("problem"), rows.where("problem is not null").drop("result")


def explode_page_results(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page_metrics, findings, page_links) of decoded rows: one metrics row, n findings, n links each."""
    base = results.select("batch_id", "result.*", month_of(F.col("result")).alias("retention_month"))
    keys = ["batch_id", "owner_id", "scan_id", "page_id", F.col("result_version").alias("record_version"), "retention_month", "observed_at"]
    metrics = base.select(
        *keys, "normalized_url", F.sha2("normalized_url", 256).alias("url_hash"), "final_url", "status_code", "content_type", "fetch_outcome", "error_code",
        "total_ms", "response_bytes", "title", text_bytes("title").alias("title_length"), "meta_description", text_bytes("meta_description").alias("description_length"),
        "canonical_url", "h1", F.transform("hreflang", lambda h: h["language"]).alias("hreflang_languages"), F.transform("hreflang", lambda h: h["url"]).alias("hreflang_urls"),
        F.transform("redirects", lambda x: x["url"]).alias("redirect_urls"), F.transform("redirects", lambda x: x["status_code"]).alias("redirect_codes"),
        F.greatest(F.size("redirects"), F.lit(0)).alias("redirect_count"), F.lit(False).alias("is_deleted"),
    )
    findings = base.select(*keys, F.explode("findings").alias("f")).select(
        "batch_id", "owner_id", "scan_id", "page_id", "record_version", "retention_month", "observed_at",
        rules.uuid5(F.col("page_id"), F.concat_ws(":", "f.rule_id", F.col("f.rule_version").cast("string"))).alias("finding_id"),
        "f.rule_id", "f.rule_version", "f.category", "f.severity", F.col("f.code").alias("finding_code"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("f.evidence")))).alias("evidence_json"),
        F.lit(False).alias("is_deleted"),
    )
    links = base.select(*keys, F.explode("links").alias("l")).select(
        "batch_id", "owner_id", "scan_id", F.col("page_id").alias("source_page_id"), "record_version", "retention_month", "observed_at",
        rules.uuid5(F.col("page_id"), F.concat_ws(":", F.col("l.ordinal").cast("string"), "l.target_url")).alias("edge_id"),
        "l.target_url", F.sha2("l.target_url", 256).alias("target_hash"), F.lower(F.regexp_extract("l.target_url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("target_host"),
        "l.anchor_text", "l.tag", "l.is_internal", "l.is_followable", "l.ordinal", F.lit(False).alias("is_deleted"),
    )
    return metrics, findings, links


def month_of(result: Column) -> Column:
    return F.trunc(result["accepted_at"].cast("date"), "month")


def text_bytes(name: str) -> Column:
    return F.least(F.octet_length(F.coalesce(F.col(name), F.lit(""))), F.lit(65535))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_partitioned(df: DataFrame, path: str, keys: list[str], mode: str = "append", month: str = "retention_month") -> None:
    """Month-partitioned facts, sorted by their logical key within a file."""
    df.sortWithinPartitions(month, *keys).write.mode(mode).partitionBy(month).option("partitionOverwriteMode", "dynamic").parquet(path)


def expire_partitions(spark: SparkSession, path: str, cut: Column, at: str = "observed_at", month: str = "retention_month") -> dict[str, str]:
    """Removes the rows of month-partitioned facts that are not younger than ``cut``; tells of each month what was done.

    Only ``at`` is read of all months: a month whose rows are all gone is dropped as a
    folder, one whose rows all stay is not touched. A month at the edge is written anew
    in a hidden folder, its new files are moved in, then the old ones are deleted: a
    crash in between repeats rows, which current_view drops, and loses none.
    """
    facts = spark.read.parquet(path)
    edges = facts.groupBy(month).agg(F.count_if(F.col(at) > cut).alias("kept"), F.count(F.lit(1)).alias("rows")).collect()  # a row a month
    jvm = spark.sparkContext._jvm
    folder = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs, done = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), {}
    for r in edges:
        name = "__HIVE_DEFAULT_PARTITION__" if r[month] is None else str(r[month])
        own = f"{path}/{month}={name}"
        if r["kept"] == r["rows"]:
            done[name] = "kept"
        elif r["kept"] == 0:
            fs.delete(folder(own), True)
            done[name] = "dropped"
        else:
            old = [f.getPath() for f in fs.listStatus(folder(own))]
            hidden = f"{path}/.expire-{uuid.uuid4().hex}"
            facts.where(F.col(month).eqNullSafe(F.lit(r[month])) & (F.col(at) > cut)).drop(month).write.parquet(hidden)
            for f in fs.listStatus(folder(hidden)):
                if not f.getPath().getName().startswith(("_", ".")):
                    fs.rename(f.getPath(), folder(f"{own}/{f.getPath().getName()}"))
            for f in old:
                fs.delete(f, False)
            fs.delete(folder(hidden), True)
            done[name] = "rewritten"
    return done


LOGICAL_KEYS = {
    "page_metrics": ["owner_id", "scan_id", "page_id"],
    "findings": ["owner_id", "scan_id", "page_id", "rule_id", "rule_version", "finding_id"],
    "page_links": ["owner_id", "scan_id", "source_page_id", "edge_id"],
    "rendered_page_metrics": ["owner_id", "capture_request_id", "page_id"],
}
#: What tells a receipt, and what is read of decoded rows.
RECEIPT = ["owner_id", "page_id", "batch_id"]
RESULT = [*RECEIPT, "result_version", "result"]


def write_facts(results: DataFrame, path: str, ingested_at: Column | None = None, at_rest: bool = False) -> None:
    """Idempotent write of decoded results: batches with a receipt are skipped; facts come first, receipts last.

    Results are laid down below ``path`` once, for the receipts and the four writes;
    ``at_rest``: they are read from files already. A crash in between repeats facts
    (current_view drops repeats), it never loses any.
    """
    spark, receipts = results.sparkSession, f"{path}/ingestion_receipts"
    at = [] if ingested_at is None else [ingested_at.alias("ingested_at")]
    results = results.select(*RESULT, *at)
    with nullcontext(results) if at_rest else laid_down(results, path) as rows:
        if not exists(spark, receipts):
            return append_rows(rows, path)
        done = spark.read.parquet(receipts).select("owner_id", F.col("aggregate_id").alias("page_id"), "batch_id")
        # only receipts of the batches at hand take part
        done = done.join(rows.select("batch_id").distinct(), "batch_id", "left_semi")
        new = lambda x: x.join(done, RECEIPT, "left_anti")
        n, fresh = rows.count(), new(rows.select(*RECEIPT)).count()  # keys only: whole rows are moved where a part of them is new
        if fresh == n:
            append_rows(rows, path)
        elif fresh:
            with laid_down(new(rows), path) as rest:
                append_rows(rest, path)


def append_rows(results: DataFrame, path: str) -> None:
    """The four writes; receipts carry ``ingested_at`` of the rows, or the time."""
    for name, facts in zip(("page_metrics", "findings", "page_links"), explode_page_results(results), strict=True):
        write_partitioned(facts, f"{path}/{name}", LOGICAL_KEYS[name])
    now = F.col("ingested_at") if "ingested_at" in results.columns else F.current_timestamp()
    receipt = results.select(
        "owner_id", F.col("page_id").alias("aggregate_id"), "batch_id", F.col("result_version").alias("receipt_version"),
        F.lit(1).alias("metric_rows"), F.greatest(F.size("result.findings"), F.lit(0)).alias("finding_rows"), F.greatest(F.size("result.links"), F.lit(0)).alias("link_rows"), now.alias("ingested_at"),
    )
    receipt.write.mode("append").parquet(f"{path}/ingestion_receipts")


def explode_capture_results(captures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rendered, network, resources, receipts) of capture payloads; a missing metric is 0 with its status."""
    keys = ["owner_id", "capture_request_id", "batch_id"]
    value = lambda m: F.coalesce(F.col(f"metrics.{m}.value"), F.lit(0.0))
    rendered = captures.select(
        *keys, "page_id", "record_version", "observed_at",
        *(x for m in ("lcp", "cls", "ttfb") for x in (value(m).alias(f"{m}_value"), F.coalesce(F.col(f"metrics.{m}.status"), F.lit("UNAVAILABLE")).alias(f"{m}_status"))),
    )
    network = captures.select(*keys, "record_version", F.explode("network").alias("n")).select(*keys, "record_version", "n.*")
    resources = captures.select(*keys, "record_version", F.explode("resources").alias("r")).select(*keys, "record_version", "r.*")
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    receipts = captures.select(*keys, F.lit(1).alias("rendered_rows"), size("network").alias("network_rows"), size("resources").alias("resource_rows"))
    return rendered, network, resources, receipts


def manifest(files: DataFrame, group: str, version: int = 1) -> DataFrame:
    """(group, value): one versioned JSON manifest per group, files in path order.

    A manifest is one document by nature; its group is a page or site archive of at
    most some hundred thousand files, of which only the metadata comes together.
    """
    entry = F.struct(*(F.col(c) for c in sorted(files.columns) if c != group))
    by_path = F.array_sort(F.collect_list(F.struct("path", entry.alias("entry"))))
    listed = files.groupBy(group).agg(by_path.alias("listed"))
    body = F.to_json(F.struct(F.lit(version).alias("schema_version"), F.col(group), F.size("listed").alias("file_count"), F.transform("listed", lambda x: x["entry"]).alias("files")))
    return listed.select(group, body.alias("value"))


def write_manifest(files: DataFrame, path: str, group: str, version: int = 1) -> None:
    manifest(files, group, version).select("value").write.mode("overwrite").text(path)
