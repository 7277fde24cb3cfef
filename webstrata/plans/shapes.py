"""The given tables in the shapes of the reference's data model.

Each shape is SQL that Spark and DuckDB both run; ``{name}`` stands for a table.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = """
  cast(user_id % 10 as string) as owner_id, cast(user_id % 100 as string) as scan_id, cast(event_id as string) as page_id,
  concat('https://site', cast(user_id % 100 as string), '.example/p/', cast(event_id % 997 as string)) as normalized_url,
  case event_id % 17 when 0 then 404 when 1 then 503 when 2 then 301 when 3 then 0 when 4 then 620 else 200 end as status_code,
  case when event_id % 23 = 0 then 'SKIPPED' when event_id % 17 = 3 then 'FAILED' when event_id % 17 in (0, 1, 4) then 'HTTP_ERROR' else 'SUCCESS' end as fetch_outcome,
  case event_id % 5 when 0 then 'text/html; charset=utf-8' when 1 then 'application/pdf' else 'text/html' end as content_type,
  cast(floor(value * 10) as bigint) as total_ms, cast(floor(value * 1000) as bigint) as response_bytes,
  case when event_id % 13 = 0 then '' else concat('Title ', cast(event_id % 211 as string)) end as title,
  case when event_id % 3 = 0 then '' else concat('About ', cast(event_id % 307 as string)) end as meta_description,
  case when event_id % 7 = 0 then '' else concat('Head ', cast(event_id % 101 as string)) end as h1_text,
  case when event_id % 4 = 0 then '' else concat('https://site.example/p/', cast(event_id % 499 as string)) end as canonical_url,
  event_id % 17 > 4 as is_indexable, ts as observed_at
"""
FINDING_COLUMNS = """
  cast(user_id % 10 as string) as owner_id, cast(user_id % 100 as string) as scan_id, cast(event_id as string) as page_id,
  case event_id % 5 when 0 then 'ERROR' when 1 then 'warning' when 2 then 'INFO' when 3 then 'CRITICAL' else 'INFO' end as severity,
  case when event_id % 2 = 0 then 'SEO' else 'CONTENT' end as category
"""
SHAPES = {
    "page_metrics": f"select {PAGE_COLUMNS} from {{events}}",
    "page_versions": f"""
      select {PAGE_COLUMNS}, v as record_version, (v = 3 and event_id % 4 = 0) or (v = 2 and event_id % 4 = 1) as is_deleted
      from {{events}} cross join (select 1 as v union all select 3 union all select 2 union all select 3) versions""",
    "findings": f"""
      select concat('a', cast(event_id as string)) as finding_id, {FINDING_COLUMNS}, concat('rule.', event_type) as rule_id, upper(event_type) as finding_code
      from {{events}} where event_id % 3 <> 2
      union all
      select concat('b', cast(event_id as string)) as finding_id, {FINDING_COLUMNS}, 'title.missing' as rule_id, 'TITLE_MISSING' as finding_code
      from {{events}} where event_id % 5 = 0""",
    "edges": """
      select cast(l_suppkey % 10 as string) as owner_id, cast(l_suppkey % 100 as string) as scan_id, cast(l_orderkey as string) as source_page_id,
        concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string)) as edge_id, concat('https://site.example/', cast(l_partkey % 500 as string)) as target_url,
        sha2_hex as target_hash, l_returnflag <> 'R' as is_internal, l_linestatus = 'O' as is_followable, l_linenumber as ordinal
      from (select *, concat('h', cast(l_partkey % 500 as string)) as sha2_hex from {lineitem}) l""",
    "targets": """
      select distinct cast(l_suppkey % 10 as string) as owner_id, cast(l_suppkey % 100 as string) as scan_id, concat('h', cast(l_partkey % 400 as string)) as url_hash,
        concat('page', cast(l_partkey % 400 as string)) as page_id from {lineitem}""",
    "websites": """
      select cast(c_custkey as string) as id, cast(c_custkey % 25 as string) as owner_id, c_name as display_name, concat('https://', lower(replace(c_name, '#', '-')), '.example/') as canonical_url,
        concat(lower(replace(c_name, '#', '-')), '.example') as hostname, case when c_custkey % 5 = 0 then 'ARCHIVED' else 'ACTIVE' end as status from {customer}""",
    "scans": """
      select cast(o_orderkey as string) as id, cast(o_custkey as string) as website_id, cast(o_custkey % 25 as string) as owner_id,
        case o_orderstatus when 'O' then case o_orderkey % 3 when 0 then 'QUEUED' when 1 then 'RUNNING' else 'CANCEL_REQUESTED' end
          when 'F' then case o_orderkey % 4 when 0 then 'FAILED' when 1 then 'CANCELLED' else 'COMPLETED' end else 'PARTIAL_SUCCESS' end as status,
        cast(floor(o_totalprice / 1000) as bigint) as processed_count, cast(floor(o_totalprice / 1000) as bigint) - cast(floor(o_totalprice / 9000) as bigint) as succeeded_count,
        cast(floor(o_totalprice / 9000) as bigint) as failed_count, case when o_orderstatus = 'F' then 'DONE' end as terminal_code, o_orderdate as created_at, 500 as max_pages
      from {orders}""",
    "scan_pages": """
      select cast(l_orderkey % 500 as string) as execution_id, case when l_orderkey % 500 >= 480 then 'FAILED' when l_orderkey % 500 >= 400 then case when l_orderkey % 500 >= 440 and l_linenumber = 1 then 'SKIPPED' else 'SUCCEEDED' end
        else case (l_partkey + l_linenumber) % 9 when 0 then 'QUEUED' when 1 then 'LEASED' when 2 then 'PERSISTING' when 3 then 'FAILED' when 4 then 'SKIPPED' when 5 then 'CANCELLED' else 'SUCCEEDED' end end as status from {lineitem}""",
    "network": """
      select cast(l_suppkey % 10 as string) as owner_id, cast(l_orderkey as string) as capture_request_id, concat(cast(l_linenumber as string), '-', cast(l_partkey as string)) as request_id,
        l_linenumber as request_sequence, concat('https://cdn.example/', l_returnflag, '/', cast(l_partkey as string)) as url,
        case l_returnflag when 'A' then 'image' when 'R' then 'stylesheet' else 'script' end as resource_type, cast(floor(l_extendedprice) as bigint) as response_bytes from {lineitem}""",
    "bodies": """
      select cast(l_suppkey % 10 as string) as owner_id, cast(l_orderkey as string) as capture_request_id, concat('r', cast(l_partkey as string)) as resource_id, l_linenumber as request_sequence,
        cast(floor(l_quantity * 100) as bigint) as body_bytes, concat('sha', cast(l_partkey as string)) as body_sha256, l_tax > 0.04 as was_truncated from {lineitem} where l_discount > 0.03""",
    "budget_rows": """
      select cast(l_orderkey as string) as capture_request_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as request_sequence,
        case when l_linenumber % 5 = 0 then cast(null as bigint) when l_linenumber % 6 = 0 then cast(0 as bigint) else cast(floor(l_extendedprice) as bigint) end as body_length,
        case when l_returnflag = 'R' then 'UNSUPPORTED_TYPE' end as skip_reason from {lineitem}""",
    "captures": """
      select cast(user_id % 10 as string) as owner_id, cast(user_id % 100 as string) as scan_id, cast(event_id % 500 as string) as page_id, cast(event_id as string) as id,
        case event_id % 4 when 0 then 'COMPLETED' when 1 then 'PARTIAL_SUCCESS' when 2 then 'FAILED' else 'RUNNING' end as status, ts as created_at from {events}""",
    "vital_entries": """
      select cast(user_id as string) as capture_request_id, event_id as entry_no, case event_id % 3 when 0 then 'lcp' when 1 then 'shift' else 'paint' end as kind,
        cast(floor(value * 7) as bigint) as start_ms, cast(floor(value) as bigint) as value, event_id % 5 = 0 as recent_input from {events}""",
    "requests": """
      select cast(user_id % 10 as string) as run_id, cast(event_id * 10 as bigint) as started_at_ms, case when event_id % 19 = 0 then cast(null as bigint) else event_id * 10 + cast(floor(value) as bigint) end as finished_at_ms,
        case when event_id % 11 = 0 then cast(null as int) when event_id % 7 = 0 then 503 when event_id % 7 = 1 then 302 else 200 end as status,
        case when event_id % 22 = 0 then 'TIMEOUT' when event_id % 11 = 0 then 'RESET' end as error, cast(floor(value * 3) as bigint) as bytes from {events}""",
    "assets": """
      select cast(cast(floor(doc_id / 250) as bigint) as string) as job_id, 'RESOURCE' as kind, concat('assets/', cast(doc_id as string), case doc_id % 3 when 0 then '.png' when 1 then '.JPG' else '' end) as path,
        case doc_id % 3 when 0 then 'image/png' when 1 then 'image/jpeg' else 'font/woff2; x=1' end as content_type, source as sha256, doc_id as file_no, n_chars as bytes from {documents}""",
    "clone_pages": """
      select cast(cast(floor(doc_id / 250) as bigint) as string) as job_id, cast(doc_id as string) as page_id, cast(doc_id as int) as ordinal, concat('https://site.example/', lang, '/', cast(doc_id as string)) as url, concat('pages/', cast(doc_id as string), '.html') as local_path,
        case doc_id % 6 when 0 then 'FAILED' when 1 then 'QUEUED' when 2 then 'RUNNING' when 3 then 'CANCELLED' else 'SUCCEEDED' end as status,
        case doc_id % 6 when 0 then 'TIMEOUT' when 3 then 'CANCELLED' end as reason, n_chars as input_bytes,
        case when doc_id % 10 = 0 then cast(null as string) else lang end as semantic_role, source as route_template, case when doc_id % 8 = 0 then cast(null as string) else concat('f', cast(doc_id % 3 as string)) end as layout_fingerprint,
        doc_id % 6 > 3 as rendered, cast(doc_id % 2 as int) as resource_gaps from {documents}""",
    "receipts": """
      select cast(o_custkey % 25 as string) as owner_id, cast(o_custkey as string) as aggregate_id, cast(o_orderkey as string) as batch_id, 2 as fact_rows from {orders} where o_orderkey % 10 <> 0""",
    "delivered": """
      select cast(o_custkey % 25 as string) as owner_id, cast(o_custkey as string) as aggregate_id, cast(o_orderkey as string) as batch_id from {orders} where o_orderkey % 11 <> 0""",
    "fact_rows": """
      select cast(o_custkey % 25 as string) as owner_id, cast(o_custkey as string) as aggregate_id from {orders} where o_orderkey % 10 <> 0
      union all
      select cast(o_custkey % 25 as string) as owner_id, cast(o_custkey as string) as aggregate_id from {orders} where o_orderkey % 10 <> 0 and o_orderkey % 7 <> 0""",
    "outbox": """
      select cast(event_id as string) as id, case event_id % 5 when 0 then 'PENDING' when 1 then 'CLAIMED' when 2 then 'DEAD' else 'DELIVERED' end as status, ts as created_at from {events}""",
    "objects": """
      select cast(doc_id as string) as object_id, cast(doc_id % 5 as string) as owner_id, source as sha256, doc_id % 3 as bytes, lang as kind,
        case doc_id % 3 when 0 then 'DELETE_PENDING' else 'ACTIVE' end as status, doc_id % 100 as delete_after from {documents}""",
    "object_references": "select cast(doc_id as string) as object_id from {documents} where doc_id % 4 = 0",
    "progress": """
      select concat('m', cast(conv_id as string), '-', cast(turn as string)) as message_id, cast(conv_id as string) as aggregate_id, cast(conv_id % 10 as string) as owner_id, turn + 1 as aggregate_version,
        case when turn = 0 then 'QUEUED' when turn = 6 then 'COMPLETED' when turn = 5 then 'CANCEL_REQUESTED' else 'RUNNING' end as status,
        10 + turn as discovered, 8 - turn as queued, turn as processed, turn as succeeded, 0 as failed, turn as analytics_expected, turn as analytics_published,
        case when turn = 6 then 'DONE' else '' end as terminal_code, '' as terminal_message, (turn * 7 + conv_id) % 5 as arrival from {conversations} where turn between 0 and 7""",
}


def tables_of(name: str) -> list[str]:
    return sorted({field for _, field, _, _ in string.Formatter().parse(SHAPES[name]) if field})


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shape as a DataFrame over the tables of ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)}
    return spark.sql(SHAPES[name], **tables)


def with_shapes(*names: str) -> str:
    """The shapes as common table expressions, for DuckDB."""
    return "with recursive " + ", ".join(f"{n} as ({SHAPES[n].format(**{t: t for t in tables_of(n)})})" for n in names) + " "


def page_metrics(spark: SparkSession, sf_dir: str, name: str = "page_metrics") -> DataFrame:
    """With h1 as an array, as the library has it."""
    rows = shape(spark, sf_dir, name)
    return rows.withColumn("h1", F.when(F.col("h1_text") == "", F.array().cast("array<string>")).otherwise(F.array("h1_text")))
