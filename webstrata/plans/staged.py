"""Queries over payloads staged, written and replayed: sources, sinks and streams; and the scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webstrata.functions import html, rules, urls
from webstrata.operators import archive, capture, pages, selection, workflow
from webstrata.sources.tables import once, shared, spread, written
from webstrata.plans import catalog, jobs
from webstrata.plans.catalog import long, query
from webstrata.plans.shapes import page_metrics, shape
from webstrata.sources import fetches, layouts
from webstrata.streaming import events


def staged(spark, sf_dir):
    """Events as staged page payloads; each 50th has another owner in its envelope, each 70th a wrong checksum, each 90th is cut;
    each 130th has more after it, each 170th is there twice."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    k = F.col("event_id")
    ident = F.lower(F.concat(F.lpad(F.hex(k), 8, "0"), F.lit("-0000-4000-8000-000000000000")))
    link = F.struct(F.concat(F.lit("https://Site.example/"), (k % 97).cast("string")).alias("target_url"), F.lit("x").alias("anchor_text"), F.lit("a").alias("tag"), F.lit(True).alias("is_internal"), (k % 2 == 0).alias("is_followable"), F.lit(0).alias("ordinal"))
    finding = F.struct(F.lit("title.missing").alias("rule_id"), F.lit(2).alias("rule_version"), F.lit("CONTENT").alias("category"), F.lit("WARNING").alias("severity"), F.lit("TITLE_MISSING").alias("code"), F.lit("m").alias("message"), F.create_map(F.lit("source"), F.lit("static_html")).alias("evidence"))
    none = lambda t: F.array().cast(t)
    result = F.struct(
        (F.col("user_id") % 10).cast("string").alias("owner_id"), F.col("user_id").cast("string").alias("scan_id"), ident.alias("page_id"), F.lit(1).cast("bigint").alias("result_version"), F.lit("2024-01-31T12:00:00.000Z").cast("timestamp").alias("accepted_at"),
        F.lit("2024-02-01T12:00:00.000Z").cast("timestamp").alias("observed_at"), F.concat(F.lit("https://site.example/"), k.cast("string")).alias("normalized_url"), F.lit("").alias("final_url"), F.when(k % 7 == 0, 404).otherwise(200).alias("status_code"), F.lit("text/html").alias("content_type"),
        F.when(k % 7 == 0, "HTTP_ERROR").otherwise("SUCCESS").alias("fetch_outcome"), F.lit("").alias("error_code"), F.lit(5).alias("total_ms"), k.alias("response_bytes"), F.concat(F.lit("é"), F.col("event_type")).alias("title"), F.lit("").alias("meta_description"), F.lit("").alias("canonical_url"),
        none("array<string>").alias("h1"), none("array<struct<language:string,url:string>>").alias("hreflang"), none("array<struct<url:string,status_code:int>>").alias("redirects"), F.when(k % 3 == 0, F.array(link)).otherwise(F.array(link, link.withField("ordinal", F.lit(1)))).alias("links"),
        F.when(k % 5 == 0, F.array(finding)).otherwise(none("array<struct<rule_id:string,rule_version:int,category:string,severity:string,code:string,message:string,evidence:map<string,string>>>")).alias("findings"),
    )
    rows = once(e.select(k.alias("event_id"), (F.col("user_id") % 10).cast("string").alias("own"), ident.alias("page_id"), "user_id", "event_type"), result=result)
    rows = once(rows, payload=fetches.canonical_payload(F.col("result")))
    rows = once(rows.select("event_id", "own", "page_id", "payload"), good=F.sha2("payload", 256))
    k = F.col("event_id")
    return rows.select(
        "event_id", F.concat(F.lit("b"), (k % 64).cast("string")).alias("batch_id"), F.when(k % 50 == 0, "other").otherwise(F.col("own")).alias("owner_id"), "page_id", F.lit(1).cast("bigint").alias("result_version"),
        F.when(k % 90 == 0, F.substring("payload", 1, 40)).when(k % 130 == 0, F.concat("payload", F.lit(" {}"))).when(k % 170 == 0, F.concat("payload", "payload")).when(k % 110 == 0, F.concat(F.lit('{"odd":1,'), F.substring("payload", F.lit(2), F.length("payload")))).otherwise(F.col("payload")).alias("payload"), F.when(k % 70 == 0, "0").otherwise(F.col("good")).alias("payload_sha256"),
    )


PROBLEM = "case when event_id % 90 = 0 or event_id % 130 = 0 or event_id % 170 = 0 then 'INVALID_JSON' when event_id % 110 = 0 then 'UNKNOWN_FIELD' when event_id % 50 = 0 then 'ENVELOPE_MISMATCH' when event_id % 70 = 0 then 'CHECKSUM_MISMATCH' end"
GOOD = f"with g as (select * from events where {PROBLEM} is null) "


@query(f"select event_id, {PROBLEM} as problem from events")
def o002_decode_payloads(spark, sf_dir):
    return fetches.decode_payloads(staged(spark, sf_dir)).select("event_id", "problem")


@query("""select id from outbox where created_at > timestamp '2024-07-01 00:00:00' - interval 180 day""", shapes=("outbox",))
def o115_expire_partitions(spark, sf_dir):
    """Rows written by month; months that are gone are dropped as folders, the one at the edge is written anew."""
    path = f"{shared(spark)}/expire-{uuid.uuid4().hex}"
    rows = shape(spark, sf_dir, "outbox").withColumn("retention_month", F.trunc("created_at", "month"))
    fetches.write_partitioned(rows, path, ["id"])
    fetches.expire_partitions(spark, path, F.expr("timestamp_ntz'2024-07-01 00:00:00' - interval 180 day"), "created_at")
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path).select("id")


@query("""select normalized_url, page_id from page_metrics where (normalized_url, page_id) > ('https://site5.example/p/', '') and cast(page_id as bigint) % 3 <> 0 order by 1, 2 limit 26""", shapes=("page_metrics",))
def o101_page_keyset_ranges(spark, sf_dir):
    """A page of a table laid out in ranges of the listing's order, of which each third row is deleted."""
    path, order = f"{shared(spark)}/ranges-{uuid.uuid4().hex}", ["normalized_url", "page_id"]
    layouts.write_ranges(page_metrics(spark, sf_dir).select(*order), path, order, files=64)
    return layouts.page_of_ranges(spark, path, order, ("https://site5.example/p/", ""), 25, alive=F.col("page_id").cast("long") % 3 != 0)


@query(GOOD + """select concat('https://site.example/', event_id) as normalized_url, sha256(concat('https://site.example/', event_id)) as url_hash, cast(length(event_type) + 2 as int) as title_length, date '2024-01-01' as retention_month from g""")
def o003_explode_page_metrics(spark, sf_dir):
    metrics, _, _ = fetches.explode_page_results(fetches.decoded(staged(spark, sf_dir))[0])
    return metrics.select("normalized_url", "url_hash", "title_length", "retention_month")


@query(GOOD + """select concat(lower(lpad(hex(event_id), 8, '0')), '-0000-4000-8000-000000000000') as page_id, 'site.example' as target_host, sha256(concat('https://Site.example/', event_id % 97)) as target_hash, cast(ordinal as int) as ordinal
  from g, (select unnest([0, 1]) as ordinal) where ordinal = 0 or event_id % 3 <> 0""")
def o003_explode_page_links(spark, sf_dir):
    _, _, links = fetches.explode_page_results(fetches.decoded(staged(spark, sf_dir))[0])
    return links.select(F.col("source_page_id").alias("page_id"), "target_host", "target_hash", "ordinal")


@query(GOOD + """select (select count(*) from g) as metric_rows, (select count(*) from g where event_id % 5 = 0) as finding_rows, (select sum(case when event_id % 3 = 0 then 1 else 2 end)::bigint from g) as link_rows, (select count(*) from g) as receipts, (select count(distinct event_id % 64) from g) as batches""")
def o004_write_facts(spark, sf_dir):
    """Written, replayed, and read back: the replay adds nothing."""
    path = f"{shared(spark)}/facts-{uuid.uuid4().hex}"
    good = written(fetches.decoded(staged(spark, sf_dir))[0].select(*fetches.RESULT))
    for _ in range(2):
        fetches.write_facts(good, path, at_rest=True)
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    out = [read(n).agg(F.count(F.lit(1)).alias(c)) for n, c in (("page_metrics", "metric_rows"), ("findings", "finding_rows"), ("page_links", "link_rows"))]
    out.append(read("ingestion_receipts").agg(F.count(F.lit(1)).alias("receipts"), F.count_distinct("batch_id").alias("batches")))
    one = out[0]
    for x in out[1:]:
        one = one.crossJoin(x)  # one row each
    return one


@query(GOOD + "select (select count(*) from g) as metric_rows, (select count(*) from events) - (select count(*) from g) as quarantined")
def o114_ingest_stream(spark, sf_dir):
    """Staged files as a stream into fact tables, replayed from the start."""
    path = f"{shared(spark)}/ingest-{uuid.uuid4().hex}"
    rows = staged(spark, sf_dir).drop("event_id")
    rows.write.parquet(f"{path}/in")
    events.ingest_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/facts", f"{path}/cp").awaitTermination()
    a = spark.read.parquet(f"{path}/facts/page_metrics").agg(F.count(F.lit(1)).alias("metric_rows"))
    return a.crossJoin(spark.read.parquet(f"{path}/facts/quarantine").agg(F.count(F.lit(1)).alias("quarantined")))  # one row each


@query(extra=catalog.SCAN_SQL, shapes=("progress",))
def o111_project_scan_events_stream(spark, sf_dir):
    """The progress events as a stream, each aggregate's in the order of arrival: what the batch twin gives, and its SQL."""
    path = f"{shared(spark)}/progress-{uuid.uuid4().hex}"
    rows = shape(spark, sf_dir, "progress")
    rows = rows.withColumns({c: F.col(c).cast("long") for c in (*events.COUNTERS, "aggregate_version")}).withColumn("occurred_at", F.timestamp_seconds(F.col("aggregate_version")))
    rows = rows.select(*[c.split()[0] for c in events.EVENT.split(", ")], "arrival")
    rows.write.parquet(f"{path}/in")
    out = events.project_stream(events.state_session(spark).readStream.schema(rows.schema).parquet(f"{path}/in"), arrival="arrival")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query(catalog.SENT_SQL)
def o112_sample_progress_stream(spark, sf_dir):
    path = f"{shared(spark)}/sample-{uuid.uuid4().hex}"
    rows = catalog.progress_events(spark, sf_dir)
    rows.write.parquet(f"{path}/in")
    out = events.sample_stream(events.state_session(spark).readStream.schema(rows.schema).parquet(f"{path}/in"))
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("scan_id", "version", "status", F.unix_millis("occurred_at").alias("occurred_ms"))


@query(extra=catalog.ORDERED + ", " + catalog.projection_sql("clone") + ", " + catalog.projection_sql("capture") + catalog.PROJECTED + ", 'clone' as kind from walk_clone where rn > 0 union all " + catalog.PROJECTED + ", 'capture' as kind from walk_capture where rn > 0", shapes=("progress",))
def o113_project_clone_events(spark, sf_dir):
    rows = shape(spark, sf_dir, "progress")
    rows = rows.withColumns({c: F.col(c).cast("long") for c in (*events.COUNTERS, "aggregate_version")}).withColumn("occurred_at", F.timestamp_seconds(F.col("aggregate_version")))
    out = [events.project_batch(rows, kind).withColumn("kind", F.lit(kind)) for kind in ("clone", "capture")]
    return out[0].unionByName(out[1])


@query(catalog.CLASSES + f"""select {catalog.PAGE_UUID} as page_id, status_code, cast(octet_length(encode(html)) as bigint) as body_bytes, cut as body_truncated, error as error_code, cast(case when page_no % 13 = 0 then 2 else 0 end as int) as hops, true as no_timing from p""")
def o001_read_fetches(spark, sf_dir):
    """Stored responses read back with the reader's schema; what the files lack is null."""
    path = f"{shared(spark)}/fetches-{uuid.uuid4().hex}"
    catalog.fetches(spark, sf_dir).drop("page_no").write.parquet(path)
    rows = fetches.read_fetches(spark, path)
    return rows.select("page_id", "status_code", F.octet_length("body").cast("long").alias("body_bytes"), "body_truncated", "error_code", F.size("redirects").alias("hops"), (F.col("ttfb_ms").isNull() & F.col("accepted_at").isNull()).alias("no_timing"))


@query("""select date_trunc('month', observed_at)::date as retention_month, owner_id, count(*) as rows, min(page_id) as first_page from page_metrics group by 1, 2""", shapes=("page_metrics",))
def o006_write_partitioned(spark, sf_dir):
    """Facts written by month in two goes, the second replacing the months that it has, and read back."""
    path = f"{shared(spark)}/months-{uuid.uuid4().hex}"
    rows = page_metrics(spark, sf_dir).withColumn("retention_month", F.trunc("observed_at", "month")).select("owner_id", "scan_id", "page_id", "retention_month")
    fetches.write_partitioned(rows, path, fetches.LOGICAL_KEYS["page_metrics"])
    last = rows.agg(F.max("retention_month").alias("last"))
    again = rows.join(F.broadcast(last), F.col("retention_month") == F.col("last")).drop("last")  # one row
    fetches.write_partitioned(again, path, fetches.LOGICAL_KEYS["page_metrics"], mode="overwrite")
    read = spark.read.parquet(path)
    return read.groupBy(F.col("retention_month").cast("date").alias("retention_month"), "owner_id").agg(F.count(F.lit(1)).alias("rows"), F.min("page_id").alias("first_page"))


def capture_payloads(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    row = F.struct(F.col("l_linenumber").alias("request_sequence"), F.concat(F.lit("https://cdn/"), F.col("l_partkey").cast("string")).alias("url"))
    metric = lambda there: F.struct(F.when(there, "AVAILABLE").otherwise("UNAVAILABLE").alias("status"), F.when(there, F.lit(2.5)).alias("value"))
    rows = l.groupBy("l_orderkey").agg(F.collect_list(row).alias("network"))
    k = F.col("l_orderkey")
    return rows.select(
        (k % 10).cast("string").alias("owner_id"), k.cast("string").alias("capture_request_id"), F.lit("b").alias("batch_id"), F.lit("p").alias("page_id"), F.lit(1).alias("record_version"), F.lit(None).cast("timestamp").alias("observed_at"),
        F.struct(metric(k % 2 == 0).alias("lcp"), metric(k % 3 == 0).alias("cls"), metric(F.lit(True)).alias("ttfb")).alias("metrics"), "network", F.filter("network", lambda n: n["request_sequence"] <= 2).alias("resources"),
    )


@query("""select cast(l_orderkey as string) as capture_request_id, case when l_orderkey % 2 = 0 then 2.5 else 0.0 end::double as lcp_value, case when l_orderkey % 3 = 0 then 'AVAILABLE' else 'UNAVAILABLE' end as cls_status, count(*) as network_rows, count(*) filter (l_linenumber <= 2) as resource_rows from lineitem group by l_orderkey""")
def o005_explode_capture_results(spark, sf_dir):
    rendered, network, resources, receipts = fetches.explode_capture_results(capture_payloads(spark, sf_dir))
    return rendered.join(receipts, ["owner_id", "capture_request_id", "batch_id"]).select("capture_request_id", "lcp_value", "cls_status", *long("network_rows", "resource_rows"))


@query("""select cast(cast(floor(doc_id / 250) as bigint) as string) as job_id, count(*) as file_count, min(doc_id) as first_no from documents group by 1""")
def o007_manifest(spark, sf_dir):
    m = fetches.manifest(shape(spark, sf_dir, "assets").select("job_id", "path", "file_no"), "job_id")
    read = F.from_json("value", "file_count bigint, files array<struct<file_no:bigint,path:string>>")
    return m.select("job_id", read.alias("m")).select("job_id", "m.file_count", F.array_min(F.transform("m.files", lambda f: f["file_no"])).alias("first_no"))


# --- scalar functions ------------------------------------------------------------------------------------------------

@query(f"""select c_custkey, not (a in (0, 10, 127) or a >= 224 or a = 100 and b between 64 and 127 or a = 169 and b = 254 or a = 172 and b between 16 and 31 or a = 192 and (b = 168 or b = 0 and c in (0, 2)) or a = 198 and (b in (18, 19) or b = 51 and c = 100) or a = 203 and b = 0 and c = 113) as public
  from (select c_custkey, c_custkey % 256 as a, (c_custkey * 7) % 256 as b, c_nationkey as c from customer)""")
def o015_is_public_address(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ip = F.concat_ws(".", (F.col("c_custkey") % 256).cast("string"), (F.col("c_custkey") * 7 % 256).cast("string"), F.col("c_nationkey").cast("string"), F.lit("1"))
    return c.select("c_custkey", urls.is_public_address(ip).alias("public"))


@query("""select page_id, html is not null and (lower(url) like 'https://%' or lower(url) like 'http://%') as http, sha256(regexp_extract(url, '^[^?#]*', 0)) as plain_hash, left(url, 20) as bounded from pages""")
def o040_bounded(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = F.col("url")
    return p.select("page_id", (F.col("html").isNotNull() & urls.is_http_url(u)).alias("http"), urls.url_hash(F.regexp_extract(u, "^[^?#]*", 0)).alias("plain_hash"), rules.bounded_utf8(u, 20).alias("bounded"))


@query("""select event_id, header, event_id % 6 in (0, 3, 4) as noindex from (select event_id, case event_id % 6 when 0 then 'noindex' when 1 then 'googlebot: noindex' when 2 then 'max-snippet: 5' when 3 then 'max-snippet: 5, NONE' when 4 then concat('bingbot: nofollow', chr(10), 'follow, noindex') else 'googlebot: all, noindex' end as header from events)""")
def o026_x_robots_noindex(spark, sf_dir):
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 6
    header = F.when(k == 0, "noindex").when(k == 1, "googlebot: noindex").when(k == 2, "max-snippet: 5").when(k == 3, "max-snippet: 5, NONE").when(k == 4, "bingbot: nofollow\nfollow, noindex").otherwise("googlebot: all, noindex")
    return e.select("event_id", header.alias("header"), rules.x_robots_noindex(header).alias("noindex"))


@query("""select event_id, case when event_id % 3 = 0 then 'AVAILABLE' else 'UNAVAILABLE' end as status, case when event_id % 3 = 0 then cast(floor(value) as double) end as value, event_id % 4 = 1 as is_html,
  (event_id % 4 = 1 and event_id % 2 = 1) as visual from events""")
def o039_measurement(spark, sf_dir):
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    m = rules.measurement(F.when(k % 3 == 0, F.floor("value")), "MISSING")
    mime = F.when(k % 4 == 1, "application/XHTML+xml; x").otherwise("image/png")
    kind = F.when(k % 4 == 1, "text/css").otherwise("text/plain")
    return e.select("event_id", m["status"].alias("status"), m["value"].alias("value"), rules.is_html(mime).alias("is_html"), rules.is_external_visual(F.lit("https://cdn.example/x"), F.lit("stylesheet"), kind).alias("visual"))


@query("""select doc_id, case when doc_id % 4 = 0 then lang when doc_id % 4 = 1 then 'pt-br' end as tag, concat('2|', case when doc_id % 2 = 0 then '1' else '0' end, '|0|3|', cast(doc_id % 5 as string), '|article,', lower(lang)) as hint from documents""")
def o037_layout_hint(spark, sf_dir):
    d, k = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    h1 = F.when(k % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    tag = rules.locale_of(F.when(k % 4 == 0, F.upper("lang")).when(k % 4 == 1, F.lit(" PT_BR ")).when(k % 4 == 2, F.lit("app")).otherwise(F.lit("x")))
    hint = rules.layout_hint(F.lit(200), h1, F.array().cast("array<string>"), F.lit(3), (k % 5).cast("int"), F.array(F.upper("lang"), F.lit("Article")))
    return d.select("doc_id", tag.alias("tag"), hint.alias("hint"))


@query(f"select event_id, {catalog.uuid5_sql("'6ba7b810-9dad-11d1-80b4-00c04fd430c8'", 'event_type')} as uuid from events")
def o024_uuid5(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", rules.uuid5(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.col("event_type")).alias("uuid"))


@query()
def o054_layout_fingerprint(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.layout_fingerprint(F.col("html")).alias("fingerprint"))


@query()
def o055_rewrite_navigation(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    routes = F.create_map(urls.route_hash(F.col("url")), F.lit("index.html"))
    return p.select("page_id", F.sha2(html.rewrite_navigation(F.col("html"), F.col("url"), F.lit("pages/x.html"), routes), 256).alias("html_sha256"))


# --- joins and reports -----------------------------------------------------------------------------------------------


@query("""select page_id from page_metrics where canonical_url <> '' and title = '' and total_ms >= 100""", shapes=("page_metrics",))
def o065_seo_performance_filter(spark, sf_dir):
    p = page_metrics(spark, sf_dir)
    base = p.withColumn("canonical_relation", F.when(F.col("canonical_url") == "", "MISSING").otherwise("NON_SELF")).withColumn("open_graph_title", F.col("title"))
    rendered = p.select(*pages.PAGE, F.lit("AVAILABLE").alias("lcp_status"), F.col("total_ms").cast("double").alias("lcp_value"))
    return pages.seo_performance_filter(base, rendered, canonical="NON_SELF", og_missing=True, metric="lcp", at_least=100.0).select("page_id")


@query("""select owner_id, scan_id, max(total_ms) as expected, max(response_bytes // 100) as published, max(total_ms) = max(response_bytes // 100) as is_fresh from page_metrics group by 1, 2""", shapes=("page_metrics",))
def o088_report_freshness(spark, sf_dir):
    e = page_metrics(spark, sf_dir).select("owner_id", "scan_id", F.col("total_ms").alias("expected"), F.floor(F.col("response_bytes") / 100).alias("published"), F.col("observed_at").alias("last_ingested_at"))
    return pages.report_freshness(e).select("owner_id", "scan_id", "expected", "published", "is_fresh")


@query(catalog.CHOSEN.rstrip() + """, h as (select scan_id, count(*) filter (verdict = 'SELECTED') > 0 as found from chosen group by 1)
  select c.scan_id, c.id as page_id, cast(row_number() over (partition by c.scan_id order by c.verdict <> 'SELECTED', c.raw_url, c.id) - 1 as int) as ordinal, c.normalized_url as url, concat(case when c.verdict = 'SELECTED' then 'pages/' else 'rejected/' end, c.id, '.html') as local_path,
    case when c.verdict = 'SELECTED' then 'QUEUED' else 'CANCELLED' end as status, case when c.verdict <> 'SELECTED' then c.verdict end as reason from chosen c join h on h.scan_id = c.scan_id where h.found
  union all select scan_id, concat('job-', scan_id), 0, concat('https://', scan_id, '/'), 'index.html', 'QUEUED', null from h where not found""")
def o106_clone_targets(spark, sf_dir):
    chosen = catalog.queries()["o118_select_design_pages"](spark, sf_dir)
    scans = chosen.select("scan_id").distinct()
    jobs_ = scans.select("scan_id", F.concat(F.lit("job-"), "scan_id").alias("job_id"), F.concat(F.lit("https://"), "scan_id", F.lit("/")).alias("root_url"))
    return selection.clone_targets(chosen, jobs_)


@query("""select k as capture_request_id, case when k % 5 = 0 then 'EXPIRED' when k % 2 = 0 then 'PUBLISHED' else 'FAILED' end as reconstruction_status, k % 5 <> 0 and k % 2 = 0 and k % 3 <> 0 as download_available from (select o_orderkey as k from orders)""")
def o120_capture_report(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    j = o.select(F.lit("o").alias("owner_id"), k.alias("id"))
    s = o.where(k % 4 == 0).select(k.alias("id"), k.alias("capture_request_id"))
    r = o.select(k.alias("id"), k.alias("capture_request_id"), F.when((k % 2 == 0) | (k % 5 == 0), "PUBLISHED").otherwise("FAILED").alias("status"), F.lit(2).alias("lease_generation"))
    a = o.select(k.alias("id"), k.alias("reconstruction_id"), F.lit("STATIC_ARCHIVE").alias("kind"), F.when((k % 3 == 0) & (k % 5 != 0), 1).otherwise(2).alias("lease_generation"), F.lit("READY").alias("status"), F.when(k % 5 == 0, 1).otherwise(9).alias("delete_after"))
    return capture.capture_report(j, s, r, a, F.lit(5)).select("capture_request_id", "reconstruction_status", "download_available")


@query(extra=""", r as (select job_id, page_id from (select *, row_number() over (partition by job_id, semantic_role, route_template, case when semantic_role is null then page_id end, coalesce(layout_fingerprint, 'FINGERPRINT_UNAVAILABLE') order by ordinal, page_id) = 1 or semantic_role is null as rep from clone_pages) where rep),
  own as (select a.*, file_no % 9 = 0 as css, coalesce(nullif(lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)), ''), lower(trim(split_part(content_type, ';', 1)))) as kind2 from assets a join r on r.job_id = a.job_id and r.page_id = cast(a.file_no as string)),
  sheets as (select job_id, path, min(path) over (partition by job_id, file_no % 4) as to_path from assets where file_no % 9 = 0),
  final as (select o.job_id, o.sha256, o.bytes, o.file_no, case when css then s.to_path else first(o.path) over (partition by o.job_id, css, o.sha256, kind2 order by o.file_no, o.path) end as path from own o left join sheets s on s.job_id = o.job_id and s.path = o.path),
  listed as (select job_id, arg_min(path, file_no) as path, arg_min(sha256, file_no) as sha256, arg_min(bytes, file_no) as bytes, min(file_no) as file_no, min(sha256) <> max(sha256) as collision from final group by job_id, lower(path)),
  o as (select *, bytes + 256 + 2 * octet_length(encode(path)) as need, row_number() over (partition by job_id order by file_no, path) as rn from listed where not collision),
  w as (select cast(0 as bigint) as rn, job_id, cast(null as string) as path, 1 as shard, cast(0 as bigint) as filled, cast(0 as bigint) as total, cast(null as string) as problem from (select distinct job_id from o)
    union all select rn, job_id, path, case when problem is null and closed then shard + 1 else shard end, cast(case when problem is not null then filled when closed then need else filled + need end as bigint), total, problem
    from (select o.rn, o.job_id, o.path, o.need, w.shard, w.filled, cast(w.total + o.bytes as bigint) as total, case when o.need > 16000 then 'SITE_FILE_EXCEEDS_SHARD_BUDGET' when w.total + o.bytes > 200000 then 'SITE_ARCHIVE_BUDGET_EXCEEDED' end as problem, w.filled > 0 and w.filled + o.need > 16000 as closed
      from w join o on o.job_id = w.job_id and o.rn = w.rn + 1))
  select l.job_id, l.path, l.sha256, l.bytes, l.collision, case when w.problem is null then w.shard end as shard, w.problem from listed l left join w on w.rn > 0 and w.job_id = l.job_id and w.path = l.path""", shapes=("clone_pages", "assets"))
def o119_plan_site_archive(spark, sf_dir):
    """Every ninth asset is a stylesheet; four kinds of them in a job, so that what a job's pages keep becomes a few shards."""
    p, k = shape(spark, sf_dir, "clone_pages"), F.col("file_no")
    files = shape(spark, sf_dir, "assets").withColumn("page_id", k.cast("string")).withColumn("source_url", F.concat(F.lit("https://site.example/"), "path"))
    files = files.withColumn("content_type", F.when(k % 9 == 0, "text/css").otherwise(F.col("content_type")))
    css = files.where("file_no % 9 = 0").select("job_id", "path", "source_url", F.concat(F.lit("a{b:url(../x"), (k % 4).cast("string"), F.lit(".png)}")).alias("body"))
    plan = jobs.plan_site_archive(p, files, css, 16_000, 200_000)
    return plan["files"].select("job_id", "path", "sha256", "bytes", "shard", "problem", "collision")


@query(extra=""" select job_id, path, min(path) over (partition by job_id, own) as canonical_path from (select *, case when file_no % 6 < 4 then cast(file_no % 6 as string)
  when file_no >= 4 and floor((file_no - 4) / 250) = floor(file_no / 250) then concat('imports ', file_no % 6) else concat('alone ', path) end as own from assets)""", shapes=("assets",))
def o108_css_alias_closure(spark, sf_dir):
    """Four kinds of stylesheets that become one each, and two that import one of the first two; imports of another job's stay alone."""
    files, k = shape(spark, sf_dir, "assets"), F.col("file_no")
    source = F.concat(F.lit("https://site.example/"), "path")
    other = F.concat(F.lit("../assets/"), (k - 4).cast("string"), F.when((k - 4) % 3 == 0, ".png").when((k - 4) % 3 == 1, ".JPG").otherwise(""))
    body = F.when(k % 6 < 4, F.concat(F.lit("a{b:url(x"), (k % 6).cast("string"), F.lit(".png)}"))).otherwise(F.concat(F.lit('@import "'), other, F.lit('";'), F.lit("/* "), (k % 6).cast("string"), F.lit(" */")))
    css = files.select("job_id", "path", source.alias("source_url"), body.alias("body"))
    out = archive.css_alias_closure(css, files.select("job_id", source.alias("url"), "path"))
    return out.select("job_id", "path", "canonical_path")


@query("""select owner_id, scan_id, cast(floor(count(*) filter (status_code between 200 and 299) * 100.0 / count(*) + 0.5) as bigint) as status_2xx_share from page_metrics group by 1, 2""", shapes=("page_metrics",))
def o078_summary_shares(spark, sf_dir):
    s = pages.scan_summary(page_metrics(spark, sf_dir), shape(spark, sf_dir, "findings"))
    return pages.summary_shares(s).select("owner_id", "scan_id", "status_2xx_share")


@query("""select run_id, string_agg(concat(status, '=', n), ',' order by status) as histogram from (select run_id, cast(status as string) as status, count(*) as n from requests where status is not null group by 1, 2) group by 1""", shapes=("requests",))
def o090_status_histogram(spark, sf_dir):
    h = workflow.histogram(shape(spark, sf_dir, "requests"), "status", ("run_id",))
    return h.select("run_id", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("histogram"))
