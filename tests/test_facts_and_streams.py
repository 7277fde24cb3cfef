from __future__ import annotations

import datetime as dt
import json
import random
import re
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, rows
from webstrata.operators import pages, workflow
from webstrata.plans import staged as staged_queries
from webstrata.sources import fetches
from webstrata.streaming import events

T0 = dt.datetime(2024, 1, 31, 23, 0)


def payload(page: str, severity: str, version: int = 1, **more) -> dict:
    return {
        "owner_id": "o", "scan_id": "s", "page_id": page, "result_version": version, "accepted_at": "2024-01-31T23:00:00Z", "observed_at": "2024-02-01T00:10:00Z", "normalized_url": f"https://e.com/{page}", "final_url": f"https://e.com/{page}",
        "status_code": 200, "content_type": "text/html", "fetch_outcome": "SUCCESS", "error_code": "", "total_ms": 5, "response_bytes": 9, "title": "é", "meta_description": "", "canonical_url": "", "h1": [],
        "hreflang": [{"language": "vi", "url": "https://e.com/vi"}], "redirects": [], "links": [{"target_url": "https://E.com/x", "anchor_text": "x", "tag": "a", "is_internal": True, "is_followable": True, "ordinal": 0}],
        "findings": [{"rule_id": "r", "rule_version": 1, "category": "SEO", "severity": severity, "code": "C", "message": "m", "evidence": {"b": "2", "a": "1"}}],
    } | more


def staged(spark, *items):
    rows = [(f"b-{p['page_id']}-{p['result_version']}", "o", p["page_id"], p["result_version"], json.dumps(p)) for p in items]
    df = spark.createDataFrame(rows, "batch_id string, owner_id string, page_id string, result_version long, payload string")
    parsed = F.from_json("payload", fetches.PAYLOAD)
    return df.withColumn("payload_sha256", fetches.payload_hash(parsed))


def test_decode_quarantine(spark):
    a, b = str(uuid.uuid4()), str(uuid.uuid4())
    good = staged(spark, payload(a, "INFO"))
    assert fetches.decode_payloads(good).first().problem is None
    put = lambda **kw: good.withColumns({k: F.lit(v) for k, v in kw.items()})
    text = json.dumps(payload(a, "INFO"))
    cases = {
        "CHECKSUM_MISMATCH": put(payload_sha256="0"), "ENVELOPE_MISMATCH": put(page_id=b), "INVALID_JSON": put(payload="{"),
        "UNKNOWN_FIELD": put(payload=json.dumps(payload(a, "INFO", extra=1))),
    }
    for want, df in cases.items():
        assert fetches.decode_payloads(df).first().problem == want
    nested = payload(a, "INFO")
    nested["links"][0]["odd"] = 1
    assert fetches.decode_payloads(put(payload=json.dumps(nested))).first().problem == "UNKNOWN_FIELD"
    assert fetches.decode_payloads(put(payload=text + " x")).first().problem == "INVALID_JSON"


def test_payloads_in_canonical_form_and_others(spark):
    """The form that is written here needs no look at its names; all problems are told in both. A name twice in a map is a problem, no error."""
    page = str(uuid.uuid4())
    loose = staged(spark, payload(page, "INFO"))
    exact = loose.withColumn("payload", fetches.canonical_payload(F.from_json("payload", fetches.PAYLOAD)))
    for df in (loose, exact):
        text = df.first().payload
        assert fetches.decode_payloads(df).first().problem is None
        cases = {"INVALID_JSON": [text + " {}", text + text, text[:-1], "[" + text + "]", re.sub(r'"evidence": ?{', '"evidence":{"a":"0",', text)], "UNKNOWN_FIELD": [text[:-1] + ',"odd":1}', text.replace('"ordinal"', '"odd":1,"ordinal"')]}
        for want, texts in cases.items():
            assert [r.problem for t in texts for r in fetches.decode_payloads(df.withColumn("payload", F.lit(t))).collect()] == [want] * len(texts)
        assert fetches.decode_payloads(df.withColumn("payload_sha256", F.lit("0"))).first().problem == "CHECKSUM_MISMATCH"


def test_write_replay(spark, tmp_path):
    a, b = str(uuid.uuid4()), str(uuid.uuid4())
    path = str(tmp_path / "facts")
    good, bad = fetches.decoded(staged(spark, payload(a, "INFO"), payload(b, "WARNING")))
    assert bad.count() == 0
    for _ in range(2):
        fetches.write_facts(good, path)
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("page_metrics", "findings", "page_links", "ingestion_receipts")}
    assert {n: d.count() for n, d in read.items()} == {"page_metrics": 2, "findings": 2, "page_links": 2, "ingestion_receipts": 2}
    m = read["page_metrics"].first()
    assert str(m.retention_month) == "2024-01-01" and m.title_length == 2 and m.hreflang_languages == ["vi"]
    f = read["findings"].where(F.col("page_id") == a).first()
    assert f.finding_id == str(uuid.uuid5(uuid.UUID(a), "r:1")) and f.evidence_json == '{"a":"1","b":"2"}'
    assert read["page_links"].first().target_host == "e.com"
    s = pages.scan_summary(read["page_metrics"], read["findings"]).first()
    assert (s.total_urls, s.issue_pages, s.finding_count, s.status_2xx) == (2, 1, 2, 2)
    # a crash before the receipts: facts repeat, the current view doesn't
    good.sparkSession.createDataFrame([], read["ingestion_receipts"].schema).write.mode("overwrite").parquet(f"{path}/ingestion_receipts")
    fetches.write_facts(good, path)
    again = spark.read.parquet(f"{path}/page_metrics")
    assert again.count() == 4 and pages.current_view(again, pages.PAGE).count() == 2


def test_ingest_stream(spark, tmp_path):
    a = str(uuid.uuid4())
    source, path = str(tmp_path / "in"), str(tmp_path / "facts")
    df = staged(spark, payload(a, "INFO"), payload(a, "INFO", 2))
    df.unionByName(df.withColumn("payload", F.lit("{")).limit(1).withColumn("batch_id", F.lit("bad"))).write.parquet(source)
    for run in range(2):
        q = events_ingest(spark, df, source, path, str(tmp_path / f"cp{run}"))
        assert q.awaitTermination(120)
    assert spark.read.parquet(f"{path}/page_metrics").count() == 2
    assert {r.problem for r in spark.read.parquet(f"{path}/quarantine").collect()} == {"INVALID_JSON"}


def events_ingest(spark, df, source, path, checkpoint):
    return events.ingest_stream(spark.readStream.schema(df.schema).parquet(source), path, checkpoint)


def event(version, status, message=None, **n):
    base = dict.fromkeys(events.COUNTERS, 0) | {"discovered": 2000}
    return {"message_id": message or f"m{version}", "aggregate_id": "s", "owner_id": "o", "aggregate_version": version, "status": status, "terminal_code": "", "terminal_message": "", "occurred_at": T0} | base | n


def as_df(spark, items):
    names = [c.split()[0] for c in events.EVENT.split(", ")]
    df = spark.createDataFrame([(*(e[n] for n in names), k) for k, e in enumerate(items)], events.EVENT + ", arrival long")
    return df


def test_projection_any_order(spark):
    """Versions 1 to 100, each three times, shuffled: always the same last state."""
    items = [event(v, "RUNNING" if v < 100 else "COMPLETED", processed=v, succeeded=v) for v in range(1, 101)] * 3
    for seed in range(2):
        random.Random(seed).shuffle(items)
        got = events.project_batch(as_df(spark, items))
        assert got.count() == 300
        last = events.final_projection(got).first()
        assert (last.state, last.last_version) == ("COMPLETED", 100)


def test_projection_rules():
    p = events.Projection()
    step = lambda e: events.step("scan", p, e)
    assert step(event(1, "QUEUED")) == "APPLIED" and p.status == "QUEUED" and p.version == 1
    assert step(event(2, "CANCEL_REQUESTED")) == "REJECTED"
    assert step(event(3, "RUNNING", succeeded=1, processed=1)) == "APPLIED"
    assert step(event(3, "RUNNING", succeeded=1, processed=1)) == "IGNORED_DUPLICATE"
    assert step(event(3, "RUNNING", succeeded=2, processed=2)) == "COLLISION"
    assert step(event(2, "RUNNING", message="late")) == "IGNORED_STALE"
    assert step(event(4, "RUNNING", processed=5)) == "REJECTED"
    assert step(event(5, "RUNNING", analytics_published=2, analytics_expected=1)) == "REJECTED"
    assert step(event(6, "CANCEL_REQUESTED")) == "APPLIED" and step(event(7, "RUNNING")) == "APPLIED" and p.status == "CANCEL_REQUESTED"
    assert step(event(8, "CANCELLED", analytics_expected=1, analytics_published=1)) == "APPLIED" and p.analytics == "READY"
    assert step(event(9, "RUNNING")) == "IGNORED_STALE"
    c = events.Projection(status="CANCEL_REQUESTED")
    assert events.step("clone", c, event(1, "RUNNING")) == "IGNORED_STALE" and events.step("clone", c, event(2, "CANCELLED")) == "APPLIED"
    assert events.step("capture", events.Projection(), event(1, "INDEXING", analytics_expected=2, analytics_published=1)) == "APPLIED"


def test_stream_equals_batch(spark, tmp_path):
    items = [event(v, "RUNNING" if v < 20 else "COMPLETED", processed=v, succeeded=v) for v in range(1, 21)]
    df = as_df(spark, items)
    source = str(tmp_path / "in")
    df.coalesce(1).sortWithinPartitions("arrival").write.parquet(source)
    stream = events.project_stream(events.state_session(spark).readStream.schema(df.schema).parquet(source).drop("arrival"))
    q = stream.writeStream.format("memory").queryName("projected").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {(r.message_id, r.outcome, r.state) for r in events.project_batch(df).collect()}
    assert {(r.message_id, r.outcome, r.state) for r in stream.sparkSession.table("projected").collect()} == want
    rows = df.select(F.col("aggregate_id").alias("scan_id"), F.col("aggregate_version").alias("version"), "status", (F.col("occurred_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("aggregate_version") * 0.3)).alias("occurred_at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in2"))
    sampled = events.sample_stream(events.state_session(spark).readStream.schema(rows.schema).parquet(str(tmp_path / "in2")))
    q = sampled.writeStream.format("memory").queryName("sampled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.version for r in sampled.sparkSession.table("sampled").collect()} == {r.version for r in workflow.sample_progress(rows).collect()}


def drain(out, path, name):
    """Runs a stream over what is there and returns all that it has written so far."""
    out.writeStream.format("parquet").option("path", f"{path}/{name}-out").option("checkpointLocation", f"{path}/{name}-cp").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/{name}-out")


def test_stream_state_lasts_over_batches(spark, tmp_path):
    """Several aggregates in several runs: duplicates, collisions and late versions of earlier runs are told by the state."""
    runs = [
        [event(1, "RUNNING"), event(3, "RUNNING", message="three"), event(2, "RUNNING", message="late")],
        [event(3, "RUNNING", message="three"), event(3, "RUNNING", message="three", processed=1, succeeded=1), event(4, "COMPLETED", message=None), event(5, "RUNNING", message="after")],
        [event(4, "COMPLETED", message=None), event(2, "RUNNING", message="late"), event(9, "RUNNING", message="after")],
    ]
    runs = [[e | {"aggregate_id": a} for e in items for a in "st"] for items in runs]
    own, path, arrival = events.state_session(spark), str(tmp_path), 0
    for items in runs:
        as_df(spark, items).withColumn("arrival", F.col("arrival") + arrival).repartition(3).write.mode("append").parquet(f"{path}/in")
        arrival += len(items)
        stream = events.project_stream(own.readStream.schema(as_df(spark, items).schema).parquet(f"{path}/in"), arrival="arrival")
        got = drain(stream, path, "all")
    every = [e for items in runs for e in items]
    pick = ("aggregate_id", "message_id", "aggregate_version", "outcome", "state", "last_version", "analytics")
    want = events.project_batch(as_df(spark, every)).select(*pick)
    assert rows(got.select(*pick)) == rows(want)
    assert {r.outcome for r in got.collect()} == {"APPLIED", "IGNORED_DUPLICATE", "COLLISION", "IGNORED_STALE"}


def test_stream_state_ends(spark, tmp_path):
    """An ended aggregate is forgotten some time after its last event; a running one keeps its version. A stream with timers runs on until it is stopped."""
    own, path = events.state_session(spark), str(tmp_path)
    first = [event(2, "COMPLETED") | {"aggregate_id": "ended"}, event(2, "RUNNING") | {"aggregate_id": "running"}]
    again = [event(1, "RUNNING") | {"aggregate_id": a} for a in ("ended", "running")]
    as_df(spark, first).write.parquet(f"{path}/in")
    stream = events.project_stream(own.readStream.schema(as_df(spark, first).schema).parquet(f"{path}/in"), keep_hours=3 / 3600, arrival="arrival")
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(processingTime="500 milliseconds").start()

    def upto(n: int) -> set:
        until, got = time.monotonic() + 60, []
        while time.monotonic() < until and len(got) < n:
            time.sleep(0.5)
            assert q.exception() is None
            got = spark.read.schema(stream.schema).parquet(f"{path}/out").collect() if (tmp_path / "out").exists() else []
        return {(r.aggregate_id, r.aggregate_version, r.outcome) for r in got}

    try:
        assert upto(2) == {("ended", 2, "APPLIED"), ("running", 2, "APPLIED")}
        time.sleep(6)
        as_df(spark, again).write.mode("append").parquet(f"{path}/in")
        assert upto(4) == {("ended", 2, "APPLIED"), ("running", 2, "APPLIED"), ("ended", 1, "APPLIED"), ("running", 1, "IGNORED_STALE")}
    finally:
        q.stop()


def test_stream_needs_a_session_with_state(spark, tmp_path):
    as_df(spark, [event(1, "RUNNING")]).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(events.PROVIDER, "")
    with pytest.raises(ValueError, match="state_session"):
        events.project_stream(spark.readStream.schema(events.EVENT).parquet(str(tmp_path / "in")))
    assert events.state_session(spark).conf.get(events.PROVIDER) == events.ROCKSDB and spark.conf.get(events.PROVIDER, "") == before


def test_manifest_and_read(spark, tmp_path):
    files = spark.createDataFrame([("j", "b.txt", 2), ("j", "a.txt", 1)], "job_id string, path string, bytes long")
    fetches.write_manifest(files, str(tmp_path / "m"), "job_id")
    text = json.loads(spark.read.text(str(tmp_path / "m")).first().value)
    assert text["schema_version"] == 1 and [f["path"] for f in text["files"]] == ["a.txt", "b.txt"]
    spark.createDataFrame([("p", "https://e.com/")], "page_id string, final_url string").write.parquet(str(tmp_path / "f"))
    row = fetches.read_fetches(spark, str(tmp_path / "f")).first()
    assert row.page_id == "p" and row.status_code is None


def test_payloads_are_parsed_once(spark):
    """Each payload has its fields read by one parser, however many columns, filters and checks use them."""
    staged_rows = spark.createDataFrame([("b", "o", "p", 1, "{}", "0")], "batch_id string, owner_id string, page_id string, result_version long, payload string, payload_sha256 string")
    metrics, _, links = fetches.explode_page_results(fetches.decoded(staged_rows)[0])
    for df in (metrics, links):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(StructField(owner_id") == 1
        assert plan.count("from_json(") == 3  # the fields, what trails, the names of nested fields


def test_facts_are_written_without_a_cache(spark, tmp_path, monkeypatch):
    """Rows for several writes lie in files, which go at the end: caches of whole partitions are more than an executor holds."""
    a, b = str(uuid.uuid4()), str(uuid.uuid4())
    path, source = str(tmp_path / "facts"), str(tmp_path / "in")
    both = staged(spark, payload(a, "INFO"), payload(b, "INFO"))

    def persist(*_):
        raise AssertionError("cached")

    monkeypatch.setattr(type(both), "persist", persist)
    fetches.write_facts(fetches.decoded(both)[0], path)
    both.write.parquet(source)
    assert events_ingest(spark, both, source, path, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(f"{path}/page_metrics").count() == 2
    assert not list((tmp_path / "facts").glob("rows-*"))


def test_only_rows_without_a_receipt_are_added(spark, tmp_path):
    """Of a replay that brings old and new pages, the new ones are; rows without a batch have no receipt that they could match."""
    ids = [str(uuid.uuid4()) for _ in range(3)]
    path = str(tmp_path / "facts")
    good = fetches.decoded(staged(spark, *(payload(x, "INFO") for x in ids)))[0]
    first = good.where(F.col("page_id") != ids[2])
    odd = good.where(F.col("page_id") == ids[2]).withColumn("batch_id", F.lit(None).cast("string"))
    when = F.lit(T0)
    fetches.write_facts(first, path, when)
    fetches.write_facts(good, path, F.col("result.accepted_at"))
    fetches.write_facts(odd.unionByName(first), path, when)
    fetches.write_facts(odd, path, when)
    count = lambda name, key: dict(rows(spark.read.parquet(f"{path}/{name}").groupBy(key).count()))
    want = {ids[0]: 1, ids[1]: 1, ids[2]: 3}
    assert count("page_metrics", "page_id") == count("findings", "page_id") == count("page_links", "source_page_id") == count("ingestion_receipts", "aggregate_id") == want
    assert not list((tmp_path / "facts").glob("rows-*"))


def test_staged_events_are_dealt_to_all_cores(spark):
    assert staged_queries.staged(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
