"""Workflow reports: scans, websites, executions, outbox, retention, load."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.operators import order
from webstrata.operators.folds import fold

ACTIVE_SCAN = ("QUEUED", "RUNNING", "CANCEL_REQUESTED")
TERMINAL_SCAN = ("COMPLETED", "PARTIAL_SUCCESS", "FAILED", "CANCELLED")
#: Days (hours) that rows are kept: fixed values.
RETENTION_DAYS = {"facts": 180, "receipts": 30, "html": 30, "screenshot": 30, "bodies": 7, "archives": 7}
RETENTION_HOURS = {"staged": 1}


def scan_list(
    scans: DataFrame, *, owner: str | None = None, website: str | None = None, statuses: tuple[str, ...] = (), created_from=None, created_to=None,
    terminal_code: str | None = None, failed_at_least: int | None = None, sort: str = "created_at", descending: bool = True, n: int = 20,
) -> DataFrame:
    out = scans
    for value, test in (
        (owner, lambda v: F.col("owner_id") == v), (website, lambda v: F.col("website_id") == v), (statuses or None, lambda v: F.col("status").isin(*v)),
        (created_from, lambda v: F.col("created_at") >= v), (created_to, lambda v: F.col("created_at") < v), (terminal_code, lambda v: F.col("terminal_code") == v),
        (failed_at_least, lambda v: F.col("failed_count") >= v),
    ):
        if value is not None:
            out = out.where(test(value))
    order = F.desc if descending else F.asc
    return out.orderBy(order(sort), order("id")).limit(n)


def website_list(
    websites: DataFrame, scans: DataFrame, *, owner: str | None = None, statuses: tuple[str, ...] = (), query: str = "", host: str | None = None,
    has_active: bool | None = None, sort: str = "display_name", descending: bool = False, n: int = 20,
) -> DataFrame:
    out = websites
    if owner is not None:
        out = out.where(F.col("owner_id") == owner)
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if query:
        hit = F.lit(False)
        for c in ("display_name", "hostname", "canonical_url"):
            hit = hit | F.contains(F.lower(c), F.lit(query.lower()))
        out = out.where(hit)
    if host is not None:
        out = out.where(F.col("hostname") == host)
    if has_active is not None:
        active = scans.where(F.col("status").isin(*ACTIVE_SCAN)).select(F.col("website_id").alias("_site")).distinct()
        out = out.join(active, F.col("id") == F.col("_site"), "left_semi" if has_active else "left_anti")
    return out.orderBy(F.desc(sort) if descending else F.asc(sort), F.asc("id")).limit(n)


def websites_with_latest_scan(websites: DataFrame, scans: DataFrame) -> DataFrame:
    row = F.struct(F.col("id").alias("scan_id"), "status", "processed_count", "succeeded_count", "failed_count", "created_at")
    newest = scans.groupBy("website_id").agg(F.max_by(row, F.struct("created_at", "id")).alias("latest"))
    out = websites.join(newest, F.col("website_id") == websites["id"], "left")
    count = lambda c: F.coalesce(F.col(f"latest.{c}"), F.lit(0)).alias(c)
    return out.select(
        websites["id"].alias("website_id"), "display_name", F.col("latest.scan_id").alias("latest_scan_id"), F.col("latest.status").alias("latest_status"),
        *map(count, ("processed_count", "succeeded_count", "failed_count")),
    )


def execution_counts(scan_pages: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    rows = scan_pages.groupBy("execution_id").agg(*map(n, ("QUEUED", "LEASED", "PERSISTING", "SUCCEEDED", "FAILED", "SKIPPED", "CANCELLED")))
    return rows.withColumn("processed", F.col("succeeded") + F.col("failed") + F.col("skipped") + F.col("cancelled"))


def execution_status(counts: DataFrame) -> DataFrame:
    """Adds final_status to counts with status, published and expected: null while work is left."""
    bad = F.col("failed") + F.col("skipped") + F.col("cancelled")
    ended = (F.col("queued") == 0) & (F.col("leased") == 0) & (F.col("persisting") == 0) & (F.col("published") == F.col("expected"))
    final = F.when(F.col("status") == "CANCEL_REQUESTED", "CANCELLED").when((F.col("succeeded") > 0) & (bad == 0), "COMPLETED").when(F.col("succeeded") > 0, "PARTIAL_SUCCESS").otherwise("FAILED")
    return counts.withColumn("final_status", F.when(ended, final))


def dashboard_summary(websites: DataFrame, scans: DataFrame, since: Column) -> DataFrame:
    """Per owner; owners with websites only, or with scans only, are there, too."""
    sites = websites.groupBy("owner_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("active_websites"))
    recent = F.col("created_at") >= since
    total = lambda c: F.coalesce(F.sum(F.when(recent, F.col(c))), F.lit(0)).alias(c)
    work = scans.groupBy("owner_id").agg(
        F.count_if(recent).alias("scans_since"), F.count_if(F.col("status").isin(*ACTIVE_SCAN)).alias("active_scans"), *map(total, ("processed_count", "succeeded_count", "failed_count"))
    )
    rows = sites.join(work, "owner_id", "full_outer").na.fill(0)
    return rows.withColumn("success_rate", F.when(F.col("processed_count") > 0, F.floor(F.col("succeeded_count") * 100 / F.col("processed_count") + 0.5)))


def active_scan_quota(scans: DataFrame, per_user: int = 3, per_website: int = 1) -> DataFrame:
    """(kind, id, active, limit): users and websites that are at their limit."""
    active = scans.where(F.col("status").isin(*ACTIVE_SCAN))
    who = F.explode(F.array(F.struct(F.lit("user").alias("kind"), F.col("owner_id").alias("id"), F.lit(per_user).alias("limit")), F.struct(F.lit("website").alias("kind"), F.col("website_id").alias("id"), F.lit(per_website).alias("limit"))))
    rows = active.select(who.alias("w")).groupBy("w.kind", "w.id", "w.limit").agg(F.count(F.lit(1)).alias("active"))
    return rows.where(F.col("active") >= F.col("limit"))


def clone_ready(scans: DataFrame, clones: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Commands of waiting clones whose scan ended: a clone request, or a failure if the scan was cancelled."""
    waiting = clones.where(F.col("status") == "WAITING_FOR_SCAN").alias("c")
    rows = scans.where(F.col("status").isin(*TERMINAL_SCAN)).alias("s").join(waiting, F.col("c.scan_id") == F.col("s.id"))
    cancelled = F.col("s.status") == "CANCELLED"
    return rows.select(
        F.col("c.id").alias("clone_id"), F.col("c.owner_id").alias("owner_id"), F.col("s.id").alias("scan_id"),
        F.when(cancelled, "SITE_CLONE_FAILED").otherwise("SITE_CLONE_REQUESTED").alias("command"),
        F.when(~cancelled, F.least("s.max_pages", F.lit(limits["max_pages"]))).alias("max_pages"), F.when(cancelled, "SOURCE_SCAN_NOT_CLONEABLE").alias("failure_code"),
    )


def reconcile_receipts(receipts: DataFrame, delivered: DataFrame, facts: DataFrame) -> DataFrame:
    """(owner_id, aggregate_id, receipts, delivered, receipt_rows, fact_rows, state).

    Receipts and deliveries are compared by batches, receipts and facts by rows.
    """
    key = ["owner_id", "aggregate_id"]
    a = receipts.groupBy(*key).agg(F.count_distinct("batch_id").alias("receipt_batches"), F.sum("fact_rows").alias("receipt_rows"))
    b = delivered.groupBy(*key).agg(F.count_distinct("batch_id").alias("delivered_batches"))
    c = facts.groupBy(*key).agg(F.count(F.lit(1)).alias("fact_rows"))
    rows = a.join(b, key, "full_outer").join(c, key, "full_outer").na.fill(0)
    state = (
        F.when((F.col("receipt_batches") < F.col("delivered_batches")), "MISSING").when(F.col("receipt_batches") > F.col("delivered_batches"), "EXTRA")
        .when(F.col("receipt_rows") != F.col("fact_rows"), "MISMATCH").otherwise("OK")
    )
    return rows.withColumn("state", state)


def expire(df: DataFrame, kind: str, now: Column, at: str = "observed_at") -> DataFrame:
    """Rows still kept; a row is gone once it is as old as its kind allows."""
    days = F.make_dt_interval(F.lit(RETENTION_DAYS.get(kind, 0)), F.lit(RETENTION_HOURS.get(kind, 0)))
    return df.where(F.col(at) > now - days)


def backlog_state(outbox: DataFrame, now: Column, max_age_minutes: int = 15) -> DataFrame:
    waiting = F.col("status").isin("PENDING", "CLAIMED", "DEAD")
    oldest = F.min(F.when(waiting, F.col("created_at")))
    late = oldest < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max_age_minutes))
    return outbox.agg(F.count_if(waiting).alias("waiting"), oldest.alias("oldest"), F.coalesce(late, F.lit(False)).alias("backpressured"))


def history_keyset(scans: DataFrame, after: tuple | None, n: int) -> DataFrame:
    from webstrata.operators.pages import keyset

    return keyset(scans, ["created_at", "id"], after, n, descending=True)


def sample_progress(events: DataFrame) -> DataFrame:
    """The progress events that are sent on: (scan_id, version, status, occurred_at).

    Terminal states always; others unless the last event sent is less than a second old
    and has the same status. What is sent depends on what was sent before; a scan has a
    few events for each of its pages.
    """
    second = datetime.timedelta(seconds=1)

    def step(last: dict, r: dict) -> tuple | None:
        if r["version"] == last["version"]:
            return None  # a version is sent once
        last["version"] = r["version"]
        recent = last["at"] is not None and last["at"] > r["occurred_at"] - second
        if r["status"] not in TERMINAL_SCAN and recent and last["status"] == r["status"]:
            return None
        last["at"], last["status"] = r["occurred_at"], r["status"]
        return r["scan_id"], r["version"], r["status"], r["occurred_at"]

    rows = events.select("scan_id", F.col("version").cast("long").alias("version"), "status", F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    start = lambda r: {"version": None, "at": None, "status": None}
    return fold(rows, ["scan_id"], ["version", "occurred_at"], start, step, "scan_id string, version long, status string, occurred_at timestamp")


def load_report(requests: DataFrame, elapsed_ms: float | None = None, groups: tuple[str, ...] = ()) -> DataFrame:
    """Counts and latencies (whole ms, nearest rank) of requests: started_at_ms,
    finished_at_ms (null: in flight), status, error, bytes.

    One run may hold all requests: quantiles and requests in flight are found in
    ranges of latencies and of time.
    """
    ended = F.col("finished_at_ms").isNotNull()
    good = ended & F.col("status").between(200, 399)
    latency = F.when(ended, F.greatest(F.ceil(F.col("finished_at_ms") - F.col("started_at_ms")), F.lit(0)))
    rows = requests.withColumn("latency", latency)
    keys = list(groups)
    main = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("started"), F.count_if(ended).alias("completed"), F.count_if(good).alias("succeeded"), F.count_if(ended & ~F.coalesce(good, F.lit(False))).alias("failed"),
        F.count_if(ended & F.col("status").isNull() & (F.col("error") == "TIMEOUT")).alias("timed_out"), F.sum(F.when(ended, F.col("bytes")).otherwise(0)).alias("bytes_received"),
        F.min("latency").alias("min_ms"), F.round(F.avg("latency"), 2).alias("mean_ms"), F.max("latency").alias("max_ms"),
        *([F.round(F.count_if(ended) * 1000 / F.lit(elapsed_ms), 2).alias("throughput_rps")] if elapsed_ms else []),
    )
    # +1 at each start, -1 at each end, ends first; summed up per instant before the running sum
    steps = F.explode(F.array(F.struct(F.col("started_at_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("finished_at_ms").alias("at"), F.lit(-1).alias("d"))))
    moves = rows.select(*keys, steps.alias("s")).where("s.at is not null").groupBy(*keys, "s.at", "s.d").agg(F.sum("s.d").alias("step"))
    flight = order.greatest_running_sum(moves, keys, ["at", "d"], "step").withColumnRenamed("peak", "max_in_flight")
    latencies = order.quantiles(rows, keys, "latency", {"p50_ms": "0.5", "p95_ms": "0.95", "p99_ms": "0.99"})
    return order.same(order.same(main, latencies, keys), flight, keys)


def histogram(requests: DataFrame, column: str, groups: tuple[str, ...] = ()) -> DataFrame:
    rows = requests.where(F.col(column).isNotNull()).groupBy(*groups, F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(*groups).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("histogram"))
