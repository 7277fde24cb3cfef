"""Projections of progress events: one rule set, used by the batch twin and by the streams.

Order comes from versions; there is no event time. A group is an aggregate (a scan,
capture or clone); its state is a small record, and a map of the messages seen, of
which a batch reads and writes only the messages that it brings.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from webstrata.operators.folds import fold
from webstrata.sources import fetches
from webstrata.sources.tables import laid_down

TERMINAL = frozenset(("COMPLETED", "PARTIAL_SUCCESS", "FAILED", "CANCELLED"))
SCAN_STATES = TERMINAL | {"QUEUED", "RUNNING", "CANCEL_REQUESTED"}
CAPTURE_STATES = TERMINAL | {"QUEUED", "RUNNING", "INDEXING", "CANCEL_REQUESTED"}
CLONE_STATES = TERMINAL | {"QUEUED", "RUNNING", "ASSEMBLING", "WAITING_FOR_SCAN", "CANCEL_REQUESTED", "EXPIRED"}
#: States that follow a state, besides itself: fixed values.
FOLLOWS = {"QUEUED": TERMINAL | {"RUNNING"}, "RUNNING": TERMINAL | {"CANCEL_REQUESTED"}, "CANCEL_REQUESTED": TERMINAL}
COUNTERS = ("discovered", "queued", "processed", "succeeded", "failed", "analytics_expected", "analytics_published")
#: What a message says, beside its own id and time.
HASHED = (*COUNTERS, "aggregate_id", "owner_id", "aggregate_version", "status", "terminal_code", "terminal_message")
MOST_CLONE_PAGES, MOST_CLONE_BYTES = 100_000, 50 * 1024**3
EVENT = (
    "message_id string, aggregate_id string, owner_id string, aggregate_version long, status string, discovered long, queued long, processed long, succeeded long, failed long, "
    "analytics_expected long, analytics_published long, terminal_code string, terminal_message string, occurred_at timestamp"
)
OUTCOME = "aggregate_id string, message_id string, aggregate_version long, outcome string, state string, last_version long, analytics string"


@dataclass
class Projection:
    """What is known of an aggregate; ``seen``: payload hash by message id."""

    status: str = "QUEUED"
    version: int = 0
    counters: dict = field(default_factory=dict)
    analytics: str = "PENDING"
    terminal_code: str | None = None
    seen: dict = field(default_factory=dict)


def payload_hash(event: dict) -> str:
    """Of the payload: all but the envelope's id and time."""
    body = {k: None if pd.isna(v) else (int(v) if k in (*COUNTERS, "aggregate_version") else v) for k, v in event.items() if k in HASHED}
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()


def numbers(event: dict) -> dict[str, int]:
    return {c: 0 if pd.isna(event.get(c)) else int(event[c]) for c in COUNTERS}


def scan_rule(p: Projection, event: dict, n: dict[str, int], status: str) -> str:
    """APPLIED, or why a scan event changes nothing. A QUEUED event only advances the version."""
    if n["processed"] != n["succeeded"] + n["failed"] or n["queued"] + n["processed"] > n["discovered"] or min(n.values()) < 0:
        return "REJECTED"
    if not n["analytics_published"] <= n["analytics_expected"] <= n["discovered"]:
        return "REJECTED"
    if p.status in TERMINAL:
        return "IGNORED_STALE"
    if status == "QUEUED":
        p.version = int(event["aggregate_version"])
        return "APPLIED_VERSION"
    if status != p.status and status not in FOLLOWS.get(p.status, ()) and not (p.status == "CANCEL_REQUESTED"):
        return "REJECTED"
    # while a cancellation is asked for, progress goes on but the state stays
    p.status = p.status if p.status == "CANCEL_REQUESTED" and status not in TERMINAL else status
    return "APPLIED"


def capture_rule(p: Projection, event: dict, n: dict[str, int], status: str) -> str:
    if p.status in TERMINAL:
        return "IGNORED_STALE"
    if min(n.values()) < 0 or n["analytics_published"] > n["analytics_expected"]:
        return "REJECTED"
    p.status = status
    return "APPLIED"


def clone_rule(p: Projection, event: dict, n: dict[str, int], status: str) -> str:
    if p.status in TERMINAL | {"EXPIRED"}:
        return "IGNORED_STALE"
    if min(n.values()) < 0 or not n["processed"] <= n["discovered"] <= MOST_CLONE_PAGES or n["succeeded"] + n["failed"] != n["processed"]:
        return "REJECTED"
    if p.status == "CANCEL_REQUESTED" and status not in TERMINAL:
        return "IGNORED_STALE"
    p.status = status
    return "APPLIED"


RULES: dict[str, tuple[frozenset, Callable[[Projection, dict, dict, str], str]]] = {
    "scan": (SCAN_STATES, scan_rule),
    "capture": (CAPTURE_STATES, capture_rule),
    "clone": (CLONE_STATES, clone_rule),
}


def step(kind: str, p: Projection, event: dict) -> str:
    """Applies one event to a projection, in the order of arrival; tells what came of it."""
    states, rule = RULES[kind]
    hashed = payload_hash(event)
    if event["message_id"] in p.seen:
        return "IGNORED_DUPLICATE" if p.seen[event["message_id"]] == hashed else "COLLISION"
    if int(event["aggregate_version"]) <= p.version:
        p.seen[event["message_id"]] = hashed
        return "IGNORED_STALE"
    status, n = str(event["status"] or "").upper(), numbers(event)
    outcome = rule(p, event, n, status) if status in states else "REJECTED"
    if outcome != "REJECTED":
        p.seen[event["message_id"]] = hashed
    if outcome == "APPLIED":
        p.version, p.counters = int(event["aggregate_version"]), n
        expected, published = n["analytics_expected"], n["analytics_published"]
        p.analytics = "READY" if expected == published and p.status in TERMINAL else "INDEXING" if expected > published else "PENDING"
        if p.status in TERMINAL:
            p.terminal_code = event.get("terminal_code") or None
    return "APPLIED" if outcome == "APPLIED_VERSION" else outcome


def outcomes(kind: str, p: Projection, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for event in rows.to_dict("records"):
        outcome = step(kind, p, event)
        out.append((event["aggregate_id"], event["message_id"], int(event["aggregate_version"]), outcome, p.status, p.version, p.analytics))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])


def project_batch(events: DataFrame, kind: str = "scan", arrival: str = "arrival") -> DataFrame:
    """The batch twin: one outcome per event, applied per aggregate in the order of ``arrival``, then message id."""
    names = [c.split()[0] for c in EVENT.split(", ")]

    def apply(p: Projection, event: dict) -> tuple:
        outcome = step(kind, p, event)
        return event["aggregate_id"], event["message_id"], event["aggregate_version"], outcome, p.status, p.version, p.analytics

    return fold(events.select(*names, arrival), ["aggregate_id"], [arrival, "message_id"], lambda r: Projection(), apply, OUTCOME)


def final_projection(outcome_rows: DataFrame) -> DataFrame:
    """(aggregate_id, state, last_version, analytics) after all events, whatever their order."""
    last = F.max_by(F.struct("state", "last_version", "analytics"), F.struct("last_version", (F.col("outcome") == "APPLIED").cast("int").alias("a"))).alias("last")
    return outcome_rows.groupBy("aggregate_id").agg(last).select("aggregate_id", "last.*")


PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


def state_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose streams keep map state and timers, which need RocksDB; ``spark`` stays as it is."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set(PROVIDER, ROCKSDB)
    return own


def keeps_state(events: DataFrame) -> None:
    if events.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError("this stream keeps map state: read its source with state_session(spark)")


class Seen:
    """The messages of one aggregate, as a mapping over map state: each is read once a batch."""

    def __init__(self, state):
        self.state, self.read = state, {}

    def __contains__(self, message: str | None) -> bool:
        if message not in self.read:
            at = (self.key(message),)
            self.read[message] = self.state.getValue(at)[0] if self.state.containsKey(at) else None
        return self.read[message] is not None

    def __getitem__(self, message: str | None) -> str:
        return self.read[message]

    def __setitem__(self, message: str | None, hashed: str) -> None:
        self.state.updateValue((self.key(message),), (hashed,))
        self.read[message] = hashed

    @staticmethod
    def key(message: str | None) -> str:
        return "" if message is None else f"={message}"


class Projector(StatefulProcessor):
    """Applies a batch's events to each aggregate. With ``keep_ms`` a message is forgotten so long after it
    was seen, and all of an ended aggregate so long after its last event."""

    def __init__(self, kind: str, keep_ms: int | None, arrival: str | None):
        self.kind, self.keep_ms, self.arrival = kind, keep_ms, arrival

    def init(self, handle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "record string")
        self.seen = handle.getMapState("seen", "message string", "hash string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        p = Projection(**json.loads(self.record.get()[0])) if self.record.exists() else Projection()
        p.seen = Seen(self.seen)
        parts = rows if self.arrival is None else [pd.concat(list(rows)).sort_values([self.arrival, "message_id"], kind="stable")]
        for part in parts:
            yield outcomes(self.kind, p, part)
        self.record.update((json.dumps({k: v for k, v in vars(p).items() if k != "seen"}),))
        if self.keep_ms is not None and p.status in TERMINAL | {"EXPIRED"}:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.record.clear()
        self.seen.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def project_stream(events: DataFrame, kind: str = "scan", keep_hours: float | None = None, arrival: str | None = None) -> DataFrame:
    """Streaming: outcomes of the events of each micro-batch; ``events`` comes from a ``state_session``.

    ``keep_hours``: state goes so long after its use, by processing time; a running
    aggregate keeps its record, an ended one goes as a whole. With None state stays, and
    a stream over what is available now ends by itself. ``arrival``: a column that
    orders an aggregate's events within a micro-batch; with None they are taken as
    they come.
    """
    keeps_state(events)
    keep_ms = None if keep_hours is None else int(keep_hours * HOUR_MS)
    return events.groupBy("aggregate_id").transformWithStateInPandas(Projector(kind, keep_ms, arrival), OUTCOME, "Append", "None" if keep_ms is None else "ProcessingTime")


class Sampler(StatefulProcessor):
    """Sends on a scan's events; its state is the last version seen and the last event sent."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "version long, at double, status string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last_version, last_at, last_status = self.last.get() if self.last.exists() else (-1, None, None)
        keep = []
        for r in pd.concat(list(rows)).sort_values("version", kind="stable").itertuples(index=False):
            at = r.occurred_at.timestamp()
            if r.version > last_version and (r.status in TERMINAL or last_at is None or not (last_at > at - 1 and last_status == r.status)):
                last_version, last_at, last_status = int(r.version), at, r.status
                keep.append((r.scan_id, int(r.version), r.status, r.occurred_at))
        self.last.update((last_version, last_at, last_status))
        yield pd.DataFrame(keep, columns=["scan_id", "version", "status", "occurred_at"])

    def close(self) -> None:
        pass


def sample_stream(events: DataFrame, keep_hours: float | None = None) -> DataFrame:
    """Streaming form of sample_progress; ``events`` comes from a ``state_session``.

    Events of a scan arrive in the order of versions from batch to batch. ``keep_hours``:
    a scan without events for so long is forgotten.
    """
    keeps_state(events)
    keep_ms = None if keep_hours is None else int(keep_hours * HOUR_MS)
    return events.groupBy("scan_id").transformWithStateInPandas(Sampler(keep_ms), "scan_id string, version long, status string, occurred_at timestamp", "Append", "None" if keep_ms is None else "ProcessingTime")


def ingest_stream(staged: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a stream of staged payloads into fact tables; replays are skipped by their receipts, bad rows quarantined."""

    def write(batch: DataFrame, batch_no: int) -> None:
        rows = fetches.decode_payloads(batch.dropDuplicates(fetches.RECEIPT))
        used = rows.withColumns({"payload": F.when(F.col("problem").isNotNull(), F.col("payload")), "result": F.when(F.col("problem").isNull(), F.col("result"))})
        with laid_down(used, path) as decoded:  # once for both
            good, bad = fetches.parted(decoded)
            fetches.write_facts(good, path, at_rest=True)
            bad.write.mode("append").parquet(f"{path}/quarantine")

    return staged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
