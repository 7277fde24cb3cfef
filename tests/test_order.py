from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from webstrata.operators import order, workflow

SHARES = {"p0": "0.001", "p50": "0.5", "p95": "0.95", "p99": "0.99", "p100": "1"}


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def disc(values, share):
    values = sorted(v for v in values if v is not None)
    return values[max(1, math.ceil(Fraction(share) * len(values))) - 1] if values else None


@pytest.mark.parametrize("size", [3, 5000])
def test_quantiles_of_hot_and_odd_groups(spark, size):
    """One group has nearly all rows; negative, huge, equal and null values; a null key; a group of nulls."""
    draw = random.Random(size)
    pick = lambda: draw.choice([draw.randint(-5, 5), draw.randint(0, 3000), draw.randint(-(10**12), 10**15), 77, None, 2**62, -(2**63)])
    data = [("hot", pick()) for _ in range(size)] + [("few", v) for v in (9, 9, 1)] + [(None, 4), (None, 6)] + [("none", None)] * 3
    df = spark.createDataFrame(data, "k string, v long").repartition(5)
    want = sorted([(k, *(disc([v for x, v in data if x == k], s) for s in SHARES.values())) for k in {k for k, _ in data}], key=repr)
    assert rows(order.quantiles(df, ["k"], "v", SHARES)) == want
    assert rows(order.quantiles(df, [], "v", SHARES)) == [tuple(disc([v for _, v in data], s) for s in SHARES.values())]
    assert order.quantiles(df.limit(0), ["k"], "v", SHARES).count() == 0


def test_no_task_has_the_values_of_a_group(spark):
    """The plan has no value map and no window; only counts by value meet by group, one row a range."""
    df = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") % 5000).alias("v"))
    plan = order.quantiles(df, ["k"], "v", {"p50": "0.5"})._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "Window" not in plan
    assert order.quantiles(df, ["k"], "v", {"p50": "0.5"}).first().p50 == 2499


def test_value_ranges_keep_the_order(spark):
    values = sorted({s * (2**k + d) for k in range(62) for d in (-1, 0, 1, 2**k // 3) for s in (1, -1)})
    got = [r.r for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", order.value_range(F.col("v")).alias("r")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 100


def test_running_sum_of_one_hot_run(spark):
    """The peak of a single run over many ranges, as a scan in Python finds it; no window has the run as its only key over rows."""
    draw = random.Random(2)
    data = [("a", draw.randint(0, 400), k, draw.randint(-3, 3)) for k in range(3000)] + [("b", 1, 0, -5), ("b", 2, 0, -1), (None, 1, 0, 4), (None, 2, 0, -4)]
    want = {}
    for k in {x[0] for x in data}:
        total = peak = None
        for _, _, _, d in sorted((x for x in data if x[0] == k), key=lambda x: x[1:3]):
            total = (total or 0) + d
            peak = total if peak is None else max(peak, total)
        want[k] = peak
    df = spark.createDataFrame(data, "run string, at int, n int, step int").repartition(7)
    got = order.greatest_running_sum(df, ["run"], ["at", "n"], "step")
    assert dict(rows(got)) == want
    plan = got._jdf.queryExecution().toString()
    assert "windowspecdefinition(run" not in plan or all(", part" in x for x in plan.split("windowspecdefinition(run")[1:])
    dealt = order.in_ranges(spark.range(200_000).select(F.lit("a").alias("run"), "id"), ["run"], ["id"])
    assert dealt.select("part").distinct().count() > 1


def test_first_of_each(spark):
    """Ranks go on from range to range; limits of nought, beyond the group and in between; null keys."""
    data = [("a", f"u{k:05d}", 700) for k in range(2000)] + [("b", f"u{k:05d}", 9999) for k in range(50)] + [("c", "x", 0), (None, "y", 1), (None, "z", 1)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "scan string, url string, most int").repartition(6)
    got = order.first_of_each(df, ["scan"], ["url"], F.col("most"))
    assert got.columns == ["scan", "url", "most", "rank"]
    want = []
    for scan in {x[0] for x in data}:
        own = sorted(x for x in data if x[0] == scan)
        want += [(*x, k + 1) for k, x in enumerate(own[: own[0][2]])]
    assert rows(got) == sorted(want, key=repr)
    assert order.first_of_each(df.limit(0), ["scan"], ["url"], F.col("most")).count() == 0


def test_load_report_of_one_run(spark):
    """Requests in flight, with ends before starts at the same instant, and latencies of a run without groups."""
    data = [(0, 10, 200, None, 5), (5, 12, 404, None, 5), (10, 30, None, "TIMEOUT", 0), (11, None, None, None, 0), (12, 13, 302, None, 1)]
    df = spark.createDataFrame(data, "started_at_ms long, finished_at_ms long, status int, error string, bytes long")
    r = workflow.load_report(df, 1000.0).first()
    assert (r.started, r.completed, r.succeeded, r.failed, r.timed_out, r.max_in_flight) == (5, 4, 2, 2, 1, 3)
    assert (r.p50_ms, r.p95_ms, r.p99_ms, r.min_ms, r.max_ms, r.throughput_rps) == (7, 20, 20, 1, 20, 4.0)
