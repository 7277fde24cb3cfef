from __future__ import annotations

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from webstrata.operators import pages
from webstrata.sources import fetches, layouts


@pytest.mark.parametrize("descending", [False, True])
def test_pages_of_ranges(spark, tmp_path, descending):
    """All pages of a listing with ties in the first column and deleted rows, one after the other, from either end."""
    draw = random.Random(1)
    data = list({(f"u{draw.randrange(60):02}", k) for k in range(500)})
    df = spark.createDataFrame(data, "url string, id long")
    layouts.write_ranges(df, str(tmp_path / "t"), ["url", "id"], files=40)
    for alive, kept in ((None, data), (F.col("id") % 10 == 0, [x for x in data if x[1] % 10 == 0])):
        want, after, got = sorted(kept, reverse=descending), None, []
        for _ in range(12):
            page = [tuple(r) for r in layouts.page_of_ranges(spark, str(tmp_path / "t"), ["url", "id"], after, 9, alive, descending).collect()]
            assert page == want[len(got) : len(got) + 10]
            got += page[:9]
            if len(page) < 10:
                break
            after = page[8]
    assert layouts.page_of_ranges(spark, str(tmp_path / "t"), ["url", "id"], ("v", 0) if not descending else ("a", 0), 9, None, descending).count() == 0


def test_a_page_reads_the_files_next_to_its_cursor(spark, tmp_path):
    """As many files for a table of ten times the size."""
    read = []
    for n in (1, 10):
        path = str(tmp_path / f"t{n}")
        layouts.write_ranges(spark.range(2000 * n).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("url"), "id"), path, ["url", "id"], files=20 * n)
        page = layouts.page_of_ranges(spark, path, ["url", "id"], ("00000500", 500), 20)
        assert [r.id for r in page.collect()] == list(range(501, 522))
        read.append(len(page.inputFiles()))
    assert max(read) <= 3


def test_current_view_of_buckets_has_no_shuffle(spark):
    """Versions appended later are seen before compaction and after; tombstones hide; compaction keeps one row a key."""
    table, keys = f"facts_{uuid.uuid4().hex}", ["owner_id", "page_id"]
    schema = "owner_id string, page_id string, record_version long, is_deleted boolean, title string"
    layouts.write_bucketed(spark.createDataFrame([("o", f"p{k}", 1, False, "a") for k in range(50)], schema), table, keys, buckets=4)
    layouts.write_bucketed(spark.createDataFrame([("o", "p1", 3, False, "c"), ("o", "p1", 2, False, "b"), ("o", "p2", 2, True, None)], schema), table, keys, buckets=4)
    try:
        view = pages.current_view(spark.table(table), keys)
        want = sorted([("o", f"p{k}", 1, False, "a") for k in range(50) if k not in (1, 2)] + [("o", "p1", 3, False, "c")], key=repr)
        assert rows(view) == want
        assert "Exchange" not in view._jdf.queryExecution().executedPlan().toString()
        assert spark.table(table).count() == 53
        layouts.compact(spark, table, keys, buckets=4)
        assert spark.table(table).count() == 50 and spark.table(table).where("page_id = 'p2'").first().is_deleted
        again = pages.current_view(spark.table(table), keys)
        assert rows(again) == want and "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
        layouts.write_bucketed(spark.createDataFrame([("o", "p2", 9, False, "back")], schema), table, keys, buckets=4)
        assert ("o", "p2", 9, False, "back") in rows(pages.current_view(spark.table(table), keys))
    finally:
        spark.sql(f"drop table if exists {table}")


def test_expired_months(spark, tmp_path):
    """Months that are gone are dropped, the one at the edge is rewritten, the files of others stay as they are."""
    start, path = dt.datetime(2024, 1, 1), str(tmp_path / "facts")
    data = [(k, start + dt.timedelta(days=k)) for k in range(150)] + [(900, None)]
    df = spark.createDataFrame(data, "id long, observed_at timestamp").withColumn("retention_month", F.trunc("observed_at", "month"))
    fetches.write_partitioned(df, path, ["id"])
    files = lambda month: sorted(os.listdir(f"{path}/retention_month={month}"))
    kept = files("2024-04-01")
    cut = F.lit(dt.datetime(2024, 3, 10))
    done = fetches.expire_partitions(spark, path, cut)
    assert {k: v for k, v in done.items() if not k.startswith("__")} == {"2024-01-01": "dropped", "2024-02-01": "dropped", "2024-03-01": "rewritten", "2024-04-01": "kept", "2024-05-01": "kept"}
    assert files("2024-04-01") == kept and not os.path.exists(f"{path}/retention_month=2024-01-01")
    want = [k for k, at in data if at and at > dt.datetime(2024, 3, 10)]
    assert [r.id for r in spark.read.parquet(path).orderBy("id").collect()] == want
    assert set(fetches.expire_partitions(spark, path, cut).values()) == {"kept"}
    assert not [x for x in os.listdir(path) if x.startswith(".expire")]


def test_trailing_data_is_quarantined(spark):
    """A payload with more after it, or there twice, is no JSON document."""
    from tests.test_facts_and_streams import payload, staged

    good = staged(spark, payload("p", "INFO"))
    text = good.first().payload
    for odd in (text + " {}", text + text, text + ",", text + "," + text, text + " x", "[" + text + "]", ""):
        bad = good.withColumn("payload", F.lit(odd))
        assert fetches.decode_payloads(bad).first().problem == "INVALID_JSON", odd[-20:]
    assert fetches.decode_payloads(good).first().problem is None
    assert fetches.decode_payloads(good.withColumn("payload", F.concat(F.lit(" \n"), "payload", F.lit("\n ")))).first().problem is None
