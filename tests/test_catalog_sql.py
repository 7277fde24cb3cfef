"""The queries over scalar functions and page signals against their SQL in DuckDB, value by value."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL
from webstrata.plans import catalog, scalars, signals

duckdb = pytest.importorskip("duckdb")
#: Of other modules, those whose SQL says what sequential or parsed results must be.
OTHERS = (
    "o001_read_fetches o006_write_partitioned o007_manifest o008_normalize_url o023_page_findings o024_uuid5 o034_semantic_role o051_page_links o053_rendered_metadata o059_filter_pages o069_crawl_depths o098_clone_plan o099_shard_plan "
    "o100_sample_progress o106_clone_targets o108_css_alias_closure o111_project_scan_events o113_project_clone_events o117_page_facts o118_select_design_pages "
    "o002_decode_payloads o068_expand_frontier o079_outcome_latency o081_execution_counts o090_load_report o101_page_keyset_ranges o111_project_scan_events_stream o115_expire_partitions o119_plan_site_archive"
).split()
NAMES = sorted({n for n in catalog.oracle_sql() if hasattr(scalars, n) or hasattr(signals, n)} | set(OTHERS))


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "events", "documents", "lineitem", "conversations"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    rows = [dict(zip((c[0] for c in want.description), r, strict=True)) for r in want.fetchall()]
    got = catalog.queries()[name](spark, SMALL)
    assert sorted(got.columns) == columns and rows
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[c] for c in columns]) for r in rows)
