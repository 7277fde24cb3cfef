"""Link edges and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.operators import order
from webstrata.sources.tables import written


def link_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("owner_id", "scan_id", "source_page_id").agg(F.count_if("is_internal").alias("internal_links"), F.count_if(~F.col("is_internal")).alias("external_links"))


def link_report(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges with the page that they lead to, where the scan has it; pages are few per hash, edges many."""
    target = pages.select("owner_id", "scan_id", F.col("url_hash").alias("target_hash"), F.col("page_id").alias("target_page_id"))
    return edges.join(target, ["owner_id", "scan_id", "target_hash"], "left")


def inlink_counts(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges per target page: summed up per hash before the join, as a home page is everyone's target."""
    counts = edges.groupBy("owner_id", "scan_id", "target_hash").agg(F.count(F.lit(1)).alias("inlinks"))
    target = pages.select("owner_id", "scan_id", F.col("url_hash").alias("target_hash"), "page_id")
    return target.join(counts, ["owner_id", "scan_id", "target_hash"], "left").select("owner_id", "scan_id", "page_id", F.coalesce("inlinks", F.lit(0)).alias("inlinks"))


def pagerank_input(edges: DataFrame) -> DataFrame:
    return edges.where("is_internal").select("owner_id", "scan_id", "source_page_id", "target_hash", "is_followable")


def expand_frontier(pages: DataFrame, links: DataFrame, known: DataFrame, limits: DataFrame) -> DataFrame:
    """The next round of a crawl: (scan_id, url, depth, parent_page_id, ordinal).

    pages: scan_id, page_id, depth, of the round that was just fetched. links: scan_id,
    source_page_id, target_url (normalised), is_internal, is_followable, ordinal. known:
    scan_id, url, all so far. limits: scan_id, max_pages, max_depth. A URL's parent is
    its first discoverer in the order of source and ordinal; the cap keeps the first
    in the order of URLs. Links repeat on every page of a site, so they are reduced to
    one a URL before anything is sorted.
    """
    source = pages.select("scan_id", F.col("page_id").alias("source_page_id"), "depth")
    found = links.where("is_internal and is_followable").join(source, ["scan_id", "source_page_id"]).join(limits, "scan_id")
    found = found.where("depth < max_depth")
    first = found.groupBy("scan_id", F.col("target_url").alias("url")).agg(
        F.min(F.struct("source_page_id", "ordinal")).alias("first"), F.min(F.col("depth") + 1).alias("depth"), F.first("max_pages").alias("max_pages")
    )
    new = first.join(known.select("scan_id", "url"), ["scan_id", "url"], "left_anti")
    have = known.groupBy("scan_id").agg(F.count(F.lit(1)).alias("have"))
    new = new.join(have, "scan_id", "left")
    room = F.col("max_pages") - F.coalesce("have", F.lit(0))
    kept = order.first_of_each(new, ["scan_id"], ["url"], room)
    return kept.select("scan_id", "url", "depth", F.col("first.source_page_id").alias("parent_page_id"), F.col("rank").alias("ordinal"))


def crawl_depths(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(scan_id, node, depth, parent): breadth-first search over a finished graph, at most ``max_depth`` rounds.

    edges: scan_id, source, target, ordinal. Each round joins the last ring only and is
    written to the shared folder.
    """
    reached = seeds.select("scan_id", "node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")).distinct()
    reached = written(reached)
    ring = reached
    for depth in range(1, max_depth + 1):
        near = ring.select("scan_id", F.col("node").alias("source")).join(edges, ["scan_id", "source"])
        near = near.groupBy("scan_id", F.col("target").alias("node")).agg(F.min(F.struct("source", "ordinal")).alias("first"))
        near = near.join(reached.select("scan_id", "node"), ["scan_id", "node"], "left_anti")
        ring = written(near.select("scan_id", "node", F.lit(depth).alias("depth"), F.col("first.source").alias("parent")))
        if ring.limit(1).count() == 0:
            break
        reached = reached.unionByName(ring)
    return reached


def frontier_invariants(pages: DataFrame) -> DataFrame:
    return pages.groupBy("scan_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("url").alias("distinct_urls"), F.max("depth").alias("max_depth"))
